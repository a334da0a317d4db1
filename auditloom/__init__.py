"""auditloom: site-quality analytics over crawled pages, as Spark DataFrame operators."""
