"""Registrable domains by public suffix rules, which are a table: any list of rules can be given.

A rule is a suffix ("co.uk"), a suffix below which every label is one ("*.ck"), or an exception to that
("!www.ck"). Of the rules that a host ends with an exception counts, else the longest; a host that none speaks of
ends with a suffix of one label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions import urls


def known_rules(spark: SparkSession) -> DataFrame:
    """The rules (rule) for the suffixes that the library knows of itself."""
    return spark.createDataFrame([(s,) for s in lx.SUFFIXES], "rule string")


def suffixes(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (host, suffix, domain) for the distinct hosts of a table (host), by rules (rule).

    domain is the suffix and the label before it, or the host itself where it has no such label, is an
    address of numbers, or is empty. Each host is looked up by the ends that it has, a row for each label, so a rule
    meets the hosts below it only; rules may be many. Case, a last dot and white space of rules and hosts do not
    count, a null host is left out, and repeated rules are one.
    """
    r = F.lower(F.trim(F.col("rule")))
    kind = F.when(r.startswith("!"), "exception").when(r.startswith("*."), "below").otherwise("plain")
    known = rules.select(F.regexp_replace(r, r"^(!|\*[.])|[.]$", "").alias("end"), kind.alias("kind")).filter("end <> '' AND end <> '*'").distinct()
    named = hosts.select("host").filter("host IS NOT NULL").distinct().withColumn("name", F.regexp_replace(F.lower(F.trim("host")), "[.]$", ""))
    named = named.withColumn("labels", F.split("name", "[.]"))
    size = F.size("labels")
    ends = named.select("host", size.alias("n"), F.explode(F.sequence(F.lit(1), size)).alias("m"), "labels")
    ends = ends.select("host", "n", "m", F.array_join(F.slice("labels", F.col("n") - F.col("m") + 1, F.col("m")), ".").alias("_end"))
    length = F.when(F.col("kind") == "exception", F.col("m") - 1).when(F.col("kind") == "below", F.col("m") + 1).otherwise(F.col("m"))
    met = ends.join(known, F.col("_end") == F.col("end")).select("host", "n", (F.col("kind") == "exception").alias("exception"), length.alias("length")).filter("length <= n")
    best = met.groupBy(F.col("host").alias("_host")).agg(F.max(F.struct("exception", "length")).alias("best"))
    found = named.join(best, F.col("host") == F.col("_host"), "left").withColumn("k", F.coalesce("best.length", F.lit(1)))
    last = lambda k: F.array_join(F.slice("labels", F.greatest(size - k + 1, F.lit(1)), k), ".")
    alone = F.col("name").rlike(r"^[0-9.]*$") | (F.col("k") >= size)
    return found.select("host", F.when(F.col("name").rlike(r"^[0-9.]*$"), "").otherwise(last(F.col("k"))).alias("suffix"), F.when(alone, F.col("name")).otherwise(last(F.col("k") + 1)).alias("domain"))


def with_domains(rows: DataFrame, rules: DataFrame, url_col: str = "url", as_col: str = "domain") -> DataFrame:
    """rows with the registrable domain of a URL column; empty where it has no host. Each host is looked up once."""
    keyed = rows.withColumn("_own", urls.host(F.col(url_col)))
    found = suffixes(keyed.select(F.col("_own").alias("host")), rules).select(F.concat("host", F.lit("")).alias("_host"), F.col("domain").alias("_domain"))
    out = keyed.join(found, F.col("_own") == F.col("_host"), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != as_col], F.coalesce("_domain", F.lit("")).alias(as_col))
