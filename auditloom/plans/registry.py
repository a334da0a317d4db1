"""The registered queries: each applies operators to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions import phones, text, urls
from auditloom.operators import contacts, discovery, domains, frontier, ingest, leads, pages, reports, rules, scoring, signals
from auditloom.plans import fixture
from auditloom.sources.store import Store
from auditloom.sources.tables import checkpointed, replace_by_key, shared_folder, table
from auditloom.streaming import events as feed

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _audits(spark: SparkSession, sf: str) -> DataFrame:
    """The audits of all sites, over all their pages."""
    sites = table(spark, sf, "pages").withColumn("site", urls.site_key(F.col("url")))
    return rules.audit(rules.page_facts(sites))


def _made_up(spark: SparkSession, sf: str) -> DataFrame:
    return rules.audit(rules.page_facts(fixture.sites(spark, sf), fixture.meta(spark, sf)))


@query
def url_normalize(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(u).alias("normal"), urls.site_key(u).alias("site"))


@query
def url_key_dedup(spark, sf):
    return table(spark, sf, "pages").groupBy(urls.url_key(urls.normalize_url(F.col("url"))).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query
def registrable_domains(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").groupBy(urls.registrable_domain(u).alias("domain")).agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(urls.host(u)).alias("hosts"))


@query
def public_suffixes(spark, sf):
    """The domains of the hosts of all pages and of hosts made up from the customers, by rules of every kind."""
    rules_ = domains.known_rules(spark).union(spark.createDataFrame([("test",), ("*.region.test",), ("!city.region.test",), ("a.b.region.test",), ("*.ck",), ("!www.ck",)], "rule string"))
    return domains.suffixes(table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host")).union(fixture.hosts(spark, sf)), rules_)


@query
def page_domains(spark, sf):
    """The domain of every page by suffix rules."""
    return domains.with_domains(table(spark, sf, "pages").select("page_id", "url"), domains.known_rules(spark)).select("page_id", "domain")


@query
def jsonld_emails(spark, sf):
    """Addresses in structured data at depths 1 to 6, in arrays, with escapes and in keys of any case."""
    found = pages.parse(fixture.structured(spark, sf), fields=("jsonld_emails",))
    return found.select("page_id", F.posexplode("jsonld_emails").alias("place", "email"))


@query
def page_links(spark, sf):
    rows = frontier.links(pages.parse(table(spark, sf, "pages"), fields=("links",)))
    return rows.select("page_id", "pos", "href", "target", urls.classify_page(F.col("target"), F.col("text")).alias("page_type"))


@query
def page_head_facts(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", pages.title(h).alias("title"), pages.language(h).alias("lang"), F.size(pages.headings(h, 1)).alias("h1"), F.size(pages.hrefs(h)).alias("links")
    )


@query
def page_text_stats(spark, sf):
    t = table(spark, sf, "pages").select("page_id", pages.visible_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("chars"), F.regexp_count("t", F.lit("[^ ]+")).alias("words"), F.md5("t").alias("digest"))


@query
def page_parse_full(spark, sf):
    asked = ("title", "lang", "h1", "links", "words", "images", "empty_links", "blocking", "has_nav", "has_main", "text")
    p = pages.parse(table(spark, sf, "pages"), fields=asked)
    return p.select("page_id", "title", "lang", F.size("h1").alias("h1"), F.size("links").alias("links"), "words", "images", "empty_links", "blocking", "has_nav", "has_main", F.md5("text").alias("digest"))


@query
def duplicate_titles(spark, sf):
    p = table(spark, sf, "pages").select(urls.site_key(F.col("url")).alias("site"), F.lower(pages.title(F.col("html"))).alias("title"))
    return p.filter("title <> ''").groupBy("site", "title").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _graph(spark, sf):
    sites = table(spark, sf, "pages").withColumn("site", urls.site_key(F.col("url")))
    return frontier.edges(frontier.links(pages.parse(sites, fields=("links",))))


@query
def frontier_plan(spark, sf):
    return frontier.frontier(_graph(spark, sf)).select("site", "key", "type", "depth", "rank")


@query
def frontier_depths(spark, sf):
    """The same crawl to several depths, over the edges of one parse."""
    graph = checkpointed(_graph(spark, sf))
    out = [frontier.frontier(graph, max_depth=d).select(F.lit(d).alias("max_depth"), "site", "key", "type", "depth", "rank") for d in (1, 3, 5)]
    return out[0].union(out[1]).union(out[2])


@query
def crawl_outcome(spark, sf):
    """A crawl in which some fetches fail and time runs out: whether and how long a page takes follows from its key's length."""
    graph = checkpointed(_graph(spark, sf))
    n = F.length("key")
    keys = graph.select("key").union(graph.select("page_key")).distinct()
    out = frontier.crawl(graph, keys.select("key", (n % 7 != 3).alias("ok"), (n * 1237 % 9000 + 500).alias("ms")), max_depth=4, budget_ms=20_000)
    return out.select("site", F.array_join(F.transform("taken", lambda x: x["key"]), " ").alias("taken"), F.col("failed").cast("long").alias("failed"), "ms", "exhausted")


@query
def link_check_sample(spark, sf):
    """The links to check, where every page of the table counts as crawled."""
    sites = table(spark, sf, "pages").select(urls.site_key(F.col("url")).alias("site"), urls.url_key(urls.normalize_url(F.col("url"))).alias("key"))
    return frontier.link_sample(_graph(spark, sf), sites).select("site", "key", "page_id", "pos", "n")


def findings_all(audits):
    return rules.findings(audits).select("site", "seq", "code", F.col("check").alias("check_name"), "severity", "deduction")


def findings_by_code(audits):
    return rules.findings(audits).groupBy(F.col("check").alias("check_name"), "code").agg(F.count(F.lit(1)).alias("sites"), F.sum("deduction").alias("points"))


def lead_tiers(audits):
    """Tiers of leads whose site was reached and for which no contact is usable; a site without problems has zeros."""
    p = scoring.top_problems(audits).groupBy("site").agg(F.count(F.lit(1)).alias("problems"), F.count_if("strong").alias("strong"))
    c, no, zero = F.col, F.lit(False), F.lit(0).cast("long")
    rows = scoring.opportunity(audits).join(p, "site", "left").select("site", "score", F.coalesce("problems", zero).alias("problems"), F.coalesce("strong", zero).alias("strong"))
    return rows.select(
        "*", scoring.clear_opportunity(c("score"), c("problems"), c("strong")).alias("clear"),
        scoring.lead_tier(c("score"), no, c("strong"), c("problems"), F.lit(True), no, F.lit(None).cast("boolean")).alias("tier"),
    )


#: Queries over audits: of the sites in pages, and as made_up_... of sites for which every rule is in reach.
_AUDIT = {
    "findings_all": findings_all,
    "findings_by_code": findings_by_code,
    "opportunity_score": scoring.opportunity,
    "score_explanation": scoring.explanation,
    "top_problems": lambda a: scoring.top_problems(a).drop("evidence"),
    "top_priorities": lambda a: scoring.top_priorities(a).drop("evidence", "severity"),
    "premium_scorecard": scoring.scorecard,
    "check_results": scoring.check_results,
    "check_status_counts": lambda a: scoring.check_results(a).groupBy("site", "status").agg(F.count(F.lit(1)).alias("n")),
    "severity_counts": scoring.severity_counts,
    "executive_summary": scoring.executive_summary,
    "lead_tiers": lead_tiers,
    "export_issue_columns": lambda a: scoring.issue_columns(a),
    "findings_context": scoring.findings_context,
    "category_shares": scoring.shares,
    "report_grades": lambda a: scoring.scorecard(a).select("site", "category", scoring.grade(F.col("score")).alias("grade")),
    "observations": lambda a: reports.observations(scoring.top_problems(a)).drop("line"),
    "recommended_codes": lambda a: scoring.recommendations(scoring.top_problems(a)).select("site", "rank", "problem_code", "category", "severity"),
}


#: Sizes of pages are not told by the number that a made-up site follows from.
_SIZES = ("Page HTML size", "HTML size")


@query
def made_up_signal_panels(spark, sf):
    """All signals of the made-up sites, with their values, but the sizes of pages."""
    found = signals.panels(rules.page_facts(fixture.sites(spark, sf), fixture.meta(spark, sf)))
    return found.filter(~F.col("label").isin(*_SIZES)).drop("reason")


def _over(audits, f):
    return lambda spark, sf: f(audits(spark, sf))


QUERIES |= {prefix + name: _over(audits, f) for prefix, audits in (("", _audits), ("made_up_", _made_up)) for name, f in _AUDIT.items()}


#: The addresses of the tables are all at domains below example.com, which count as junk elsewhere.
_JUNK = [d for d in lx.JUNK_DOMAINS if not d.startswith("example.")]


@query
def email_scan(spark, sf):
    return contacts.scan_emails(table(spark, sf, "documents"), _JUNK)


@query
def email_rank(spark, sf):
    return contacts.rank_emails(contacts.scan_emails(table(spark, sf, "documents"), _JUNK)).select("doc_id", "email", "rank")


@query
def phone_scan(spark, sf):
    return contacts.scan_phones(table(spark, sf, "documents")).select("doc_id", "raw", "e164", "national", "status")


def _site_emails(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.site_emails(pages.parse(fixture.sites(spark, sf), fields=("mailto", "text", "header", "footer", "jsonld_emails")))


@query
def made_up_emails(spark, sf):
    return _site_emails(spark, sf)


@query
def made_up_validation(spark, sf):
    found = contacts.validate(_site_emails(spark, sf), fixture.dns(spark, sf))
    return found.select("site", "email", "status", "valid_confidence", "usable")


@query
def made_up_contacts(spark, sf):
    c = contacts.site_contacts(pages.parse(fixture.sites(spark, sf), fields=("tel", "whatsapp", "social", "forms", "names")))
    return c.select("site", *[F.array_join(k, "|").alias(k) for k in c.columns if k != "site"])


@query
def candidate_domains(spark, sf):
    found = urls.candidate_domains(F.col("c_name"), F.lit("US"))
    return table(spark, sf, "customer").select("c_custkey", F.posexplode(found).alias("at", "url")).select("c_custkey", "url", (F.col("at") + 1).alias("pos"))


@query
def dedup_keep_first(spark, sf):
    return leads.keep_first(table(spark, sf, "pages").select("page_id", "url"), urls.site_key(F.col("url")), "page_id").select("page_id", "duplicate_of")


@query
def lead_search(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal >= 0")
    return leads.search(c, "00001", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_acctbal")


@query
def lead_page(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return leads.page(c, [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], number=2)


@query
def lead_status_join(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_orderstatus")


def _with(spark, sf, yes):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return leads.having(table(spark, sf, "customer").select("c_custkey"), o, F.col("c_custkey") == F.col("o_custkey"), yes)


@query
def lead_with_items(spark, sf):
    return _with(spark, sf, True)


@query
def lead_without_items(spark, sf):
    return _with(spark, sf, False)


@query
def errors_left_join(spark, sf):
    e = feed.newest(table(spark, sf, "events").filter("event_type = 'error'"), 1000)
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return e.join(c, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "user_id", F.coalesce("c_name", F.lit("")).alias("name"))


@query
def lead_children(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderkey")
    return leads.children(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "o_totalprice", "o_orderkey", 3)


@query
def stats_dimensions(spark, sf):
    return leads.statistics(table(spark, sf, "orders"), {"o_orderstatus": "unprocessed", "o_orderpriority": "unscored"})


@query
def score_averages(spark, sf):
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    return table(spark, sf, "customer").agg(
        F.count(F.lit(1)).alias("leads"), F.count_if(F.col("c_acctbal") >= 7500).alias("high"), F.count_distinct("c_nationkey").alias("nations"),
        F.floor(F.sum(cents) / F.count(F.lit(1))).alias("mean_cents"),
    )


@query
def error_users_top12(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.orderBy(F.col("n").desc(), "user_id").limit(12)


@query
def job_progress(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("job"), "o_orderstatus")
    return leads.progress(items, "job", F.col("o_orderstatus"), ["F"], ["P"])


@query
def export_formula_guard(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.formula_guard(F.col("text")).alias("cell"))


@query
def retention_trim(spark, sf):
    return feed.newest(table(spark, sf, "events").select("event_id", "event_type"), 5000)


@query
def fan_out(spark, sf):
    return feed.fan_out(table(spark, sf, "events"), "user_id", 5).select("user_id", "event_id")


@query
def job_transitions(spark, sf):
    return feed.transitions(table(spark, sf, "events"), "user_id", "event_type")


@query
def progress_windows(spark, sf):
    return feed.per_window(table(spark, sf, "events"))


@query
def channel_choice(spark, sf):
    k = F.col("c_custkey")
    status = F.when(k % 7 == 0, "confirmed_on_website").otherwise("unlikely")
    return table(spark, sf, "customer").select(k, contacts.choose_channel(status, k % 3 == 0, k % 5 == 0, F.when(k % 2 == 0, "valid").otherwise("invalid")).alias("channel"))


@query
def made_up_issue_texts(spark, sf):
    """Scores, problems and top issues of the made-up sites as an export words them."""
    c = reports.audit_columns(_made_up(spark, sf))
    return c.select("site", "website_score", "opportunity_tier", "problems", *[f"top_issue_{i}{k}" for i in range(1, 6) for k in ("", "_category", "_severity")])


@query
def made_up_report_pages(spark, sf):
    """The HTML reports of the made-up sites, by what can be told of them without their wording."""
    r = reports.reports(_made_up(spark, sf))
    count = lambda what: F.regexp_count("text", F.lit(what))
    return r.select("site", "name", count("<tr>").alias("rows"), F.regexp_extract("text", "<p>([0-9]+)/100", 1).cast("int").alias("overall"), count(": pass</li>").alias("passed"), count("<script").alias("scripts"))


@query
def lead_export(spark, sf):
    """All columns of an export; an original column has the name of an added one."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k, k.alias("row_index"), "c_name", "c_nationkey", F.concat(F.lit("="), "c_mktsegment").alias("lead_tier"), "c_acctbal")
    known = {
        "website_score": F.when(k % 3 > 0, k % 100), "lead_tier": F.when(k % 3 > 0, F.lit("B")), "contact_channel": F.when(k % 4 == 0, "whatsapp").when(k % 4 == 1, "call"),
        "website_identity_confidence": F.round(k % 7 / F.lit(7.0), 3), "audit_status": F.when(k % 3 > 0, "completed"), "phone_raw_original": F.col("c_name"),
    }
    out = reports.export(rows, ["c_name", "c_nationkey", "lead_tier"], known)
    return out.select([text.formula_guard(F.col(c)).alias(c) if c != "row_index" else F.col(c) for c in out.columns])


@query
def lead_orders(spark, sf):
    """The first page of each order of a list of leads."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")).alias("score"), F.col("c_name").alias("name"), (F.col("c_custkey") * 7919 % 1000).alias("processed_at"))
    columns = {"score": "score", "name": "name", "processed_at": "processed_at", "row_index": "c_custkey"}
    out = None
    for name in leads.ORDERS:
        rows = leads.page(c, leads.ordered(name, columns, "c_custkey"), size=20).select(F.lit(name).alias("ordering"), "c_custkey")
        out = rows if out is None else out.union(rows)
    return out


@query
def lead_counts(spark, sf):
    """How many leads there are before a page is taken, and the page."""
    c = table(spark, sf, "customer").filter("c_acctbal >= 0").select("c_custkey", "c_acctbal")
    return leads.counted_page(c, [F.col("c_acctbal").desc(), F.col("c_custkey")], 2, 25)


@query
def lead_detail(spark, sf):
    """One lead with its orders."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    d = leads.detail(7, "c_custkey", table(spark, sf, "customer").select("c_custkey", "c_name"), orders=o)
    return d.select("c_custkey", "c_name", F.array_join(F.transform("orders", lambda x: F.concat_ws("/", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("orders"))


@query
def cascade_delete(spark, sf):
    """What is left of two tables once the leads of a segment and their orders go."""
    c, o = table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    left, orders = leads.cascade_delete(c.filter("c_mktsegment = 'BUILDING'"), "c_custkey", c, o)
    return left.select(F.lit("customer").alias("of"), F.col("c_custkey").alias("id")).union(orders.select(F.lit("orders"), "o_orderkey"))


@query
def job_list(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("job"), "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    return leads.jobs(o, "job", F.col("o_orderstatus"), F.col("at"), F.col("at"), ["F"], ["P"])


@query
def order_shares(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return leads.reranked(o, "o_custkey", [F.col("cents").desc(), F.col("o_orderkey")], "cents")


@query
def drafts_sent(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("lead"), F.lit(False).alias("sent_manually"))
    return leads.mark_sent(d, table(spark, sf, "customer").filter("c_custkey % 4 = 1").select(F.col("c_custkey").alias("lead")), ["lead"])


@query
def events_since(spark, sf):
    return feed.since(table(spark, sf, "events").select("event_id", "event_type"), 1000, 100)


@query
def events_merged(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return feed.merged(e.filter("event_id % 3 <> 0"), e.filter("event_id % 2 = 0").withColumn("event_type", F.lit("client")), 500)


@query
def formatted_values(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k, text.fmt_bytes(k * k * k).alias("bytes"), text.fmt_duration(k * 7).alias("duration"), text.fmt_time(F.timestamp_seconds(k * 86_461)).alias("time"), text.slug(F.col("c_name")).alias("slug"))


@query
def whatsapp_status(spark, sf):
    k = F.col("c_custkey")
    e164 = F.when(k % 7 > 0, F.concat(F.lit("+1555"), k.cast("string")))
    status = F.when(k % 11 == 3, "invalid").when(k % 2 == 0, "valid").otherwise("possible")
    line = F.element_at(F.array(*[F.lit(x) for x in ("mobile", "fixed_line", "voip", "voicemail")]), (k % 4).cast("int") + 1)
    on_site = F.when(k % 5 == 0, F.array(F.concat(F.lit("1555"), k.cast("string"))))
    return table(spark, sf, "customer").select(k, contacts.whatsapp(F.when(k % 13 > 0, F.lit("x")), status, e164, on_site, line).alias("status"))


@query
def identity_scores(spark, sf):
    k, name = F.col("c_custkey"), F.concat(F.lit("Blue "), F.col("c_name"), F.lit(" Ltd"))
    number = F.right("c_name", F.lit(9))
    domain = F.when(k % 4 == 0, F.concat(F.lit("bluecustomer"), number, F.lit(".com"))).when(k % 4 == 1, "customer-shop.com").when(k % 4 == 2, "bc0-works.com").otherwise("other.com")
    title = F.when(k % 3 == 0, F.concat(F.lit("Blue Customer "), number)).when(k % 3 == 1, "Customer page").otherwise("none")
    body = F.concat(
        F.lit("all of "), F.when(k % 5 == 0, F.concat(F.lit("blue customer "), number)).when(k % 5 == 1, "blue sky").otherwise("words"), F.when(k % 2 == 0, " tel 0113 496 0000").otherwise(""),
        F.when(k % 6 == 0, " LS1 4AP leeds").otherwise(""), F.when(k % 7 == 0, " high street near park").otherwise(""), F.when(k % 11 == 0, " plumbing").otherwise(""),
    )
    score = discovery.identity(name, domain, title, body, F.lit("+44 113 496 0000"), F.lit("ls14ap"), F.lit("Leeds"), F.lit("5 High Street, Park"), F.lit("Plumbing help"))
    return table(spark, sf, "customer").select(k, score.alias("confidence")).withColumn("verdict", discovery.verdict(F.col("confidence")))


@query
def evidence_lists(spark, sf):
    """Evidence with lists, nested values, truths and nothing, as a report shows it; what there is follows from the customer's number."""
    k = table(spark, sf, "customer").select("c_custkey", F.parse_json(fixture.evidence(F.col("c_custkey"))).alias("e"))
    rows = k.select("c_custkey", F.posexplode(reports.evidence_rows(F.col("e"))).alias("place", "r"))
    return rows.select("c_custkey", "place", F.col("r.k").alias("label"), F.col("r.v").alias("value"))


@query
def robots_decisions(spark, sf):
    """Which pages a crawler of its own name may fetch, by the robots texts of made-up sites."""
    r = fixture.robots(spark, sf)
    rules_ = frontier.robots_rules(r.select("site", "robots").distinct())
    return frontier.robots_allowed(r.select("site", "url"), rules_, "AuditBot").select("site", "url", "allowed")


@query
def phone_layouts(spark, sf):
    """Numbers in ten layouts, with the region that country, state or address tell."""
    p = fixture.phones(spark, sf).withColumn("home", phones.resolve_region(F.col("country"), F.col("state"), F.col("address")))
    p = p.withColumn("p", phones.normalize_phone(F.col("raw"), F.col("home")))
    return p.select(F.col("k").alias("c_custkey"), "home", "p.status", "p.e164", "p.national", "p.region", "p.line", "p.extension")


@query
def lead_keys(spark, sf):
    """What makes leads one, and the first lead of each."""
    rows = fixture.leads(spark, sf).withColumn("key", ingest.dedup_key(*[F.col(c) for c in ("website", "place_id", "business_name", "city", "phone")]))
    first = rows.groupBy(F.col("key").alias("_key")).agg(F.min("k").alias("first"))
    return rows.join(first, F.col("key") == F.col("_key")).select(F.col("k").alias("c_custkey"), "key", "first")


@query
def website_decisions(spark, sf):
    """What became of the address of each lead, by made-up fetches, and of the addresses guessed for it the one that is taken."""
    k = F.col("k")
    rows = fixture.leads(spark, sf).withColumn("final", F.when(k % 3 == 0, "https://other.test/").otherwise(urls.normalize_url(F.col("website")))).withColumn("error", F.when(k % 7 == 1, "blocked").when(k % 7 == 2, "timeout"))
    rows = rows.select("k", discovery.website_status(F.col("website"), F.col("final"), F.col("error"), k % 10 / F.lit(10.0)).alias("status"))
    tried = rows.select("k", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("pos")).withColumn("confidence", (F.col("k") * F.col("pos") * 37 % 100) / F.lit(100.0))
    best = discovery.best_candidate(tried, "k").select(F.col("k").alias("_k"), F.col("pos").alias("taken"))
    return rows.join(best, k == F.col("_k"), "left").select(k.alias("c_custkey"), "status", "taken")


@query
def parked_pages(spark, sf):
    """The notes on all pages, and on placeholders made up from the customers, whose wordings the pages do not have."""
    p = pages.parse(table(spark, sf, "pages"), fields=("title", "text")).select(F.lit("page").alias("of"), F.col("page_id").alias("id"), "title", "text")
    rows = p.unionByName(fixture.placeholders(spark, sf))
    return rows.select("of", "id", F.array_join(discovery.parked(F.col("title"), F.col("text")), "|").alias("notes"))


@query
def industry_phrases(spark, sf):
    rows = table(spark, sf, "customer").select("c_mktsegment").distinct()
    more = spark.createDataFrame([("Plumber",), ("Bakery Services",), ("Hair Salon | Spa",), ("Coach",), ("Glass",), (None,)], "c_mktsegment string")
    return rows.union(more).select("c_mktsegment", reports.industry_phrase(F.col("c_mktsegment")).alias("phrase"))


@query
def job_newest(spark, sf):
    return leads.newest_jobs(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 500)


@query
def replace_by_key_write(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    new = c.select(F.col("c_custkey").alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("new").alias("o_orderstatus"))
    return replace_by_key(old, new, "o_custkey")


def _committed(spark, sf):
    """A store of leads and their drafts after three commits: drafts replaced, leads deleted with theirs, drafts regenerated by channel."""
    k, at = F.col("c_custkey"), F.col("o_orderkey")
    lead = table(spark, sf, "customer").select(k.alias("lead"), "c_name")
    draft = table(spark, sf, "orders").select(F.col("o_custkey").alias("lead"), at.alias("draft"), F.col("o_orderstatus").alias("channel"), (at % 5 == 0).alias("sent_manually"))
    place = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "lead", buckets=16)
    place.commit({"leads": lead, "drafts": draft})
    new = lead.filter("lead % 7 = 0").select("lead", (-F.col("lead")).alias("draft"), F.lit("O").alias("channel"), F.lit(False).alias("sent_manually"))
    place.commit({"leads": lead.filter("lead % 7 = 0").withColumn("c_name", F.lit("replaced")), "drafts": new})
    place.delete(lead.filter("lead % 11 = 3").select("lead"))
    old = place.read("drafts")
    again = old.filter("channel = 'P' AND lead % 2 = 0").select("lead", (F.col("draft") + 1_000_000_000).alias("draft"), "channel", F.lit(False).alias("sent_manually"))
    rows, keys = leads.regenerated(old, again)
    place.commit({"drafts": rows}, by=["lead", "channel"], keys=keys)
    place.vacuum(keep=1)
    return place


@query
def store_commits(spark, sf):
    place = _committed(spark, sf)
    one = place.read("leads").select(F.lit("lead").alias("of"), "lead", F.col("c_name").alias("value"), F.lit(None).cast("long").alias("draft"))
    return one.union(place.read("drafts").select(F.lit("draft"), "lead", "channel", F.col("draft").cast("long")))


@query
def uploads_to_remove(spark, sf):
    """Orders as jobs that share an upload for each hundred prices."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).cast("long").alias("upload"))
    return leads.uploads_to_remove(o, o.filter("o_orderkey % 3 <> 0").select("o_orderkey"), "o_orderkey", "upload")


QUERIES["replace_by_key"] = QUERIES.pop("replace_by_key_write")
