"""What a fetch means, whose site a page is, and which address is a lead's own site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions import text, urls


def fetch_error(status: Column, content_type: Column) -> Column:
    """struct(code, retryable) of an answer; code is null if it is a page."""
    code = (
        F.when(status.isin(401, 403, 429, 503), "blocked").when(status >= 500, "http_server_error").when(status >= 400, "http_client_error")
        .when(~F.lower(F.coalesce(content_type, F.lit(""))).rlike("html|xml|text/plain"), "non_html")
    )
    return F.struct(code.alias("code"), (status.isin(429, 503) | (status >= 500)).alias("retryable"))


def exception_error(kind: Column, message: Column) -> Column:
    """struct(code, retryable) of a fetch that gave no answer: kind is timeout, redirects, connect, protocol, http or other."""
    low = F.lower(F.coalesce(message, F.lit("")))
    code = (
        F.when(kind == "timeout", "timeout").when(kind == "redirects", "redirect_loop").when((kind == "connect") & low.rlike("certificate|ssl|tls"), "ssl_error")
        .when((kind == "connect") & low.rlike("name or service not known|getaddrinfo|nodename|no address"), "dns_failure").when(kind == "connect", "connection_error")
        .when(kind == "protocol", "protocol_error").when(kind == "http", "http_error").otherwise("fetch_failed")
    )
    return F.struct(code.alias("code"), code.isin("timeout", "connection_error", "protocol_error", "http_error").alias("retryable"))


def sitemap_found(robots: Column, probe: Column) -> Column:
    """Whether there is a sitemap: one that the first 200 lines of robots.txt name, else an answer at /sitemap.xml that looks like markup."""
    start = F.array_join(F.slice(F.split(F.coalesce(robots, F.lit("")), "\n"), 1, 200), "\n")
    return sitemap_of(start).isNotNull() | F.coalesce(F.contains(F.substring(probe, 1, 2000), F.lit("<")), F.lit(False))


def goes_on_to_guesses(raw: Column) -> Column:
    """Whether candidates are tried: only where the cell holds no address that can be read."""
    return urls.normalize_url(raw).isNull()


def sitemap_of(robots: Column) -> Column:
    """The first sitemap that a robots.txt names; null if none."""
    return F.nullif(F.regexp_extract(robots, r"(?im)^\s*sitemap:\s*(\S+)", 1), F.lit(""))


def identity(
    name: Column, domain: Column, title: Column, body: Column, phone: Column, postal: Column, city: Column,
    address: Column | None = None, category: Column | None = None,
) -> Column:
    """How sure a page is the named business's, 0 to 1 in thousandths: evidence adds up and is capped at 1."""
    low = lambda c: F.lower(F.coalesce(c, F.lit(""))) if c is not None else F.lit("")
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    read = F.struct(
        urls.distinctive_tokens(name).alias("words"), F.regexp_replace(F.substring_index(domain, ".", 1), "[^a-z0-9]", "").alias("core"), low(title).alias("title"), low(body).alias("body"),
        F.right(digits(F.coalesce(phone, F.lit(""))), F.lit(9)).alias("tail"), F.replace(F.trim(low(postal)), F.lit(" "), F.lit("")).alias("postal"), F.length(F.trim(low(postal))).alias("postal_size"),
        low(city).alias("city"), F.slice(F.filter(F.split(F.regexp_replace(low(address), "[^a-z0-9 ]", " "), r"\s+"), lambda w: F.length(w) > 3), 1, 4).alias("street"),
        F.filter(F.split(low(category), "[^a-z]+"), lambda w: F.length(w) > 3).alias("kinds"),
    )

    def judged(p: Column) -> Column:
        words, core, t, b = p["words"], p["core"], p["title"], p["body"]
        n = F.size(words)
        share = lambda where: F.size(F.filter(words, lambda w: F.contains(where, w))) / F.greatest(n, F.lit(1))
        hits = F.size(F.filter(words, lambda w: (F.length(w) >= 4) & F.contains(core, w)))
        full, initials = F.array_join(words, ""), F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
        in_domain = (
            F.when((full != "") & F.contains(core, full), 0.45).when((core != "") & (hits > 0), 0.34 * hits / F.greatest(n, F.lit(1)))
            .when((n >= 3) & (core != "") & F.contains(core, initials), 0.16).otherwise(0.0)
        )
        in_title = F.when((n > 0) & (share(t) >= 0.6), 0.22).when((n > 0) & (share(t) > 0), 0.1).otherwise(0.0)
        in_body = F.when((n > 0) & (b != "") & (share(b) >= 1), 0.14).when((n > 0) & (share(b) > 0), 0.07).otherwise(0.0)
        called = F.when((F.length(p["tail"]) >= 7) & F.contains(digits(b), p["tail"]), 0.28).otherwise(0.0)
        at = F.when((p["postal_size"] >= 4) & F.contains(F.replace(b, F.lit(" "), F.lit("")), p["postal"]), 0.12).otherwise(0.0)
        in_city = F.when((F.length(p["city"]) > 2) & F.contains(b, p["city"]), 0.08).otherwise(0.0)
        streets = F.size(F.filter(p["street"], lambda w: F.contains(b, w)))
        on_street = F.when((F.size(p["street"]) > 0) & (streets >= F.greatest(F.lit(2), F.size(p["street"]) - 1)), 0.1).otherwise(0.0)
        of_kind = F.when(F.exists(p["kinds"], lambda w: F.contains(b, w)), 0.05).otherwise(0.0)
        return F.round(F.least(F.lit(1.0), in_domain + in_title + in_body + called + at + in_city + on_street + of_kind), 3)

    return text.let(read, judged)


def verdict(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "strong_match").when(confidence >= 0.55, "probable_match").when(confidence >= 0.3, "weak_match").otherwise("no_match")


def direct(raw: Column, final_url: Column, error: Column) -> Column:
    """struct(status, confidence, verdict) of an address that the user names: it is the site, so only what became of it counts."""
    status = website_status(raw, final_url, error, F.lit(1.0))
    ok = status.isin("valid", "redirected")
    return F.struct(status.alias("status"), F.when(ok, 1.0).alias("confidence"), F.when(ok, "explicit_url").alias("verdict"))


def parked(title: Column, body: Column) -> Column:
    """The notes on a page that is parked or unfinished, in the order of lexicons.PARKED.

    Wordings are looked for in the title and the first 4000 characters of the text; a page without any whose text
    has under 200 characters is noted as almost empty. Null counts as empty.
    """
    text = F.coalesce(body, F.lit(""))
    low = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(text, 1, 4000)))
    notes = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in lx.PARKED.items()]))
    short = F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) < 200
    return F.when((F.size(notes) == 0) & short, F.array(F.lit(lx.EMPTY_PAGE))).otherwise(notes)


def website_status(raw: Column, final_url: Column, error: Column, confidence: Column) -> Column:
    """What became of the address that a lead came with."""
    asked = urls.normalize_url(raw)
    return (
        F.when(asked.isNull(), "not_found")
        .when(urls.profile_kind(asked).isNotNull(), "not_a_website")
        .when(error == "blocked", "blocked")
        .when(error.isNotNull(), "unavailable")
        .when(urls.profile_kind(final_url).isNotNull(), "not_a_website")
        .when(confidence < 0.2, "mismatch")
        .when(~urls.same_site(asked, final_url), "redirected")
        .otherwise("valid")
    )


def best_candidate(candidates: DataFrame, key: str, least: float = 0.55, sure: float = 0.85) -> DataFrame:
    """The accepted candidate of each key (url, pos, confidence): the best up to the first that is sure, if it is least or more.

    A key has a few candidates only (see urls.candidate_domains).
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tried = candidates.withColumn("_sure", F.coalesce(F.max(F.col("confidence") >= sure).over(w), F.lit(False))).filter("not _sure")
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.col("confidence").desc(), "pos"))
    return tried.withColumn("_n", best).filter((F.col("_n") == 1) & (F.col("confidence") >= least)).drop("_n", "_sure")


def page_speed(payload: Column) -> Column:
    """struct(score, lcp, fcp, tbt, cls, speed_index, opportunities, field_category) of a measurement's JSON; null where it does not say.

    opportunities are the six largest savings of 250 ms and more: id, title, savings_ms.
    """
    at = lambda p: F.get_json_object(payload, f"$.lighthouseResult.{p}").cast("double")
    audit = lambda a: at(f"audits.{a}.numericValue")
    kind = "map<string,struct<title:string,details:struct<type:string,overallSavingsMs:double>>>"
    audits = F.map_entries(F.from_json(F.get_json_object(payload, "$.lighthouseResult.audits"), kind))
    worth = F.filter(audits, lambda e: (e["value"]["details"]["type"] == "opportunity") & (e["value"]["details"]["overallSavingsMs"] >= 250))
    saved = F.transform(worth, lambda e: F.struct((-F.bround(e["value"]["details"]["overallSavingsMs"])).cast("int").alias("n"), e["key"].alias("id"), e["value"]["title"].alias("title")))
    return F.struct(
        F.bround(100 * at("categories.performance.score")).cast("int").alias("score"),
        F.bround(audit("largest-contentful-paint") / 1000, 2).alias("lcp"),
        F.bround(audit("first-contentful-paint") / 1000, 2).alias("fcp"),
        F.bround(audit("total-blocking-time")).alias("tbt"),
        F.bround(audit("cumulative-layout-shift"), 3).alias("cls"),
        F.bround(audit("speed-index") / 1000, 2).alias("speed_index"),
        F.transform(F.slice(F.array_sort(saved), 1, 6), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), (-x["n"]).alias("savings_ms"))).alias("opportunities"),
        F.get_json_object(payload, "$.loadingExperience.overall_category").alias("field_category"),
    )


def report_name(job: Column, lead: Column, name: Column) -> Column:
    return F.format_string("job_%d/%06d-%s.html", job, lead, text.slug(name))
