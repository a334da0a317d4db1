"""What leaves the engine: the export of leads, reports of audits, and drafts of first messages, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions import text as t
from auditloom.operators import scoring

#: Columns that an export adds after the original ones, in this order (fixed values).
ENRICHMENT = [
    "website_status", "website_final", "website_identity_confidence", "website_source",
    "email_1", "email_1_source", "email_1_status", "email_2", "email_2_source", "email_2_status",
    "phone_raw_original", "phone_normalized", "phone_country", "phone_type", "phone_status",
    "whatsapp_status", "whatsapp_reason", "whatsapp_url", "linkedin_url", "linkedin_status",
    "website_score", "opportunity_tier", "lead_tier", "problems", "recommendations",
    "top_issue_1", "top_issue_1_category", "top_issue_1_severity", "top_issue_1_fix",
    "top_issue_2", "top_issue_2_category", "top_issue_2_severity", "top_issue_2_fix",
    "top_issue_3", "top_issue_3_category", "top_issue_3_severity", "top_issue_3_fix",
    "top_issue_4", "top_issue_4_category", "top_issue_4_severity", "top_issue_4_fix",
    "top_issue_5", "top_issue_5_category", "top_issue_5_severity", "top_issue_5_fix",
    "contact_channel", "contact_channel_reason", "whatsapp_message", "whatsapp_draft_url",
    "email_subject", "email_message", "email_draft_url", "linkedin_message", "call_notes",
    "audit_report_path", "audit_status", "audit_error", "processed_at",
]
#: How channels are named in an export (fixed values).
CHANNELS = {"whatsapp": "WHATSAPP", "email": "EMAIL", "linkedin": "LINKEDIN", "phone": "PHONE", "none": "SKIP", "": "SKIP", "website_contact": "WEBSITE_CONTACT"}


def _title(code: Column) -> Column:
    """A finding's code in words."""
    words = F.replace(F.regexp_replace(code, "^(security|a11y|onpage|offpage|perf|local)_", ""), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 200))


def _advice(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in lx.ADVICE.items() for x in (F.lit(k), F.lit(v))]), code), F.lit(""))


def _label(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in lx.CARD_LABELS.items() for x in (F.lit(k), F.lit(v))]), category), F.initcap(category))


def audit_columns(audits: DataFrame) -> DataFrame:
    """One row for each site: website_score, opportunity_tier, problems, recommendations and the top issues, as an export has them."""
    scores = scoring.opportunity(audits).select("site", F.col("score").alias("website_score"), F.col("tier").alias("opportunity_tier"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("v")))), lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["v"])), " | ")
    top = scoring.top_problems(audits).groupBy("site").agg(listed(_title(F.col("code"))).alias("problems"), listed(_advice(F.col("code"))).alias("recommendations"))
    at = lambda i, c: F.max(F.when(F.col("rank") == i, c))
    issues = []
    for i in range(1, 6):
        fields = {"": _title(F.col("code")), "_category": _label(F.col("category")), "_severity": F.upper("severity"), "_fix": _advice(F.col("code"))}
        issues += [at(i, c).alias(f"top_issue_{i}{k}") for k, c in fields.items()]
    priorities = scoring.top_priorities(audits).groupBy("site").agg(*issues)
    return scores.join(top, "site", "left").join(priorities, "site", "left")


def export(leads: DataFrame, original: list[str], known: dict[str, Column]) -> DataFrame:
    """leads as an export has them: row_index, the original columns as they are, then all of ENRICHMENT.

    known gives the enrichment columns that leads can tell; the others are empty. A lead stays one
    row. Where an original column has the name of an added one, the added one is called audit_ and
    that name. Sort by row_index to have the order of the input.
    """
    defaults = {"phone_status": "unavailable", "whatsapp_status": "no_phone", "linkedin_status": "not_checked", "contact_channel": "SKIP", "audit_status": "not_processed"}
    out = []
    for name in ENRICHMENT:
        value = known.get(name, F.lit(None)).cast("string")
        if name == "contact_channel":
            named = F.create_map(*[x for k, v in CHANNELS.items() for x in (F.lit(k), F.lit(v))])
            value = F.coalesce(F.try_element_at(named, F.coalesce(value, F.lit(""))), F.upper(value))
        out.append(F.coalesce(value, F.lit(defaults.get(name, ""))).alias(f"audit_{name}" if name in original else name))
    return leads.select("row_index", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in original], *out)


def two_emails(emails: DataFrame) -> DataFrame:
    """One row for each site of ranked emails (site, rank, email, source_url, status): the first two side by side."""
    at = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    cols = [at(i, c).alias(f"email_{i}{k}") for i in (1, 2) for k, c in (("", "email"), ("_source", "source_url"), ("_status", "status"))]
    return emails.filter("rank <= 2").groupBy("site").agg(*cols)


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def reports(audits: DataFrame) -> DataFrame:
    """Rows (site, name, text): a page of HTML for each audit, everything in it escaped.

    It has the overall score and its grade, the categories, the priorities with their measures and
    what to do, and the state of every check.
    """
    card = scoring.scorecard(audits).groupBy("site").agg(
        F.max("overall").alias("overall"),
        F.collect_list(F.concat(F.lit("<tr><td>"), _label(F.col("category")), F.lit("</td><td>"), F.coalesce(F.col("score").cast("string"), F.lit("not applicable")), F.lit("</td></tr>"))).alias("rows"),
    )
    proof = F.array_join(F.transform("evidence", lambda e: F.concat(e["name"], F.lit(": "), F.coalesce(_escape(e["value"]), F.lit("none")))), ", ")
    item = F.concat(F.lit("<li><b>"), _title(F.col("code")), F.lit("</b> "), F.col("priority"), F.lit(" <i>"), proof, F.lit("</i> "), _escape(_advice(F.col("code"))), F.lit("</li>"))
    todo = scoring.top_priorities(audits).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("v")))).alias("todo"))
    check = F.concat(F.lit("<li>"), F.replace("check_id", F.lit("_"), F.lit(" ")), F.lit(": "), F.replace("status", F.lit("_"), F.lit(" ")), F.lit("</li>"))
    checks = scoring.check_results(audits).groupBy("site").agg(F.array_sort(F.collect_list(check)).alias("checks"))
    whole = card.join(todo, "site", "left").join(checks, "site")
    text = F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Audit of '), _escape(F.col("site")), F.lit("</title></head><body><h1>"), _escape(F.col("site")), F.lit("</h1><p>"),
        F.col("overall").cast("string"), F.lit("/100, "), scoring.grade(F.col("overall")), F.lit("</p><table>"), F.array_join(F.array_sort("rows"), ""), F.lit("</table><ol>"),
        F.coalesce(F.array_join(F.transform("todo", lambda x: x["v"]), ""), F.lit("")), F.lit("</ol><ul>"), F.array_join("checks", ""), F.lit("</ul></body></html>"),
    )
    return whole.select("site", F.concat(t.slug(F.col("site")), F.lit(".html")).alias("name"), text.alias("text"))


def pick(key: Column, choices: list[str], salt: str = "") -> Column:
    """One of choices by a hash of key: the same for the same key, whatever the run."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(choices))).cast("int") + 1)


def _value(name: str) -> Column:
    return F.get(F.filter("evidence", lambda e: e["name"] == name), 0)["value"]


#: The measure that the phrasing of a code may name.
MEASURED = {
    "slow_response": lambda: _value("ms"), "pagespeed_low": lambda: _value("score"), "broken_internal_links": lambda: F.nullif(_value("count"), F.lit("0")),
    "heavy_page": lambda: F.round(_value("bytes").cast("double") / 1_000_000, 1).cast("string"), "very_thin_homepage": lambda: _value("words"), "thin_homepage": lambda: _value("words"),
    "generic_value_proposition": lambda: F.nullif(_value("h1"), F.lit("")),
}


def observations(problems: DataFrame, limit: int = 2, salt: str = "") -> DataFrame:
    """Rows (site, place, code, topic, line): the first problems of each site that can be put in a sentence, of different topics.

    problems: site, rank, code, evidence (see scoring.top_problems). The wording of a code is one of its PHRASES by a hash of the
    site and the place, with what was measured; where that is not known it is the code's first wording without it.
    """
    pairs = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)])
    topic = F.try_element_at(pairs({k: F.lit(v) for k, v in lx.TOPIC.items()}), F.col("code"))
    listed = problems.withColumn("topic", topic).filter("topic IS NOT NULL").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "topic", "evidence"))).alias("p"))
    firsts = listed.select("site", "p", F.transform("p", lambda x: x["topic"]).alias("ts"))
    kept = F.slice(F.filter(F.transform("p", lambda x, i: F.struct((F.array_position("ts", x["topic"]) == i + 1).alias("first"), x.alias("x"))), lambda y: y["first"]), 1, limit)
    rows = firsts.select("site", F.posexplode(kept).alias("at", "y")).select("site", (F.col("at") + 1).alias("place"), "y.x.code", "y.x.topic", "y.x.evidence")
    seed = F.pmod(F.xxhash64("site", F.lit(salt)), F.lit(997)).cast("int") + F.col("place") - 1
    lines = F.element_at(pairs({k: F.array(*[F.lit(x) for x in v]) for k, v in lx.PHRASES.items()}), F.col("code"))
    measure = F.lit(None).cast("string")
    for code, of in MEASURED.items():
        measure = F.when(F.col("code") == code, of()).otherwise(measure)
    rows = rows.select("site", "place", "code", "topic", seed.alias("seed"), lines.alias("lines"), measure.alias("measure"))
    chosen = F.element_at("lines", F.pmod(F.col("seed"), F.size("lines")) + 1)
    plain = F.get(F.filter("lines", lambda x: ~F.contains(x, F.lit("{}"))), 0)
    line = F.when(~F.contains(chosen, F.lit("{}")), chosen).when(F.col("measure").isNull(), plain).otherwise(F.replace(chosen, F.lit("{}"), F.col("measure")))
    return rows.select("site", "place", "code", "topic", line.alias("line"))


def evidence_rows(evidence: Column, limit: int = 6) -> Column:
    """array(struct(k, v)): the first limit measures of a finding as a report shows them. evidence is a VARIANT object, such as parse_json gives.

    Null and empty values and objects are left out; of a list the first four items are named, by the url or the title of
    those that are objects, 110 characters of each, and how many more there are; true and false are Yes and No, and
    other values are cut at 240 characters. Names are in the order of the object's own (alphabetical), with blanks for underscores.
    """
    fields = F.map_entries(F.try_variant_get(evidence, "$", "map<string,variant>"))

    def named(x: Column) -> Column:
        about = lambda p: F.nullif(F.try_variant_get(x, p, "string"), F.lit(""))
        return F.substring(F.coalesce(about("$.url"), about("$.title"), F.try_variant_get(x, "$", "string"), F.to_json(x)), 1, 110)

    def shown(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        items = F.try_variant_get(v, "$", "array<variant>")
        more = F.when(F.size(items) > 4, F.concat(F.lit(" (+"), (F.size(items) - 4).cast("string"), F.lit(" more)"))).otherwise("")
        listed = F.when(F.size(items) > 0, F.concat(F.array_join(F.transform(F.slice(items, 1, 4), named), ", "), more))
        return (
            F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT") | (kind == "VOID"), F.lit(None))
            .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "Yes").otherwise("No"))
            .otherwise(F.nullif(F.substring(F.try_variant_get(v, "$", "string"), 1, 240), F.lit("")))
        )

    rows = F.transform(fields, lambda e: F.struct(F.replace(e["key"], F.lit("_"), F.lit(" ")).alias("k"), shown(e["value"]).alias("v")))
    return F.slice(F.filter(rows, lambda r: r["v"].isNotNull()), 1, limit)


#: Endings of trades, whose plural names people, and of trades that have no plural (fixed values).
TRADES = ("er", "or", "ist", "ian", "eur", "smith", "wright", "ess", "ant", "ard")
NO_PLURAL = ("ing", "al", "ance", "ence", "ment", "care", "work", "repair", "wear")


def industry_phrase(category: Column) -> Column:
    """Whom a message speaks of: a category in the plural, or its businesses."""
    low = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(category, F.lit("")))), r"\s*[|/,].*$", ""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(low, r"\b(services?|companies|company|businesses|business)\b", ""), r"\s+", " "))

    def named(c: Column) -> Column:
        ends = lambda words: c.rlike("(" + "|".join(words) + ")$")
        ies = F.concat(F.regexp_replace(c, "y$", ""), F.lit("ies"))
        of_y = c.endswith("y") & ~ends(("ay", "ey", "oy", "uy"))
        many = F.when(ends(("s", "sh", "ch", "x", "z")), F.concat(c, F.lit("es"))).when(of_y, ies).otherwise(F.concat(c, F.lit("s")))
        return (
            F.when(c == "", "local businesses").when(c.contains(" "), F.concat(c, F.lit(" businesses"))).when(c.endswith("s") & ~c.endswith("ss"), c)
            .when(ends(NO_PLURAL), F.concat(c, F.lit(" businesses"))).when(ends(TRADES), many).when(of_y, ies).otherwise(F.concat(c, F.lit(" businesses")))
        )

    return t.let(bare, named)


#: How messages begin and end, by tone, in own words.
TONES = {
    "professional": ("Good day", "Would you like the details?"), "friendly": ("Hi", "Shall I send you what I found?"), "direct": ("Hello", "Interested?"), "helpful": ("Hello", "I am glad to explain."),
}
#: What a sender has to have said before anything is drafted.
PROFILE = ("sender_name", "offer")


def drafts(seen: DataFrame, name: Column, profile: dict[str, str], tone: str = "friendly", most: int = 2) -> DataFrame:
    """Rows (site, channel, variant, subject, message, based_on): messages from the observations of each site, for every channel.

    seen: site, place, code, line (see observations). Only what was found is said; based_on has the codes.
    A profile without what PROFILE asks for is refused. The call's message are notes for a call.
    """
    missing = [k for k in PROFILE if not profile.get(k)]
    if missing:
        raise ValueError(f"the profile lacks {', '.join(missing)}")
    hello, end = TONES[tone]
    first = seen.filter(F.col("place") <= most).groupBy("site", name.alias("name")).agg(F.array_sort(F.collect_list(F.struct("place", "code", "line"))).alias("p"))
    lines = F.array_join(F.transform("p", lambda x: x["line"]), ". ")
    who, what = F.lit(profile["sender_name"]), F.lit(profile["offer"])
    body = F.concat(F.lit(hello + " "), "name", F.lit(",\n\n"), lines, F.lit(". "), what, F.lit(". " + end + "\n\n"), who)
    again = F.concat(F.lit(hello + " "), "name", F.lit(",\n\nmy message on this may have been lost: "), lines, F.lit(".\n\n"), who)
    rows = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.lit(v).alias("variant"), (F.concat(F.lit("Your website, "), "name") if c == "email" else F.lit("")).alias("subject"), m.alias("message"))
        for c, v, m in (
            ("email", "initial", body), ("email", "follow_up", again), ("whatsapp", "initial", body), ("whatsapp", "follow_up", again),
            ("linkedin", "initial", F.substring(body, 1, 300)), ("call", "initial", F.concat(F.lit("Ask for the owner. Say: "), lines, F.lit(". Offer: "), what)),
        )
    ])
    return first.select("site", F.transform("p", lambda x: x["code"]).alias("based_on"), F.explode(rows).alias("x")).select("site", "x.*", "based_on")


def mail_link(address: Column, subject: Column, message: Column) -> Column:
    return F.when(F.coalesce(address, F.lit("")) != "", F.concat(F.lit("mailto:"), address, F.lit("?subject="), t.percent_encode(subject), F.lit("&body="), t.percent_encode(message)))
