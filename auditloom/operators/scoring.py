"""Scores, rankings and the check catalogue over audits (rules.audit(): one row for each site, its findings an array).

Every function here is a projection of a site's row: no rows meet, and a site without findings is
scored like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions import text

_SPEED = [k for k, v in lx.CARD_CATEGORY.items() if v == "performance"]


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def display_category(f: Column) -> Column:
    return F.when(f["code"].isin(_SPEED), F.lit("performance")).otherwise(f["check"])


def card_category(f: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in lx.CARD_CATEGORY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, f["code"]), f["check"])


def priority(severity: Column, deduction: Column) -> Column:
    return F.when((severity == "high") | (deduction >= 20), "P1").when((severity == "medium") | (deduction >= 10), "P2").otherwise("P3")


def _categorised(audits: DataFrame, category) -> DataFrame:
    """audits with lost: the category and the points lost of every finding."""
    lost = F.transform("findings", lambda f: F.struct(category(f).alias("c"), F.greatest(F.lit(0), f["deduction"]).alias("d")))
    return audits.select("*", lost.alias("lost"))


def _of(k: str) -> Column:
    return F.filter("lost", lambda x: x["c"] == k)


def _points(k: str) -> Column:
    return F.aggregate(_of(k), F.lit(0), lambda n, x: n + x["d"])


def category_health(audits: DataFrame, category, weights: dict[str, int]) -> DataFrame:
    """audits with health, a map from every category of weights to 100 less what its findings cost, 0 at least.

    Findings of other categories are ignored; a category without findings is at 100.
    """
    scored = _categorised(audits, category)
    pairs = [x for k in weights for x in (F.lit(k), F.greatest(F.lit(0), 100 - _points(k)).cast("int"))]
    return scored.select("*", F.create_map(*pairs).alias("health"))


def opportunity(audits: DataFrame, weights: dict[str, int] = lx.WEIGHTS) -> DataFrame:
    """site, the health of each category, score (0 to 100, half to even: the weighted mean of 100 - health) and tier."""
    health = category_health(audits, lambda f: f["check"], weights)
    total = sum(max(0, w) for w in weights.values()) or 1
    score = F.bround(sum((100 - F.col("health")[k]) * max(0, w) for k, w in weights.items()) / total).cast("int")
    out = health.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), score)))
    return out.select("site", *[F.col("health")[k].alias(k) for k in weights], "score", tier(F.col("score")).alias("tier"))


def tier(score: Column) -> Column:
    out = None
    for least, name in lx.TIERS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("Low")


def explanation(audits: DataFrame, weights: dict[str, int] = lx.WEIGHTS) -> DataFrame:
    """Rows (site, place, category, weight, health, opportunity, contribution, findings, deductions): what each category adds.

    contribution is opportunity * weight over the sum of weights, to one decimal; place 1 adds most,
    and equal ones stay in the order of weights.
    """
    total = sum(max(0, w) for w in weights.values()) or 1
    health = category_health(audits, lambda f: f["check"], weights)
    rows = []
    for i, (k, w) in enumerate(weights.items()):
        gain = 100 - F.col("health")[k]
        share = F.bround(gain * max(0, w) / F.lit(float(total)), 1)
        rows.append(F.struct(
            (-share).alias("order"), F.lit(i).alias("i"), F.lit(k).alias("category"), F.lit(w).alias("weight"), F.col("health")[k].alias("health"),
            gain.alias("opportunity"), share.alias("contribution"), F.size(_of(k)).alias("findings"), _points(k).alias("deductions"),
        ))
    out = health.select("site", F.posexplode(F.array_sort(F.array(*rows))).alias("at", "x")).select("site", (F.col("at") + 1).alias("place"), "x.*")
    return out.drop("order", "i")


def diverse_top(audits: DataFrame, k: int, category, eligible) -> DataFrame:
    """The k worst eligible findings of each site with rank from 1: first the worst of each category, then the rest."""
    keyed = F.transform(
        F.filter("findings", eligible),
        lambda f: F.struct(severity_rank(f["severity"]).alias("s"), (-f["deduction"]).alias("d"), f["seq"].alias("n"), category(f).alias("category"), f.alias("f")),
    )
    worst = audits.select("site", F.array_sort(keyed).alias("w")).select("site", "w", F.transform("w", lambda x: x["category"]).alias("cs"))
    picked = F.transform(
        "w", lambda x, i: F.struct((F.array_position("cs", x["category"]) != i + 1).alias("again"), x["s"].alias("s"), x["d"].alias("d"), x["n"].alias("n"), x["category"].alias("category"), x["f"].alias("f"))
    )
    first = worst.select("site", F.slice(F.array_sort(picked), 1, k).alias("w"))
    ordered = F.array_sort(F.transform("w", lambda x: F.struct(x["s"].alias("s"), x["d"].alias("d"), x["again"].alias("again"), x["n"].alias("n"), x["category"].alias("category"), x["f"].alias("f"))))
    return first.select("site", F.posexplode(ordered).alias("at", "x")).select("site", (F.col("at") + 1).alias("rank"), F.col("x.category").alias("category"), "x.f.*")


def top_problems(audits: DataFrame, k: int = 7) -> DataFrame:
    """Rows (site, rank, code, category, severity, deduction, strong, evidence): the problems to open a conversation with."""
    out = diverse_top(audits, k, display_category, lambda f: (f["deduction"] > 0) | f["code"].isin(lx.STRONG))
    return out.select("site", "rank", "code", "category", "severity", "deduction", F.col("code").isin(lx.STRONG).alias("strong"), "evidence")


def top_priorities(audits: DataFrame, k: int = 5) -> DataFrame:
    out = diverse_top(audits, k, card_category, lambda f: f["deduction"] > 0)
    return out.select("site", "rank", "code", "category", priority(F.col("severity"), F.col("deduction")).alias("priority"), "severity", "deduction", "evidence")


def recommendations(problems: DataFrame) -> DataFrame:
    """Rows (site, rank, problem_code, category, severity, recommendation) for the problems whose code has an advice."""
    known = [x for code, text in lx.ADVICE.items() for x in (F.lit(code), F.lit(text))]
    out = problems.withColumn("recommendation", F.try_element_at(F.create_map(*known), F.col("code")))
    return out.filter("recommendation IS NOT NULL").select("site", "rank", F.col("code").alias("problem_code"), "category", "severity", "recommendation")


def _carded(audits: DataFrame, weights: dict[str, int]) -> tuple[DataFrame, Column]:
    health = category_health(audits, card_category, weights)
    applies = lambda k: F.col("local_applies") if k == "local_seo" else F.lit(True)
    top = sum(F.when(applies(k), (100 - F.col("health")[k]) * w).otherwise(0) for k, w in weights.items())
    bottom = sum(F.when(applies(k), w).otherwise(0) for k, w in weights.items())
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("category"), F.when(applies(k), F.col("health")[k]).alias("score"), applies(k).alias("applicable"), F.when(applies(k), w).otherwise(0).alias("weight"),
            F.when(applies(k), F.size(_of(k))).otherwise(0).alias("findings"), F.when(applies(k), _points(k)).otherwise(0).alias("deductions"),
        )
        for k, w in weights.items()
    ])
    overall = (100 - F.bround(top / F.greatest(bottom, F.lit(1)))).cast("int")
    return health.select("*", overall.alias("overall")), rows


def scorecard(audits: DataFrame, weights: dict[str, int] = lx.CARD_WEIGHTS) -> DataFrame:
    """Rows (site, category, score, applicable, weight, findings, deductions, overall): the card's categories in order.

    local_seo has no score where it does not apply. overall is the weighted mean of the scores of
    categories that apply, rounded half to even.
    """
    card, rows = _carded(audits, weights)
    return card.select("site", "overall", F.explode_outer(rows).alias("x")).select("site", "x.*", "overall")


def severity_counts(audits: DataFrame) -> DataFrame:
    """site and how many findings of each severity cost points: high, medium, low."""
    n = lambda s: F.size(F.filter("findings", lambda f: (f["severity"] == s) & (f["deduction"] > 0))).alias(s)
    return audits.select("site", n("high"), n("medium"), n("low"))


def _checks(audits: DataFrame) -> tuple[DataFrame, Column]:
    fired = F.map_from_entries(F.transform("findings", lambda f: F.struct(f["code"], f["severity"])))
    status = lambda severity: F.when(severity == "high", "fail").when(severity.isNotNull(), "warning")
    rows = []
    for check_id, category, codes in lx.CHECKS:
        found = status(F.coalesce(*[F.try_element_at("fired", F.lit(c)) for c in codes])).otherwise("pass")
        if category == "local_seo":
            found = F.when(F.col("local_applies"), found).otherwise("not_applicable")
        rows.append((check_id, category, found))
    rows += [(check_id, category, F.lit("not_verified")) for check_id, category in lx.NOT_VERIFIED]
    speed = F.when(F.col("speed_measured"), status(F.try_element_at("fired", F.lit("pagespeed_low"))).otherwise("pass")).otherwise("not_verified")
    rows.append(("core_web_vitals", "performance", speed))
    return audits.select("*", fired.alias("fired")), F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit(c).alias("category"), s.alias("status")) for i, c, s in rows])


def check_results(audits: DataFrame) -> DataFrame:
    """Rows (site, check_id, category, status): every check of the catalogue for each site.

    The first fired code of a check decides: fail if its severity is high, else warning; none: pass.
    """
    found, rows = _checks(audits)
    return found.select("site", F.explode_outer(rows).alias("x")).select("site", "x.*")


def clear_opportunity(score: Column, problems: Column, strong: Column, least: int = 3) -> Column:
    return score.isNotNull() & (problems >= least) & ((strong > 0) | (score >= 40))


def lead_tier(score: Column, contact: Column, strong: Column, problems: Column, ok: Column, no_site: Column, active: Column) -> Column:
    """A+ to D. ok: the site was reached; no_site: the lead has none; active: recent reviews, null if unknown."""
    return (
        F.when(no_site, F.when(contact, F.when(active.eqNullSafe(False), "C").otherwise("B")).otherwise("D"))
        .when(score.isNull() | ~ok, "D")
        .when((score >= 75) & contact & (strong >= 2), "A+")
        .when((score >= 60) & contact & (strong >= 1), "A")
        .when((score >= 60) & ~contact, "B")
        .when((score >= 40) & contact, "B")
        .when(score >= 40, "C")
        .when(problems == 0, "D")
        .otherwise("C")
    )


def band(score: Column) -> Column:
    return F.when(score >= 85, "strong").when(score >= 70, "fair").when(score >= 50, "weak").otherwise("poor")


#: Letter grades by the least score for each (fixed values).
GRADES = [
    (95, "A+"), (90, "A"), (85, "A\u2212"), (80, "B+"), (75, "B"), (70, "B\u2212"),
    (65, "C+"), (60, "C"), (55, "C\u2212"), (50, "D+"), (40, "D"), (0, "F"),
]


def grade(score: Column) -> Column:
    """The letter of a score; empty without one."""
    out = F.when(score.isNull(), "")
    for least, letter in GRADES:
        out = out.when(score >= least, letter)
    return out.otherwise("F")


def evidence_rows(evidence: Column, limit: int = 6) -> Column:
    """The first limit measures of a finding as label and value for readers: no empty ones, Yes and No, 240 characters at most."""
    some = F.filter(evidence, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    value = lambda e: F.when(e["value"] == "true", "Yes").when(e["value"] == "false", "No").otherwise(F.substring(e["value"], 1, 240))
    return F.transform(F.slice(some, 1, limit), lambda e: F.struct(F.replace(e["name"], F.lit("_"), F.lit(" ")).alias("label"), value(e).alias("value")))


def findings_context(audits: DataFrame) -> DataFrame:
    """Rows (site, place, code, category, severity, deduction): all findings, the worst first, as a report lists them by severity."""
    keyed = F.transform("findings", lambda f: F.struct(severity_rank(f["severity"]).alias("s"), (-f["deduction"]).alias("d"), f["seq"].alias("n"), f.alias("f"), card_category(f).alias("category")))
    rows = audits.select("site", F.posexplode(F.array_sort(keyed)).alias("at", "x"))
    return rows.select("site", (F.col("at") + 1).alias("place"), F.col("x.f.code").alias("code"), F.col("x.category").alias("category"), F.col("x.f.severity").alias("severity"), F.col("x.f.deduction").alias("deduction"))


def shares(audits: DataFrame) -> DataFrame:
    """Rows (site, category, findings, percent_of_most, percent_of_all): what bars and rings of a report show, to one decimal."""
    card, rows = _carded(audits, lx.CARD_WEIGHTS)
    found = lambda c: c["findings"]
    part = lambda c, whole: F.round(100 * found(c) / F.nullif(whole, F.lit(0)), 1)

    def shared(cs: Column) -> Column:
        whole = F.struct(F.array_max(F.transform(cs, found)).alias("most"), F.aggregate(cs, F.lit(0), lambda a, c: a + found(c)).alias("sum"))
        row = lambda c, m: F.struct(c["category"].alias("category"), found(c).alias("findings"), part(c, m["most"]).alias("percent_of_most"), part(c, m["sum"]).alias("percent_of_all"))
        return text.let(whole, lambda m: F.transform(cs, lambda c: row(c, m)))

    return card.select("site", F.explode_outer(text.let(rows, shared)).alias("c")).select("site", "c.*")


def _with_status(status: str) -> Column:
    return F.size(F.filter("checks", lambda c: c["status"] == status))


def executive_summary(audits: DataFrame, weights: dict[str, int] = lx.CARD_WEIGHTS) -> DataFrame:
    """One row for each site: what the first page of a report says.

    overall and its band; working: the best four categories from 85 on; weak: the worst three under 70; impacted: the
    card's first three categories with a finding of high or medium severity; and how many checks have each status. The
    problems of that page and what to do about them are the first of top_priorities() and recommendations().
    """
    card, rows = _carded(audits, weights)
    card, checks = _checks(card.select("*", rows.alias("card")))
    at = F.create_map(*[x for i, k in enumerate(weights) for x in (F.lit(k), F.lit(i))])
    listed = lambda least, most, sign, n: F.array_join(
        F.transform(
            F.slice(F.array_sort(F.transform(F.filter("card", lambda c: (c["score"] >= least) & (c["score"] < most)), lambda c: F.struct((sign * c["score"]).alias("s"), at[c["category"]].alias("i"), c["category"].alias("k")))), 1, n),
            lambda x: x["k"],
        ),
        ", ",
    )
    hurt = F.array_distinct(F.transform(F.filter("findings", lambda f: (f["deduction"] > 0) & (f["severity"] != "low")), card_category))
    out = card.select(
        "site", "overall", band(F.col("overall")).alias("band"), listed(85, 101, -1, 4).alias("working"), listed(0, 70, 1, 3).alias("weak"),
        F.array_join(F.slice(F.array_intersect(F.array(*[F.lit(k) for k in weights]), hurt), 1, 3), ", ").alias("impacted"), checks.alias("checks"),
    )
    return out.select(
        *out.columns[:-1], *[_with_status(s).alias(f"n_{s}") for s in ("pass", "warning", "fail", "not_verified", "not_applicable")]
    )


def issue_columns(audits: DataFrame, n: int = 5) -> DataFrame:
    """One row for each site: code, category, priority and deduction of its first n priorities side by side, null beyond them."""
    at = lambda i, f: F.max(F.when(F.col("rank") == i, F.col(f)))
    cols = [at(i, f).alias(f"issue_{i}_{f}") for i in range(1, n + 1) for f in ("code", "category", "priority", "deduction")]
    return audits.select("site").join(top_priorities(audits, n).groupBy("site").agg(*cols), "site", "left")
