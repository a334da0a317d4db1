"""Regions and phone numbers by own numbering plans (lexicons.PLANS): lengths, trunk prefixes, mobile ranges.

A plan tells whether a number can be one of its region, not whether it is assigned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions.text import let


def _map(pairs) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])


def resolve_region(country: Column, state: Column, address: Column) -> Column:
    """The region code by country, else by a US state or Canadian province, else by the address; null if none tells."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+", " "))
    names = _map([(n, r) for r, ns in lx.REGION_NAMES.items() for n in [*ns, r.lower()]])
    s, a = clean(state), clean(address)
    named = F.lit(None).cast("string")
    for region, ns in reversed(lx.REGION_NAMES.items()):
        long = [n for n in ns if len(n) > 3]
        if long:
            named = F.when(a.rlike(r"\b(" + "|".join(long) + r")\b"), region).otherwise(named)
    zip_state = F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"\b([A-Z]{2}) [0-9]{5}\b", 1))
    return F.coalesce(
        F.try_element_at(names, clean(country)),
        F.when(s.isin(lx.US_STATES), "US"),
        F.when(s.isin(lx.CA_PROVINCES), "CA"),
        named,
        F.when(zip_state.isin(lx.US_STATES), "US"),
    )


def _plan(region: Column) -> Column:
    """The numbering plan of a region; null if none is known."""
    plans = _map([(r, i) for i, r in enumerate(lx.PLANS)])
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("region"), F.lit(c).alias("code"), F.lit(t).alias("trunk"), F.lit(a).alias("least"), F.lit(z).alias("most"), F.lit(m).alias("mobile"))
            for r, (c, t, a, z, m) in lx.PLANS.items()
        ]
    )
    return F.get(rows, F.coalesce(F.try_element_at(plans, region), F.lit(len(lx.PLANS))))


def normalize_phone(raw: Column, region: Column) -> Column:
    """struct(status, e164, national, region, calling_code, line, extension).

    status: empty, ambiguous_region (neither a + or 00 prefix nor a region), unparseable, invalid,
    possible (the length fits but for a digit) or valid. line: mobile, fixed_line, or
    fixed_line_or_mobile where the plan does not tell.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    body = F.regexp_replace(text, r"(?i)\s*(?:ext[.]?|extension|x|#)\s*[0-9]{1,6}\s*$", "")
    read = F.struct(
        (text == "").alias("empty"),
        F.regexp_extract(text, r"(?i)(?:ext[.]?|extension|x|#)\s*([0-9]{1,6})\s*$", 1).alias("extension"),
        body.rlike(r"^\s*[(]?\s*(\+|00)").alias("abroad"),
        F.regexp_replace(F.regexp_replace(body, "[^0-9]", ""), F.when(body.rlike(r"^\s*00"), "^00").otherwise("^$"), "").alias("number"),
        F.upper(F.coalesce(region, F.lit(""))).alias("given"),
    )
    return let(read, lambda r: let(_region(r), lambda own: let(_plan(own), lambda p: let(_national(r, p), lambda cut: _judged(r, p, cut)))))


def _region(r: Column) -> Column:
    """The region of a number: the given one, or that of its calling code; of those that share one, the given one or the first."""
    out = F.lit(None).cast("string")
    for code in sorted({p[0] for p in lx.PLANS.values()}, key=lambda c: (len(c), c)):
        regions = [x for x, p in lx.PLANS.items() if p[0] == code]
        out = F.when(r["number"].startswith(code), F.when(r["given"].isin(regions), r["given"]).otherwise(regions[0])).otherwise(out)
    return F.when(r["abroad"], out).otherwise(F.when(r["given"].isin(list(lx.PLANS)), r["given"]))


def _national(r: Column, p: Column) -> Column:
    """The national number, without calling code and trunk prefix."""
    rest = F.when(r["abroad"], F.substr(r["number"], F.length(p["code"]) + 1)).otherwise(r["number"])
    leads = (p["trunk"] != "") & rest.startswith(p["trunk"]) & ((p["trunk"] != "1") | (F.length(rest) > p["most"]))
    return F.when(leads, F.substr(rest, F.length(p["trunk"]) + 1)).otherwise(rest)


def _judged(r: Column, p: Column, cut: Column) -> Column:
    size = F.length(cut)
    plain = ~cut.rlike(r"^(\d)\1+$")
    american = (p["code"] == "1") & ~cut.rlike("^[2-9][0-9]{2}[2-9]")
    status = (
        F.when(r["empty"], "empty").when(F.length(r["number"]) < 5, "unparseable").when(~r["abroad"] & p.isNull(), "ambiguous_region").when(p.isNull(), "invalid")
        .when((size >= p["least"]) & (size <= p["most"]) & plain & ~american, "valid")
        .when((size >= p["least"] - 1) & (size <= p["most"] + 1) & plain & ~american, "possible").otherwise("invalid")
    )
    line = F.when(p["mobile"] == "", "fixed_line_or_mobile").when(F.regexp_like(cut, p["mobile"]), "mobile").otherwise("fixed_line")
    good = lambda c: F.when(status.isin("valid", "possible"), c)
    return F.struct(
        status.alias("status"),
        good(F.concat(F.lit("+"), p["code"], cut)).alias("e164"),
        good(cut).alias("national"),
        good(p["region"]).alias("region"),
        good(p["code"]).alias("calling_code"),
        F.when(status == "valid", line).alias("line"),
        F.nullif(r["extension"], F.lit("")).alias("extension"),
    )
