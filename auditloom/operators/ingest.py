"""From a table of unknown columns to typed leads."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions import text, urls

SHAPES = {
    "website": r"(?i)^(https?://|www[.])|[.][a-z]{2,24}(/|$)",
    "google_maps_url": r"(?i)(google[.][a-z.]+/maps|goo[.]gl/maps|maps[.]app[.]goo[.]gl)",
    "email": r"(?i)^[^@\s]+@[^@\s]+[.][a-z]{2,}$",
    "phone": r"^[+()\d][\d\s()\-.+extEXT]{5,}$",
    "rating": r"^[0-5]([.,][0-9]+)?$",
    "review_count": r"^[0-9]+$",
    "postal_code": r"(?i)^[A-Z0-9][A-Z0-9 \-]{2,9}$",
    "place_id": r"(?i)^(ChI|0x[0-9a-f]+:|GhIJ|EiQ)",
}


def name_score(header: Column) -> Column:
    """For a normalised header a map from each field to how well its name fits, 0 to 1."""
    fields = []
    for field, names in lx.ALIASES.items():
        names = list(dict.fromkeys(n.replace("_", " ").replace("-", " ") for n in names))
        score = F.lit(0.0)
        for n in names:
            inside = F.contains(header, F.lit(n)) | F.contains(F.lit(n), header)
            part = F.least(F.length(header), F.lit(len(n))) / F.greatest(F.length(header), F.lit(len(n)))
            score = F.greatest(score, F.when(inside, 0.72 + 0.18 * part).otherwise(0.0))
        score = F.least(F.lit(0.97), score)
        barred = F.lit(False)
        for w in lx.NOT_HEADERS.get(field, []):
            barred = barred | F.array_contains(F.split(header, " "), w)
        fields += [F.lit(field), F.when(barred | (header == ""), 0.0).when(header.isin(names), 1.0).otherwise(score)]
    return F.create_map(*fields)


def likeness(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How alike two short strings are, by matching blocks."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def mapping_scores(rows: DataFrame, sample: int = 200) -> DataFrame:
    """Rows (header, field, name, shape, score) for the columns of a table, by its first sample rows.

    The sample is a look at the data to suggest a mapping; it decides nothing about rows. Headers
    that no alias contains can still fit by likeness.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("header"), F.col(f"`{c}`").cast("string").alias("value")) for c in rows.columns])
    v = F.trim("value")
    shape = F.create_map(*[x for f, p in SHAPES.items() for x in (F.lit(f), F.avg(F.when(v != "", v.rlike(p).cast("double"))))])
    looks = rows.limit(sample).select(F.explode(cells).alias("x")).select("x.*").groupBy("header").agg(shape.alias("shapes"))
    pairs = looks.withColumn("h", text.norm_header(F.col("header"))).select("header", "h", "shapes", F.explode(name_score(F.col("h"))).alias("field", "exact"))
    aliases = F.create_map(*[x for f, ns in lx.ALIASES.items() for x in (F.lit(f), F.array(*[F.lit(n) for n in ns]))])
    alike = (
        pairs.filter("exact = 0").select("header", "h", "field", F.explode(aliases[F.col("field")]).alias("alias"))
        .groupBy("header", "field").agg(F.max(F.pandas_udf(likeness, "double")("h", "alias")).alias("r"))
    )
    name = F.greatest("exact", F.when(F.col("r") > 0.86, 0.85 * F.col("r")).otherwise(0.0))
    shaped = F.coalesce(F.try_element_at("shapes", F.col("field")), F.lit(0.0))
    scored = pairs.join(alike, ["header", "field"], "left").select("header", "field", F.coalesce(name, "exact").alias("name"), shaped.alias("shape"))
    by_shape = F.col("field").isin("website", "email", "phone", "google_maps_url", "place_id")
    score = (
        F.when((F.col("name") >= 0.5) & (F.col("shape") >= 0.5), F.least(F.lit(1.0), 0.75 * F.col("name") + 0.35 * F.col("shape")))
        .when(F.col("name") >= 0.5, 0.85 * F.col("name")).when((F.col("shape") >= 0.8) & by_shape, 0.6 * F.col("shape")).otherwise(0.0)
    )
    return scored.withColumn("score", F.bround(score, 3))


def assign(scores: DataFrame, columns: list[str], least: float = 0.45) -> dict[str, str]:
    """field -> header, best scores first, each once. scores has a row for each column and field of one table."""
    order = {f: i for i, f in enumerate(lx.ALIASES)}
    rows = scores.filter(F.col("score") >= least).collect()  # columns times fields at most
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (-r["score"], columns.index(r["header"]), order[r["field"]])):
        if r["field"] not in out and r["header"] not in out.values():
            out[r["field"]] = r["header"]
    return out


#: Fields that a table of leads has to have.
REQUIRED = ["business_name"]


def suggestion(scores: DataFrame, columns: list[str]) -> dict:
    """assign() with what a reviewer needs: mapping, confidence, evidence (name and shape), unmapped, missing_required, low_confidence, needs_review."""
    mapping = assign(scores, columns)
    found = {(r["field"], r["header"]): r for r in scores.collect()}  # columns times fields at most
    sure = {f: round(found[f, h]["score"], 3) for f, h in mapping.items()}
    missing = [f for f in REQUIRED if f not in mapping]
    low = [f for f, c in sure.items() if c < 0.7]
    return {
        "mapping": mapping, "confidence": sure,
        "evidence": {f: {"name": round(found[f, h]["name"], 3), "shape": round(found[f, h]["shape"], 3)} for f, h in mapping.items()},
        "unmapped": [c for c in columns if c not in mapping.values()], "missing_required": missing, "low_confidence": low, "needs_review": bool(missing or low),
    }


def typed(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """rows with the fields of a mapping as typed columns and dedup_key; fields without a header are empty."""
    cell = lambda f: F.trim(F.coalesce(F.col(f"`{mapping[f]}`"), F.lit(""))) if f in mapping else F.lit("")
    out = rows.select("*", *[cell(f).alias(f) for f in lx.ALIASES if f not in ("rating", "review_count") and f not in rows.columns])
    out = out.withColumn("rating", text.to_float(cell("rating"))).withColumn("review_count", text.to_int(cell("review_count")))
    return out.withColumn("dedup_key", dedup_key(F.col("website"), F.col("place_id"), F.col("business_name"), F.col("city"), F.col("phone")))


def dedup_key(website: Column, place_id: Column, name: Column, city: Column, phone: Column) -> Column:
    """What makes two leads one: the site's domain, else the place id, else name and city, else the phone's digits; "" if none."""
    site = urls.normalize_url(website)
    own = F.when(site.isNotNull() & urls.profile_kind(site).isNull(), urls.registrable_domain(site))
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", "")
    named = text.norm_name(name)
    return (
        F.when(F.coalesce(own, F.lit("")) != "", F.concat(F.lit("site:"), own))
        .when(F.trim(F.coalesce(place_id, F.lit(""))) != "", F.concat(F.lit("place:"), F.lower(F.trim(place_id))))
        .when(named != "", F.concat(F.lit("name:"), named, F.lit("|"), text.norm_name(city)))
        .when(digits != "", F.concat(F.lit("phone:"), digits))
        .otherwise("")
    )
