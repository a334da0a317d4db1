"""Text helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value), with value worked out once: f's Column may use it often without growing the plan."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(c: Column) -> Column:
    """c without white space at its ends (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_header(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"[_\-./\\]+", " "), "[^a-z0-9 ]", ""), " +", " "))


def norm_name(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def to_float(c: Column) -> Column:
    """A decimal number with comma or dot, null for anything else."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def to_int(c: Column) -> Column:
    """All digits of a cell as one number; null without digits."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def formula_guard(c: Column, limit: int = 32_000) -> Column:
    """A cell that no spreadsheet takes for a formula, cut to limit characters."""
    risky = F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r")
    return F.substring(F.when(risky, F.concat(F.lit("'"), c)).otherwise(c), 1, limit)


def percent_encode(c: Column) -> Column:
    """c for a query string, a space as %20."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def chat_url(e164: Column, message: Column) -> Column:
    digits = F.regexp_replace(e164, "[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit("https://wa.me/"), digits, F.lit("?text="), percent_encode(message)))


def slug(c: Column, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)


def first_word(text: Column, words: list[str]) -> Column:
    """The first of words, in their order, that text contains anywhere; null if none."""
    return F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)), 0)


def has_word(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def fmt_time(c: Column) -> Column:
    """A time to the second, empty for null."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def fmt_bytes(c: Column) -> Column:
    """A size with the unit in which it is under 1024, to one decimal from KB on; GB of any number, never with an exponent."""
    # tenths are rounded as doubles, as SQL does; a double of ten million or more would be written as 1.0E7
    step = lambda n, unit: F.concat((F.round(c / float(1 << n) * 10) / 10).cast("decimal(20,1)").cast("string"), F.lit(unit))
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1 << 20, step(10, " KB")).when(c < 1 << 30, step(20, " MB")).otherwise(step(30, " GB"))


def fmt_duration(seconds: Column) -> Column:
    """Whole seconds as 5s, 2m 5s or 1h 2m."""
    part = lambda n: F.floor(seconds / n).cast("string")
    left = lambda n, m: F.floor((seconds % n) / m).cast("string")
    return (
        F.when(seconds < 60, F.concat(part(1), F.lit("s"))).when(seconds < 3600, F.concat(part(60), F.lit("m "), left(60, 1), F.lit("s")))
        .otherwise(F.concat(part(3600), F.lit("h "), left(3600, 60), F.lit("m")))
    )
