"""URL algebra as Column functions: every one takes and returns Columns and stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions.text import let

_PLACEHOLDERS = ["", "n/a", "na", "none", "null", "-", "--", "no website", "nil", "not available", "."]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """The host without user and port, in lower case; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(_authority(url), "^.*@", ""), ":[0-9]*$", ""))


def origin(url: Column) -> Column:
    """scheme://host:port, empty for what is no absolute URL."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def without_tracking(q: Column) -> Column:
    """A query string without tracking parameters and empty parts, in its order."""
    return F.array_join(
        F.filter(F.split(q, "&"), lambda p: (p != "") & ~F.array_contains(_strings(lx.TRACKING), F.lower(F.substring_index(p, "=", 1)))), "&"
    )


def _parts(url: Column) -> Column:
    """struct(scheme, place, way, query) of an absolute URL, split once; place is host and port in lower case."""
    return F.struct(
        F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"),
        F.lower(_authority(url)).alias("place"),
        path(url).alias("way"),
        query(url).alias("query"),
    )


def normalize_url(raw: Column) -> Column:
    """The canonical http or https URL of a cell, or null where it holds none.

    Quotes and white space go, a missing scheme becomes https, the host is lower-cased and needs a
    dot, ports 80 and 443 go, an empty path is "/", tracking parameters and the fragment go.
    """

    def full(b: Column) -> Column:
        return (
            F.when(F.lower(b).isin(_PLACEHOLDERS), F.lit(None))
            .when(b.startswith("//"), F.concat(F.lit("https:"), b))
            .when(b.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), b)
            .when(b.rlike(r"^[^/?#:]*[.][^/?#]*"), F.concat(F.lit("https://"), b))
        )

    def put_together(p: Column) -> Column:
        rest = without_tracking(p["query"])
        url = F.concat(
            p["scheme"], F.lit("://"), F.regexp_replace(p["place"], ":(80|443)$", ""), F.when(p["way"] == "", F.lit("/")).otherwise(p["way"]),
            let(rest, lambda r: F.when(r != "", F.concat(F.lit("?"), r)).otherwise("")),
        )
        named = F.regexp_replace(F.regexp_replace(p["place"], "^.*@", ""), ":[0-9]*$", "").contains(".")
        return F.when(p["scheme"].isin("http", "https") & named, url)

    bare = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^[\s'\"]+|[\s'\"]+$", ""), r"\s+", "")
    return let(let(bare, full), lambda u: let(_parts(u), put_together))


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, or three where the last two are a known public suffix."""
    h = host(url)
    labels = F.split(h, "[.]")
    two = F.substring_index(h, ".", -2)
    return F.when(h.rlike(r"^[0-9.]+$") | (F.size(labels) < 2), h).when(
        F.array_contains(_strings(lx.SUFFIXES), two), F.substring_index(h, ".", -3)
    ).otherwise(two)


def same_site(a: Column, b: Column) -> Column:
    d = registrable_domain(a)
    return (d != "") & (d == registrable_domain(b))


def site_key(url: Column) -> Column:
    """The host without a leading www., m. or blog."""
    return F.regexp_replace(host(url), r"^(www|m|blog)[.]", "")


def profile_kind(url: Column) -> Column:
    """social_profile, directory_listing or link_in_bio if the URL is somebody's page on such a host, else null."""
    h, d = F.regexp_replace(host(url), "^www[.]", ""), registrable_domain(url)
    out = F.lit(None).cast("string")
    for hosts, kind in ((lx.BIO_HOSTS, "link_in_bio"), (lx.DIRECTORY_HOSTS, "directory_listing"), (lx.SOCIAL_HOSTS, "social_profile")):
        out = F.when(h.isin(hosts) | d.isin(hosts), F.lit(kind)).otherwise(out)
    return out


def is_crawlable(url: Column) -> Column:
    return url.rlike("(?i)^https?://") & ~F.lower(path(url)).rlike(r"[.](" + "|".join(lx.BINARY_EXTENSIONS) + ")$")


def should_skip(url: Column) -> Column:
    import re

    return F.lower(url).rlike("|".join(re.escape(p) for p in lx.SKIP_PARTS))


def absolutize(base: Column, href: Column) -> Column:
    """href as seen from base, normalised; null for fragments and schemes that name no page.

    Dot segments are resolved one after the other, ten at most.
    """

    def joined(h: Column) -> Column:
        folder = F.regexp_extract(path(base), "^(.*/)", 1)
        return (
            F.when((h == "") | h.rlike("(?i)^(mailto|tel|javascript|data|sms|whatsapp|callto):"), F.lit(None))
            .when(h.rlike("(?i)^https?://"), h)
            .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), h))
            .when(h.startswith("/"), F.concat(origin(base), h))
            .when(h.startswith("?"), F.concat(origin(base), path(base), h))
            .otherwise(F.concat(origin(base), F.when(folder == "", F.lit("/")).otherwise(folder), h))
        )

    def without_dots(u: Column) -> Column:
        way = F.regexp_replace(u, r"/\./", "/")
        for _ in range(10):
            way = F.regexp_replace(way, r"^([a-zA-Z]+://[^/]*)((?:/[^/?#]+)*?)/(?!\.\./)[^/?#]+/\.\./", "$1$2/")
        return F.when(u.contains("/."), F.regexp_replace(way, r"^([a-zA-Z]+://[^/]*)(/\.\.)+/", "$1/")).otherwise(u)

    h = F.regexp_replace(F.trim(F.coalesce(href, F.lit(""))), "#.*$", "")
    return normalize_url(let(let(h, joined), without_dots))


def url_key(url: Column) -> Column:
    """The same for all addresses of one page: no scheme, www., port, index page or last slash; in lower case."""
    h = F.regexp_replace(F.lower(F.regexp_replace(_authority(url), ":[0-9]+$", "")), "^(.*?)www[.]", "$1")
    way = F.regexp_replace(F.lower(path(url)), "/(index|default|home)[.](html|htm|php|aspx|asp)$", "/")
    way = F.regexp_replace(way, "/+$", "")
    q = F.lower(query(url))
    return F.concat(h, way, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def classify_page(url: Column, text: Column | None = None) -> Column:
    """The page's type by its path and the text of the link to it: one look for each type."""

    def first_of(p: Column) -> Column:
        out = F.when(p["way"].isin("", "/"), F.lit("homepage"))
        for kind, keys in lx.PAGE_TYPES.items():
            every = dict.fromkeys([*keys, *(k.replace("-", " ") for k in keys)])
            out = out.when(p["both"].rlike(r"\b(" + "|".join(every) + r")\b"), F.lit(kind))
        return out.when(p["all"].rlike("blog|news|article|post"), F.lit("blog")).otherwise(F.lit("other"))

    said = F.lower(F.coalesce(text, F.lit(""))) if text is not None else F.lit("")
    read = let(
        F.struct(F.lower(path(url)).alias("way"), said.alias("said"), F.lower(url).alias("url")),
        lambda p: F.struct(
            p["way"].alias("way"), F.concat(F.regexp_replace(p["way"], "[/_-]", " "), F.lit("\n"), p["said"]).alias("both"), F.concat(p["url"], F.lit(" "), p["said"]).alias("all")
        ),
    )
    return let(read, first_of)


def name_tokens(name: Column) -> Column:
    """The words of a business name over one character, without legal forms, repeats kept in order."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[&+]", " and "), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(_strings(lx.LEGAL_WORDS), w))


def distinctive_tokens(name: Column) -> Column:
    all_ = name_tokens(name)
    rare = F.filter(all_, lambda w: ~F.array_contains(_strings(lx.GENERIC_WORDS), w))
    return F.when(F.size(rare) > 0, rare).otherwise(all_)


def candidate_domains(name: Column, region: Column, limit: int = 6) -> Column:
    """Addresses a business of this name could have: joined, hyphenated and first two words, by the region's suffixes."""
    words = name_tokens(name)
    bases = F.array_distinct(
        F.filter(
            F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(F.slice(words, 1, 2), "")), lambda b: F.length(b) > 2
        )
    )
    pairs = F.create_map(*[x for r, t in lx.REGION_TLDS.items() for x in (F.lit(r), _strings(t))])
    tlds = F.coalesce(F.try_element_at(pairs, F.upper(F.coalesce(region, F.lit("")))), _strings([".com", ".net"]))
    urls = F.flatten(F.transform(bases, lambda b: F.transform(tlds, lambda t: F.concat(F.lit("https://"), b, t))))
    return F.slice(F.array_distinct(urls), 1, limit)
