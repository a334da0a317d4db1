"""Signal panels of a report: what was measured of a site, by panel, with label, value and reason.

Signals are expressions over a site's row of rules.facts(), so panels are one projection. A value that was not measured
says so and is never estimated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators import rules


def _is(condition: str, yes: str = "Present", no: str = "Not found", unknown: str = "Not measured") -> str:
    return f"CASE WHEN {condition} THEN '{yes}' WHEN NOT ({condition}) THEN '{no}' ELSE '{unknown}' END"


def _head(name: str, yes: str = "Present", no: str = "Missing") -> str:
    return f"CASE WHEN NOT measured THEN 'Not measured' WHEN headers['{name}'] IS NOT NULL THEN '{yes}' ELSE '{no}' END"


_MS, _KB = "response_ms || ' ms'", "CASE WHEN h.bytes > 0 THEN int(bround(h.bytes / 1024.0)) || ' KB' END"
_HTTP = "size(filter(concat(h.scripts, h.stylesheets, h.iframes, h.image_srcs), x -> startswith(x, 'http://')))"
_NOT_MEASURED_HERE = "'This needs a source outside the site, and it is never estimated.'"
#: In order: panel, label (a fixed value), the value in SQL (null or empty: none), why in SQL, and what stands for no value.
SIGNALS = [
    ("headline", "HTTPS", _is("is_https", "Enabled", "Not enabled"), "''", ""),
    ("headline", "Homepage response time", _MS, "'One request from one place, which is no profile of the site.'", ""),
    ("headline", "Pages crawled", "pages", "''", ""),
    ("headline", "Indexable", "CASE WHEN contains(h.robots, 'noindex') THEN 'No — noindex present' ELSE 'Yes' END", "''", ""),
    ("headline", "XML sitemap", _is("sitemap_found", "Found"), "''", ""),
    ("headline", "robots.txt", _is("robots_found", "Found"), "''", ""),
    ("headline", "Image alt coverage", "CASE WHEN images > 0 THEN int(bround(images_alt / images, 3) * 100) || '% of ' || images || ' images' END", "CASE WHEN images > 0 THEN '' ELSE 'The pages have no images.' END", ""),
    ("headline", "Security headers measured", _is("measured", "Yes", "No"), "''", ""),
    ("headline", "Page HTML size", _KB, "''", ""),
    ("headline", "Google PageSpeed score", "pagespeed || '/100 (mobile)'", f"CASE WHEN pagespeed IS NULL THEN {_NOT_MEASURED_HERE} ELSE '' END", "Not Verified"),
    ("headline", "Backlinks / referring domains / domain authority", "cast(NULL AS string)", _NOT_MEASURED_HERE, "Not Verified"),
    ("headline", "Organic traffic / keyword rankings", "cast(NULL AS string)", _NOT_MEASURED_HERE, "Not Verified"),
    ("technical", "Final URL", "h.url", "''", ""),
    ("technical", "Redirect hops", "redirects", "''", ""),
    ("technical", "Canonical URL", "h.canonical", "CASE WHEN h.canonical = '' THEN 'The homepage names no canonical address.' ELSE '' END", ""),
    ("technical", "Meta robots", "h.robots", "CASE WHEN h.robots = '' THEN 'Without a directive pages are indexed and followed.' ELSE '' END", ""),
    ("technical", "Broken internal links", "broken", "''", ""),
    ("onpage", "Title", "h.title", "CASE WHEN h.title = '' THEN 'The homepage has no title.' ELSE length(h.title) || ' characters' END", ""),
    ("onpage", "Meta description", "h.description", "CASE WHEN h.description = '' THEN 'The homepage has no description.' ELSE length(h.description) || ' characters' END", ""),
    ("onpage", "H1", "concat_ws(', ', h.h1)", "size(h.h1) || ' on the homepage'", ""),
    ("onpage", "Open Graph tags", "concat_ws(', ', array_sort(map_keys(h.og)))", "''", ""),
    ("onpage", "Twitter/X card tags", "concat_ws(', ', array_sort(map_keys(h.twitter)))", "''", ""),
    ("onpage", "Declared language", "h.lang", "''", ""),
    ("local_seo", "LocalBusiness/Organization schema", _is("org"), "''", ""),
    ("local_seo", "Schema contains a postal address", _is("org_address", "Yes", "No"), "''", ""),
    ("local_seo", "Address published on site", _is("address", "Yes"), "''", ""),
    ("local_seo", "Map embed or Google Business Profile link", _is("map"), "''", ""),
    ("local_seo", "Service-area content", _is("area"), "''", ""),
    ("local_seo", "Opening hours", _is("hours", "Published"), "''", ""),
    ("offpage", "Social profiles linked from the site", "CASE WHEN social THEN 'Yes' END", "''", ""),
    ("offpage", "sameAs entries in structured data", "CASE WHEN same_as THEN 'Yes' END", "''", ""),
    ("offpage", "Backlink count", "cast(NULL AS string)", _NOT_MEASURED_HERE, "Not Verified"),
    ("offpage", "Referring domains", "cast(NULL AS string)", _NOT_MEASURED_HERE, "Not Verified"),
    ("offpage", "Domain authority", "cast(NULL AS string)", _NOT_MEASURED_HERE, "Not Verified"),
    ("performance", "Response time", _MS, "''", ""),
    ("performance", "HTML size", _KB, "''", ""),
    ("performance", "Scripts on homepage", "size(h.scripts)", "''", ""),
    ("performance", "Render-blocking scripts", "h.blocking", "''", ""),
    ("performance", "Stylesheets", "size(h.stylesheets)", "''", ""),
    ("performance", "Content-Encoding", "headers['content-encoding']", "CASE WHEN measured AND headers['content-encoding'] IS NULL THEN 'The answer was not compressed.' ELSE '' END", ""),
    ("performance", "Cache-Control", "headers['cache-control']", "''", ""),
    ("accessibility", "Language declared", _is("h.lang <> ''", "Yes", "No"), "''", ""),
    ("accessibility", "<main> landmark", _is("h.has_main", "Present", "Missing"), "''", ""),
    ("accessibility", "Unlabelled form inputs", "unlabelled", "''", ""),
    ("accessibility", "Links with no accessible text", "empty_links", "''", ""),
    ("accessibility", "Colour contrast", "cast(NULL AS string)", "'Contrast cannot be told from markup alone.'", "Not Verified"),
    ("security", "HTTPS", _is("is_https", "Enabled", "Not enabled"), "''", ""),
    ("security", "Strict-Transport-Security", _head("strict-transport-security"), "''", ""),
    ("security", "Content-Security-Policy", _head("content-security-policy"), "''", ""),
    ("security", "X-Content-Type-Options", "headers['x-content-type-options']", "''", ""),
    ("security", "X-Frame-Options", "headers['x-frame-options']", "''", ""),
    ("security", "Referrer-Policy", _head("referrer-policy"), "''", ""),
    ("security", "Permissions-Policy", _head("permissions-policy"), "''", ""),
    ("security", "Mixed content items", f"CASE WHEN startswith(h.url, 'https://') THEN {_HTTP} ELSE 0 END", "''", ""),
    ("ux_conversion", "Mobile viewport", "h.viewport", "CASE WHEN h.viewport = '' THEN 'The homepage has no viewport tag.' ELSE '' END", ""),
    ("ux_conversion", "Tap-to-call on homepage", _is("size(h.tel) > 0"), "''", ""),
    ("ux_conversion", "Mobile navigation pattern", _is("h.has_menu", "Detected", "Not detected"), "''", ""),
    ("ux_conversion", "Contact form", _is("form"), "''", ""),
    ("ux_conversion", "Booking CTA", _is("booking"), "''", ""),
]


def panels(sites: DataFrame) -> DataFrame:
    """Rows (site, place, panel, label, value, missing, reason), one for each of SIGNALS and site of rules.facts().

    value is text; where nothing was measured it says Not Available, or Not Verified for what no page can tell, and missing
    is true. place is the order within the report. A site without headers has its header signals as not measured.
    """
    shared = rules.with_shared(sites)
    rows = []
    for i, (panel, label, value, why, none) in enumerate(SIGNALS):
        of, said = label.replace("'", "\\'"), none or "Not Available"
        rows.append(f"transform(array(nullif(string({value}), '')), v -> struct({i} AS place, '{panel}' AS panel, '{of}' AS label, coalesce(v, '{said}') AS value, v IS NULL AS missing, {why} AS reason))")
    by = {p: [r for r, s in zip(rows, SIGNALS) if s[0] == p] for p in dict.fromkeys(s[0] for s in SIGNALS)}
    # an array for each panel keeps the generated methods small
    parts = shared.select("site", *[F.expr(f"concat({', '.join(r)})").alias(f"_{p}") for p, r in by.items()])
    return parts.select("site", F.explode_outer(F.concat(*[f"_{p}" for p in by])).alias("s")).select("site", "s.*")
