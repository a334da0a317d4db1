"""Made-up sites, one for each customer, whose markup follows from the customer's number alone.

They let every rule fire for some sites and not for others, at any scale, and SQL can say from the number
what an audit has to find. Each feature depends on the remainder of the number by a small divisor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources.tables import table

TITLE = "CASE k % 11 WHEN 0 THEN '' WHEN 1 THEN 'Short' WHEN 2 THEN repeat('Long title ', 8) ELSE concat('Site ', k, ' repairs of roofs in town') END"
DESCRIPTION = "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'Short text' ELSE concat('Site ', k, ' mends and builds roofs of every kind in all the town') END"
VIEWPORT = "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'width=900' WHEN 2 THEN 'width=device-width, user-scalable=no' WHEN 3 THEN 'width=device-width, maximum-scale=1.0' ELSE 'width=device-width' END"
H1 = "CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN '<h1>One</h1><h1>Two</h1>' WHEN 2 THEN '<h1>Welcome</h1>' ELSE concat('<h1>Roofs ', k, '</h1>') END"
JSONLD = """CASE k % 8
  WHEN 0 THEN concat('{"@type": "LocalBusiness", "name": "Acme', k, ' Co", "address": {"city": "X"}', CASE WHEN k % 16 = 0 THEN ', "openingHours": "Mo-Fr"' ELSE '' END, '}')
  WHEN 1 THEN '{"@type": "Organization", "name": "Roofs Ltd", "email": "info@roofs-ltd.test"}'
  WHEN 2 THEN '{"@graph": [{"@type": ["Review"], "rating": 5}]}'
  WHEN 3 THEN '[{"@type": "PostalAddress"}]'
  WHEN 4 THEN '{"@type": "Organization", "sameAs": ["https://a.test/x"]}'
  ELSE 'no json' END"""
SAYS = {
    "reach us": "k % 19 = 3", "book now": "k % 9 = 1", "free quote": "k % 7 = 2", "discovery call": "k % 13 = 5", "happy customers": "k % 4 = 3",
    "licensed": "k % 3 = 1", "portfolio": "k % 5 = 4", "opening hours": "k % 6 = 2", "what we do": "k % 4 = 2", "serving": "k % 7 = 5",
    "areas we serve": "k % 8 = 5", "12 Main Rose street": "k % 5 = 1",
}


def _if(condition: str, markup: str, other: str = "''") -> str:
    return f"CASE WHEN {condition} THEN {markup} ELSE {other} END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


HOME = [
    "'<!DOCTYPE html><html'", _if("k % 9 <> 0", _q(' lang="en"')), "'><head>'", f"concat('<title>', {TITLE}, '</title>')",
    _if("k % 5 > 0", f"concat('<meta name=\"description\" content=\"', {DESCRIPTION}, '\">')"), _if("k % 13 = 0", _q('<meta name="robots" content="NoIndex, follow">')),
    _if("k % 6 > 0", f"concat('<meta name=\"viewport\" content=\"', {VIEWPORT}, '\">')"), _if("k % 4 > 0", _q('<link rel="canonical" href="https://c.test/">')),
    _if("k % 3 = 1", _q('<meta property="og:title" content="x">')), _if("k % 4 = 2", _q('<meta name="twitter:card" content="summary">')),
    "CASE k % 17 WHEN 0 THEN repeat('<script src=\"/s.js\" defer></script>', 30) WHEN 1 THEN repeat('<script src=\"/s.js\"></script>', 6) ELSE '<script async src=\"/s.js\"></script>' END",
    _if("k % 11 = 5", _q('<script async src="https://calendly.com/x.js"></script>')), _if("k % 12 = 0", _q("<style>p{width:700px} b{min-width: 800px} i{width:900px} u{max-width:950px}</style>")),
    _if("k % 14 = 0", _q("<style>p{font-size:9px} b{font-size: 10.5px} i{font-size:11px}</style>")), f"concat('<script type=\"application/ld+json\">', {JSONLD}, '</script>')",
    "'</head><body>'", _if("k % 3 = 0 AND k % 2 = 0", _q('<header><a href="tel:+14155550100">Ring</a></header>')),
    _if("k % 2 = 0", _q('<div class="hamburger"></div>')), _if("k % 5 <> 2", "'<main>'"), H1, _if("k % 19 = 3", "' reach us '"),
    "repeat('word ', CASE k % 3 WHEN 0 THEN 60 WHEN 1 THEN 200 ELSE 350 END)", _if("k % 7 <> 6", "'<h2>More</h2>'"), _if("k % 2 = 0", "'<h3>Detail</h3>'"),
    *[_if(c, _q(f"<p>{w}</p>")) for w, c in SAYS.items() if w != "reach us"],
    _if("k % 4 = 1", _if("k % 3 = 0", "repeat('<img src=\"/a.png\" alt=\"roof\">', 6)", "repeat('<img src=\"/a.png\">', 6)")), _if("k % 10 = 0", _q('<img alt="x" src="http://x.test/a.png">')),
    _if("k % 12 = 1", "repeat('<table width=\"700\"></table>', 3)"), _if("k % 15 = 0", _q('<object data="x.swf"></object>')),
    "concat_ws('', transform(sequence(1, CASE k % 6 WHEN 5 THEN 30 WHEN 4 THEN 2 ELSE 5 END), i -> concat('<a href=\"/p', i, '\">Link ', i, '</a>')))",
    "repeat('<a href=\"/p1\"></a>', int(k % 3))", _if("k % 18 = 7", _q('<button>Learn more</button>')), _if("k % 3 = 0 AND k % 2 = 1", _q('<p><a href="tel:+14155550100">Ring</a></p>')),
    _if("k % 10 < 5", "concat('<a href=\"https://www.facebook.com/x', k, '\">F</a>')"), _if("k % 9 = 4", _q('<iframe src="https://www.google.com/maps/embed"></iframe>')),
    _if("k % 5 = 0", "concat('<form><label for=\"e\">E</label><input id=\"e\" name=\"email\">', repeat('<input name=\"x\">', int(k % 3)), '<input type=\"submit\" value=\"Post it\"></form>')"),
    _if("k % 7 = 1", _q('<form class="search"><input aria-label="s" name="email"></form>')),
    _if("k % 5 <> 2", "'</main>'"), _if("k % 8 = 6", "concat('<footer>mail info@site', k, '.test or jane [at] site', k, ' [dot] test</footer>')"),
    _if("k % 1000 = 1", "repeat('<!-- filler -->', 170000)"), "'</body></html>'",
]
#: Further pages: path, which sites have it, title, description and what else is on it.
PAGES = [
    ("/contact", "k % 2 = 0", "concat('Same ', k)", "concat('About us all, site ', k)", _if("k % 3 = 1", _q('<a href="tel:+14155550100">Ring</a>')) + ", " + _if("k % 4 = 0", "concat('<a href=\"mailto:Office@site', k, '.test?subject=x\">Write</a><a href=\"https://wa.me/4915112345', k, '\">Chat</a>')")),
    ("/about", "k % 3 <> 1", _if("k % 2 = 0", "concat('Same ', k)", "concat('Other ', k)"), _if("k % 4 = 0", "concat('About us all, site ', k)", "concat('Who is site ', k)"), _q("<h2>Mary Jones</h2><p>Our founder John Smith builds.</p><a href=\"https://www.linkedin.com/company/roofs?x=1\">L</a>")),
    ("/services", "k % 4 <> 1", "concat('Offer ', k)", "''", "''"),
    ("/testimonials", "k % 5 = 3", "concat('Praise ', k)", "''", "''"),
    ("/locations", "k % 6 = 3", "concat('Places ', k)", "''", "''"),
    ("/booking", "k % 7 = 3", "concat('Dates ', k)", "''", "''"),
]


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (page_id, site, url, html): the pages of all made-up sites; the homepage has the smallest page_id.

    Numbers are dealt out before pages are made of them: a file of a few megabytes, one task to read, gives gigabytes of pages.
    """
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    k = k.repartition(4 * spark.sparkContext.defaultParallelism)
    page = lambda i, path, html: f"named_struct('page_id', k * 10 + {i}, 'path', {_q(path)}, 'html', {html})"
    pages = [page(0, "/", f"concat({', '.join(HOME)})")]
    for i, (path, has, title, description, body) in enumerate(PAGES, 1):
        html = f"concat('<html><head><title>', {title}, '</title><meta name=\"description\" content=\"', {description}, '\"></head><body>', {body}, '</body></html>')"
        pages.append(f"CASE WHEN {has} THEN {page(i, path, html)} END")
    rows = k.select("k", F.expr(f"explode(array_compact(array({', '.join(pages)})))").alias("p"))
    return rows.select("p.page_id", F.expr("concat('site', k, '.test')").alias("site"), F.expr("concat(CASE WHEN k % 7 = 0 THEN 'http' ELSE 'https' END, '://site', k, '.test', p.path)").alias("url"), "p.html")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (site, and the columns of rules.META): what a fetch would have measured."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    headers = {
        "strict-transport-security": ("k % 4 < 2", "'max-age=1'"), "x-frame-options": ("k % 5 = 1", "'DENY'"), "content-security-policy": ("k % 6 < 3", _if("k % 2 = 0", "'frame-ancestors x'", "'default-src x'")),
        "x-content-type-options": ("k % 3 > 0", _if("k % 3 = 1", "'NoSniff'", "'other'")), "referrer-policy": ("k % 7 > 2", "'origin'"), "server": ("k % 8 > 3", _if("k % 8 > 5", "'nginx/1.25'", "'nginx'")),
        "content-encoding": ("k % 9 > 4", "'gzip'"), "cache-control": ("k % 10 > 3", _if("k % 10 > 7", "'no-store'", "'max-age=9'")),
    }
    pairs = ", ".join(f"CASE WHEN {has} THEN struct({_q(name)}, {value}) END" for name, (has, value) in headers.items())
    return k.selectExpr(
        "concat('site', k, '.test') AS site", "cast(NULL AS boolean) AS is_https", "CASE k % 4 WHEN 0 THEN false WHEN 1 THEN true END AS robots_found",
        "CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true END AS sitemap_found", "int(k * 37 % 5000) AS response_ms", "int(k % 5) AS redirects",
        "CASE WHEN k % 7 <> 2 THEN int(k % 6) END AS broken", f"CASE WHEN k % 11 > 1 THEN map_from_entries(array_compact(array({pairs}))) END AS headers",
        "CASE WHEN k % 2 = 1 THEN int(k * 13 % 100) END AS pagespeed", "int(k % 2) AS emails",
    )


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (domain, mx, has_a, error): lookups of the sites' domains."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return k.selectExpr(
        "concat('site', k, '.test') AS domain", "CASE WHEN k % 5 < 2 THEN array('mx1.test') ELSE cast(array() AS array<string>) END AS mx", "k % 5 = 2 AS has_a",
        "CASE k % 5 WHEN 3 THEN 'nxdomain' WHEN 4 THEN 'timeout' END AS error",
    )


def placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (of, id, title, text), one for each customer: pages that nobody has built yet, some of them almost empty."""
    says = """CASE k % 13 WHEN 0 THEN 'This Domain is FOR SALE' WHEN 1 THEN 'Buy this domain. Coming soon' WHEN 2 THEN 'Under  construction' WHEN 3 THEN 'under construction'
      WHEN 4 THEN 'Site is temporarily unavailable' WHEN 5 THEN 'Default Web Page' WHEN 6 THEN 'Apache2 Ubuntu Default Page' WHEN 7 THEN 'Future home of something quite cool'
      WHEN 8 THEN 'this domain is parked, buy this domain: the domain is for sale' WHEN 9 THEN 'godaddy.com' WHEN 10 THEN repeat('long ', 800) || 'coming soon' ELSE '' END"""
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_custkey AS k")
    title = "CASE k % 7 WHEN 0 THEN 'Welcome to nginx!' WHEN 1 THEN NULL ELSE 'Title' END"
    return rows.selectExpr("'made up' AS of", "id", f"{title} AS title", f"concat({says}, repeat('  word', int(k % 60)))  AS text")


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (host): a host for each customer, with suffixes of every kind and of one to six labels."""
    ends = ["com", "co.uk", "test", "region.test", "x.region.test", "city.region.test", "a.b.region.test", "b.region.test", "ck", "www.ck", "any.ck", "CO.UK", "unknown.", "10.0.0.7"]
    cases = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ends))
    names = "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN concat('n', k % 97, '.') WHEN 2 THEN concat('www.n', k % 89, '.') ELSE 'a.b.c.' END"
    return table(spark, sf, "customer").selectExpr("c_custkey AS k").selectExpr(f"CASE WHEN k % {len(ends)} = 13 THEN '10.0.0.7' ELSE concat({names}, CASE k % {len(ends)} {cases} END) END AS host")


#: Structured data in which KEY stands for a spelling of the key and MAIL for an address.
STRUCTURED = [
    '{"@type": "Shop", "KEY": "MAIL"}', '{"a": {"KEY": "MAIL", "b": "x"}, "KEY": {"name": "no"}}', '[{"a": [{"KEY": "MAIL"}, {"KEY": "second"}], "c": 1}]',
    '{"@graph": [{"a": {"b": [{"KEY": "MAIL"}]}}, {"KEY": "graph"}]}', '{"a": [[{"b": {"c": {"KEY": "MAIL"}}}]], "KEY": ["in a list"]}',
    '{"a": {"b": {"c": {"d": {"e": {"KEY": "MAIL"}}}}}, "text": "\\"KEY\\": \\"no\\"", "KEY": null}', '{"KEY": 7, "emails": "no", "z": {"KEY": true}}',
]


def structured(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (page_id, html): a page with structured data for each customer."""
    cases = " ".join(f"WHEN {i} THEN r'{x}'" for i, x in enumerate(STRUCTURED))
    key = "CASE k % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'Email' ELSE 'EMAIL' END"
    mail = r"CASE k % 4 WHEN 0 THEN concat('m', k, '@a.test') WHEN 1 THEN concat(r'm\u0040', k, r'\u00e9') WHEN 2 THEN concat(r'say \"', k, r'\"') ELSE concat(r'a\\', k, r'\/b') END"
    json = f"replace(replace(CASE k % {len(STRUCTURED)} {cases} END, 'KEY', {key}), 'MAIL', {mail})"
    return table(spark, sf, "customer").selectExpr("c_custkey AS k").selectExpr("k AS page_id", f"concat('<html><script type=\"application/ld+json\">', {json}, '</script></html>') AS html")


def evidence(k: Column) -> Column:
    """The JSON of a finding's evidence: broken links as objects, plain lists, truths, numbers, nested and empty values."""
    broken = F.transform(F.sequence(F.lit(1), (k % 7).cast("int") + 1), lambda i: F.when(i % 3 == 2, F.concat(F.lit('{"title": "Page '), i.cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"url": "/p'), i.cast("string"), F.lit('", "status": 404}'))))
    words = F.transform(F.sequence(F.lit(1), (k % 6).cast("int") + 1), lambda i: F.concat(F.lit('"'), F.repeat(F.lit("w"), i * 40), F.lit('"')))
    parts = [
        F.concat(F.lit('"broken_pages": ['), F.when(k % 4 > 0, F.array_join(broken, ", ")).otherwise(""), F.lit("]")), F.concat(F.lit('"count": '), (k % 5).cast("string")),
        F.concat(F.lit('"found_elsewhere": '), (k % 2 == 0).cast("string")), F.lit('"inner": {"a": 1}'), F.lit('"nothing": null'), F.concat(F.lit('"score": '), (k % 9).cast("string"), F.lit(".5")),
        F.concat(F.lit('"text": "'), F.repeat(F.lit("t"), (k % 3).cast("int") * 200), F.lit('"')), F.concat(F.lit('"words": ['), F.array_join(words, ", "), F.lit("]")), F.lit('"zone": "last"'),
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def robots(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (site, robots, url): a robots text for each customer, and pages that it may speak of."""
    says = r"""CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'User-agent: *\nDisallow: /private # no\nAllow: /' WHEN 2 THEN 'User-agent: AuditBot\nDisallow: /\n\nUser-agent: *\nDisallow: /x'
      WHEN 3 THEN 'User-agent: auditbot\nUser-agent: other\nDisallow:\n\nUser-agent: *\nDisallow: /' WHEN 4 THEN 'User-agent: other\nDisallow: /' ELSE 'USER-AGENT: *\r\nALLOW: /private/open\r\nDISALLOW: /private' END"""
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS k").selectExpr("concat('site', k) AS site", f"{says} AS robots")
    return rows.selectExpr("*", "explode(array('/', '/x/y', '/private', '/private/open?a=1')) AS way").selectExpr("site", "robots", "concat('https://', site, '.test', way) AS url")


def phones(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (k, raw, country, state, address): a number for each customer in one of ten layouts, and where it is from."""
    n = "lpad(string(k % 1000), 3, '0')"
    raw = f"""CASE k % 10 WHEN 0 THEN concat('0113 496 0', {n}) WHEN 1 THEN concat('(415) 555-0', {n}) WHEN 2 THEN concat('+49 151 12345', {n}) WHEN 3 THEN concat('0412 345 ', {n})
      WHEN 4 THEN concat('415.555.0', {n}, ' ext. 12') WHEN 5 THEN concat('0044 (113) 4960', {n}) WHEN 6 THEN concat('415-555-0', {n}) WHEN 7 THEN '1111111111' WHEN 8 THEN '12' ELSE '  ' END"""
    return table(spark, sf, "customer").selectExpr("c_custkey AS k").selectExpr(
        "k", f"{raw} AS raw", "CASE k % 10 WHEN 0 THEN 'United Kingdom' WHEN 1 THEN 'usa' WHEN 2 THEN 'Germany' WHEN 3 THEN 'AU' END AS country", "CASE k % 10 WHEN 4 THEN 'CA' WHEN 7 THEN 'TX' END AS state",
        "CASE k % 10 WHEN 8 THEN '1 Main St, Austin TX 78701' WHEN 6 THEN 'nowhere' END AS address",
    )


def leads(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (k, website, place_id, business_name, city, phone): leads some of which are the same one."""
    return table(spark, sf, "customer").selectExpr("c_custkey AS k").selectExpr(
        "k", "CASE k % 5 WHEN 0 THEN concat('https://www.shop', k % 30, '.co.uk/about?utm_source=x') WHEN 1 THEN concat('shop', k % 30, '.co.uk') WHEN 2 THEN 'https://www.facebook.com/shop' ELSE 'n/a' END AS website",
        "CASE WHEN k % 5 = 2 THEN concat('  PLACE', k % 40) ELSE '' END AS place_id", "CASE WHEN k % 5 = 3 THEN concat('Joe ', k % 50) END AS business_name", "'Leeds' AS city", "concat('0113 ', k % 60) AS phone",
    )
