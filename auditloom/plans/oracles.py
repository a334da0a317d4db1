"""The registered queries once more, as SQL over the same tables, for comparison."""

from __future__ import annotations

from auditloom.plans import fixture_sql
from auditloom.plans import sql_values as lx

_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
_SITE = f"regexp_replace({_HOST}, '^(www|m|blog)[.]', '')"


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + _list(values)[1:-1] + ")"


def _unescape(c: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\n\\r]+', ' ', 'g'))"


def _flat(c: str) -> str:
    return _squeeze(_unescape(f"regexp_replace({c}, '<[^>]*>', '', 'g')"))


_TITLE = _flat("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_DROPPED = "(script|style|noscript|template|svg|iframe|title)"
_TEXT = _squeeze(
    _unescape(
        f"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<{_DROPPED}[^>]*>.*?</{_DROPPED}>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g')"
    )
)


def _heads(level: int) -> str:
    return f"list_filter(list_transform(regexp_extract_all(html, '(?is)<h{level}[^>]*>(.*?)</h{level}>', 1), lambda x: {_flat('x')}), lambda x: x <> '')"


_HREFS = "regexp_extract_all(html, '(?i)<a[^>]*\\bhref=\"([^\"]*)\"', 1)"
_LINK_TEXTS = f"list_transform(regexp_extract_all(html, '(?is)<a[^>]*>(.*?)</a>', 1), lambda x: {_flat('x')})"


def _path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


def _normal(u: str) -> str:
    """For absolute http addresses of plain form, as the tables have them."""
    kept = f"array_to_string(list_filter(string_split(regexp_extract({u}, '[?]([^#]*)', 1), '&'), lambda q: q <> '' AND NOT list_contains({_list(lx.TRACKING)}, lower(string_split(q, '=')[1]))), '&')"
    return (
        f"(lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#]*)', 1)) || CASE WHEN {_path(u)} = '' THEN '/' ELSE {_path(u)} END "
        f"|| CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"
    )


def _key(u: str) -> str:
    place = f"replace(lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#:]*)', 1)), 'www.', '')"
    way = f"regexp_replace(regexp_replace(lower({_path(u)}), '/(index|default|home)[.](html|htm|php|aspx|asp)$', '/'), '/+$', '')"
    q = f"lower(regexp_extract({u}, '[?]([^#]*)', 1))"
    return f"({place} || {way} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def _type(u: str, text: str | None = None) -> str:
    words = f"regexp_replace(lower({_path(u)}), '[/_-]', ' ', 'g')"
    cases = f"WHEN lower({_path(u)}) IN ('', '/') THEN 'homepage' "
    for kind, keys in lx.PAGE_TYPES.items():
        any_of = "\\b(" + "|".join(k.replace("-", " ") for k in keys) + ")\\b"
        more = f" OR regexp_matches(lower({text}), '\\b({'|'.join(keys)})\\b') OR regexp_matches(lower({text}), '{any_of}')" if text else ""
        cases += f"WHEN regexp_matches({words}, '{any_of}'){more} THEN '{kind}' "
    blog = f"lower({u})" + (f" || ' ' || lower({text})" if text else "")
    return f"CASE {cases} WHEN regexp_matches({blog}, 'blog|news|article|post') THEN 'blog' ELSE 'other' END"


_SITES = f"SELECT *, {_SITE} AS site FROM pages"
_ALL_LINKS = f"SELECT page_id, url AS base, unnest({_HREFS}) AS href, unnest({_LINK_TEXTS}) AS text, CAST(generate_subscripts({_HREFS}, 1) AS INTEGER) AS pos FROM pages"


def _words(blob: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({blob}, '{w}')" for w in words) + ")"


def _tag(what: str) -> str:
    return f"regexp_matches(html, '(?i){what}')"


def _re(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _findings() -> str:
    cta = lambda ws: _words("cta", ws)
    vp = "lower(regexp_extract(html, '(?i)<meta[^>]*name=\"viewport\"[^>]*content=\"([^\"]*)\"', 1))"
    booking = f"({cta(lx.BOOKING)} OR {_words('blob', lx.BOOKING)} OR list_contains(types, 'booking') OR platform)"
    asks = f"({cta(lx.QUOTE)} OR {_words('blob', lx.QUOTE)} OR {cta(lx.CONSULT)} OR {_words('blob', lx.CONSULT)})"
    praise = f"({_words('blob', lx.TESTIMONIAL)} OR list_contains(types, 'testimonials'))"
    hours = _words("blob", lx.HOURS)
    area = f"({_re('blob', lx.LOCAL_AREA)} OR list_contains(types, 'locations'))"
    strong = lx.BOOKING + lx.QUOTE + lx.CONSULT + lx.STRONG_CTA
    calls = lx.BOOKING + lx.QUOTE + lx.CONSULT + lx.CONTACT
    street = _re("blob", lx.STREET)
    applies = f"(({street})::INT + (gmap)::INT + ({area})::INT >= 2)"
    rows = [
        ("technical", "no_https", "NOT starts_with(url, 'https://')", "high", 30),
        ("technical", "mixed_content", f"starts_with(url, 'https://') AND {_tag('src="http://')}", "medium", 12),
        ("technical", "noindex", _tag('<meta[^>]*name="robots"[^>]*noindex'), "high", 40),
        ("technical", "missing_title", "title = ''", "high", 18),
        ("technical", "title_too_short", "title <> '' AND length(title) < 15", "low", 6),
        ("technical", "title_too_long", "length(title) > 70", "low", 3),
        ("technical", "missing_meta_description", "descr = ''", "medium", 14),
        ("technical", "meta_description_short", "descr <> '' AND length(descr) < 50", "low", 5),
        ("technical", "missing_h1", "h1 = 0", "medium", 14),
        ("technical", "multiple_h1", "h1 > 1", "low", 4),
        ("technical", "missing_canonical", f"NOT {_tag('rel="canonical"')}", "low", 4),
        ("technical", "missing_lang", "lang = ''", "low", 3),
        *[("technical", c, "FALSE", "low", 0) for c in ("missing_sitemap", "missing_robots", "broken_internal_links")],
        ("technical", "low_alt_coverage", "images >= 5", "medium", 8),
        ("technical", "long_redirect_chain", "FALSE", "low", 4),
        ("technical", "slow_response", "FALSE", "low", 7),
        ("technical", "heavy_page", "length(html) > 2500000", "medium", 10),
        ("technical", "many_scripts", "len(regexp_extract_all(html, '(?i)<script[^>]*src=')) > 25", "low", 6),
        ("technical", "pagespeed_low", "FALSE", "low", 6),
        ("mobile", "missing_viewport", f"trim({vp}) = ''", "high", 45),
        ("mobile", "viewport_not_responsive", f"trim({vp}) <> '' AND NOT contains({vp}, 'width=device-width')", "high", 25),
        ("mobile", "zoom_disabled", f"contains(replace({vp}, ' ', ''), 'user-scalable=no')", "medium", 10),
        ("mobile", "fixed_width_layout", "len(regexp_extract_all(html, 'width[ ]*:[ ]*[0-9]{4,5}px')) >= 3", "medium", 15),
        ("mobile", "small_mobile_text", "len(regexp_extract_all(html, 'font-size[ ]*:[ ]*[0-9]px')) >= 3", "low", 8),
        ("mobile", "no_mobile_tap_to_call", "NOT htel", "CASE WHEN tel THEN 'medium' ELSE 'high' END", "CASE WHEN tel THEN 12 ELSE 20 END"),
        ("mobile", "legacy_plugin_content", _tag("<(object|embed|applet)\\b"), "low", 6),
        ("mobile", "no_mobile_menu", f"len({_HREFS}) > 25 AND NOT {_tag('hamburger|mobile-menu|menu-toggle|navbar-toggle|nav-toggle|burger')}", "medium", 10),
        ("conversion", "no_primary_cta_above_fold", f"NOT {_words('lower(substr(text, 1, 1600))', calls)} AND NOT htel AND NOT hmail", "high", 22),
        ("conversion", "no_phone_cta", "NOT tel", "high", 22),
        ("conversion", "no_contact_form", "NOT form", "CASE WHEN NOT tel AND NOT mail THEN 'high' ELSE 'medium' END", 15),
        ("conversion", "no_booking_cta", f"NOT {booking}", "medium", 16),
        ("conversion", "no_quote_cta", f"NOT {asks}", "low", 8),
        ("conversion", "no_email_cta", "NOT mail AND NOT form", "medium", 10),
        ("conversion", "no_contact_page", "NOT list_contains(types, 'contact')", "medium", 12),
        ("conversion", "weak_cta_language", f"list_has_any(ctas, {_list(lx.GENERIC_CTA)}) AND NOT {cta(strong)}", "low", 6),
        ("trust", "no_testimonials", f"NOT {praise}", "high", 24),
        ("trust", "reviews_not_structured", praise, "low", 5),
        ("trust", "no_credentials", f"NOT {_words('blob', lx.CREDENTIAL)}", "medium", 14),
        ("trust", "no_portfolio", f"NOT {_words('blob', lx.PORTFOLIO)}", "medium", 12),
        ("trust", "no_about_page", "NOT list_contains(types, 'about')", "low", 10),
        ("trust", "no_social_presence_linked", "NOT social", "low", 6),
        ("contact", "no_phone_on_site", "NOT tel", "high", 30),
        ("contact", "phone_not_on_homepage", "tel AND NOT htel", "medium", 15),
        ("contact", "no_email_on_site", "NOT mail", "medium", 15),
        ("contact", "no_address", f"NOT {street}", "medium", 12),
        ("contact", "no_opening_hours", f"NOT {hours}", "low", 10),
        ("contact", "contact_hard_to_find", "NOT framed AND NOT list_contains(types, 'contact')", "high", 20),
        ("content", "very_thin_homepage", "words < 120", "high", 28),
        ("content", "thin_homepage", "words BETWEEN 120 AND 299", "medium", 14),
        ("content", "services_not_clear", f"NOT list_contains(types, 'services') AND NOT {_words('blob', lx.SERVICES)}", "high", 22),
        ("content", "generic_value_proposition", f"lower(trim(first_h1)) IN {_in(lx.EMPTY_HEADINGS)}", "medium", 12),
        ("content", "no_service_area", f"NOT {_words('blob', lx.SERVICE_AREA)} AND NOT list_contains(types, 'locations')", "low", 10),
        ("content", "no_heading_structure", "h2 = 0 AND words > 200", "low", 8),
        ("content", "minimal_navigation", f"len(list_distinct({_HREFS})) < 3", "medium", 12),
        *[("security", f"security_{k}", "FALSE", "low", 4) for k in ("hsts_missing", "frame_protection_missing", "csp_missing", "xcto_missing", "referrer_policy_missing", "server_header_discloses_version")],
        ("accessibility", "a11y_no_main_landmark", f"NOT {_tag('<main\\b|role="main"')}", "low", 6),
        ("accessibility", "a11y_unlabelled_form_inputs", "FALSE", "low", 6),
        ("accessibility", "a11y_empty_links", "empty_links > 0", "low", "least(10, 3 * empty_links)"),
        ("accessibility", "a11y_heading_order_skipped", "h3 > 0 AND h2 = 0", "low", 5),
        ("onpage", "onpage_missing_open_graph", f"NOT {_tag('og:(title|description)')}", "medium", 10),
        ("onpage", "onpage_missing_twitter_card", f"NOT {_tag('twitter:card')}", "low", 4),
        ("onpage", "onpage_duplicate_titles", "twice", "medium", 10),
        ("onpage", "onpage_duplicate_meta_description", "descr_twice", "low", 5),
        ("offpage", "offpage_no_social_profiles", "NOT social AND NOT same_as", "low", 8),
        ("offpage", "offpage_sameas_not_structured", "social AND NOT same_as", "low", 4),
        ("performance", "perf_render_blocking_scripts", "len(list_filter(regexp_extract_all(html, '(?i)<script[^>]*src=[^>]*>'), lambda x: NOT regexp_matches(x, 'async|defer|module'))) > 4", "medium", 10),
        ("performance", "perf_no_compression", "FALSE", "medium", 8),
        ("performance", "perf_no_cache_headers", "FALSE", "low", 4),
        ("local_seo", "local_no_business_schema", applies, "high", 22),
        ("local_seo", "local_no_address_signal", f"{applies} AND NOT {street}", "high", 20),
        ("local_seo", "local_address_not_structured", "FALSE", "low", 6),
        ("local_seo", "local_no_map_or_gbp_link", f"{applies} AND NOT gmap", "medium", 12),
        ("local_seo", "local_no_service_area_content", f"{applies} AND NOT {area}", "medium", 12),
        ("local_seo", "local_no_opening_hours", f"{applies} AND NOT {hours}", "low", 8),
        ("local_seo", "local_no_reviews_or_testimonials", f"{applies} AND NOT {praise}", "medium", 12),
        ("local_seo", "local_reviews_not_structured", f"{applies} AND {praise}", "low", 5),
        ("local_seo", "local_name_mismatch", "FALSE", "low", 6),
    ]
    text = lambda x: x if str(x).startswith("CASE") else f"'{x}'"
    structs = ", ".join(
        f"CASE WHEN {cond} THEN {{'seq': {i}, 'code': '{code}', 'check_name': '{check}', 'severity': {text(sev)}, 'deduction': CAST({ded} AS INTEGER)}} END"
        for i, (check, code, cond, sev, ded) in enumerate(rows)
    )
    same_as = _tag('"sameAs"')
    social_links = "facebook[.]com|instagram[.]com|twitter[.]com|x[.]com|linkedin[.]com|youtube[.]com|tiktok[.]com|pinterest[.]com"
    descr = "regexp_extract(html, '(?i)<meta[^>]*name=\"description\"[^>]*content=\"([^\"]*)\"', 1)"
    return f"""
    c AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS ord FROM ({_SITES})),
    pg AS MATERIALIZED (
      SELECT site, ord, url, html, {_TITLE} AS title, {_TEXT} AS text, {descr} AS descr, len({_heads(1)}) AS h1, {_heads(1)}[1] AS first_h1,
             len({_heads(2)}) AS h2, len({_heads(3)}) AS h3, regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1) AS lang,
             {_tag('href="(tel|callto):')} AS htel, {_tag('href="mailto:')} AS hmail, {_tag('<form')} AS hform,
             len(regexp_extract_all(html, '(?i)<img\\b')) AS img, {_LINK_TEXTS} AS texts, {_HREFS} AS hrefs,
             CASE WHEN ord = 1 THEN 'homepage' ELSE {_type('url')} END AS kind FROM c
    ), st AS (
      SELECT site, bool_or(htel) AS tel, bool_or(hmail) AS mail, bool_or(hform) AS form, sum(img) AS images,
             bool_or(regexp_matches(html, '(?is)<(header|footer)[^>]*>.*(tel|mailto):')) AS framed, bool_or({_words('lower(html)', lx.BOOKING_PLATFORMS)}) AS platform,
             bool_or({same_as}) AS same_as, regexp_matches(lower(array_to_string(flatten(list(hrefs)), chr(10))), '{social_links}') AS social,
             count(*) FILTER (descr <> '') > count(DISTINCT lower(trim(descr))) FILTER (descr <> '') AS descr_twice,
             list(DISTINCT kind) AS types, lower(substr(string_agg(text, ' ' ORDER BY ord), 1, 60000)) AS blob,
             list_filter(list_transform(flatten(list(texts)), lambda x: lower(trim(x))), lambda x: length(x) BETWEEN 2 AND 60) AS ctas,
             regexp_matches(array_to_string(flatten(list(hrefs)), chr(10)), '{lx.MAP_LINK}') AS gmap,
             len(list_filter(flatten(list(texts)), lambda x: x = '')) AS empty_links,
             count(*) FILTER (title <> '') > count(DISTINCT lower(title)) FILTER (title <> '') AS twice
      FROM pg GROUP BY site
    ), hs AS (
      SELECT st.*, array_to_string(ctas, chr(10)) AS cta, pg.* EXCLUDE (site, ord),
             len(regexp_extract_all(text, '[^ ]+')) AS words
      FROM st JOIN pg ON pg.site = st.site AND pg.ord = 1
    ), f0 AS (
      SELECT site, {applies} AS local_applies, unnest(list_filter([{structs}], lambda x: x IS NOT NULL)) AS f FROM hs
    ), au AS (SELECT site, {applies} AS local_applies, NULL::INTEGER AS speed FROM hs), f AS (SELECT site, local_applies, f.seq AS seq, f.code AS code, f.check_name AS check_name, f.severity AS severity, f.deduction AS deduction FROM f0)
    """


_F = _findings()
#: The same of the made-up sites.
_X = fixture_sql.FINDINGS + ", au AS (SELECT site, applies AS local_applies, CASE WHEN k % 2 = 1 THEN speed END AS speed FROM s)"
_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_CARD = f"coalesce(map_from_entries([{', '.join(f'{p!r}' for p in lx.CARD)}])[code], check_name)"
_DISPLAY = f"CASE WHEN {_CARD} = 'performance' THEN 'performance' ELSE check_name END"
_PRIORITY = "CASE WHEN severity = 'high' OR deduction >= 20 THEN 'P1' WHEN severity = 'medium' OR deduction >= 10 THEN 'P2' ELSE 'P3' END"


def _health(cat: str, k: str) -> str:
    return f"greatest(0, 100 - coalesce(sum(greatest(0, deduction)) FILTER ({cat} = '{k}'), 0))"


def _even(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS INTEGER)"


_TIER = "CASE " + " ".join(f"WHEN score >= {m} THEN '{n}'" for m, n in lx.TIERS) + " ELSE 'Low' END"
_OPP = (
    "o AS (SELECT *, " + _even("(" + " + ".join(f"(100 - {k}) * {w}" for k, w in lx.WEIGHTS.items()) + f") / {float(sum(lx.WEIGHTS.values()))}")
    + " AS score FROM (SELECT au.site, " + ", ".join(f"CAST({_health('check_name', k)} AS INTEGER) AS {k}" for k in lx.WEIGHTS) + " FROM au LEFT JOIN f ON f.site = au.site GROUP BY au.site))"
)
_KEEP = lambda k: "local" if k == "local_seo" else "TRUE"
def _lost(k: str) -> str:
    return f"coalesce(sum(greatest(0, deduction)) FILTER ({_CARD} = '{k}'), 0)"


_SCORES = (
    "hc AS (SELECT au.site, bool_or(au.local_applies) AS local, "
    + ", ".join(f"CAST({_health(_CARD, k)} AS INTEGER) AS {k}, CAST({_lost(k)} AS INTEGER) AS {k}_lost, CAST(count(code) FILTER ({_CARD} = '{k}') AS INTEGER) AS {k}_n" for k in lx.CARD_WEIGHTS)
    + " FROM au LEFT JOIN f ON f.site = au.site GROUP BY au.site), card AS ("
    + " UNION ALL ".join(
        f"SELECT site, '{k}' AS category, CASE WHEN {_KEEP(k)} THEN {k} END AS score, {_KEEP(k)} AS applicable, CASE WHEN {_KEEP(k)} THEN {w} ELSE 0 END AS weight, "
        f"CASE WHEN {_KEEP(k)} THEN {k}_n ELSE 0 END AS findings, CASE WHEN {_KEEP(k)} THEN {k}_lost ELSE 0 END AS deductions, "
        + "100 - " + _even("(" + " + ".join(f"CASE WHEN {_KEEP(j)} THEN (100 - {j}) * {v} ELSE 0 END" for j, v in lx.CARD_WEIGHTS.items()) + ") / (0.0::DOUBLE + "
        + " + ".join(f"CASE WHEN {_KEEP(j)} THEN {v} ELSE 0 END" for j, v in lx.CARD_WEIGHTS.items()) + ")") + " AS overall FROM hc"
        for k, w in lx.CARD_WEIGHTS.items()
    )
    + ")"
)


def _top(category: str, eligible: str, k: int) -> str:
    o = f"{_RANK}, deduction DESC, seq"
    return f"""
    e AS (SELECT *, {category} AS category FROM f WHERE {eligible}),
    l AS (SELECT *, row_number() OVER (PARTITION BY site, category ORDER BY {o}) = 1 AS lead FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY NOT lead, {o}) AS pick FROM l),
    t AS (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY {_RANK}, deduction DESC, NOT lead, seq) AS INTEGER) AS rank FROM k WHERE pick <= {k})
    """


_PROBLEMS = _top(_DISPLAY, f"deduction > 0 OR code IN {_in(lx.STRONG)}", 7)
_PRIORITIES = _top(_CARD, "deduction > 0", 5)


def _check_rows() -> str:
    out = []
    for check_id, category, codes in lx.CHECKS:
        first = "coalesce(" + ", ".join(f"max(severity) FILTER (code = '{c}')" for c in codes) + ")"
        status = f"CASE WHEN {first} = 'high' THEN 'fail' WHEN {first} IS NOT NULL THEN 'warning' ELSE 'pass' END"
        if category == "local_seo":
            status = f"CASE WHEN bool_or(au.local_applies) THEN {status} ELSE 'not_applicable' END"
        out.append((check_id, category, status))
    out += [(i, c, "'not_verified'") for i, c in lx.NOT_VERIFIED]
    out.append(("core_web_vitals", "performance", "CASE WHEN max(speed) IS NULL THEN 'not_verified' WHEN max(speed) < 40 THEN 'fail' WHEN max(speed) < 80 THEN 'warning' ELSE 'pass' END"))
    return (
        f"ck AS (SELECT au.site, unnest({_list(x[0] for x in out)}) AS check_id, unnest({_list(x[1] for x in out)}) AS category, "
        f"unnest([{', '.join(x[2] for x in out)}]) AS status FROM au LEFT JOIN f ON f.site = au.site GROUP BY au.site)"
    )


def _summary() -> str:
    hurt = " ".join(f"WHEN {_CARD} = '{k}' THEN {i}" for i, k in enumerate(lx.CARD_WEIGHTS))
    counts = ", ".join(f"CAST(count(*) FILTER (status = '{x}') AS INTEGER) AS n_{x}" for x in ("pass", "warning", "fail", "not_verified", "not_applicable"))
    return f"""
    a AS (SELECT *, list_position({_list(lx.CARD_WEIGHTS)}, category) AS place FROM card),
    w AS (SELECT site, max(overall) AS overall,
        coalesce(array_to_string((list(category ORDER BY score DESC, place) FILTER (score >= 85))[1:4], ', '), '') AS working,
        coalesce(array_to_string((list(category ORDER BY score, place) FILTER (score < 70))[1:3], ', '), '') AS weak FROM a GROUP BY site),
    i0 AS (SELECT DISTINCT site, {_CARD} AS category, CASE {hurt} END AS place FROM f WHERE deduction > 0 AND severity <> 'low'),
    i AS (SELECT site, array_to_string((list(category ORDER BY place))[1:3], ', ') AS impacted FROM i0 GROUP BY site),
    n AS (SELECT site, {counts} FROM ck GROUP BY site)
    SELECT w.site, overall, CASE WHEN overall >= 85 THEN 'strong' WHEN overall >= 70 THEN 'fair' WHEN overall >= 50 THEN 'weak' ELSE 'poor' END AS band,
           working, weak, coalesce(impacted, '') AS impacted, n.* EXCLUDE (site)
    FROM w JOIN n ON n.site = w.site LEFT JOIN i ON i.site = w.site"""


def _explained() -> str:
    total = float(sum(lx.WEIGHTS.values()))
    parts = " UNION ALL ".join(
        f"SELECT au.site, '{k}' AS category, {w} AS weight, {i} AS i, CAST({_health('check_name', k)} AS INTEGER) AS health, CAST(count(code) FILTER (check_name = '{k}') AS INTEGER) AS findings, "
        f"CAST(coalesce(sum(greatest(0, deduction)) FILTER (check_name = '{k}'), 0) AS INTEGER) AS deductions FROM au LEFT JOIN f ON f.site = au.site GROUP BY au.site"
        for i, (k, w) in enumerate(lx.WEIGHTS.items())
    )
    return f"""
    x AS (SELECT *, 100 - health AS opportunity, round_even((100 - health) * weight / {total}, 1) AS contribution FROM ({parts}))
    SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY contribution DESC, i) AS INTEGER) AS place, category, weight, health, opportunity, contribution, findings, deductions FROM x"""


_GRADES = [(95, "A+"), (90, "A"), (85, "A\u2212"), (80, "B+"), (75, "B"), (70, "B\u2212"), (65, "C+"), (60, "C"), (55, "C\u2212"), (50, "D+"), (40, "D"), (0, "F")]


def _audit_queries(prefix: str, f: str) -> dict[str, str]:
    """SQL of all queries over findings, whatever they are found in."""
    issues = ", ".join(f"max({c}) FILTER (rank = {i}) AS issue_{i}_{c}" for i in range(1, 6) for c in ("code", "category", "priority", "deduction"))
    out = {
        "findings_all": "SELECT site, seq, code, check_name, severity, deduction FROM f",
        "findings_by_code": "SELECT check_name, code, count(*) AS sites, CAST(sum(deduction) AS BIGINT) AS points FROM f GROUP BY 1, 2",
        "opportunity_score": f", {_OPP} SELECT *, {_TIER} AS tier FROM o",
        "score_explanation": f", {_explained()}",
        "top_problems": f", {_PROBLEMS} SELECT site, rank, code, category, severity, deduction, code IN {_in(lx.STRONG)} AS strong FROM t",
        "top_priorities": f", {_PRIORITIES} SELECT site, rank, code, category, {_PRIORITY} AS priority, deduction FROM t",
        "premium_scorecard": f", {_SCORES} SELECT * FROM card",
        "check_results": f", {_check_rows()} SELECT * FROM ck",
        "check_status_counts": f", {_check_rows()} SELECT site, status, count(*) AS n FROM ck GROUP BY 1, 2",
        "severity_counts": "SELECT au.site, " + ", ".join(f"CAST(count(*) FILTER (severity = '{x}' AND deduction > 0) AS INTEGER) AS {x}" for x in ("high", "medium", "low")) + " FROM au LEFT JOIN f ON f.site = au.site GROUP BY au.site",
        "executive_summary": f", {_SCORES}, {_check_rows()}, {_summary()}",
        "lead_tiers": f""", {_OPP}, {_PROBLEMS}, q AS (SELECT site, count(*) AS problems, count(*) FILTER (code IN {_in(lx.STRONG)}) AS strong FROM t GROUP BY site),
          r AS (SELECT o.site, score, coalesce(problems, 0) AS problems, coalesce(strong, 0) AS strong FROM o LEFT JOIN q ON q.site = o.site)
          SELECT site, score, problems, strong, problems >= 3 AND (strong > 0 OR score >= 40) AS clear,
          CASE WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' WHEN problems = 0 THEN 'D' ELSE 'C' END AS tier FROM r""",
        "export_issue_columns": f", {_PRIORITIES}, p AS (SELECT *, {_PRIORITY} AS priority FROM t) SELECT au.site, {issues} FROM au LEFT JOIN p ON p.site = au.site GROUP BY au.site",
    }
    topic = f"map_from_entries([{', '.join(f'{p!r}' for p in lx.TOPIC)}])[code]"
    out |= {
        "findings_context": f"SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY {_RANK}, deduction DESC, seq) AS INTEGER) AS place, code, {_CARD} AS category, severity, deduction FROM f",
        "category_shares": f", {_SCORES} SELECT site, category, findings, round(100 * findings / nullif(max(findings) OVER w, 0)::DOUBLE, 1) AS percent_of_most, round(100 * findings / nullif(sum(findings) OVER w, 0)::DOUBLE, 1) AS percent_of_all FROM card WINDOW w AS (PARTITION BY site)",
        "report_grades": f", {_SCORES} SELECT site, category, CASE WHEN score IS NULL THEN '' " + " ".join(f"WHEN score >= {a} THEN '{b}'" for a, b in _GRADES) + " END AS grade FROM card",
        "observations": f""", {_PROBLEMS}, tp AS (SELECT site, rank, code, {topic} AS topic FROM t),
          od AS (SELECT * FROM tp WHERE topic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, topic ORDER BY rank) = 1)
          SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY rank) AS INTEGER) AS place, code, topic FROM od QUALIFY row_number() OVER (PARTITION BY site ORDER BY rank) <= 2""",
        "recommended_codes": f", {_PROBLEMS} SELECT site, rank, code AS problem_code, category, severity FROM t",
    }
    return {prefix + k: f"WITH {f} {v}" for k, v in out.items()}


_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_PLAIN = f"(?:^|[^A-Za-z0-9._%+-])({_LOCAL}{{1,64}})@({_LABEL}(?:[.]{_LABEL})+)"
_AT = "\\s*(?:\\[at\\]|\\(at\\)|\\{at\\}|\\s+at\\s+|&#64;|%40)\\s*"
_DOT = "(?:\\s*(?:\\[dot\\]|\\(dot\\)|\\{dot\\})\\s*|\\s+dot\\s+|\\.)"
_HIDDEN = f"(?i)({_LOCAL}{{1,64}}){_AT}((?:[a-z0-9-]{{1,63}}{_DOT})+[a-z]{{2,24}})"
_MAILS = f"""
  c AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_PLAIN}', 1)) AS l, unnest(regexp_extract_all(t, '{_PLAIN}', 2)) AS d FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '{_HIDDEN}', 1)), regexp_replace(unnest(regexp_extract_all(t, '{_HIDDEN}', 2)), '{_DOT}', '.', 'gi') FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
  m AS (SELECT doc_id, lower(regexp_replace(trim(l, '.'), '^-+', '')) AS l, lower(trim(d, '.')) AS d FROM c),
  g AS (SELECT doc_id, l || '@' || d AS email, count(*) AS n FROM m
        WHERE l <> '' AND l NOT IN {_in(lx.JUNK_LOCALS)} AND NOT regexp_matches(l, '^({'|'.join(lx.JUNK_PREFIXES)})') AND NOT regexp_matches(l, '^[0-9a-f]{{16,}}$')
          AND NOT regexp_matches(d, '(^|[.])({'|'.join(x.replace('.', '[.]') for x in lx.JUNK_DOMAINS if not x.startswith('example.'))})$')
          AND split_part(d, '.', -1) NOT IN {_in(lx.FILE_ENDINGS)} AND NOT regexp_matches(d, '[.]([0-9]+|.)$')
        GROUP BY 1, 2)"""
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY site ORDER BY NOT own_domain, place, confidence DESC, email) AS rank FROM found"

ORACLES = {
    "url_normalize": f"SELECT page_id, {_normal('url')} AS normal, {_SITE} AS site FROM pages",
    "url_key_dedup": f"SELECT {_key(_normal('url'))} AS key, count(*) AS n FROM pages GROUP BY 1",
    "registrable_domains": f"SELECT regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1) AS domain, count(*) AS pages, count(DISTINCT {_HOST}) AS hosts FROM pages GROUP BY 1",
    "page_links": f"SELECT page_id, pos, href, lower(base) || href AS target, {_type('base || href', 'text')} AS page_type FROM (SELECT page_id, pos, href, text, regexp_extract(base, '^([A-Za-z]+://[^/?#]+)', 1) AS base FROM ({_ALL_LINKS}))",
    "page_head_facts": f"SELECT page_id, {_TITLE} AS title, regexp_extract(html, '(?i)<html[^>]*\\blang=\"([^\"]*)\"', 1) AS lang, CAST(len({_heads(1)}) AS INTEGER) AS h1, CAST(len({_HREFS}) AS INTEGER) AS links FROM pages",
    "page_text_stats": f"SELECT page_id, CAST(length(t) AS INTEGER) AS chars, CAST(len(regexp_extract_all(t, '[^ ]+')) AS INTEGER) AS words, md5(t) AS digest FROM (SELECT page_id, {_TEXT} AS t FROM pages)",
    "duplicate_titles": f"SELECT site, title, count(*) AS n FROM (SELECT {_SITE} AS site, lower({_TITLE}) AS title FROM pages) WHERE title <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "email_scan": f"WITH {_MAILS} SELECT doc_id, email, n FROM g",
    "email_rank": f"""WITH {_MAILS} SELECT doc_id, email, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(list_position({_list(lx.PREFERRED)}, split_part(email, '@', 1)),
      CASE WHEN split_part(email, '@', 1) IN {_in(lx.ROLES)} THEN 19 ELSE 20 END), n DESC, email) AS INTEGER) AS rank FROM g""",
    "phone_scan": """SELECT doc_id, raw, '+' || regexp_replace(raw, '[^0-9]', '', 'g') AS e164, substr(regexp_replace(raw, '[^0-9]', '', 'g'), 2, 10) AS national, 'valid' AS status
      FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}'))) AS raw FROM documents) WHERE regexp_matches(raw, '^[+]1 [(][2-9]..[)] [2-9]')""",
    "made_up_emails": f"""WITH {fixture_sql.EMAILS}, r AS ({_RANKED}) SELECT site, email, CASE WHEN k % 7 = 0 THEN 'http' ELSE 'https' END || '://' || site || path AS source_url, source_type, page_type,
      CAST(confidence AS DOUBLE) AS confidence, is_role, own_domain, CAST(rank AS INTEGER) AS rank FROM r""",
    "made_up_validation": f"""WITH {fixture_sql.EMAILS}, r AS ({_RANKED}),
      v AS (SELECT *, CASE WHEN NOT own_domain THEN 'unknown' WHEN k % 5 < 2 THEN 'valid_public' WHEN k % 5 = 2 THEN 'domain_valid' WHEN k % 5 = 3 THEN 'invalid' ELSE 'unknown' END AS status FROM r WHERE rank <= 5)
      SELECT site, email, status, CAST(CASE status WHEN 'invalid' THEN 0 WHEN 'unknown' THEN round(0.3 + 0.1 * confidence, 3)
        ELSE round(least(0.99, 0.35 + CASE status WHEN 'valid_public' THEN 0.55 ELSE 0.2 END + 0.1 * confidence + 0.05), 3) END AS DOUBLE) AS valid_confidence,
        status IN ('valid_public', 'mx_valid', 'domain_valid') AS usable FROM v""",
    "made_up_contacts": fixture_sql.CONTACTS,
    "candidate_domains": "SELECT c_custkey, u.url, CAST(u.pos AS INTEGER) AS pos FROM (SELECT c_custkey, list_distinct_keep AS l FROM (SELECT c_custkey, ['https://' || b || '.com', 'https://' || b || '.net', 'https://' || d || '.com', 'https://' || d || '.net'] AS list_distinct_keep FROM (SELECT c_custkey, replace(lower(c_name), '#', '') AS b, replace(lower(c_name), '#', '-') AS d FROM customer))), unnest(l) WITH ORDINALITY AS u(url, pos)",
    "dedup_keep_first": f"SELECT page_id, CASE WHEN min(page_id) OVER (PARTITION BY key) <> page_id THEN min(page_id) OVER (PARTITION BY key) END AS duplicate_of FROM (SELECT page_id, {_SITE} AS key FROM pages)",
    "lead_search": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE (c_name ILIKE '%00001%' OR c_mktsegment ILIKE '%00001%') AND c_acctbal >= 0",
    "lead_page": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 50",
    "lead_status_join": "SELECT c.c_custkey, o.o_orderkey, o.o_orderstatus FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P'",
    "lead_with_items": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "lead_without_items": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "errors_left_join": "SELECT event_id, user_id, coalesce(c_name, '') AS name FROM (SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 1000) LEFT JOIN customer ON c_custkey = user_id",
    "lead_children": "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ' | ' ORDER BY n), '') AS \"values\" FROM customer LEFT JOIN r ON o_custkey = c_custkey AND n <= 3 GROUP BY c_custkey",
    "stats_dimensions": "SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "score_averages": "SELECT count(*) AS leads, count(*) FILTER (c_acctbal >= 7500) AS high, count(DISTINCT c_nationkey) AS nations, CAST(floor(sum(CAST(round(c_acctbal * 100) AS BIGINT)) / count(*)) AS BIGINT) AS mean_cents FROM customer",
    "error_users_top12": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 12",
    "job_progress": "SELECT o_custkey AS job, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed, floor(count(*) FILTER (o_orderstatus = 'F') * 1000 / count(*)) / 10 AS percent FROM orders GROUP BY 1",
    "export_formula_guard": "SELECT doc_id, substr(CASE WHEN substr(text, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || text ELSE text END, 1, 32000) AS cell FROM documents",
    "retention_trim": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 5000",
    "fan_out": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
    "job_transitions": "SELECT event_id, user_id, ts, before AS from_status, event_type AS to_status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type",
    "progress_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2",
    "channel_choice": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'whatsapp' WHEN c_custkey % 3 = 0 THEN 'email' WHEN c_custkey % 5 = 0 THEN 'linkedin' WHEN c_custkey % 2 = 0 THEN 'call' ELSE 'none' END AS channel FROM customer",
    "replace_by_key": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT c_custkey, c_custkey, 'new' FROM customer WHERE c_mktsegment = 'BUILDING'",
}
ORACLES |= _audit_queries("", _F) | _audit_queries("made_up_", _X)

_GRAPH = f"""l AS (SELECT page_id, {_SITE} AS site, {_key(_normal('url'))} AS page_key, href, text, pos, lower(regexp_extract(base, '^([A-Za-z]+://[^/?#]+)', 1)) || href AS url
         FROM (SELECT page_id, base AS url, base, href, text, pos FROM ({_ALL_LINKS}))),
  g AS (SELECT site, page_id, page_key, pos, {_key('url')} AS key, {_type('url', 'text')} AS type FROM l
        WHERE NOT regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '[.](pdf|jpg|jpeg|png|gif|svg|webp|ico|zip|rar|mp4|mp3|avi|mov|docx?|xlsx?|pptx?|css|js|json|xml|woff2?|ttf|eot|dmg|exe)$')
          AND NOT {_words('lower(url)', lx.SKIP_PARTS)})"""
_PRIO = f"coalesce(map_extract_value(MAP {{{', '.join(f"'{a}': {b}" for a, b in lx.PAGE_PRIORITY.items())}}}, type), 20)"


def _crawl(depth: int, fetches: str | None = None, budget: int = 90_000) -> str:
    """st: the states of each site's crawl, a candidate at a time; those with the largest step are how it ends."""
    known = f"LEFT JOIN ({fetches}) ft ON ft.key = g.key" if fetches else ""
    ok, ms = ("coalesce(ft.ok, false)", "coalesce(ft.ms, 0)") if fetches else ("true", "0")
    return f"""{_GRAPH},
      e AS (SELECT site, page_key AS page, list({{'p': {_PRIO}, 'key': g.key, 'type': type, 'ok': {ok}, 'ms': {ms}}} ORDER BY page_id, pos) AS links FROM g {known} GROUP BY 1, 2),
      h AS (SELECT site, min_by(page_key, page_id) AS key FROM g GROUP BY site),
      st AS (
        SELECT site, 0 AS step, []::VARCHAR[] AS have, [g.key] AS seen, [{{'p': 0, 'd': 0, 's': 0, 'key': g.key, 'type': 'homepage', 'ok': true, 'ms': {ms}}}] AS todo,
               []::STRUCT(key VARCHAR, type VARCHAR, depth INTEGER)[] AS taken, 0 AS failed, 0::BIGINT AS ms, 1 AS n FROM h g {known}
        UNION ALL
        SELECT site, step + 1, CASE WHEN fetched AND c.ok THEN list_append(have, c.type) ELSE have END, list_concat(seen, list_transform(found, lambda x: x.key)),
               list_concat(rest, list_transform(found, lambda x, i: {{'p': x.p, 'd': c.d + 1, 's': n + i, 'key': x.key, 'type': x.type, 'ok': x.ok, 'ms': x.ms}})),
               CASE WHEN fetched AND c.ok THEN list_append(taken, {{'key': c.key, 'type': c.type, 'depth': c.d}}) ELSE taken END,
               failed + CASE WHEN fetched AND NOT c.ok THEN 1 ELSE 0 END, ms + CASE WHEN fetched THEN c.ms ELSE 0 END, n + len(found)
        FROM (SELECT *, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: y.key), x.key) = i) AS found FROM (
          SELECT s4.*, list_filter(coalesce(e.links, []), lambda x: NOT list_contains(seen, x.key) AND NOT (x.type IN ('other', 'blog') AND c.d + 1 >= {depth})) AS l FROM (
            SELECT *, c.type = 'other' OR NOT list_contains(have, c.type) AS fetched FROM (
              SELECT *, q[i] AS c, list_concat(q[1:i - 1], q[i + 1:]) AS rest FROM (
                SELECT *, coalesce(list_position(list_transform(q, lambda x: x.p < 10 OR NOT list_contains(have, x.type)), true), 1) AS i FROM (
                  SELECT *, list_sort(todo) AS q FROM st WHERE len(todo) > 0 AND len(taken) < 12 AND ms <= {budget})))) s4
          LEFT JOIN e ON e.site = s4.site AND e.page = c.key AND fetched AND c.ok AND c.d < {depth}))),
      z AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY site ORDER BY step DESC) = 1)"""


def _plan(depth: int) -> str:
    return f"""SELECT site, x.key AS key, x.type AS type, x.depth AS depth, CAST(place - 1 AS INTEGER) AS rank
      FROM (WITH RECURSIVE {_crawl(depth)} SELECT site, unnest(taken) AS x, generate_subscripts(taken, 1) AS place FROM z) WHERE place > 1"""


_FETCHES = "SELECT DISTINCT key, length(key) % 7 <> 3 AS ok, CAST(length(key) * 1237 % 9000 + 500 AS BIGINT) AS ms FROM (SELECT key FROM g UNION ALL SELECT page_key FROM g)"
ORACLES["frontier_plan"] = _plan(2)
ORACLES["frontier_depths"] = " UNION ALL ".join(f"SELECT {d} AS max_depth, * FROM ({_plan(d)})" for d in (1, 3, 5))
ORACLES["crawl_outcome"] = f"""WITH RECURSIVE {_crawl(4, _FETCHES, 20_000)}
  SELECT site, array_to_string(list_transform(taken, lambda x: x.key), ' ') AS taken, CAST(failed AS BIGINT) AS failed, ms, len(todo) > 0 AS exhausted FROM z"""
ORACLES["link_check_sample"] = f"""WITH {_GRAPH}, o AS (SELECT site, key, min((page_id, pos)) AS m FROM g GROUP BY 1, 2),
  c AS (SELECT {_SITE} AS site, {_key(_normal('url'))} AS key FROM pages),
  s AS (SELECT site, key, m[1] AS page_id, m[2] AS pos, CAST(row_number() OVER (PARTITION BY site ORDER BY m[1], m[2], key) AS INTEGER) AS n FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.site = o.site AND c.key = o.key))
  SELECT * FROM s WHERE n <= 12"""

_T = "regexp_replace(code, '^(security|a11y|onpage|offpage|perf|local)_', '')"
_CODE_WORDS = f"upper(substr({_T}, 1, 1)) || replace(substr({_T}, 2), '_', ' ')"
_LABELS = "CASE category WHEN 'technical' THEN 'Technical SEO' WHEN 'onpage' THEN 'On-Page SEO' WHEN 'local_seo' THEN 'Local SEO' WHEN 'offpage' THEN 'Off-Page & Authority' WHEN 'ux_conversion' THEN 'UX & Conversion' ELSE upper(substr(category, 1, 1)) || substr(category, 2) END"
_ISSUES = ", ".join(f"max({c}) FILTER (rank = {i}) AS top_issue_{i}{k}" for i in range(1, 6) for k, c in (("", _CODE_WORDS), ("_category", _LABELS), ("_severity", "upper(severity)")))
_EMPTY = (
    "website_status website_final website_source email_1 email_1_source email_1_status email_2 email_2_source email_2_status phone_normalized phone_country phone_type "
    "whatsapp_reason whatsapp_url linkedin_url opportunity_tier problems recommendations contact_channel_reason whatsapp_message whatsapp_draft_url email_subject "
    "email_message email_draft_url linkedin_message call_notes audit_report_path audit_error processed_at"
).split() + [f"top_issue_{i}{k}" for i in range(1, 6) for k in ("", "_category", "_severity", "_fix")]
ORACLES |= {
    "made_up_issue_texts": f"""WITH {_X}, {_OPP}, pr AS (WITH {_PROBLEMS} SELECT site, string_agg(rank || '. ' || {_CODE_WORDS}, ' | ' ORDER BY rank) AS problems FROM t GROUP BY site),
      ti AS (WITH {_PRIORITIES} SELECT site, {_ISSUES} FROM t GROUP BY site)
      SELECT o.site, score AS website_score, {_TIER} AS opportunity_tier, problems, ti.* EXCLUDE (site) FROM o LEFT JOIN pr ON pr.site = o.site LEFT JOIN ti ON ti.site = o.site""",
    "made_up_report_pages": f"""WITH {_X}, {_SCORES}, {_check_rows()}, p AS (SELECT site, count(*) AS passed FROM ck WHERE status = 'pass' GROUP BY site)
      SELECT card.site, replace(card.site, '.', '-') || '.html' AS name, CAST(count(*) AS INTEGER) AS rows, max(overall) AS overall, CAST(coalesce(max(passed), 0) AS INTEGER) AS passed, 0 AS scripts
      FROM card LEFT JOIN p ON p.site = card.site GROUP BY card.site""",
    "lead_export": "SELECT c_custkey AS row_index, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, '''=' || c_mktsegment AS lead_tier, " + ", ".join(f"'' AS {c}" for c in _EMPTY)
    + """, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 100 AS VARCHAR) ELSE '' END AS website_score, CASE WHEN c_custkey % 3 > 0 THEN 'B' ELSE '' END AS audit_lead_tier,
      CASE c_custkey % 4 WHEN 0 THEN 'WHATSAPP' WHEN 1 THEN 'CALL' ELSE 'SKIP' END AS contact_channel, CAST(round(c_custkey % 7 / 7.0::DOUBLE, 3) AS VARCHAR) AS website_identity_confidence,
      CASE WHEN c_custkey % 3 > 0 THEN 'completed' ELSE 'not_processed' END AS audit_status, c_name AS phone_raw_original, 'unavailable' AS phone_status, 'no_phone' AS whatsapp_status, 'not_checked' AS linkedin_status FROM customer""",
    "lead_orders": "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS score, c_name, c_custkey * 7919 % 1000 AS p FROM customer) " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{n}' AS ordering, c_custkey FROM c ORDER BY {o} LIMIT 20)"
        for n, o in (
            ("score_desc", "score DESC NULLS LAST, c_custkey"), ("score_asc", "score NULLS FIRST, c_custkey"), ("name_asc", "c_name, c_custkey"), ("name_desc", "c_name DESC, c_custkey"),
            ("recent", "p DESC NULLS LAST, c_custkey DESC"), ("row_asc", "c_custkey"),
        )
    ),
    "lead_counts": "SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS total FROM customer WHERE c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 25",
    "lead_detail": "SELECT c_custkey, c_name, (SELECT string_agg(o_orderkey || '/' || o_orderstatus, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = 7) AS orders FROM customer WHERE c_custkey = 7",
    "cascade_delete": "SELECT 'customer' AS \"of\", c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "job_list": """WITH j AS (SELECT o_custkey AS job, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed, epoch(max(o_orderdate)::TIMESTAMP) - epoch(min(o_orderdate)::TIMESTAMP) AS s FROM orders GROUP BY 1),
      r AS (SELECT *, CASE WHEN s > 0 AND done + failed > 0 THEN (done + failed) * 60 / s END AS rate0 FROM j)
      SELECT job, total, done, failed, floor(done * 1000 / total) / 10 AS percent, round(rate0, 4) AS rate, CAST(round((total - done - failed) * 60 / rate0) AS BIGINT) AS eta_seconds FROM r""",
    "order_shares": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
      SELECT o_custkey, o_orderkey, cents, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY cents DESC, o_orderkey) AS INTEGER) AS rank, round(cents / nullif(sum(cents) OVER (PARTITION BY o_custkey), 0)::DOUBLE, 4) AS share FROM o""",
    "drafts_sent": "SELECT o_orderkey, o_custkey AS lead, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1) AS sent_manually FROM orders",
    "events_since": "SELECT event_id, event_type FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 100",
    "events_merged": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type ELSE 'client' END AS event_type FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0 ORDER BY event_id DESC LIMIT 500",
    "formatted_values": """WITH c AS (SELECT c_custkey AS k, c_custkey * c_custkey * c_custkey AS b, c_custkey * 7 AS s, c_name FROM customer)
      SELECT k AS c_custkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN round(b / 1024.0::DOUBLE, 1) || ' KB' WHEN b < 1073741824 THEN round(b / 1048576.0::DOUBLE, 1) || ' MB' ELSE round(b / 1073741824.0::DOUBLE, 1) || ' GB' END AS bytes,
      CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s % 3600 // 60 || 'm' END AS duration,
      strftime(make_timestamp(k * 86461 * 1000000), '%Y-%m-%d %H:%M:%S') AS time, replace(lower(c_name), '#', '-') AS slug FROM c""",
    "whatsapp_status": """SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'no_phone' WHEN c_custkey % 11 = 3 OR c_custkey % 7 = 0 THEN 'invalid_number' WHEN c_custkey % 5 = 0 THEN 'confirmed_on_website'
      WHEN c_custkey % 4 IN (1, 3) THEN 'unlikely' ELSE 'usable_unverified' END AS status FROM customer""",
    "identity_scores": """WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 0.45 WHEN 1 THEN 0.34 / 3 WHEN 2 THEN 0.16 ELSE 0 END + CASE c_custkey % 3 WHEN 0 THEN 0.22 WHEN 1 THEN 0.1 ELSE 0 END
        + CASE c_custkey % 5 WHEN 0 THEN 0.14 WHEN 1 THEN 0.07 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 0.28 ELSE 0 END + CASE WHEN c_custkey % 6 = 0 THEN 0.2 ELSE 0 END
        + CASE WHEN c_custkey % 7 = 0 THEN 0.1 ELSE 0 END + CASE WHEN c_custkey % 11 = 0 THEN 0.05 ELSE 0 END AS c FROM customer),
      r AS (SELECT k, CAST(round(least(1, c), 3) AS DOUBLE) AS confidence FROM s)
      SELECT k AS c_custkey, confidence, CASE WHEN confidence >= 0.8 THEN 'strong_match' WHEN confidence >= 0.55 THEN 'probable_match' WHEN confidence >= 0.3 THEN 'weak_match' ELSE 'no_match' END AS verdict FROM r""",
}
ORACLES |= {
    "industry_phrases": """SELECT DISTINCT c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 'machineries' ELSE lower(c_mktsegment) || ' businesses' END AS phrase FROM customer
      UNION ALL SELECT * FROM (VALUES ('Plumber', 'plumbers'), ('Bakery Services', 'bakeries'), ('Hair Salon | Spa', 'hair salon businesses'), ('Coach', 'coach businesses'), ('Glass', 'glass businesses'), (NULL, 'local businesses'))""",
    "job_newest": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 200",
}
ORACLES["page_parse_full"] = f"""SELECT page_id, {_TITLE} AS title, regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1) AS lang, CAST(len({_heads(1)}) AS INTEGER) AS h1,
  CAST(len(list_filter({_HREFS}, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(#|(mailto|tel|javascript|data|sms|whatsapp|callto):)'))) AS INTEGER) AS links,
  CAST(len(regexp_extract_all({_TEXT}, '[^ ]+')) AS INTEGER) AS words, CAST(len(regexp_extract_all(html, '(?i)<img\\b')) AS INTEGER) AS images,
  CAST(len(list_filter({_LINK_TEXTS}, lambda x: x = '')) AS INTEGER) AS empty_links, CAST(len(list_filter(regexp_extract_all(html, '(?i)<script[^>]*src=[^>]*>'), lambda x: NOT regexp_matches(x, 'async|defer|module'))) AS INTEGER) AS blocking,
  regexp_matches(html, '(?i)<nav\\b') AS has_nav, regexp_matches(html, '(?i)<main\\b|role="main"') AS has_main, md5({_TEXT}) AS digest FROM pages"""

_SAYS = """CASE k % 13 WHEN 0 THEN 'this domain is for sale' WHEN 1 THEN 'buy this domain. coming soon' WHEN 3 THEN 'under construction' WHEN 4 THEN 'site is temporarily unavailable' WHEN 5 THEN 'default web page'
  WHEN 6 THEN 'apache2 ubuntu default page' WHEN 7 THEN 'future home of something quite cool' WHEN 8 THEN 'this domain is parked, buy this domain: the domain is for sale' ELSE '' END"""
_NOTES = ", ".join(f"CASE WHEN contains(t, '{k}') THEN '{v.replace(chr(39), chr(39) * 2)}' END" for k, v in lx.PARKED)
_LENGTH = """CASE k % 13 WHEN 0 THEN 23 WHEN 1 THEN 28 WHEN 2 THEN 18 WHEN 3 THEN 18 WHEN 4 THEN 31 WHEN 5 THEN 16 WHEN 6 THEN 27 WHEN 7 THEN 35 WHEN 8 THEN 62 WHEN 9 THEN 11 WHEN 10 THEN 4011 ELSE 0 END"""
ORACLES["parked_pages"] = f"""WITH r AS (
    SELECT 'page' AS of, page_id AS id, lower(title || ' ' || substr(text, 1, 4000)) AS t, length(text) AS n FROM (SELECT page_id, {_TITLE} AS title, {_TEXT} AS text FROM pages)
    UNION ALL SELECT 'made up', k, CASE WHEN k % 7 = 0 THEN 'welcome to nginx! ' ELSE '' END || {_SAYS}, {_LENGTH} + 5 * (k % 60) - CASE WHEN k % 13 > 10 AND k % 60 > 0 THEN 1 ELSE 0 END FROM (SELECT c_custkey AS k FROM customer)),
  m AS (SELECT of, id, n, array_to_string(list_filter([{_NOTES}], lambda x: x IS NOT NULL), '|') AS notes FROM r)
  SELECT of, id, CASE WHEN notes = '' AND n < 200 THEN 'The page contains almost no content.' ELSE notes END AS notes FROM m"""

_RULES = [*lx.SUFFIXES, "test", "*.region.test", "!city.region.test", "a.b.region.test", "*.ck", "!www.ck"]


def _suffixes(hosts: str, rules: list[str]) -> str:
    """Of each host the rule that counts, found by trying every rule on every host."""
    return f"""WITH h AS (SELECT DISTINCT host, regexp_replace(lower(host), '[.]$', '') AS name FROM ({hosts})),
      r AS (SELECT unnest({_list(rules)}) AS rule),
      m AS (SELECT host, rule, len(string_split(rule, '.')) - CASE WHEN rule[1] = '!' THEN 1 ELSE 0 END AS n FROM h, r
            WHERE regexp_matches('.' || name, '[.]' || replace(replace(ltrim(rule, '!'), '.', '[.]'), '*', '[^.]+') || '$')),
      b AS (SELECT host, arg_max(n, (rule[1] = '!', n)) AS n FROM m GROUP BY host),
      l AS (SELECT h.host, name, string_split(name, '.') AS l, coalesce(n, 1) AS n FROM h LEFT JOIN b ON b.host = h.host)
      SELECT host, CASE WHEN regexp_full_match(name, '[0-9.]*') THEN '' ELSE array_to_string(l[-n:], '.') END AS suffix,
             CASE WHEN regexp_full_match(name, '[0-9.]*') OR n >= len(l) THEN name ELSE array_to_string(l[-n - 1:], '.') END AS domain FROM l"""


ORACLES["public_suffixes"] = _suffixes(f"SELECT {_HOST} AS host FROM pages UNION ALL {fixture_sql.HOSTS}", _RULES)
ORACLES["page_domains"] = f"SELECT page_id, domain FROM pages p JOIN ({_suffixes(f'SELECT {_HOST} AS host FROM pages', lx.SUFFIXES)}) d ON d.host = {_HOST.replace('url', 'p.url')}"
ORACLES["jsonld_emails"] = f"""SELECT k AS page_id, CAST(row_number() OVER (PARTITION BY k ORDER BY id) - 1 AS INTEGER) AS place, atom ->> '$' AS email
  FROM (SELECT s.k, t.id, t.atom FROM ({fixture_sql.STRUCTURED}) s, json_tree(s.j) t WHERE lower(t.key) = 'email' AND t.type = 'VARCHAR')"""

ORACLES["store_commits"] = """WITH l AS (SELECT c_custkey AS lead, CASE WHEN c_custkey % 7 = 0 THEN 'replaced' ELSE c_name END AS value FROM customer WHERE c_custkey % 11 <> 3),
    o AS (SELECT o_custkey AS lead, o_orderkey AS draft, o_orderstatus AS channel, o_orderkey % 5 = 0 AS sent FROM orders WHERE o_custkey % 7 <> 0
          UNION ALL SELECT c_custkey, -c_custkey, 'O', false FROM customer WHERE c_custkey % 7 = 0),
    d AS (SELECT *, channel = 'P' AND lead % 2 = 0 AND NOT bool_or(sent) OVER (PARTITION BY lead, channel) AS again FROM o WHERE lead % 11 <> 3)
  SELECT 'lead' AS of, lead, value, NULL::BIGINT AS draft FROM l
  UNION ALL SELECT 'draft', lead, channel, draft + CASE WHEN again THEN 1000000000 ELSE 0 END FROM d"""
ORACLES["uploads_to_remove"] = "SELECT CAST(trunc(o_totalprice / 100) AS BIGINT) AS upload FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 3 = 0) = 0"

_MORE = "CASE WHEN {n} > 4 THEN ' (+' || ({n} - 4) || ' more)' ELSE '' END"
ORACLES["evidence_lists"] = f"""WITH c AS (SELECT c_custkey AS k FROM customer), r AS (
    SELECT k, 1 AS o, 'broken pages' AS label, array_to_string(list_transform(range(1, least(k % 7 + 1, 4) + 1), lambda i: CASE WHEN i % 3 = 2 THEN 'Page ' || i ELSE '/p' || i END), ', ') || {_MORE.format(n='(k % 7 + 1)')} AS value FROM c WHERE k % 4 > 0
    UNION ALL SELECT k, 2, 'count', CAST(k % 5 AS VARCHAR) FROM c UNION ALL SELECT k, 3, 'found elsewhere', CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END FROM c
    UNION ALL SELECT k, 4, 'score', (k % 9) || '.5' FROM c UNION ALL SELECT k, 5, 'text', repeat('t', CASE k % 3 WHEN 1 THEN 200 ELSE 240 END) FROM c WHERE k % 3 > 0
    UNION ALL SELECT k, 6, 'words', array_to_string(list_transform(range(1, least(k % 6 + 1, 4) + 1), lambda i: repeat('w', least(i * 40, 110))), ', ') || {_MORE.format(n='(k % 6 + 1)')} FROM c
    UNION ALL SELECT k, 7, 'zone', 'last' FROM c)
  SELECT k AS c_custkey, place, label, value FROM (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS INTEGER) AS place FROM r) WHERE place < 6"""

ORACLES["made_up_signal_panels"] = fixture_sql.PANELS

ORACLES["robots_decisions"] = """SELECT 'site' || k AS site, 'https://site' || k || '.test' || p AS url,
    CASE k % 6 WHEN 1 THEN p NOT LIKE '/private%' WHEN 2 THEN p NOT LIKE '/x%' WHEN 5 THEN p NOT LIKE '/private%' OR p LIKE '/private/open%' ELSE true END AS allowed
  FROM (SELECT c_custkey AS k, unnest(['/', '/x/y', '/private', '/private/open?a=1']) AS p FROM customer)"""
ORACLES["phone_layouts"] = """WITH c AS (SELECT c_custkey AS k, c_custkey % 10 AS i, lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS n FROM customer),
    r AS (SELECT *, CASE WHEN i IN (0, 5) THEN '1134960' || n WHEN i IN (1, 4) THEN '4155550' || n WHEN i = 2 THEN '15112345' || n WHEN i = 3 THEN '412345' || n END AS national FROM c)
  SELECT k AS c_custkey, ['GB', 'US', 'DE', 'AU', 'US', NULL, NULL, 'US', 'US', NULL][i + 1] AS home, ['valid', 'valid', 'valid', 'valid', 'valid', 'valid', 'ambiguous_region', 'invalid', 'unparseable', 'empty'][i + 1] AS status,
         ['+44', '+1', '+49', '+61', '+1', '+44'][i + 1] || national AS e164, national, ['GB', 'US', 'DE', 'AU', 'US', 'GB'][i + 1] AS region,
         ['fixed_line', 'fixed_line_or_mobile', 'mobile', 'mobile', 'fixed_line_or_mobile', 'fixed_line'][i + 1] AS line, CASE WHEN i = 4 THEN '12' END AS extension FROM r"""
ORACLES["lead_keys"] = """WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 2 THEN 'place:place' || c_custkey % 40 WHEN 3 THEN 'name:joe ' || c_custkey % 50 || '|leeds' WHEN 4 THEN 'phone:0113' || c_custkey % 60
    ELSE 'site:shop' || c_custkey % 30 || '.co.uk' END AS key FROM customer) SELECT k AS c_custkey, key, min(k) OVER (PARTITION BY key) AS first FROM c"""
ORACLES["website_decisions"] = """WITH c AS (SELECT c_custkey AS k FROM customer), t AS (SELECT k, unnest([1, 2, 3, 4]) AS pos FROM c), s AS (SELECT k, pos, (k * pos * 37) % 100 AS sure FROM t),
    b AS (SELECT * FROM s x WHERE sure >= 55 AND NOT EXISTS (SELECT 1 FROM s y WHERE y.k = x.k AND y.pos < x.pos AND y.sure >= 85) QUALIFY row_number() OVER (PARTITION BY k ORDER BY sure DESC, pos) = 1)
  SELECT c.k AS c_custkey, CASE WHEN c.k % 5 > 2 THEN 'not_found' WHEN c.k % 5 = 2 THEN 'not_a_website' WHEN c.k % 7 = 1 THEN 'blocked' WHEN c.k % 7 = 2 THEN 'unavailable' WHEN c.k % 10 < 2 THEN 'mismatch' WHEN c.k % 3 = 0 THEN 'redirected' ELSE 'valid' END AS status,
         b.pos AS taken FROM c LEFT JOIN b ON b.k = c.k"""
