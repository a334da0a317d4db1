"""What audits of the made-up sites of fixture.py find, as SQL over the customers' numbers alone.

Nothing here comes from the code under test: every condition is written out from how the pages are made.
"""

from __future__ import annotations

#: In order: check, code, when it fires, severity, points lost.
_ROWS = [
    ("technical", "no_https", "k % 7 = 0", "'high'", "30"),
    ("technical", "mixed_content", "k % 7 <> 0 AND k % 10 = 0", "'medium'", "12"),
    ("technical", "noindex", "k % 13 = 0", "'high'", "40"),
    ("technical", "missing_title", "k % 11 = 0", "'high'", "18"),
    ("technical", "title_too_short", "k % 11 = 1", "'low'", "6"),
    ("technical", "title_too_long", "k % 11 = 2", "'low'", "3"),
    ("technical", "missing_meta_description", "k % 5 = 0", "'medium'", "14"),
    ("technical", "meta_description_short", "k % 5 = 1", "'low'", "5"),
    ("technical", "missing_h1", "k % 8 = 0", "'medium'", "14"),
    ("technical", "multiple_h1", "k % 8 = 1", "'low'", "4"),
    ("technical", "missing_canonical", "k % 4 = 0", "'low'", "4"),
    ("technical", "missing_lang", "k % 9 = 0", "'low'", "3"),
    ("technical", "missing_sitemap", "k % 3 = 0", "'low'", "6"),
    ("technical", "missing_robots", "k % 4 = 0", "'low'", "3"),
    ("technical", "broken_internal_links", "k % 7 <> 2 AND k % 6 > 0", "CASE WHEN k % 6 >= 3 THEN 'high' ELSE 'medium' END", "least(20, 8 + 4 * (k % 6))"),
    ("technical", "low_alt_coverage", "k % 4 = 1 AND k % 3 <> 0", "'medium'", "8"),
    ("technical", "long_redirect_chain", "k % 5 > 2", "'low'", "4"),
    ("technical", "slow_response", "ms > 1500", "CASE WHEN ms > 4000 THEN 'high' WHEN ms > 2500 THEN 'medium' ELSE 'low' END", "CASE WHEN ms > 4000 THEN 20 WHEN ms > 2500 THEN 14 ELSE 7 END"),
    ("technical", "heavy_page", "k % 1000 = 1", "'medium'", "10"),
    ("technical", "many_scripts", "k % 17 = 0", "'low'", "6"),
    ("technical", "pagespeed_low", "k % 2 = 1 AND speed < 80", "CASE WHEN speed < 40 THEN 'high' WHEN speed < 60 THEN 'medium' ELSE 'low' END", "CASE WHEN speed < 40 THEN 18 WHEN speed < 60 THEN 12 ELSE 6 END"),
    ("mobile", "missing_viewport", "k % 6 = 0", "'high'", "45"),
    ("mobile", "viewport_not_responsive", "k % 6 = 1", "'high'", "25"),
    ("mobile", "zoom_disabled", "k % 6 IN (2, 3)", "'medium'", "10"),
    ("mobile", "fixed_width_layout", "k % 12 IN (0, 1)", "'medium'", "15"),
    ("mobile", "small_mobile_text", "k % 14 = 0", "'low'", "8"),
    ("mobile", "no_mobile_tap_to_call", "k % 3 <> 0", "CASE WHEN tel THEN 'medium' ELSE 'high' END", "CASE WHEN tel THEN 12 ELSE 20 END"),
    ("mobile", "legacy_plugin_content", "k % 15 = 0", "'low'", "6"),
    ("mobile", "no_mobile_menu", "k % 6 = 5", "'medium'", "10"),
    ("conversion", "no_primary_cta_above_fold", "NOT (k % 3 = 0 OR k % 19 = 3 OR (k % 3 = 1 AND (k % 9 = 1 OR k % 7 = 2 OR k % 13 = 5)))", "'high'", "22"),
    ("conversion", "no_phone_cta", "NOT tel", "'high'", "22"),
    ("conversion", "no_contact_form", "k % 5 <> 0", "CASE WHEN NOT tel AND k % 4 <> 0 THEN 'high' ELSE 'medium' END", "15"),
    ("conversion", "no_booking_cta", "NOT (k % 9 = 1 OR k % 7 = 3 OR k % 11 = 5)", "'medium'", "16"),
    ("conversion", "no_quote_cta", "NOT (k % 7 = 2 OR k % 13 = 5)", "'low'", "8"),
    ("conversion", "no_email_cta", "k % 4 <> 0 AND k % 5 <> 0", "'medium'", "10"),
    ("conversion", "no_contact_page", "k % 2 = 1", "'medium'", "12"),
    ("conversion", "weak_cta_language", "k % 18 = 7", "'low'", "6"),
    ("trust", "no_testimonials", "NOT praise", "'high'", "24"),
    ("trust", "reviews_not_structured", "praise AND k % 8 <> 2", "'low'", "5"),
    ("trust", "no_credentials", "k % 3 <> 1", "'medium'", "14"),
    ("trust", "no_portfolio", "k % 5 <> 4", "'medium'", "12"),
    ("trust", "no_about_page", "k % 3 = 1", "'low'", "10"),
    ("trust", "no_social_presence_linked", "NOT social", "'low'", "6"),
    ("contact", "no_phone_on_site", "NOT tel", "'high'", "30"),
    ("contact", "phone_not_on_homepage", "tel AND k % 3 <> 0", "'medium'", "15"),
    ("contact", "no_email_on_site", "k % 4 <> 0 AND k % 2 = 0", "'medium'", "15"),
    ("contact", "no_address", "NOT (k % 5 = 1 OR k % 8 IN (0, 1, 3, 4))", "'medium'", "12"),
    ("contact", "no_opening_hours", "NOT hours", "'low'", "10"),
    ("contact", "contact_hard_to_find", "k % 2 = 1", "'high'", "20"),
    ("content", "very_thin_homepage", "k % 3 = 0", "'high'", "28"),
    ("content", "thin_homepage", "k % 3 = 1", "'medium'", "14"),
    ("content", "services_not_clear", "k % 4 = 1", "'high'", "22"),
    ("content", "generic_value_proposition", "k % 8 = 2", "'medium'", "12"),
    ("content", "no_service_area", "NOT (k % 7 = 5 OR k % 8 = 5 OR k % 6 = 3)", "'low'", "10"),
    ("content", "no_heading_structure", "k % 7 = 6 AND k % 3 <> 0", "'low'", "8"),
    ("content", "minimal_navigation", "k % 6 = 4", "'medium'", "12"),
    ("security", "security_hsts_missing", "measured AND k % 7 <> 0 AND k % 4 >= 2", "'medium'", "12"),
    ("security", "security_frame_protection_missing", "measured AND k % 5 <> 1 AND NOT (k % 6 < 3 AND k % 2 = 0)", "'medium'", "10"),
    ("security", "security_csp_missing", "measured AND k % 6 >= 3", "'low'", "6"),
    ("security", "security_xcto_missing", "measured AND k % 3 <> 1", "'low'", "5"),
    ("security", "security_referrer_policy_missing", "measured AND k % 7 <= 2", "'low'", "4"),
    ("security", "security_server_header_discloses_version", "measured AND k % 8 > 5", "'low'", "4"),
    ("accessibility", "a11y_no_main_landmark", "k % 5 = 2", "'low'", "6"),
    ("accessibility", "a11y_unlabelled_form_inputs", "k % 5 = 0 AND k % 3 > 0", "CASE WHEN k % 3 = 2 THEN 'medium' ELSE 'low' END", "6 + 4 * (k % 3)"),
    ("accessibility", "a11y_empty_links", "k % 3 > 0", "'low'", "3 * (k % 3)"),
    ("accessibility", "a11y_heading_order_skipped", "k % 2 = 0 AND k % 7 = 6", "'low'", "5"),
    ("onpage", "onpage_missing_open_graph", "k % 3 <> 1", "'medium'", "10"),
    ("onpage", "onpage_missing_twitter_card", "k % 4 <> 2", "'low'", "4"),
    ("onpage", "onpage_duplicate_titles", "k % 2 = 0 AND k % 3 <> 1", "'medium'", "10"),
    ("onpage", "onpage_duplicate_meta_description", "k % 4 = 0 AND k % 3 <> 1", "'low'", "5"),
    ("offpage", "offpage_no_social_profiles", "NOT social AND k % 8 <> 4", "'low'", "8"),
    ("offpage", "offpage_sameas_not_structured", "social AND k % 8 <> 4", "'low'", "4"),
    ("performance", "perf_render_blocking_scripts", "k % 17 = 1", "'medium'", "10"),
    ("performance", "perf_no_compression", "measured AND k % 9 <= 4", "'medium'", "8"),
    ("performance", "perf_no_cache_headers", "measured AND (k % 10 <= 3 OR k % 10 > 7)", "'low'", "4"),
    ("local_seo", "local_no_business_schema", "applies AND k % 8 NOT IN (0, 1, 4)", "'high'", "22"),
    ("local_seo", "local_no_address_signal", "applies AND NOT address", "'high'", "20"),
    ("local_seo", "local_address_not_structured", "applies AND k % 5 = 1 AND k % 8 IN (1, 4)", "'low'", "6"),
    ("local_seo", "local_no_map_or_gbp_link", "applies AND k % 9 <> 4", "'medium'", "12"),
    ("local_seo", "local_no_service_area_content", "applies AND NOT area", "'medium'", "12"),
    ("local_seo", "local_no_opening_hours", "applies AND NOT hours", "'low'", "8"),
    ("local_seo", "local_no_reviews_or_testimonials", "applies AND NOT (praise OR k % 8 = 2)", "'medium'", "12"),
    ("local_seo", "local_reviews_not_structured", "applies AND praise AND k % 8 <> 2", "'low'", "5"),
    ("local_seo", "local_name_mismatch", "applies AND (k % 8 = 0 OR k % 8 = 1 AND k % 11 IN (0, 1, 2))", "'low'", "6"),
]
#: CTEs: s has the flags of each made-up site, and f its findings.
FINDINGS = f"""
s0 AS (
  SELECT c_custkey AS k, 'site' || c_custkey || '.test' AS site, c_custkey * 37 % 5000 AS ms, c_custkey * 13 % 100 AS speed FROM customer
), s1 AS (
  SELECT *, k % 3 = 0 OR k % 6 = 4 AS tel, k % 4 = 3 OR k % 5 = 3 AS praise, k % 10 < 5 OR k % 3 <> 1 AS social,
         k % 6 = 2 OR k % 16 = 0 AS hours, k % 5 = 1 OR k % 8 = 0 AS address, k % 8 = 5 OR k % 6 = 3 AS area,
         k % 11 > 1 AND (k % 4 < 2 OR k % 5 = 1 OR k % 6 < 3 OR k % 3 > 0 OR k % 7 > 2 OR k % 8 > 3 OR k % 9 > 4 OR k % 10 > 3) AS measured
  FROM s0
), s AS (
  SELECT *, k % 8 = 0 OR (address)::INT + (k % 9 = 4)::INT + (area)::INT >= 2 AS applies FROM s1
), f0 AS (
  SELECT site, applies AS local_applies, unnest(list_filter([{', '.join(
    f"CASE WHEN {when} THEN {{'seq': {i}, 'code': '{code}', 'check_name': '{check}', 'severity': {severity}, 'deduction': CAST({points} AS INTEGER)}} END"
    for i, (check, code, when, severity, points) in enumerate(_ROWS)
  )}], lambda x: x IS NOT NULL)) AS f FROM s
), f AS (
  SELECT site, local_applies, f.seq AS seq, f.code AS code, f.check_name AS check_name, f.severity AS severity, f.deduction AS deduction FROM f0
)"""
#: Addresses of the made-up sites: on contact pages, in footers (twice, once written out) and in structured data.
EMAILS = """
e AS (
  SELECT c_custkey AS k, 'site' || c_custkey || '.test' AS site FROM customer
), found AS (
  SELECT site, k, 'office@' || site AS email, '/contact' AS path, 'mailto' AS source_type, 'contact' AS page_type, 0.99 AS confidence, TRUE AS is_role, TRUE AS own_domain, 7 AS place FROM e WHERE k % 4 = 0
  UNION ALL SELECT site, k, 'info@' || site, '/', 'footer', 'homepage', round((0.5 + 0.25 * 0.9) * (0.6 + 0.4 * 0.92) + 0.28, 3), TRUE, TRUE, 0 FROM e WHERE k % 8 = 6
  UNION ALL SELECT site, k, 'jane@' || site, '/', 'footer', 'homepage', round((0.5 + 0.25 * 0.9) * (0.6 + 0.4 * 0.92) + 0.22, 3), FALSE, TRUE, 19 FROM e WHERE k % 8 = 6
  UNION ALL SELECT site, k, 'info@roofs-ltd.test', '/', 'jsonld', 'homepage', round((0.5 + 0.25 * 0.95) * (0.6 + 0.4 * 0.92) + 0.06, 3), TRUE, FALSE, 0 FROM e WHERE k % 8 = 1
)"""
CONTACTS = """
SELECT site, CASE WHEN tel THEN '+14155550100' ELSE '' END AS tel, CASE WHEN chat THEN 'https://wa.me/4915112345' || k ELSE '' END AS whatsapp,
       CASE WHEN chat THEN '4915112345' || k ELSE '' END AS whatsapp_numbers,
       CASE WHEN k % 10 < 5 THEN 'https://www.facebook.com/x' || k ELSE '' END || CASE WHEN k % 10 < 5 AND about THEN '|' ELSE '' END
         || CASE WHEN about THEN 'https://www.linkedin.com/company/roofs?x=1' ELSE '' END AS social,
       CASE WHEN about THEN 'https://www.linkedin.com/company/roofs' ELSE '' END AS linkedin,
       CASE WHEN k % 5 = 0 THEN CASE WHEN k % 7 = 0 THEN 'http' ELSE 'https' END || '://' || site || '/' ELSE '' END AS forms,
       CASE WHEN about THEN 'Mary Jones|John Smith' ELSE '' END AS names
FROM (SELECT c_custkey AS k, 'site' || c_custkey || '.test' AS site, c_custkey % 3 = 0 OR c_custkey % 6 = 4 AS tel, c_custkey % 4 = 0 AS chat, c_custkey % 3 <> 1 AS about FROM customer)
WHERE tel OR chat OR k % 10 < 5 OR about OR k % 5 = 0"""

#: The hosts and the structured data of the fixture once more.
HOSTS = """SELECT CASE WHEN k % 14 = 13 THEN '10.0.0.7' ELSE CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'n' || k % 97 || '.' WHEN 2 THEN 'www.n' || k % 89 || '.' ELSE 'a.b.c.' END
  || ['com', 'co.uk', 'test', 'region.test', 'x.region.test', 'city.region.test', 'a.b.region.test', 'b.region.test', 'ck', 'www.ck', 'any.ck', 'CO.UK', 'unknown.'][k % 14 + 1] END AS host
  FROM (SELECT c_custkey AS k FROM customer)"""
STRUCTURED = r"""SELECT k, replace(replace(CASE k % 7 WHEN 0 THEN '{"@type": "Shop", "KEY": "MAIL"}' WHEN 1 THEN '{"a": {"KEY": "MAIL", "b": "x"}, "KEY": {"name": "no"}}'
    WHEN 2 THEN '[{"a": [{"KEY": "MAIL"}, {"KEY": "second"}], "c": 1}]' WHEN 3 THEN '{"@graph": [{"a": {"b": [{"KEY": "MAIL"}]}}, {"KEY": "graph"}]}'
    WHEN 4 THEN '{"a": [[{"b": {"c": {"KEY": "MAIL"}}}]], "KEY": ["in a list"]}' WHEN 5 THEN '{"a": {"b": {"c": {"d": {"e": {"KEY": "MAIL"}}}}}, "text": "\"KEY\": \"no\"", "KEY": null}'
    ELSE '{"KEY": 7, "emails": "no", "z": {"KEY": true}}' END, 'KEY', ['email', 'Email', 'EMAIL'][k % 3 + 1]),
    'MAIL', CASE k % 4 WHEN 0 THEN 'm' || k || '@a.test' WHEN 1 THEN 'm\u0040' || k || '\u00e9' WHEN 2 THEN 'say \"' || k || '\"' ELSE 'a\\' || k || '\/b' END)::JSON AS j
  FROM (SELECT c_custkey AS k FROM customer)"""


def _is(c: str, yes: str = "Present", no: str = "Not found", unknown: str = "Not measured") -> str:
    return f"CASE WHEN {c} THEN '{yes}' WHEN NOT ({c}) THEN '{no}' ELSE '{unknown}' END"


def _head(c: str) -> str:
    return f"CASE WHEN NOT measured THEN 'Not measured' WHEN {c} THEN 'Present' ELSE 'Missing' END"


_N = "(6 * (k % 4 = 1)::INT + (k % 10 = 0)::INT)"
_ALT = "(6 * (k % 4 = 1 AND k % 3 = 0)::INT + (k % 10 = 0)::INT)"
#: In the order of the report: the signal's place, panel, label, value by the number (null: none), and what stands for none.
_SIGNALS = [
    (0, "headline", "HTTPS", _is("k % 7 <> 0", "Enabled", "Not enabled")), (1, "headline", "Homepage response time", "ms || ' ms'"),
    (2, "headline", "Pages crawled", "1 + (k % 2 = 0)::INT + (k % 3 <> 1)::INT + (k % 4 <> 1)::INT + (k % 5 = 3)::INT + (k % 6 = 3)::INT + (k % 7 = 3)::INT"),
    (3, "headline", "Indexable", "CASE WHEN k % 13 = 0 THEN 'No — noindex present' ELSE 'Yes' END"),
    (4, "headline", "XML sitemap", "['Not found', 'Found', 'Not measured'][k % 3 + 1]"), (5, "headline", "robots.txt", "['Not found', 'Found', 'Not measured', 'Not measured'][k % 4 + 1]"),
    (6, "headline", "Image alt coverage", f"CASE WHEN {_N} > 0 THEN CAST(floor(round({_ALT} / {_N}, 3) * 100) AS INT) || '% of ' || {_N} || ' images' END"),
    (7, "headline", "Security headers measured", _is("measured", "Yes", "No")), (9, "headline", "Google PageSpeed score", "CASE WHEN k % 2 = 1 THEN speed || '/100 (mobile)' END", "Not Verified"),
    (10, "headline", "Backlinks / referring domains / domain authority", "NULL", "Not Verified"), (11, "headline", "Organic traffic / keyword rankings", "NULL", "Not Verified"),
    (12, "technical", "Final URL", "CASE WHEN k % 7 = 0 THEN 'http' ELSE 'https' END || '://' || site || '/'"), (13, "technical", "Redirect hops", "k % 5"),
    (14, "technical", "Canonical URL", "CASE WHEN k % 4 > 0 THEN 'https://c.test/' END"), (15, "technical", "Meta robots", "CASE WHEN k % 13 = 0 THEN 'noindex, follow' END"),
    (16, "technical", "Broken internal links", "CASE WHEN k % 7 <> 2 THEN k % 6 END"),
    (17, "onpage", "Title", "CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN 'Short' WHEN 2 THEN rtrim(repeat('Long title ', 8)) ELSE 'Site ' || k || ' repairs of roofs in town' END"),
    (18, "onpage", "Meta description", "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Short text' ELSE 'Site ' || k || ' mends and builds roofs of every kind in all the town' END"),
    (19, "onpage", "H1", "CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN 'One, Two' WHEN 2 THEN 'Welcome' ELSE 'Roofs ' || k END"), (20, "onpage", "Open Graph tags", "CASE WHEN k % 3 = 1 THEN 'title' END"),
    (21, "onpage", "Twitter/X card tags", "CASE WHEN k % 4 = 2 THEN 'card' END"), (22, "onpage", "Declared language", "CASE WHEN k % 9 <> 0 THEN 'en' END"),
    (23, "local_seo", "LocalBusiness/Organization schema", _is("k % 8 IN (0, 1, 4)")), (24, "local_seo", "Schema contains a postal address", _is("k % 8 = 0", "Yes", "No")),
    (25, "local_seo", "Address published on site", _is("address", "Yes")), (26, "local_seo", "Map embed or Google Business Profile link", _is("k % 9 = 4")),
    (27, "local_seo", "Service-area content", _is("area")), (28, "local_seo", "Opening hours", _is("hours", "Published")),
    (29, "offpage", "Social profiles linked from the site", "CASE WHEN social THEN 'Yes' END"), (30, "offpage", "sameAs entries in structured data", "CASE WHEN k % 8 = 4 THEN 'Yes' END"),
    (31, "offpage", "Backlink count", "NULL", "Not Verified"), (32, "offpage", "Referring domains", "NULL", "Not Verified"), (33, "offpage", "Domain authority", "NULL", "Not Verified"),
    (34, "performance", "Response time", "ms || ' ms'"), (36, "performance", "Scripts on homepage", "CASE k % 17 WHEN 0 THEN 30 WHEN 1 THEN 6 ELSE 1 END + (k % 11 = 5)::INT"),
    (37, "performance", "Render-blocking scripts", "CASE WHEN k % 17 = 1 THEN 6 ELSE 0 END"), (38, "performance", "Stylesheets", "0"),
    (39, "performance", "Content-Encoding", "CASE WHEN k % 11 > 1 AND k % 9 > 4 THEN 'gzip' END"), (40, "performance", "Cache-Control", "CASE WHEN k % 11 > 1 AND k % 10 > 7 THEN 'no-store' WHEN k % 11 > 1 AND k % 10 > 3 THEN 'max-age=9' END"),
    (41, "accessibility", "Language declared", _is("k % 9 <> 0", "Yes", "No")), (42, "accessibility", "<main> landmark", _is("k % 5 <> 2", "Present", "Missing")),
    (43, "accessibility", "Unlabelled form inputs", "CASE WHEN k % 5 = 0 THEN k % 3 ELSE 0 END"), (44, "accessibility", "Links with no accessible text", "k % 3"), (45, "accessibility", "Colour contrast", "NULL", "Not Verified"),
    (46, "security", "HTTPS", _is("k % 7 <> 0", "Enabled", "Not enabled")), (47, "security", "Strict-Transport-Security", _head("k % 4 < 2")), (48, "security", "Content-Security-Policy", _head("k % 6 < 3")),
    (49, "security", "X-Content-Type-Options", "CASE WHEN k % 11 > 1 AND k % 3 = 1 THEN 'NoSniff' WHEN k % 11 > 1 AND k % 3 = 2 THEN 'other' END"), (50, "security", "X-Frame-Options", "CASE WHEN k % 11 > 1 AND k % 5 = 1 THEN 'DENY' END"),
    (51, "security", "Referrer-Policy", _head("k % 7 > 2")), (52, "security", "Permissions-Policy", _head("false")), (53, "security", "Mixed content items", "CASE WHEN k % 7 <> 0 AND k % 10 = 0 THEN 1 ELSE 0 END"),
    (54, "ux_conversion", "Mobile viewport", "['', 'width=900', 'width=device-width, user-scalable=no', 'width=device-width, maximum-scale=1.0', 'width=device-width', 'width=device-width'][k % 6 + 1]"),
    (55, "ux_conversion", "Tap-to-call on homepage", _is("k % 3 = 0")), (56, "ux_conversion", "Mobile navigation pattern", _is("k % 2 = 0", "Detected", "Not detected")),
    (57, "ux_conversion", "Contact form", _is("k % 5 = 0")), (58, "ux_conversion", "Booking CTA", _is("k % 9 = 1 OR k % 7 = 3 OR k % 11 = 5")),
]
PANELS = f"WITH {FINDINGS}, v AS (" + " UNION ALL ".join(
    f"SELECT site, {x[0]} AS place, '{x[1]}' AS panel, '{x[2]}' AS label, nullif(CAST({x[3]} AS VARCHAR), '') AS v, '{x[4] if len(x) > 4 else 'Not Available'}' AS none FROM s" for x in _SIGNALS
) + ") SELECT site, place, panel, label, coalesce(v, none) AS value, v IS NULL AS missing FROM v"
