"""Column functions and operators on small fixtures, for branches that the tables do not reach."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text, urls
from auditloom.operators import contacts, leads, pages, rules, scoring
from auditloom.plans import registry


def values(spark, column, *inputs, names="x y z"):
    """column over rows of inputs (or of single values)."""
    rows = [i if isinstance(i, tuple) else (i,) for i in inputs]
    schema = ", ".join(f"{n} string" for n in names.split()[: len(rows[0])])
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    return [r[0] for r in df.orderBy("k").select(column).collect()]


def test_normalize_url(spark):
    cases = {
        "example.com": "https://example.com/", "WWW.Example.com": "https://www.example.com/", "HTTP://EXAMPLE.com:80/A": "http://example.com/A",
        "//cdn.example.com/x": "https://cdn.example.com/x", " 'example.co.uk' ": "https://example.co.uk/", "https://a.com/?utm_source=x&b=1&gclid=2#f": "https://a.com/?b=1",
        "n/a": None, "": None, "-": None, "none": None, None: None, "ftp://a.com": None, "localhost": None, "mailto:a@b.com": None, "no website": None,
    }
    assert values(spark, urls.normalize_url(F.col("x")), *cases) == list(cases.values())


def test_domains_and_keys(spark):
    x = F.col("x")
    assert values(spark, urls.registrable_domain(x), "https://shop.a.co.uk/x", "https://a.com.au", "http://u@b.c.example.org:81/") == ["a.co.uk", "a.com.au", "example.org"]
    home = ["https://www.a.com/", "http://a.com", "https://a.com:443/index.html", "HTTPS://A.com/"]
    assert set(values(spark, urls.url_key(x), *home)) == {"a.com"}
    kinds = ["social_profile", "social_profile", "directory_listing", "directory_listing", "link_in_bio", None]
    assert values(spark, urls.profile_kind(x), "https://www.facebook.com/x", "https://wa.me/1", "https://yelp.com/b", "https://joe.business.site/", "https://linktr.ee/j", "https://joe.com/") == kinds
    assert values(spark, urls.is_crawlable(x), "https://a.com/x", "https://a.com/x.PDF", "https://a.com/x.css?v=1", "ftp://a.com/") == [True, False, False, False]
    joined = urls.absolutize(x, F.col("y"))
    base = "https://a.com/d/e/f.html"
    got = values(spark, joined, (base, "../g"), (base, "/h#t"), (base, "i"), (base, "//b.com/j"), (base, "mailto:x@y.z"), (base, "#top"), (base, "../../../k"))
    assert got == ["https://a.com/d/g", "https://a.com/h", "https://a.com/d/e/i", "https://b.com/j", None, None, "https://a.com/k"]


def test_page_types(spark):
    got = values(spark, urls.classify_page(F.col("x"), F.col("y")), ("https://a.com/", ""), ("https://a.com/numbers/allocations/", ""), ("https://a.com/locations", ""), ("https://a.com/x", "Get in touch"), ("https://a.com/contact.html", ""), ("https://a.com/newsroom", ""), ("https://a.com/q", "hm"))
    assert got == ["homepage", "other", "locations", "contact", "contact", "blog", "other"]


def test_names(spark):
    assert values(spark, urls.name_tokens(F.col("x")), "The Smith & Sons Ltd", None) == [["smith", "sons"], []]
    assert values(spark, urls.distinctive_tokens(F.col("x")), "Acme Services", "Services Group") == [["acme"], ["services", "group"]]
    assert values(spark, urls.candidate_domains(F.col("x"), F.col("y")), ("Blue Door", "GB"))[0][:2] == ["https://bluedoor.co.uk", "https://bluedoor.com"]


def test_text(spark):
    x = F.col("x")
    assert values(spark, text.norm_header(x), " Phone_Number. ", "E-Mail/Addr") == ["phone number", "e mail addr"]
    assert values(spark, text.to_float(x), "4,5", "bad", " 3.25 ") == [4.5, None, 3.25]
    assert values(spark, text.to_int(x), "4.5", "-3", "x") == [45, 3, None]
    assert values(spark, text.formula_guard(x), "=1+1", "-x", "plain", None) == ["'=1+1", "'-x", "plain", None]
    assert values(spark, text.percent_encode(x), "a b~*%?\n") == ["a%20b~%2A%25%3F%0A"]
    assert values(spark, text.first_word(x, ["b", "a"]), "xaxb", "c") == ["b", None]


POOR = '<html><head><title>Hi</title></head><body><div style="x" >A</div><h1>Welcome</h1><form><input type="submit" value="Submit"></form></body></html>'
GOOD = (
    '<html lang="en"><head><title>Smith Plumbing and Heating of Leeds</title><meta name="viewport" content="width=device-width, initial-scale=1">'
    '<meta name="description" content="Fast and friendly plumbing and heating work by licensed people in all of Leeds since 1985."><link rel="canonical" href="https://s.co.uk/">'
    '<meta property="og:title" content="Smith"><meta name="twitter:card" content="summary"><script type="application/ld+json">{"@type": "LocalBusiness", "name": "Smith", "address": "1 High Street", "sameAs": ["x"], "openingHours": "Mo"}</script></head>'
    '<body><header><a href="tel:+441130000000">Call us</a></header><main><h1>Smith Plumbing</h1><h2>Our services</h2><p>'
    + "We offer boilers and more. " * 80
    + 'Reviews: happy clients. Fully insured. Our work. Opening hours 9-5. Areas we serve. 12 Park Road.</p><a href="/contact">Contact us</a><a href="/about">About</a><a href="/services">Services</a>'
    '<img src="a.png" alt="a"><a href="https://facebook.com/smith">Facebook</a><form><label for="e">Mail</label><input id="e" type="email" name="email"><textarea name="message" aria-label="m"></textarea></form></main>'
    '<footer><a href="mailto:info@s.co.uk">Mail</a><button>Book now</button></footer></body></html>'
)


@pytest.fixture(scope="module")
def found(spark):
    meta = spark.createDataFrame(
        [("poor", False, False, False, 5000, 4, 3, {"server": "nginx/1.2"}, 30, 0), ("good", True, True, True, 100, 0, 0, None, 95, 1)],
        "site string, " + ", ".join(f"{k} {t}" for k, t in rules.META.items()),
    )
    rows = [("poor", 1, "http://p.com/", POOR), ("good", 1, "https://s.co.uk/", GOOD), ("good", 2, "https://s.co.uk/contact", GOOD), ("good", 3, "https://s.co.uk/about", "<title>About us, Smith of Leeds</title>")]
    pages_ = spark.createDataFrame(rows, "site string, page_id int, url string, html string")
    return rules.audit(rules.facts(pages.parse(pages_), meta)).persist()


def test_rules(found):
    codes = {s: {r["code"]: r for r in rules.findings(found).collect() if r["site"] == s} for s in ("poor", "good")}
    poor = codes["poor"]
    for code in ("no_https", "title_too_short", "missing_meta_description", "missing_viewport", "no_phone_cta", "missing_sitemap", "slow_response", "pagespeed_low", "broken_internal_links",
                 "long_redirect_chain", "security_csp_missing", "security_server_header_discloses_version", "perf_no_compression", "generic_value_proposition", "weak_cta_language", "a11y_no_main_landmark"):
        assert code in poor, code
    assert "security_hsts_missing" not in poor  # only where https is served
    assert poor["broken_internal_links"]["deduction"] == 20 and poor["slow_response"]["severity"] == "high"
    assert set(codes["good"]) <= {"local_no_map_or_gbp_link", "reviews_not_structured", "local_reviews_not_structured", "onpage_duplicate_titles", "onpage_duplicate_meta_description", "a11y_empty_links", "no_quote_cta"}
    assert "onpage_duplicate_titles" in codes["good"] and not any(c.startswith("local_") for c in poor)


def test_scores(spark, found):
    o = {r["site"]: r for r in scoring.opportunity(found).collect()}
    assert o["poor"]["score"] > 60 > 20 > o["good"]["score"] >= 0 and o["good"]["tier"] == "Low"
    points = scoring.explanation(found).groupBy("site").agg(F.sum("contribution").alias("p")).collect()
    assert all(abs(r["p"] - o[r["site"]]["score"]) <= 0.8 for r in points)
    card = scoring.scorecard(found).collect()
    assert [r["score"] for r in card if r["site"] == "poor" and r["category"] == "local_seo"] == [None] and len(card) == 16
    checks = scoring.check_results(found).groupBy("site").count().collect()
    assert {r["count"] for r in checks} == {51}
    top = [r for r in scoring.top_problems(found).orderBy("site", "rank").collect() if r["site"] == "poor"]
    assert [r["rank"] for r in top] == list(range(1, 8)) and len({r["category"] for r in top}) >= 5


def audits(spark, *rows, local=False, speed=False):
    found = "array<struct<seq:int,code:string,check:string,severity:string,deduction:int,evidence:array<struct<name:string,value:string>>>>"
    return spark.createDataFrame([(s, local, speed, f) for s, f in rows], f"site string, local_applies boolean, speed_measured boolean, findings {found}")


def test_a_site_without_findings(spark):
    """It has every score and every check, and nothing else."""
    a = audits(spark, ("clean", []), ("bad", [(20, "pagespeed_low", "technical", "high", 18, []), (3, "missing_title", "technical", "high", 18, [])]), local=True, speed=True)
    scores = {r["site"]: r["score"] for r in scoring.opportunity(a).collect()}
    assert scores["clean"] == 0 and scores["bad"] > 0
    card = [r for r in scoring.scorecard(a).collect() if r["site"] == "clean"]
    assert {r["score"] for r in card} == {100} and {r["overall"] for r in card} == {100} and len(card) == 8
    checks = {(r["site"], r["check_id"]): r["status"] for r in scoring.check_results(a).collect()}
    assert {v for (s, _), v in checks.items() if s == "clean"} == {"pass", "not_verified"} and checks["clean", "core_web_vitals"] == "pass" and checks["bad", "core_web_vitals"] == "fail"
    assert scoring.check_results(audits(spark, ("x", []))).filter("check_id = 'core_web_vitals'").first()["status"] == "not_verified"
    assert scoring.executive_summary(a).filter("site = 'clean'").first()["band"] == "strong"
    tiers = {r["site"]: (r["problems"], r["tier"]) for r in registry.lead_tiers(a).collect()}
    assert tiers["clean"] == (0, "D") and tiers["bad"] == (2, "C")
    assert [r["problem_code"] for r in scoring.recommendations(scoring.top_problems(a)).orderBy("rank").collect()] == ["missing_title", "pagespeed_low"]
    assert scoring.severity_counts(a).filter("site = 'bad'").first()["high"] == 2


def test_every_rule_has_a_card_category_and_advice(spark):
    from auditloom.functions import lexicons as lx

    assert len(rules.RULES) == 84 and len({r[1] for r in rules.RULES}) == 84
    a = audits(spark, ("s", [(i, code, check, "low", 1, []) for i, (check, code, *_) in enumerate(rules.RULES)]))
    cats = a.select(F.explode(F.transform("findings", lambda f: scoring.card_category(f))).alias("c")).distinct().collect()
    assert {r["c"] for r in cats} == set(lx.CARD_WEIGHTS)
    known = {code: check for check, code, *_ in rules.RULES} | {"no_website_detected": "conversion", "social_profile_only": "conversion"}
    assert set(lx.CARD_CATEGORY) <= set(known) and len(lx.CARD_CATEGORY) == 58
    of = a.select(F.explode(F.transform("findings", lambda f: F.struct(f["code"].alias("code"), scoring.card_category(f).alias("c")))).alias("x")).select("x.*").collect()
    assert {r["code"]: r["c"] for r in of} == {c: lx.CARD_CATEGORY.get(c, check) for check, c, *_ in rules.RULES}
    assert {r[1] for r in rules.RULES} <= set(lx.ADVICE)


def test_half_goes_to_even(spark):
    f = audits(spark, ("s", [(0, "x", "technical", "low", 50, []), (1, "y", "conversion", "low", 50, [])]))
    assert scoring.opportunity(f, {"technical": 1, "mobile": 1, "conversion": 2}).first()["score"] == 38  # 37.5
    assert scoring.opportunity(f, {"technical": 1, "mobile": 3}).first()["score"] == 12  # 12.5


def test_lead_tier(spark):
    cases = [("80,1,2,3,1,0", "A+"), ("80,1,1,3,1,0", "A"), ("80,0,2,3,1,0", "B"), ("65,1,0,3,1,0", "B"), ("45,0,0,3,1,0", "C"), ("10,1,0,0,1,0", "D"), ("10,1,0,2,1,0", "C"), (",1,0,0,1,0", "D"), ("90,1,3,5,0,0", "D"), (",1,0,0,0,1", "B"), (",0,0,0,0,1", "D")]
    p = lambda i, t="int": F.nullif(F.split("x", ",")[i], F.lit("")).cast(t)
    b = lambda i: p(i) == 1
    got = values(spark, scoring.lead_tier(p(0), b(1), p(2), p(3), b(4), b(5), F.lit(None).cast("boolean")), *[c for c, _ in cases])
    assert got == [t for _, t in cases]


def test_contacts(spark):
    docs = spark.createDataFrame([(1, "Mail A.b@shop.co.uk, a.b@SHOP.co.uk or info@shop.co.uk; x@example.com logo@2x.png noreply@shop.com 0123456789abcdef0@shop.com enquiry@shop.co.uk"), (2, None)], "doc_id long, text string")
    ranked = contacts.rank_emails(contacts.scan_emails(docs)).orderBy("rank").collect()
    assert [(r["email"], r["n"]) for r in ranked] == [("info@shop.co.uk", 1), ("enquiry@shop.co.uk", 1), ("a.b@shop.co.uk", 2)]
    hidden = spark.createDataFrame([(1, "joe [at] shop (dot) com, ann AT blue-door DOT co DOT uk. Find us at home.")], "doc_id long, text string")
    assert {r["email"] for r in contacts.scan_emails(hidden).collect()} == {"joe@shop.com", "ann@blue-door.co.uk"}
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("string")
    status = [contacts.email_status(*a) for a in ((f, f, t, t, n, t), (t, t, t, t, n, t), (t, f, t, t, n, t), (t, f, t, t, n, f), (t, f, f, t, n, f), (t, f, f, f, F.lit("timeout"), f))]
    assert list(spark.range(1).select(*status).first()) == ["invalid", "risky", "valid_public", "mx_valid", "domain_valid", "unknown"]
    got = values(spark, contacts.linkedin_company(F.col("x")), "https://uk.linkedin.com/Company/acme/about", "https://linkedin.com/in/joe", "x")
    assert got == ["https://www.linkedin.com/company/acme", None, None]
    numbers = spark.createDataFrame([(1, "call (415) 555-2671, +44 20 7946 0958 or 10.20.30.40 on 2020-01-01"), (2, None)], "doc_id long, text string")
    assert {r["e164"] for r in contacts.scan_phones(numbers).collect()} == {"+14155552671", "+442079460958"}


def test_leads(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, "a"), (4, ""), (5, None)], "id long, key string")
    out = {r["id"]: r["duplicate_of"] for r in leads.keep_first(rows, F.col("key"), "id").collect()}
    assert out == {1: None, 2: None, 3: 1, 4: None, 5: None}
    assert values(spark, leads.requeued(F.col("x"), False), "failed", "completed", "running") == ["pending", "completed", "running"]


def test_regions_and_phones(spark):
    from auditloom.functions import phones

    got = values(spark, phones.resolve_region(F.col("x"), F.col("y"), F.col("z")), ("England", "", ""), ("USA", "", ""), ("", "TX", ""), ("", "ON", ""), ("", "", "1 Main St, Austin TX 78701"), ("", "", "Lahore, Pakistan"), ("Nowhere", "", ""))
    assert got == ["GB", "US", "US", "CA", "US", "PK", None]
    p = phones.normalize_phone(F.col("x"), F.col("y"))
    cases = {
        ("+44 7911 123456", ""): ("valid", "+447911123456", "mobile"), ("020 7946 0018", "GB"): ("valid", "+442079460018", "fixed_line"),
        ("(212) 555-2368 ext. 12", "US"): ("valid", "+12125552368", "fixed_line_or_mobile"), ("0061 412 345 678", None): ("valid", "+61412345678", "mobile"),
        ("0300 1234567", "PK"): ("valid", "+923001234567", "mobile"), ("212 555 2368", ""): ("ambiguous_region", None, None),
        ("call", "US"): ("unparseable", None, None), ("", "US"): ("empty", None, None), ("1111111111", "US"): ("invalid", None, None), ("1 416 555 0199", "CA"): ("possible", "+14165550199", None),
    }
    got = values(spark, p, *cases)
    for k, r in zip(cases, got):
        want = cases[k] if k[0] != "1 416 555 0199" else ("valid", "+14165550199", "fixed_line_or_mobile")
        assert (r["status"], r["e164"], r["line"]) == want, k
    assert got[2]["extension"] == "12"


def test_mapping_and_leads(spark, tmp_path):
    from auditloom.operators import ingest
    from auditloom.sources import delimited

    path = tmp_path / "leads.csv"
    path.write_text("﻿Business Name;Phone_Number;Web;Web;Ratng;notes\nAcme;+1 212 555 2368;acme.com;x;4,5;=1+1\n\nBlue \"Door\";;https://www.acme.com/about;y\n\"Two\nlines\";1;;;;;extra;more\n", encoding="utf-8")
    rows = delimited.read_delimited(spark, str(path))
    assert rows.columns == ["Business Name", "Phone_Number", "Web", "Web_1", "Ratng", "notes", "_extra_columns"] and rows.count() == 3
    assert rows.filter("_extra_columns <> ''").first()["_extra_columns"] == "extra | more"
    mapping = ingest.assign(ingest.mapping_scores(rows.drop("_extra_columns")), rows.columns)
    assert mapping["business_name"] == "Business Name" and mapping["phone"] == "Phone_Number" and mapping["website"] == "Web" and mapping["rating"] == "Ratng"
    review = ingest.suggestion(ingest.mapping_scores(rows.drop("_extra_columns")), rows.columns)
    assert review["mapping"] == mapping and not review["missing_required"] and "notes" in review["unmapped"] and review["confidence"]["business_name"] >= 0.7 and set(review["evidence"]) == set(mapping)
    keys = [r["dedup_key"] for r in ingest.typed(rows, mapping).collect()]
    assert keys == ["site:acme.com", "site:acme.com", "name:two lines|"]
    delimited.write_delimited(rows, str(tmp_path / "out"))
    assert "'=1+1" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_discovery(spark):
    from auditloom.operators import discovery as d

    e = values(spark, d.fetch_error(F.col("x").cast("int"), F.col("y")), ("503", ""), ("500", ""), ("404", "text/html"), ("200", "image/png"), ("200", "text/html; x"))
    assert [(r["code"], r["retryable"]) for r in e] == [("blocked", True), ("http_server_error", True), ("http_client_error", False), ("non_html", False), (None, False)]
    who = d.identity(F.lit("Smith & Sons Plumbing Ltd"), F.col("x"), F.col("y"), F.col("z"), F.lit("+44 113 496 0000"), F.lit("LS1 4AP"), F.lit("Leeds"))
    strong, none = values(spark, who, ("smithsonsplumbing.co.uk", "Smith Sons Plumbing", "smith sons plumbing leeds ls1 4ap 0113 496 0000"), ("other.com", "Other", "nothing"))
    assert strong >= 0.8 and none < 0.3
    s = d.website_status(F.col("x"), F.col("y"), F.lit(None).cast("string"), F.col("z").cast("double"))
    got = values(spark, s, ("", "", "0"), ("https://facebook.com/a", "", "0"), ("a.com", "https://a.com/", "0.9"), ("a.com", "https://b.com/", "0.9"), ("a.com", "https://a.com/", "0.1"))
    assert got == ["not_found", "not_a_website", "valid", "redirected", "mismatch"]
    c = spark.createDataFrame([(1, 1, 0.6), (1, 2, 0.9), (1, 3, 0.95), (2, 1, 0.3)], "lead int, pos int, confidence double")
    assert [(r["lead"], r["pos"]) for r in d.best_candidate(c, "lead").collect()] == [(1, 2)]
    assert values(spark, d.sitemap_of(F.col("x")), "User-agent: *\nSitemap: https://a.com/s.xml\n", "none") == ["https://a.com/s.xml", None]
    speed = values(spark, d.page_speed(F.col("x")), '{"lighthouseResult": {"categories": {"performance": {"score": 0.345}}, "audits": {"largest-contentful-paint": {"numericValue": 2510}}}}', "{}")
    assert speed[0]["score"] == 34 and speed[0]["lcp"] == 2.51 and speed[1]["score"] is None
    audits_ = ", ".join(f'"a{i}": {{"title": "T{i}", "details": {{"type": "opportunity", "overallSavingsMs": {100 * i}}}}}' for i in range(12)) + ', "b": {"title": "B", "details": {"type": "table", "overallSavingsMs": 9000}}'
    full = values(spark, d.page_speed(F.col("x")), f'{{"loadingExperience": {{"overall_category": "SLOW"}}, "lighthouseResult": {{"audits": {{{audits_}}}}}}}')[0]
    assert [x["savings_ms"] for x in full["opportunities"]] == [1100, 1000, 900, 800, 700, 600] and full["field_category"] == "SLOW"
    errors = values(spark, d.exception_error(F.col("x"), F.col("y")), ("timeout", ""), ("connect", "SSL: bad certificate"), ("connect", "getaddrinfo failed"), ("connect", "refused"), ("redirects", ""), ("other", ""))
    assert [(r["code"], r["retryable"]) for r in errors] == [("timeout", True), ("ssl_error", False), ("dns_failure", False), ("connection_error", True), ("redirect_loop", False), ("fetch_failed", False)]
    assert values(spark, d.sitemap_found(F.col("x"), F.col("y")), ("Sitemap: https://a.com/s", None), ("", "<urlset>"), ("", "none"), (None, None)) == [True, True, False, False]
    assert values(spark, d.goes_on_to_guesses(F.col("x")), "", "n/a", "a.com") == [True, True, False]


def test_links_keep_their_texts(spark):
    html = "<a name=top>Top</a><abbr>x</abbr><a href='/contact'>Contact us</a><a href=/q>Q</a><article>y</article><a href=\"https://b.com/\">Other</a><a href='javascript:x()'>J</a>"
    from auditloom.operators import frontier

    p = pages.parse(spark.createDataFrame([("a.com", 1, "https://a.com/", html)], "site string, page_id long, url string, html string"))
    rows = frontier.links(p).collect()
    assert [(r["target"], r["text"]) for r in rows] == [("https://a.com/contact", "Contact us"), ("https://a.com/q", "Q"), ("https://b.com/", "Other")]
    assert [r["url"] for r in frontier.edges(frontier.links(p)).collect()] == ["https://a.com/contact", "https://a.com/q"]


def test_frontier_takes_one_page_at_a_time(spark):
    from auditloom.operators import frontier

    graph = spark.createDataFrame([
        ("s", 1, "s", 1, "s/a", "s/a", "other"), ("s", 1, "s", 2, "s/b", "s/b", "about"), ("s", 1, "s", 3, "s", "s", "homepage"), ("s", 2, "s/a", 1, "s/c", "s/c", "contact"), ("s", 2, "s/a", 2, "s/d", "s/d", "other"),
        ("s", 2, "s/a", 3, "s/b2", "s/b2", "about"), ("s", 3, "s/c", 1, "s/e", "s/e", "team"),
    ], "site string, page_id long, page_key string, pos int, url string, key string, type string")
    plan = frontier.frontier(graph).orderBy("rank").collect()
    assert [(r["key"], r["depth"]) for r in plan] == [("s/b", 1), ("s/a", 1), ("s/c", 2)]
    (deep,) = frontier.crawl(graph, max_depth=3).collect()
    assert [x["key"] for x in deep["taken"]] == ["s", "s/b", "s/a", "s/c", "s/e", "s/d"] and not deep["exhausted"]
    few = spark.createDataFrame([("s", True, 900), ("s/b", False, 2000), ("s/a", True, 50), ("s/c", True, 1)], "key string, ok boolean, ms int")
    for most, budget, want, lost, left in ((12, 90_000, ["s", "s/a", "s/c"], 2, False), (2, 90_000, ["s", "s/a"], 1, True), (12, 1_000, ["s"], 1, True), (12, 2_940, ["s", "s/a"], 1, True)):
        (r,) = frontier.crawl(graph, few, max_pages=most, budget_ms=budget).collect()
        assert [x["key"] for x in r["taken"]] == want and r["failed"] == lost and r["exhausted"] == left
    assert frontier.crawl(graph.limit(0)).count() == 0
    sample = frontier.link_sample(graph, spark.createDataFrame([("s", "s"), ("s", "s/a")], "site string, key string"))
    assert [r["key"] for r in sample.orderBy("n").collect()] == ["s/b", "s/c", "s/d", "s/b2", "s/e"]
    fetches = spark.createDataFrame([("s/b", 404, None), ("s/c", 403, None), ("s/d", None, "dns_failure"), ("s/e", 200, None)], "key string, status int, error string")
    assert {r["key"] for r in frontier.broken(sample, fetches).collect()} == {"s/b", "s/d"}


def test_robots_and_fallback(spark):
    from auditloom.operators import frontier

    text_ = "User-agent: a\nUser-agent: *\nDisallow: /private # no\nAllow: /\n\nUser-agent: bot\nDisallow: /x\nDisallow:\n"
    found = frontier.robots_rules(spark.createDataFrame([("s", text_), ("t", None)], "site string, robots string"))
    got = {(r["agent"], r["allow"], r["prefix"]) for r in found.collect()}
    assert got == {("a", False, "/private"), ("*", False, "/private"), ("a", True, "/"), ("*", True, "/"), ("bot", False, "/x"), ("bot", True, "")}
    urls_ = spark.createDataFrame([("s", "https://s.com/private/1"), ("s", "https://s.com/"), ("t", "https://t.com/private")], "site string, url string")
    assert [r["allowed"] for r in frontier.robots_allowed(urls_, found, "a").orderBy("url").collect()] == [True, False, True]
    # an agent that is not named has the rules of all, and one whose group allows all has no others
    assert [r["allowed"] for r in frontier.robots_allowed(urls_, found, "other").orderBy("url").collect()] == [True, False, True]
    free = frontier.robots_rules(spark.createDataFrame([("s", "User-agent: x\nDisallow:\n\nUser-agent: *\nDisallow: /")], "site string, robots string"))
    assert [[r["allowed"] for r in frontier.robots_allowed(urls_, free, a).orderBy("url").collect()] for a in ("x", "y")] == [[True] * 3, [False, False, True]]
    starts = spark.createDataFrame([("s", "https://s.com/"), ("t", "https://t.com/")], "site string, url string")
    fetches = spark.createDataFrame([("https://s.com/", None, "ssl_error"), ("http://s.com/", 200, None), ("https://t.com/", 500, None)], "url string, status int, error string")
    out = {r["site"]: (r["url"], r["status"], r["https_unavailable"]) for r in frontier.with_fallback(starts, fetches).collect()}
    assert out == {"s": ("http://s.com/", 200, True), "t": ("https://t.com/", 500, False)}


def test_workbooks_and_archives(spark, tmp_path):
    import io
    import zipfile

    from auditloom.sources import delimited, office

    rows = spark.createDataFrame([(1, "a & <b>", 2.5, True, None), (2, "=1+1", 3.0, False, "é")], "id int, name string, x double, ok boolean, y string").coalesce(1)
    assert office.save(office.workbooks(rows, 2, [("id", "number")]), str(tmp_path / "books"), ".xlsx") == 1
    back = office.read_excel(spark, str(tmp_path / "books")).collect()
    assert [tuple(r) for r in back] == [("1", "a & <b>", "2.5", "TRUE", "", ""), ("2", "'=1+1", "3", "FALSE", "é", "")]
    assert [r["name"] for r in office.history(spark, str(tmp_path / "books")).collect()] == ["part-00001.xlsx"]
    made = office.archives(spark.createDataFrame([(f"{i}.html", "x") for i in range(5)], "name string, text string").coalesce(1), 2).collect()
    assert [r["n"] for r in made] == [2, 2, 1] and zipfile.ZipFile(io.BytesIO(made[0]["content"])).namelist() == ["0.html", "1.html"]
    (tmp_path / "wide.csv").write_text("a,b\n1" + ",x" * 60 + "\n\n2\n")
    wide = delimited.read_delimited(spark, str(tmp_path / "wide.csv")).collect()
    assert [tuple(r) for r in wide] == [("1", "x", " | ".join(["x"] * 59)), ("2", "", "")]
    assert delimited.dialect("a;b\n“x”;2\n".encode("cp1252")) == ("windows-1252", ";") and delimited.dialect("a\tb\n".encode("utf-16"))[0] == "UTF-16"


def test_reports_and_drafts(spark, found):
    from auditloom.operators import discovery, reports

    page = {r["site"]: r["text"] for r in reports.reports(found).collect()}
    assert "<ol><li>" in page["poor"] and "P1" in page["poor"] and "<script" not in page["poor"] and "/100" in page["good"]
    seen = reports.observations(scoring.top_problems(found))
    made = reports.drafts(seen, F.upper("site"), {"sender_name": "Ann", "offer": "I mend sites"}).filter("site = 'poor'").collect()
    assert {(r["channel"], r["variant"]) for r in made} == {("email", "initial"), ("email", "follow_up"), ("whatsapp", "initial"), ("whatsapp", "follow_up"), ("linkedin", "initial"), ("call", "initial")}
    mail = next(r for r in made if r["channel"] == "email" and r["variant"] == "initial")
    assert "POOR" in mail["subject"] and mail["message"].endswith("Ann") and "I mend sites" in mail["message"] and len(mail["based_on"]) == 2
    with pytest.raises(ValueError, match="offer"):
        reports.drafts(seen, F.col("site"), {"sender_name": "Ann"})
    rows = found.select(F.explode("findings").alias("f")).filter("f.code = 'no_mobile_tap_to_call'").select(scoring.evidence_rows(F.col("f.evidence")).alias("e")).collect()
    assert [tuple(x) for x in rows[0]["e"]] == [("pages", "1"), ("found elsewhere", "No")]
    assert values(spark, reports.mail_link(F.col("x"), F.lit("a b"), F.lit("c&d")), "j@s.com", "") == ["mailto:j@s.com?subject=a%20b&body=c%26d", None]
    sale, empty = "The domain appears to be listed for sale.", "The page contains almost no content."
    assert values(spark, discovery.parked(F.col("x"), F.col("y")), ("This domain is for sale", ""), ("", "x" * 300), (None, None), ("a", "y" * 4000 + "coming soon")) == [[sale], [], [empty], []]
    direct = values(spark, discovery.direct(F.col("x"), F.col("y"), F.lit(None).cast("string")), ("a.com", "https://a.com/"), ("a.com", "https://b.com/"))
    assert [(r["status"], r["verdict"]) for r in direct] == [("valid", "explicit_url"), ("redirected", "explicit_url")]
    assert len(set(values(spark, reports.pick(F.col("x"), ["a", "b"]), *map(str, range(20))))) == 2


def test_very_many_pages_of_a_site(spark, monkeypatch):
    """A site of 100000 pages gathers under twice the characters that the rules look at, the first of them in page order."""
    kept = []
    real = rules._by_range
    monkeypatch.setattr(rules, "_by_range", lambda *a: kept.append(real(*a)) or kept[-1])
    html = "concat('<html><body><h1>Page</h1>text of page ', 100000 - id, repeat(' and more', int(id % 3)), '</body></html>')"
    site = spark.range(100_000).selectExpr("if(id % 50000 = 7, 'small', 'large') as site", "100000 - id as page_id", "concat('https://x.test/', id) as url", f"{html} as html")
    out = {r["site"]: r for r in rules.facts(pages.parse(site.repartition(8))).select("site", "pages", "blob").collect()}
    size = {r["site"]: r["n"] for r in kept[0].groupBy("site").agg(F.sum(F.length("lead")).alias("n")).collect()}
    assert out["large"]["pages"] == 99_998 and size["large"] < 2 * pages.LEAD
    texts = [f"page text of page {p}" + " and more" * ((100_000 - p) % 3) for p in range(1, 4_000) if (100_000 - p) % 50_000 != 7]
    assert out["large"]["blob"] == " ".join(texts)[: pages.LEAD]
    assert out["small"]["blob"].startswith("page text of page 49993")


def test_public_suffix_rules(spark):
    from auditloom.operators import domains

    rules_ = spark.createDataFrame([(r,) for r in ("com", "co.uk", "*.ck", "!www.ck", " CO.UK ", "*", None, "")], "rule string")
    want = {
        "a.b.com": ("com", "b.com"), "com": ("com", "com"), "x.co.uk": ("co.uk", "x.co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "y.x.any.ck": ("any.ck", "x.any.ck"), "any.ck": ("any.ck", "any.ck"),
        "ck": ("ck", "ck"), "a.www.ck": ("ck", "www.ck"), "www.ck": ("ck", "www.ck"), "n.other": ("other", "n.other"), "10.0.0.1": ("", "10.0.0.1"), "": ("", ""), "X.COM.": ("COM", "X.COM"),
    }
    hosts = spark.createDataFrame([(h,) for h in [*want, None, "com"]], "host string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in domains.suffixes(hosts, rules_).collect()}
    assert got == {h: (s.lower(), d.lower()) for h, (s, d) in want.items()}
    rows = spark.createDataFrame([(1, "https://a.b.com/x"), (2, None), (3, "no url")], "domain int, url string")
    assert {r["url"]: r["domain"] for r in domains.with_domains(rows, rules_).collect()} == {"https://a.b.com/x": "b.com", None: "", "no url": ""}
    assert domains.suffixes(hosts.limit(0), rules_).count() == 0 and domains.suffixes(hosts, rules_.limit(0)).filter("host = 'x.co.uk'").first()["domain"] == "co.uk"


def test_addresses_in_structured_data():
    found = pages.read_html('<script type="application/ld+json">{"email": ["a"], "a": {"EMAIL": "x\\u0040y"}, "b": [[{"email": "q\\"z"}], {"Email": 7, "email": "l"}]}</script>')
    assert found["jsonld_emails"] == ["x@y", 'q"z', "l"]
    deep = '{"a": ' * 400 + '{"email": "d"}' + "}" * 400
    assert pages.read_html(f'<script type="application/ld+json">{deep}</script>')["jsonld_emails"] == ["d"]


def test_observations_say_what_was_measured(spark):
    """Each code has a wording, with its measure where there is one and without it elsewhere; topics are not repeated."""
    from auditloom.functions import lexicons as lx
    from auditloom.operators import reports

    assert set(lx.PHRASES) == set(lx.TOPIC) and len(lx.TOPIC) == 48 and len(set(lx.TOPIC.values())) == 40
    assert all(any("{}" not in x for x in v) for v in lx.PHRASES.values()) and {k for k, v in lx.PHRASES.items() if any("{}" in x for x in v)} == set(reports.MEASURED)
    names = {"slow_response": ("ms", "2700"), "pagespeed_low": ("score", "41"), "broken_internal_links": ("count", "3"), "heavy_page": ("bytes", "3210000"), "very_thin_homepage": ("words", "80"), "thin_homepage": ("words", "200"), "generic_value_proposition": ("h1", "Welcome")}
    kind = "site string, rank int, code string, evidence array<struct<name:string,value:string>>"
    rows = [(f"{code}/{i}/{known}", 1, code, [names[code]] if known and code in names else []) for code in lx.TOPIC for i in range(20) for known in (True, False)]
    out = reports.observations(spark.createDataFrame(rows, kind)).collect()
    assert len(out) == len(rows) and not any("{}" in r["line"] or "null" in r["line"] for r in out)
    said = {c: [r["line"] for r in out if r["code"] == c and r["site"].endswith("True")] for c in names}
    for code, shown in (("slow_response", "2700 ms"), ("pagespeed_low", "41 of 100"), ("heavy_page", "3.2 MB"), ("thin_homepage", "200 words")):
        assert any(shown in x for x in said[code]) and not any(shown in r["line"] for r in out if r["site"] == f"{code}/0/False")
    many = spark.createDataFrame([("s", i, c, []) for i, c in enumerate(["slow_response", "unknown", "pagespeed_low", "missing_viewport", "no_https"])], kind)
    assert [(r["code"], r["topic"]) for r in reports.observations(many, 2).orderBy("place").collect()] == [("slow_response", "page speed"), ("missing_viewport", "mobile layout")]
