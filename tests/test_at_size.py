"""What only larger tables reach: values, texts and plans that the small ones do not have."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text
from auditloom.operators import contacts, pages, rules
from auditloom.plans import fixture


def test_sizes_have_no_exponent(spark):
    cubes = [0, 1023, 1024, 1 << 20, 220_619**3, 221_486**3, 899_999**3]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(cubes)], "k int, n bigint").orderBy("k")
    got = [r[0] for r in df.select(text.fmt_bytes(F.col("n"))).collect()]
    assert got == ["0 B", "1023 B", "1.0 KB", "1.0 MB", "10000664.7 GB", "10119032.0 GB", "678931893.8 GB"]


def test_numbers_side_by_side(spark):
    texts = [
        "on +1 (608) 555-2280 37.92.178.161 in", "10.20.30.40 (608) 555-2280 and", "(608) 555-2280 (415) 555-2671", "608 555 2280 2020-01-01", "+44 20 7946 0958 10.20.30.40. 415-555-2671. 12 of",
        "4970190306279289 37 608 555 2280 x", "6 0 8 5 5 5 2 2 8 0 1", "555-2671 415abc", "2280 " * 3000, "5" * 9000, None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in contacts.scan_phones(df).collect():
        got.setdefault(r["doc_id"], set()).add((r["raw"], r["e164"]))
    assert {k: sorted(e for _, e in v) for k, v in got.items()} == {
        0: ["+16085552280"], 1: ["+16085552280"], 2: ["+14155552671", "+16085552280"], 3: ["+16085552280"], 4: ["+14155552671", "+442079460958"], 5: ["+16085552280"], 6: ["+16085552280"],
    }
    assert got[0] == {("+1 (608) 555-2280", "+16085552280")} and got[3] == {("608 555 2280", "+16085552280")}


def test_references_without_a_semicolon():
    page = pages.read_html("<html><head><title>von &amp;&amp&quot</title></head><body><p>a &amp b &am c</p></body></html>")
    assert (page["title"], page["text"]) == ('von &&"', "a & b &am c")


SITES = [("a.test", 1, "https://a.test/", '<a href="tel:+14155550100">Ring</a><footer>info@a.test</footer>'), ("a.test", 2, "https://a.test/contact", '<a href="mailto:jo@a.test">x</a>'), ("b.test", 3, "https://b.test/", "")]


@pytest.mark.parametrize("found", [contacts.site_contacts, contacts.site_emails])
def test_pages_are_parsed_once(spark, found):
    parsed = pages.parse(spark.createDataFrame(SITES, "site string, page_id long, url string, html string"))
    out = found(parsed)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") < 2
    assert {r["site"] for r in out.collect()} == {"a.test"}


def test_numbers_are_dealt_out_before_pages_are_made(spark):
    assert fixture.sites(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_comments_in_a_row():
    page = pages.read_html("a<!--x--><!-- y --><!----><!--> z --><!-- - --><!-- > --><!--\\n-->b<script><!--x--><!--y--></script><!-- open")
    assert page["text"] == "ab <!-- open"
    steps = []
    reader = pages._Reader()
    whole = reader.parse_comment
    reader.parse_comment = lambda i, report=1: steps.append(i) or whole(i, report)
    reader.feed("<!-- filler -->" * 1000 + "x")
    assert len(steps) == 1


def test_plain_tags_are_read_without_the_general_parser(monkeypatch):
    slow = []
    general = pages.HTMLParser.parse_starttag
    monkeypatch.setattr(pages.HTMLParser, "parse_starttag", lambda self, i: slow.append(i) or general(self, i))
    html = '<body class="x"><p id="a"><a href="/b" title="t">L</a><img src="/c" alt>'
    plain = pages.read_html(html)
    assert not slow and plain["links"] == [{"href": "/b", "text": "L"}] and plain["image_srcs"] == ["/c"]
    odd = pages.read_html(html.replace('"/b"', "'/b'").replace("<img", "<IMG").replace("alt>", "alt/>") + "<title>a<b></title>")
    assert len(slow) == 3 and odd["links"] == plain["links"] and odd["image_srcs"] == plain["image_srcs"]
    assert not pages.read_html("<h2>Mary Jones</h2>", names=False)["names"] and pages.read_html("<h2>Mary Jones</h2>")["names"] == ["Mary Jones"]


def test_audits_make_only_the_columns_that_they_take(spark):
    site = spark.createDataFrame(SITES, "site string, page_id long, url string, html string")
    asked, whole = rules.page_facts(site), rules.facts(pages.parse(site))
    assert sorted(map(repr, rules.audit(asked).collect())) == sorted(map(repr, rules.audit(whole).collect()))
    assert "jsonld_emails" not in asked._jdf.queryExecution().optimizedPlan().toString() and set(rules.PARSED) <= set(pages.FIELDS)
