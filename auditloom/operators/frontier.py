"""The crawl as joins over a link table: edges, the frontier level by level, robots rules and link checks.

Fetches are tables: a page is reached if the pages have its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions import urls
from auditloom.sources.tables import checkpointed


def links(parsed: DataFrame) -> DataFrame:
    """The links of parsed pages (page_id, url, links and further columns, kept but for the parsed ones) with pos, href, text and target."""
    keep = [c for c in parsed.columns if c in ("site", "page_id", "url", "ord")]
    rows = parsed.select(*keep, F.posexplode("links").alias("at", "x"))
    rows = rows.select(*[F.col(c).alias("base") if c == "url" else F.col(c) for c in keep], (F.col("at") + 1).alias("pos"), "x.href", "x.text")
    return rows.select("*", urls.absolutize(F.col("base"), F.col("href")).alias("target"))


def edges(rows: DataFrame) -> DataFrame:
    """links() that lead to another page of the same site that a crawl would take: site, page_id, page_key, pos, url, key, type."""
    t = F.col("target")
    keyed = rows.filter(t.isNotNull()).filter(urls.is_crawlable(t) & ~urls.should_skip(t)).filter(urls.same_site(F.col("base"), t))
    return keyed.select(
        "site", "page_id", urls.url_key(urls.normalize_url(F.col("base"))).alias("page_key"), "pos", t.alias("url"), urls.url_key(t).alias("key"), urls.classify_page(t, F.col("text")).alias("type")
    )


def priority(kind: Column) -> Column:
    known = F.create_map(*[x for k, v in lx.PAGE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, kind), F.lit(20))


#: Steps between two checkpoints of a crawl.
STEPS = 6
_LINK = "struct<p:int,d:int,s:int,key:string,type:string,url:string,ok:boolean,ms:bigint>"
_FRESH = "get(filter(todo, x -> NOT array_contains(have, x.type)), 0)"
_MORE = "get(filter(todo, x -> x.type = 'other'), 0)"


def _linked(graph: DataFrame, fetches: DataFrame | None) -> DataFrame:
    """Rows (site, page, links): the edges of each page in their order, with what a fetch of each gives."""
    if fetches is None:
        rows = graph.select("*", F.lit(True).alias("ok"), F.lit(0).cast("long").alias("ms"))
    else:
        rows = graph.join(fetches.select(F.col("key").alias("_key"), "ok", F.col("ms").cast("long").alias("ms")), F.col("key") == F.col("_key"), "left")
        rows = rows.withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("ms", F.coalesce("ms", F.lit(0).cast("long")))
    link = F.struct("page_id", "pos", "key", "type", "url", priority(F.col("type")).cast("int").alias("p"), "ok", "ms")
    return rows.groupBy("site", F.col("page_key").alias("page")).agg(F.array_sort(F.collect_list(link)).alias("links"))


def _step(state: DataFrame, linked: DataFrame, max_depth: int, max_pages: int, budget_ms: int) -> DataFrame:
    """state after each open site has taken one page, or has none to take.

    The next page is the first of a type that is not taken yet or, where there is none, the first other page.
    What a crawl taking one candidate at a time would drop before it is dropped: of the known types, all that have a
    priority below 10 and stand before the next page, and where no new type is left all that stand before it.
    """
    stop = f"size(todo) = 0 OR size(taken) >= {max_pages} OR ms > {budget_ms}"
    chosen = state.selectExpr("*", f"CASE WHEN open AND NOT ({stop}) THEN {_FRESH} END AS fresh", f"CASE WHEN open AND NOT ({stop}) THEN {_MORE} END AS more")
    chosen = chosen.selectExpr("* EXCEPT (open, exhausted, fresh, more)", f"open AND NOT ({stop}) AS open", f"exhausted OR (open AND size(todo) > 0 AND (size(taken) >= {max_pages} OR ms > {budget_ms})) AS exhausted", "fresh IS NOT NULL AS fresh", "coalesce(fresh, more) AS next")
    rest = """CASE WHEN NOT open THEN todo WHEN next IS NULL THEN array() WHEN fresh THEN filter(todo, x -> x > next OR x < next AND x.p >= 10)
              ELSE filter(todo, x -> x > next AND x.p >= 10) END AS todo"""
    moved = chosen.selectExpr("* EXCEPT (todo)", rest).withColumn("_page", F.expr(f"CASE WHEN next.ok AND next.d < {max_depth} THEN next.key END"))
    # rows that need no links are joined to none, by a value of their own
    own = F.coalesce("_page", F.concat(F.lit("\n"), "site"))
    met = moved.withColumn("_page", own).join(linked.select(F.col("site").alias("_s"), "page", "links"), (F.col("site") == F.col("_s")) & (F.col("_page") == F.col("page")), "left")
    wanted = f"filter(coalesce(links, array()), x -> NOT array_contains(seen, x.key) AND NOT (x.type IN ('other', 'blog') AND next.d + 1 >= {max_depth}))"
    met = met.selectExpr("* EXCEPT (_s, _page, page, links)", f"{wanted} AS links")
    # of the links of one key the first, and these in their order again
    met = met.selectExpr("* EXCEPT (links)", "array_sort(transform(links, (x, i) -> struct(x.key AS key, i AS i, x AS x))) AS links")
    met = met.selectExpr("* EXCEPT (links)", "transform(array_sort(transform(filter(links, (y, i) -> i = 0 OR links[i - 1].key <> y.key), y -> struct(y.i AS i, y.x AS x))), y -> y.x) AS links")
    return met.selectExpr(
        "site", "CASE WHEN next.ok THEN array_append(have, next.type) ELSE have END AS have", "concat(seen, transform(links, x -> x.key)) AS seen",
        f"array_sort(concat(todo, transform(links, (x, i) -> cast(struct(x.p, next.d + 1, n + i, x.key, x.type, x.url, x.ok, x.ms) AS {_LINK})))) AS todo",
        "CASE WHEN next.ok THEN array_append(taken, struct(next.key AS key, next.url AS url, next.type AS type, next.d AS depth)) ELSE taken END AS taken",
        "CASE WHEN next.ok IS FALSE THEN failed + 1 ELSE failed END AS failed", "ms + coalesce(next.ms, 0L) AS ms", "n + size(links) AS n", "open", "exhausted",
    )


def crawl(graph: DataFrame, fetches: DataFrame | None = None, max_depth: int = 2, max_pages: int = 12, budget_ms: int = 90_000, cut=None) -> DataFrame:
    """One row for each site of edges(): site, taken (key, url, type, depth, in the order of the crawl), failed, ms, exhausted.

    A crawl starts at the page with the smallest page_id and takes one page at a time, over all sites at once: the known links
    are sorted by priority, depth and the order in which they were found, and the first of a type that was not taken
    yet is fetched, or an other page where there is none. Its links join the known ones if it is above max_depth;
    other and blog pages of the last level are left out. It ends at max_pages pages, with nothing left, or once the
    fetches took over budget_ms; exhausted tells whether known links were left then. fetches (key, ok, ms) has
    what a fetch gives, a key that is not there fails; without it all fetches succeed and take no time.
    The state of a site is its known and seen links, those of max_pages pages at most; it is cut by a checkpoint
    every STEPS steps. An empty table gives an empty result.
    """
    cut = cut or checkpointed
    linked = cut(_linked(graph, fetches).repartition("site", "page"))
    first = F.row_number().over(Window.partitionBy("site").orderBy("id"))
    homes = linked.select("site", "page", F.get("links", 0)["page_id"].alias("id")).withColumn("_n", first).filter("_n = 1")
    if fetches is None:
        homes = homes.withColumn("ms", F.lit(0).cast("long"))
    else:
        homes = homes.join(fetches.select("key", F.col("ms").cast("long").alias("ms")), F.col("page") == F.col("key"), "left").withColumn("ms", F.coalesce("ms", F.lit(0).cast("long")))
    start = homes.selectExpr(
        "site", "cast(array() AS array<string>) AS have", "array(page) AS seen", f"array(cast(struct(0, 0, 0, page, 'homepage', '', true, ms) AS {_LINK})) AS todo",
        "cast(array() AS array<struct<key:string,url:string,type:string,depth:int>>) AS taken", "0 AS failed", "0L AS ms", "1 AS n", "true AS open", "false AS exhausted",
    )
    state = _step(start, linked, max_depth, max_pages, budget_ms)  # the homepage
    while True:
        for _ in range(STEPS):
            state = _step(state, linked, max_depth, max_pages, budget_ms)
        state = cut(state)
        if state.filter("open").isEmpty():
            return state.select("site", "taken", "failed", "ms", "exhausted")


def frontier(graph: DataFrame, fetches: DataFrame | None = None, max_depth: int = 2, max_pages: int = 12, budget_ms: int = 90_000) -> DataFrame:
    """The pages that crawl() takes of each site after its homepage: site, key, url, type, depth, rank."""
    rows = crawl(graph, fetches, max_depth, max_pages, budget_ms).select("site", F.posexplode("taken").alias("rank", "x"))
    return rows.filter("rank > 0").select("site", "x.key", "x.url", "x.type", "x.depth", "rank")


def link_sample(graph: DataFrame, crawled: DataFrame, limit: int = 12) -> DataFrame:
    """The links of each site to check: its first distinct edges, by page and position, whose key is not among crawled (site, key)."""
    once = graph.groupBy("site", "key").agg(F.min(F.struct("page_id", "pos", "url")).alias("m")).select("site", "key", "m.*")
    rest = once.join(crawled.select("site", "key"), ["site", "key"], "left_anti")
    return rest.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("page_id", "pos", "key"))).filter(F.col("n") <= limit)


def broken(sample: DataFrame, fetches: DataFrame) -> DataFrame:
    """link_sample() rows whose fetch (key, status, error) failed: 4xx and 5xx but for those that refuse robots, or no answer at all."""
    gone = (F.col("status") >= 400) & ~F.col("status").isin(401, 403, 429)
    return sample.join(fetches, "key", "left").filter(gone | F.col("error").isin("dns_failure", "connection_error"))


def with_fallback(starts: DataFrame, fetches: DataFrame) -> DataFrame:
    """starts (site, url) with the fetch (url, status, error) of the https address, or of the http one where https does not connect."""
    plain = F.regexp_replace("url", "^https://", "http://")
    first = starts.join(fetches.select(F.col("url").alias("_u"), F.col("status").alias("s1"), F.col("error").alias("e1")), F.col("url") == F.col("_u"), "left").drop("_u")
    failed = F.col("e1").isin("ssl_error", "connection_error", "dns_failure")
    second = first.withColumn("_plain", F.when(failed & F.col("url").startswith("https://"), plain))
    out = second.join(fetches.select(F.col("url").alias("_u"), F.col("status").alias("s2"), F.col("error").alias("e2")), F.col("_plain") == F.col("_u"), "left")
    use = F.col("_plain").isNotNull() & F.col("s2").isNotNull()
    return out.select(
        "site", F.when(use, F.col("_plain")).otherwise(F.col("url")).alias("url"), F.when(use, F.col("s2")).otherwise(F.col("s1")).alias("status"),
        F.when(use, F.col("e2")).otherwise(F.col("e1")).alias("error"), use.alias("https_unavailable"),
    )


def robots_rules(robots: DataFrame) -> DataFrame:
    """Rows (site, agent, allow, prefix, n) of robots texts (site, robots): each rule under each agent of its group, in order.

    A group is the agents that follow each other and the rules after them; null and empty texts have none. A
    rule that names no path allows all.
    """
    lines = F.transform(F.split(F.coalesce("robots", F.lit("")), "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    known = F.filter(lines, lambda x: x.rlike("(?i)^(user-agent|allow|disallow)\\s*:"))
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("open"), F.array().cast("array<struct<agents:array<string>,allow:boolean,prefix:string>>").alias("rules"))

    def step(a: Column, x: Column) -> Column:
        agent, value = x.rlike("(?i)^user-agent"), F.trim(F.regexp_replace(x, "^[^:]*:", ""))
        named = F.struct(F.concat(F.when(a["open"], a["agents"]).otherwise(F.array().cast("array<string>")), F.array(F.lower(value))).alias("agents"), F.lit(True).alias("open"), a["rules"].alias("rules"))
        rule = F.array(F.struct(a["agents"].alias("agents"), (x.rlike("(?i)^allow") | (value == "")).alias("allow"), value.alias("prefix")))
        ruled = F.struct(a["agents"].alias("agents"), F.lit(False).alias("open"), F.concat(a["rules"], rule).alias("rules"))
        return F.when(agent, named).otherwise(ruled)

    found = robots.select("site", F.posexplode(F.aggregate(known, start, step)["rules"]).alias("n", "r"))
    return found.select("site", F.explode("r.agents").alias("agent"), "r.allow", "r.prefix", "n")


def robots_allowed(pages: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """pages (site, url) with allowed: by the first rule whose prefix the path has, of the agent's own rules.

    An agent without rules of its own has those of "*". A path that no rule speaks of is allowed, and so is one that
    the rules of "*" allow.
    """
    own = rules.filter(F.col("agent").isin(agent.lower(), "*")).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("n", "agent", "allow", "prefix"))).alias("rules"))
    way = F.coalesce(F.nullif(F.concat(urls.path(F.col("url")), F.regexp_extract("url", r"(\?[^#]*)", 1)), F.lit("")), F.lit("/"))
    first = lambda name: F.coalesce(F.get(F.filter("rules", lambda r: (r["agent"] == name) & F.startswith(F.col("_way"), r["prefix"])), 0)["allow"], F.lit(True))
    out = pages.withColumn("_way", way).join(own, "site", "left")
    named = F.coalesce(F.exists("rules", lambda r: r["agent"] == agent.lower()), F.lit(False))
    return out.withColumn("allowed", F.col("rules").isNull() | (named & first(agent.lower())) | first("*")).drop("rules", "_way")
