"""Sharding by balanced label propagation (operator 1).

Nodes are texts: all rows of one text are a node with their bytes, unless they are more than a shard holds, and nodes that
share passages are linked. Nodes start in shards by hash. In each round a part of the linked nodes asks to move where
most of its neighbours are, and as many of those moves are granted as the shard's quota of bytes lets in, best
gains first. After the rounds nodes without links even out the sizes, and whole linked nodes only where that is not
enough. All sums that decide are taken over a fixed number of bins for each shard, so no shard is sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import cut, dealt_anew, text_or_empty
from auditloom.llm.exact_dedup import chunks

ROUNDS = 8
#: How far over its share a shard may grow while labels propagate.
SLACK = 0.1
BINS = 1024
#: Passages of a text, those with the smallest hashes, that link it to others with the same one.
SKETCH = 4
#: Rows that are numbered in one sort, about.
NUMBERED = 20_000


def _bin(node: Column, salt: int, bins: int = BINS) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(salt)), F.lit(bins)).cast("int")


def _loads(nodes: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for s, n in nodes.groupBy("shard").agg(F.sum("size")).collect():  # a row for each shard
        out[s] = n
    return out


def propagate(nodes: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """nodes (node long, size long, perhaps piece long) with shard int: few links cut, sizes nearly even.

    links (a, b) are between different nodes, in any direction and any number. Nodes with the same piece move as one
    node of all their bytes, and links between pieces are those of their nodes.
    """
    if "piece" in nodes.columns:
        of = nodes.select(F.col("node").alias("_n"), "piece")
        whole = nodes.groupBy(F.col("piece").alias("node")).agg(F.sum("size").alias("size"))
        there = links.join(of, F.col("a") == F.col("_n")).select(F.col("piece").alias("a"), "b")
        there = there.join(of, F.col("b") == F.col("_n")).select("a", F.col("piece").alias("b")).filter("a <> b")
        placed = propagate(whole, there, shards, rounds, slack).select(F.col("node").alias("_p"), "shard")
        return nodes.withColumn("_own", dealt_anew(F.col("piece"))).join(placed, F.col("_own") == F.col("_p")).select("node", "size", "shard")
    nodes = nodes.withColumn("piece", F.col("node"))
    spark = nodes.sparkSession
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    linked = edges.select(F.col("a").alias("node")).distinct().withColumn("linked", F.lit(True))
    state = cut(
        nodes.join(linked, "node", "left").select(
            "node", "size", "piece", F.coalesce("linked", F.lit(False)).alias("linked"), _bin(F.col("node"), -1, shards).alias("shard")
        )
    )
    total = sum(_loads(state, shards))
    free = state.filter("not linked")
    free_loads = _loads(free, shards)
    moving = cut(state.filter("linked").select("node", "size", "piece", "shard"))
    idle = 0
    for r in range(rounds):
        loads = [a + b for a, b in zip(free_loads, _loads(moving, shards))]
        beside = (
            edges.join(moving.select(F.col("node").alias("b"), "shard"), "b").groupBy("a", "shard").agg(F.count(F.lit(1)).alias("n"))
        )
        best = (
            beside.join(moving.select(F.col("node").alias("a"), F.col("shard").alias("own"), "size"), "a")
            .groupBy("a")
            .agg(
                F.max(F.struct("n", (-F.col("shard")).alias("to"))).alias("m"),
                F.sum(F.when(F.col("shard") == F.col("own"), F.col("n")).otherwise(0)).alias("here"),
                F.first("size").alias("size"),
            )
            .select("a", "size", (-F.col("m.to")).alias("to"), (F.col("m.n") - F.col("here")).alias("gain"))
            # half of the nodes stay, else neighbours would change places for ever
            .filter((F.col("gain") > 0) & (_bin(F.col("a"), r, 2) == 0))
            .withColumn("bin", (F.greatest(F.lit(0), F.lit(7) - F.col("gain").cast("int")) * (BINS // 8) + _bin(F.col("a"), r, BINS // 8)))
        )
        best = cut(best)
        bins = best.groupBy("to", "bin").agg(F.sum("size").alias("z")).orderBy("to", "bin").collect()  # shards * BINS rows at most
        if not bins:
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        quota = [max(0.0, total / shards * (1 + slack) - x) for x in loads]
        granted = []
        for x in bins:
            if x["z"] <= quota[x["to"]]:
                quota[x["to"]] -= x["z"]
                granted.append((x["to"], x["bin"]))
        if granted:
            ok = F.broadcast(spark.createDataFrame(granted, "to int, bin int"))
            moves = best.join(ok, ["to", "bin"]).select(F.col("a").alias("node"), "to")
            moving = cut(
                moving.join(moves, "node", "left").select("node", "size", "piece", F.coalesce("to", "shard").alias("shard"))
            )
    state = free.select("node", "size", "piece", "shard", "linked").union(moving.select("node", "size", "piece", "shard", F.lit(True)))
    return even_out(cut(state), shards, total).select("node", "size", "shard")


def even_out(state: DataFrame, shards: int, total: int) -> DataFrame:
    """state (node, size, piece, shard, linked) with bins of nodes moved from full shards to others.

    Nodes without links move first, then whole pieces while a shard is off by over 2 percent, and
    nodes without links once more after them. Only where that is not enough, as where pieces are
    nearly all there is, do the pieces of over an eighth of a shard move in parts.
    """
    spark, mean = state.sparkSession, total / shards
    for k, step in enumerate(("free", "free", "free", "pieces", "pieces", "free", "parts", "parts", "free")):
        loads = _loads(state, shards)
        off = max(abs(x - mean) for x in loads)
        if off <= mean * 1e-4 or k >= 3 and off <= mean * 0.02:
            break
        by, may = F.col("node" if step == "parts" else "piece"), F.lit(True) if step == "pieces" else ~F.col("linked")
        if step == "parts":
            sizes = state.groupBy("piece").agg(F.sum("size").alias("z")).filter(F.col("z") > mean / 8)
            large = [r["piece"] for r in sizes.collect()]  # 8 * shards at most
            may = F.col("piece").isin(large)
        full = [s for s in range(shards) if loads[s] > mean]
        bins = state.filter(may & F.col("shard").isin(full)).groupBy("shard", _bin(by, 101 + k).alias("bin")).agg(F.sum("size").alias("z"))
        moves = []
        for x in sorted(bins.collect(), key=lambda x: (-x["z"], x["shard"], x["bin"])):  # shards * BINS rows at most
            to = min(range(shards), key=loads.__getitem__)
            if loads[x["shard"]] - mean >= x["z"] / 2 and mean - loads[to] >= x["z"] / 2:
                loads[x["shard"]] -= x["z"]
                loads[to] += x["z"]
                moves.append((x["shard"], x["bin"], to))
        if not moves:
            continue
        table = F.broadcast(spark.createDataFrame(moves, "shard int, bin int, to int"))
        state = cut(
            state.withColumn("bin", F.when(may, _bin(by, 101 + k)))
            .join(table, ["shard", "bin"], "left")
            .select("node", "size", "piece", F.coalesce("to", "shard").alias("shard"), "linked")
        )
    return state


def equal_text_pieces(rows: DataFrame, piece_bytes: float) -> DataFrame:
    """rows (node, size, g, g2, the hashes of the text, and further columns) with piece, the same for rows of one text.

    A group of over piece_bytes, which no shard can hold, is dealt into pieces of about that size by hash.
    """
    sizes = rows.groupBy("g", "g2").agg(F.ceil(F.sum("size") / max(piece_bytes, 1.0)).alias("k")).filter("k > 1")
    sizes = sizes.select(F.col("g").alias("_g"), F.col("g2").alias("_g2"), "k")  # fewer than twice as many as shards or pieces
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("_h", dealt_anew(F.col("g"))).join(F.broadcast(sizes), (F.col("_h") == F.col("_g")) & (F.col("g2") == F.col("_g2")), "left")
    return rows.withColumn("piece", F.xxhash64("g", "g2", part)).drop("_h", "_g", "_g2", "k")


def passage_links(pieces: DataFrame) -> DataFrame:
    """Links (a, b) between the pieces that share a passage: a tree over each passage's. pieces: piece, sketch (array of hashes).

    Each piece is linked to the least of about the square root of a passage's pieces, and these to the least of all, so a
    passage adds no more links to one piece than that.
    """
    members = cut(pieces.select("piece", F.explode("sketch").alias("c")).distinct())
    sizes = members.groupBy("c").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select(dealt_anew(F.col("c")).alias("_c"), "m")
    dealt = cut(members.join(sizes, F.col("c") == F.col("_c")).select("c", "piece", F.pmod(F.xxhash64("piece", F.lit(9)), F.col("m")).alias("part")))
    subs = cut(dealt.groupBy("c", "part").agg(F.min("piece").alias("sub")))
    hubs = subs.groupBy("c").agg(F.min("sub").alias("hub")).select(dealt_anew(F.col("c")).alias("_c"), "hub")
    below = subs.select(dealt_anew(F.col("c")).alias("_c"), F.col("part").alias("_part"), "sub")
    near = dealt.join(below, (F.col("c") == F.col("_c")) & (F.col("part") == F.col("_part"))).select(F.col("piece").alias("a"), F.col("sub").alias("b"))
    far = subs.join(hubs, F.col("c") == F.col("_c")).select(F.col("sub").alias("a"), F.col("hub").alias("b"))
    return near.union(far).filter("a <> b").distinct()


def with_slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows with slot: 0, 1, 2 ... within each shard. Parts are numbered apart and then offset."""
    parts = max(1, n_rows // NUMBERED)
    rows = rows.withColumn("_part", _bin(F.col("node"), 11, parts))
    sizes = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    order = Window.partitionBy("shard", "_part").orderBy("doc_id", "node")
    return (
        rows.withColumn("_at", F.row_number().over(order))
        .join(offsets, ["shard", "_part"])
        .withColumn("slot", (F.col("_from") + F.col("_at") - 1).cast("long"))
        .drop("_part", "_at", "_from")
    )


def shard_equal_texts(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text (null: none) plus 1. The law is "bytes": sizes of shards
    are nearly equal. Rows with equal texts are in one shard where it can hold them: a group of over a shard's share of
    the bytes is dealt into pieces of that size at most, and where shards would still differ by over 2 percent with
    whole groups, those of over an eighth of a shard are divided. Different texts are linked by passages
    that they share (SKETCH of each text's, see exact_dedup.chunks) and propagation brings them together. Repeated rows (the
    same id and text) are always together; a null id is an id, and a null text counts as empty. Whole texts are
    read, however long. slot numbers a shard's rows from 0 without gaps; grown_shard is null under this law. The result
    depends on ids, texts, shards and rounds only. Further columns are not read. An empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    sketch = F.slice(F.array_sort(F.array_distinct(F.transform(chunks(text), lambda c: F.xxhash64(c)))), 1, SKETCH)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(F.col(id_col), text).alias("node"),
            F.xxhash64(text).alias("g"),
            F.xxhash64(F.lit("second"), text).alias("g2"),
            sketch.alias("sketch"),
        )
    )
    n_rows, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    share = (total or 0) / shards
    for most in (share, share / 8):
        pieces = equal_text_pieces(rows, most)
        nodes = pieces.groupBy(F.col("piece").alias("node")).agg(F.sum("size").alias("size"))
        placed = cut(propagate(nodes, passage_links(pieces.select("piece", "sketch")), shards, rounds))
        if max([abs(x - share) for x in _loads(placed, shards)]) <= 0.02 * share:
            break
    at = placed.select(F.col("node").alias("_p"), "shard")
    # a piece of many rows is a hot key
    own = pieces.withColumn("_own", dealt_anew(F.col("piece"))).join(at, F.col("_own") == F.col("_p")).drop("_own", "_p", "piece", "sketch")
    return with_slots(own, n_rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
