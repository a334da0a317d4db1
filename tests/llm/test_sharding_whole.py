"""Equal texts are never parted unless their group is over an eighth of a shard."""

from collections import Counter, defaultdict

import pytest

from auditloom.llm import sharding


def test_groups_are_whole(spark):
    # 400 groups of 2 to 21 equal texts, most of the bytes, and some texts of their own
    texts = [f"text of group {g} " * 20 for g in range(400) for _ in range(2 + g % 20)] + [f"alone {i} " * 20 for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards, sizes = defaultdict(set), Counter()
    for r in sharding.shard_equal_texts(docs).collect():
        shards[texts[r["doc_id"]]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert all(len(s) == 1 for s in shards.values())
    assert len(sizes) == 8 and max(abs(x - mean) for x in sizes.values()) < 0.05 * mean


def test_a_large_group_is_divided(spark):
    texts = ["copies are most of the bytes " * 10] * 600 + [f"alone {i} " * 30 for i in range(200)]
    out = sharding.shard_equal_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert len(out) == 800 and len(sizes) == 8 and max(abs(x - mean) for x in sizes.values()) < 0.1 * mean


def test_rounds_lower_the_cut(spark):
    """Over documents, propagation cuts far fewer of the links between texts that share passages, at the same balance."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {}
    real = sharding.passage_links

    def links(pieces):
        kept["links"] = real(pieces).collect()
        return real(pieces)

    cut, off, split = {}, {}, {}
    for rounds in (0, sharding.ROUNDS):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(sharding, "passage_links", links)
            out = sharding.shard_equal_texts(docs, rounds=rounds)
            own = docs.select(F.col("doc_id").alias("_d"), F.xxhash64(F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"), F.lit(0).cast("bigint")).alias("piece"))
            rows = out.join(own, F.col("doc_id") == F.col("_d")).collect()
        at, sizes = defaultdict(set), Counter()
        for r in rows:
            at[r["piece"]].add(r["shard"])
            sizes[r["shard"]] += r["size"]
        assert {x["a"] for x in kept["links"]} <= set(at)
        cut[rounds] = sum(at[x["a"]] != at[x["b"]] for x in kept["links"])
        mean = sum(sizes.values()) / 8
        off[rounds], split[rounds] = max(abs(x - mean) for x in sizes.values()) / mean, sum(len(s) > 1 for s in at.values())
    assert len(kept["links"]) > 80 and cut[sharding.ROUNDS] < 0.5 * cut[0]
    assert max(off.values()) <= 0.02 and set(split.values()) == {0}
