"""Shingles weigh by their own document frequency, however rare they are."""

import math
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_brute_force import classes

from auditloom.llm import near_dedup


def test_every_shingle_has_its_own_frequency(spark, monkeypatch):
    """Over 50 rows, in several blocks and ranges: shingles of one row, of two and of all; a repeated row counts."""
    monkeypatch.setattr(near_dedup, "BLOCK", 700)
    monkeypatch.setattr(near_dedup, "RANGE", 40)
    same = "a passage that all texts have"
    texts = [f"{same} {k} x{k} y{k} z{k} and pair {k // 2} p q r s" for k in range(120)] + [None, "", "few words", "few words"]
    sets = near_dedup.shingles([t or "" for t in texts])[1]
    df = Counter(x for h, _ in sets for x in h.tolist())
    assert {1, 2, 120} <= set(df.values())
    weights = near_dedup.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    h = np.array(sorted(df), np.uint64)
    want = [1 + math.log(len(texts) / df[x]) for x in h.tolist()]
    assert weights.n == len(texts) and np.allclose(weights.of(h, np.ones(len(h))), want, rtol=1e-12)


def test_classes_are_those_of_plain_weights(spark):
    """On this table one near copy comes apart that a floor of 2 percent holds together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    own, _ = classes([r["text"] or "" for r in rows], 0.0)
    assert len(set(own)) == len(set(classes([r["text"] or "" for r in rows], 0.02)[0])) + 1
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).select("doc_id", F.col("class_id")).collect()}
    assert got == {r["doc_id"]: rows[c]["doc_id"] for r, c in zip(rows, own)}


def test_near_stage_keeps_a_row_of_each_plain_class(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    want = sorted({rows[c]["doc_id"] for c in classes([r["text"] or "" for r in rows], 0.0)[0]})
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").select("doc_id").collect()) == want


def test_near_stage_in_several_blocks_and_ranges(spark, monkeypatch):
    """Over 200 rows: pairs with 81 of 100 shingles in common come apart, as what they share is in two rows; a floor of 2 percent holds them."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6000, raising=False)
    monkeypatch.setattr(near_dedup, "RANGE", 1500, raising=False)
    run = lambda name, n: [f"{name}{i}" for i in range(n)]
    texts = []
    for k in range(16):
        same = run(f"s{k}x", 85 if k % 2 else 94)
        texts += [" ".join(same + run(f"a{k}x", 10 if k % 2 else 5)), " ".join(same + run(f"b{k}x", 9 if k % 2 else 5))]
    texts += [" ".join(run(f"t{k}x", 100)) for k in range(200 - len(texts))]
    kept = lambda floor: sorted(set(classes(texts, floor)[0]))
    assert (len(kept(0.0)), len(kept(0.02))) == (192, 184)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert near_dedup.document_frequencies(docs).known.count() > 10
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").select("doc_id").collect()) == kept(0.0)
