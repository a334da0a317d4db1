"""Deduplication stages over repeated rows, null ids, and one id on several texts: one row of each class stays."""

import os
from collections import Counter

import pytest

from auditloom.llm import common, exact_dedup, near_dedup

A, B, C, D, E = (" ".join(f"{k}{i}" for i in range(80)) for k in "abcde")
ROWS = [
    (1, A, "x"), (1, A, "x"), (2, A, "x"),  # repeated rows, and a copy
    (None, A, "x"), (None, B, "x"), (None, B, "x"), (None, C, "x"),  # null ids: a copy of 1, a repeated row, a text of its own
    (5, C, "x"), (5, D, "x"),  # one id on two texts, the first of which a null id has too
    (3, E, "x"), (7, E, "x"), (7, D, "x"), (8, "", "x"), (None, None, "x"),
]
WANT = Counter({(1, A): 1, (None, B): 1, (5, C): 1, (5, D): 1, (3, E): 1, (8, ""): 1})


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, near_dedup.keep_one])
def test_one_row_of_each_text(spark, keep):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    out = keep(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == WANT


def test_near_copies_of_one_id(spark):
    """A class whose rows share their id keeps one of them, and an id dropped in one class stays in another."""
    near = A.replace("a40", "z")
    docs = spark.createDataFrame([(4, A), (4, near), (9, near), (9, B), (None, C), (None, C + " tail"), (None, D)], "doc_id long, text string")
    out = [(r["doc_id"], r["text"]) for r in near_dedup.keep_one(docs).collect()]
    assert sorted(i for i, _ in out if i is not None) == [4, 9] and (9, B) in out
    assert sum(t.startswith(C) for _, t in out) == 1 and (None, D) in out and len(out) == 4


def test_near_copies_without_ids(spark):
    """Each row without an id meets its own text only: so many rows are joined as there are texts, and one stays."""
    base = [f"w{i}" for i in range(400)]
    rows = [(None, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(0, 400, 5)]
    docs = spark.createDataFrame(rows + [(None, A)], "doc_id long, text string")
    out = near_dedup.near_duplicates(docs).collect()
    assert sorted(r["class_size"] for r in out) == [1] + [len(rows)] * len(rows)
    kept = [r["text"] for r in near_dedup.keep_one(docs).collect()]
    assert len(kept) == 2 and A in kept


def test_a_task_gives_its_memory_back():
    """Blocks that are freed between ones in use stay with the process, unless they are handed back to the system."""
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    stay = []

    def run(batches):
        for b in batches:
            many = [bytes(2000) for _ in range(100_000)]
            stay.extend(many[::1000])
            yield b

    before = held()
    assert list(getattr(common, "sparing", lambda f: f)(run)(iter([1]))) == [1]
    assert held() - before < 60_000_000


def test_labels_are_not_written_by_the_shuffle(spark):
    """A checkpoint of a few links has a file for each of a few parts, not for each of 150 partitions; so has no round of labels more."""
    held = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in (*range(6), *range(9, 12))], "a binary, b binary")
        got = {bytes(r["t"])[0]: bytes(r["c"])[0] for r in near_dedup.components(links).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: 0 if i < 9 else 9 for i in (*range(7), *range(9, 13))}
    files = [sum(x.startswith("part-") for x in os.listdir(f"{folder}/{d}")) for d in set(os.listdir(folder)) - before]
    assert len(files) > 3 and max(files) <= 50
