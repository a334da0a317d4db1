"""Language-model scores: counts and mixture against plain Python, rows without content, and held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from auditloom.llm import ngram_lm

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, block int, n string"


def tokens(text):
    text = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [None]


def learns(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2


def counts(docs):
    one, two = Counter(), Counter()
    for _, t in docs:
        own = tokens(t)
        one.update(own)
        two.update(zip(["<begin>", *own], own))
        one["<begin>"] += 1
    return one, two


def check(spark, docs, schema="doc_id long, text string"):
    """Every row's counts and base score, and the score by the weights that were learned, in plain Python."""
    df = spark.createDataFrame(docs, schema)
    found = {}
    real = ngram_lm.learned

    def kept(bucket, ratios, n, rounds=60):
        found["weights"], found["n"] = real(bucket, ratios, n, rounds), n.sum()
        return found["weights"]

    ngram_lm.learned = kept
    try:
        out = ngram_lm.score(df).collect()
    finally:
        ngram_lm.learned = real
    plain = [(d[0], d[1]) for d in docs]
    train = [d for d in plain if learns(d[0])]
    one, two = counts(train)
    n = sum(len(tokens(t)) for _, t in train)
    v = len([w for w in one if w != "<begin>"])
    want = []
    for i, t in plain:
        own, score, base, before = tokens(t), 0.0, 0.0, "<begin>"
        for w in own:
            base += math.log10((one[w] + 1) / (n + v + 1))
            c = one[before]
            weights = found["weights"][0 if not c else int(math.log2(c)) + 1]
            score += math.log10(weights[0] * (two[before, w] / c if c else 0) + weights[1] * one[w] / n + weights[2] / (v + 1) if n else 1 / (v + 1))
            before = w
        want.append((i, not learns(i), len(own), sum(one[w] > 0 for w in own), n, base, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted(map(tuple, out), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want, key=key)]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in sorted(want, key=key)], rtol=1e-9)
    return got, found


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got, found = check(spark, docs)
    assert found["n"] > 0
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)


@pytest.mark.parametrize("block", [40, 4_000_000])
def test_rows_of_every_kind(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_lm, "BLOCK", block)
    monkeypatch.setattr(ngram_lm, "RANGE", 50)
    long = " ".join(f"Word{i % 500} ÄB" for i in range(20_000))
    docs = [(None, None, 1, "x"), (None, "a b", 1, "x"), (1, "", 2, None), (2, " \n\t", None, ""), (3, long, 1, "x"), (3, long, 1, "x"), (4, "A b a\x0bB c", 1, "x"), (5, "a b Ä ä", 1, "x")]
    docs += [(i, f"the cat {i} sat on the mat", 1, "x") for i in range(6, 60)]
    check(spark, docs, DOCS)


def test_empty_table_and_nothing_learned(spark):
    assert ngram_lm.score(spark.createDataFrame([], DOCS)).count() == 0
    out = next(i for i in range(100) if not learns(i))
    (row,) = ngram_lm.score(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).collect()
    assert tuple(row) == (out, True, 3, 0, 0, 0.0, 0.0)


def test_weights_find_the_mixture():
    """Tokens drawn from a known mixture give its weights back."""
    r = np.random.default_rng(4)
    true = np.array([0.6, 0.3, 0.1])
    # three outcomes under three components, each component a distribution over outcomes
    parts = np.array([[0.8, 0.1, 0.1], [0.1, 0.7, 0.2], [0.2, 0.2, 0.6]])
    n = r.multinomial(2_000_000, true @ parts).astype(float)
    ratios = (parts / parts[2]).T
    weights = ngram_lm.learned(np.full(3, 5), ratios, n, rounds=3000)
    np.testing.assert_allclose(weights[5], true, atol=0.02)
    np.testing.assert_allclose(weights[7], 1 / 3)
    assert weights[0, 0] == 0 and weights[0].sum() == pytest.approx(1)
