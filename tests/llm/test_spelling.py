"""Spelling variants: all pairs in plain Python, counts with slips, and rows of every kind."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from auditloom.llm import spelling

DOCS = "doc_id long, text string, word string, n int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(vocabulary):
    found = {}
    for w, n in vocabulary.items():
        others = sorted((-m, o) for o, m in vocabulary.items() if near(w, o))
        takes = others and -others[0][0] >= 2 * n
        found[w] = (others[0][1] if takes else None, len(others), -others[0][0] if takes else None)
    def root(w):  # noqa: E306
        return root(found[w][0]) if found[w][0] else w

    return {(w, f, root(w), n, k, m) for w, n in vocabulary.items() for f, k, m in [found[w]]}


def counted(docs):
    out = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = re.sub("[A-Z]", lambda m: m.group().lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            out[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def test_rows_of_every_kind(spark):
    docs = [(None, "Großes GROSSES Ämter ämter"), (None, None), (1, ""), (2, " \n"), (3, "house houses hause hous horse " * 40), (3, "house houses hause hous horse " * 40), (4, "ÉTUDE étude Étude ÷÷÷÷÷ " * 5)]
    docs += [(i, f"letters letter{'s' * (i % 3)} lettre lettres kettles kettle settle battle bottle cattle {'x' * (i % 9)}") for i in range(10, 700)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], DOCS).repartition(4)
    vocabulary = counted(docs)
    assert {r["word"]: r["n"] for r in spelling.words(df).collect()} == vocabulary
    assert any(near("letters", w) and w not in ("letter", "letterss") for w in vocabulary)  # slips came about
    assert {tuple(r) for r in spelling.variants(spelling.words(df)).collect()} == plain(vocabulary)
    assert spelling.variants(spelling.words(df.limit(0))).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.text(alphabet="abcé", min_size=5, max_size=7), st.integers(3, 400), min_size=1, max_size=120))
def test_all_pairs(spark, vocabulary):
    out = spelling.variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long"))
    assert {tuple(r) for r in out.collect()} == plain(vocabulary)


@pytest.mark.parametrize("length", [12])
def test_long_chains(spark, length):
    """Forms lead over many steps to one root."""
    words = ["a" * i + "b" * (40 - i) for i in range(length)]
    out = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(words)], "word string, n long")).collect()}
    assert set(out.values()) == {words[-1]}
