"""Fill-in-middle: cuts against plain Python, exact round trips, and rows of every kind."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import fill_middle

DOCS = "doc_id long, text string, n string, h1 int, form string"
TEXTS = [None, "", "\n", "\n\n", "a", "a\n", "\na", "é\n😀ü\n\nz", "one\ntwo\nthree\n", "<P", "<P>", "x<S>y", "<<M>", "<M\n>", "P>", "<\nP>", "<X>", "a" * 50_000 + "\nb", "l\n" * 30_000, "\r\n \t"]


def plain(i, t, seed=7, rate=100, spm=50):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, z = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (i, len(units), "plain", None, None, t)
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    form = "spm" if h4 % 100 < spm else "psm"
    return (i, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 100), (0, 50), (100, 0)])
def test_rows_of_every_kind(spark, rate, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, t) for t in TEXTS] + [(3, "x\ny"), (3, "x\ny")] + [(i, "a\nb\nc\nd") for i in range(100, 160)]
    docs = spark.createDataFrame([(i, t, "n", 1, None) for i, t in rows], DOCS).repartition(3)
    out = fill_middle.fill_in_middle(docs, rate=rate, spm_rate=spm)
    assert Counter(map(tuple, out.collect())) == Counter(plain(i, t, 7, rate, spm) for i, t in rows)
    back = out.select("doc_id", fill_middle.restored(out["output"], out["form"]).alias("t")).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in rows)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="a<>PSM\né😀", max_size=12), min_size=1, max_size=6))
def test_scan_is_the_automaton_step_by_step(texts):
    """The scan of a lot gives what walking each text through the table byte by byte gives."""
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0] + [len(r) for r in raw[:-1]])
    got = fill_middle.scan(np.frombuffer(b"".join(raw), np.uint8), starts)
    want = []
    for r in raw:
        state = fill_middle.BEGIN
        for b in r:
            k = fill_middle._class[b]
            want.append(fill_middle.COUNTS[state, k])
            state = fill_middle.NEXT[state, k]
    assert got.tolist() == want
    for t, r, s in zip(texts, raw, starts):
        own = got[s : s + len(r)]
        count = lambda bit: int(((own & bit) > 0).sum())
        assert count(fill_middle.CODE_POINT) == len(t) and count(fill_middle.UNIT) == len(re.findall(r"[^\n]*\n|[^\n]+", t))
        assert count(fill_middle.SENTINEL) == len(re.findall("<[PSM]>", t))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab<>PSM\né", max_size=20), min_size=1, max_size=5), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.booleans())
def test_round_trip_of_slices(texts, h1, h2, turned):
    """Arrays that are slices of others are cut at their own bytes."""
    whole = pa.array(["head é\n", *texts, "tail"])
    n = len(texts)
    found = fill_middle.transformed(whole.slice(1, n), np.full(n, h1), np.full(n, h2), np.zeros(n, bool), np.full(n, turned))
    for t, (units, form, p, m, out) in zip(texts, found):
        out = out.decode()
        if form == "plain":
            assert out == t and (not t or re.search("<[PSM]>", t))
            continue
        a, b, c = re.split("<[PSM]>", out)[1:]
        prefix, suffix = (b, a) if turned else (a, b)
        assert prefix + c + suffix == t and (len(prefix), len(c)) == (p, m)
