"""Quality rules by weak supervision (operator 7).

Each rule votes that a text is good (1), bad (-1), or abstains (0). Expectation-maximisation
over the vote patterns of the whole corpus estimates each rule's accuracy, and a text is kept
by its posterior probability of being good, not by passing every rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import SPACE_CHARS, cut, in_lots, sparing

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Votes bad above `bad`, good at `good` or below, and abstains between; of texts with `least` words or more."""

    name: str
    good: float
    bad: float
    least: int = 1


#: What each rule looks at is in measure().
RULES = (
    Rule("symbols per word", 0.05, 0.2),
    Rule("duplicate lines", 0.05, 0.4),
    Rule("words in repeated windows", 0.08, 0.35),
    Rule("words outside 2.5 to 12 characters on average", 0.0, 0.5),
    Rule("capital letters", 0.12, 0.4),
    Rule("exclamation marks per word", 0.04, 0.25),
    Rule("words without a letter", 0.08, 0.25),
    Rule("words used before", 0.75, 0.9, 50),
    Rule("punctuation and symbols among characters", 0.06, 0.09),
)
#: A text is kept at this posterior probability.
KEEP = 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more, and distinct words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(ids) < 4 or len(number) == len(ids):
        return 0, len(number)
    m = len(number)
    if m < 1 << 21:
        keys = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:
        keys = np.unique(ids[:-2] * m + ids[1:-1], return_inverse=True)[1] * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, m
    twice = np.zeros(len(ranked), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(ids), bool)
    at = order[twice]
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum()), m


_LETTER, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])
_SPACE[[ord(c) for c in SPACE_CHARS]] = True


def _letterless(raw: bytes) -> tuple[int, float]:
    """Words without a letter of ASCII or a character beyond it; the share of punctuation and symbols of ASCII."""
    b = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[b]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return 0, 0.0
    return int((np.add.reduceat(_LETTER[b].astype(np.int32), starts) == 0).sum()), float(_MARK[b].mean())


def _capitals(text: str) -> float:
    """The share of characters that are not their own lower case."""
    a, b = text.encode("utf-32-le", "replace"), text.lower().encode("utf-32-le", "replace")
    if len(a) != len(b):
        return sum(map(str.isupper, text)) / len(text)
    return float((np.frombuffer(a, np.uint32) != np.frombuffer(b, np.uint32)).mean()) if a else 0.0


def measure(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """MEASURES of a text, and what each rule looks at."""
    raw = text.encode()
    words = raw.split()  # at the white space of ASCII
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE_CHARS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE_CHARS)]
    dup = len(lines) - len(set(lines))
    repeat, distinct = _repeated(words)
    letterless, marks = _letterless(raw)
    some = max(n, 1)
    looks = (
        symbols / some,
        dup / max(len(lines), 1),
        repeat / some,
        float(not 2.5 <= chars / some <= 12),
        _capitals(text),
        text.count("!") / some,
        letterless / some,
        1 - distinct / some,
        marks,
    )
    return (n, chars, symbols, dup, repeat), looks


def votes(n_words: int, looks: tuple[float, ...]) -> str:
    """The votes as one character each: G, B or - for an abstention."""
    return "".join(
        "-" if n_words < r.least else "G" if x <= r.good else "B" if x > r.bad else "-" for r, x in zip(RULES, looks)
    )


def _numbers(patterns: list[str]) -> np.ndarray:
    return np.array([[{"G": 1, "B": -1, "-": 0}[c] for c in p] for p in patterns]).reshape(-1, len(RULES))


@dataclass(frozen=True)
class Estimate:
    """share of good texts; for each rule, how often its vote is right on good and on bad texts."""

    share: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        v = _numbers(patterns)
        # a vote for good is never held against a text, nor one for bad in its favour; to abstain says nothing
        good = np.maximum(np.log(self.on_good / (1 - self.on_bad)), 0)
        bad = np.minimum(np.log((1 - self.on_good) / self.on_bad), 0)
        return 1 / (1 + np.exp(-(np.log(self.share / (1 - self.share)) + (v == 1) @ good + (v == -1) @ bad)))


def estimate(patterns: list[tuple[str, int]], rounds: int = 100) -> Estimate:
    """The share of good texts and each rule's two accuracies, by expectation-maximisation.

    patterns: vote strings and how many texts have them, 3 to the power of the number of rules
    at most. Votes are taken as independent given the quality. Estimates start at, and are
    smoothed by 20 votes at, an accuracy of 0.99 on good texts and 0.2 on bad ones (a rule sees
    one kind of badness only); the order of patterns does not matter.
    """
    e = Estimate(0.85, np.full(len(RULES), 0.99), np.full(len(RULES), 0.2))
    n = np.array([k for _, k in patterns], float)
    names = [p for p, _ in patterns]
    v = _numbers(names)
    for _ in range(rounds if patterns else 0):
        good = e.posterior(names)
        g, b = n * good, n * (1 - good)
        e = Estimate(
            float(np.clip((g.sum() + 17) / (n.sum() + 20), 0.02, 0.98)),
            np.clip((g @ (v == 1) + 19.8) / (g @ (v != 0) + 20), 0.01, 0.999),
            np.clip((b @ (v == -1) + 4) / (b @ (v != 0) + 20), 0.01, 0.999),
        )
    return e


def _measured(docs: DataFrame, text_col: str, batch_out, schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            rows = [measure(t) for lot in in_lots(b.column(at)) for t in lot]
            yield batch_out(b, [m for m, _ in rows], [votes(m[0], x) for m, x in rows])

    return docs.mapInArrow(sparing(run), schema)


def learn(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The posterior probability of each vote pattern in docs; every whole text votes."""

    def counted(b, measures, patterns):
        found: dict[str, int] = {}
        for p in patterns:
            found[p] = found.get(p, 0) + 1
        return pa.RecordBatch.from_pydict({"pattern": list(found), "n": pa.array(found.values(), pa.int64())})

    return _posteriors(_measured(docs.select(text_col), text_col, counted, "pattern string, n bigint"))


def _posteriors(counts: DataFrame) -> dict[str, float]:
    found = counts.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # 3^rules rows at most
    names = [r["pattern"] for r in found]
    return dict(zip(names, estimate([(r["pattern"], r["n"]) for r in found]).posterior(names).tolist()))


def _failed(m: tuple[int, ...]) -> bool:
    return m[0] < MIN_WORDS or 100 * m[4] > REPEAT_PERCENT * m[0]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, MEASURES, base_failed, p_good, kept.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text; a null or empty text has none and fails.
    word_chars: code points in words; n_symbols: characters of SYMBOLS; n_dup_lines: lines with a
    word that equal an earlier line; n_repeat_words: words in 3-word windows found twice or more.
    base_failed: under MIN_WORDS words, or over REPEAT_PERCENT of them in repeated windows. The
    other texts are kept if p_good, the posterior of their votes, is KEEP or more. Equal texts get
    equal verdicts; repeated and null ids are judged row by row; other columns are not read. Texts are
    measured whole, however long, a lot at a time. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def out(b, measures, patterns):
        cols = [pa.array([m[i] for m in measures], pa.int64()) for i in range(len(MEASURES))]
        failed = pa.array([_failed(m) for m in measures], pa.bool_())
        return pa.RecordBatch.from_arrays(
            [b.column(0), *cols, failed, pa.array(patterns, pa.string())], names=["doc_id", *MEASURES, "base_failed", "pattern"]
        )

    schema = f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", base_failed boolean, pattern string"
    # the texts are read once; what is kept of them has a fixed size for each row
    measured = cut(_measured(docs.select(id_col, text_col), text_col, out, schema))
    known = _posteriors(measured.select("pattern", F.lit(1).cast("long").alias("n")))
    p_good = docs.sparkSession.createDataFrame(list(known.items()), "pattern string, p_good double")
    return measured.join(F.broadcast(p_good), "pattern").select(
        "doc_id", *MEASURES, "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= KEEP)).alias("kept")
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names. No row moves.

    Repeated rows stay or go together, and an empty table gives an empty one.
    """
    known = learn(docs, text_col)

    def out(b, measures, patterns):
        return b.filter(pa.array([not _failed(m) and known[x] >= KEEP for m, x in zip(measures, patterns)], pa.bool_()))

    return _measured(docs, text_col, out, docs.schema)
