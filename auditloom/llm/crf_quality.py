"""Document quality by a linear-chain conditional random field over lines (operator 3).

Every line is labelled good or bad from features of itself and of the lines beside it; the
forward-backward marginals, weighted by line length, give the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, in_lots

#: Of the labelled documents, the model is fitted on so many at most (those with the smallest hash), and on
#: fewer where their texts come to more than so many bytes.
TRAIN_DOCS, TRAIN_BYTES = 4000, 64 << 20
#: A document is predicted good from this score on.
GOOD = 0.3

_SYMBOLS = "#*$%&|<>"
_KINDS = ("upper", "lower", "digit", "symbol", "bang", "mark", "space")
BASE = (
    "upper", "lower", "digit", "symbol", "bang", "mark", "word length", "repeated words", "earlier line", "sentence end",
    "log length", "empty",
)
#: A line's own features, those of the line before and the line after, whether these exist, and a constant.
WIDTH = 3 * len(BASE) + 3

_table: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """The kind of each character of the basic plane, as a bit set in the order of _KINDS."""
    global _table
    if _table is None:
        t = np.zeros(65537, np.uint8)
        for i in range(65536):
            c = chr(i)
            t[i] = (
                c.isupper() or (c.islower() and 2) or (c.isdigit() and 4) or (c in _SYMBOLS and 8) or (c == "!" and 16) or (c in ".,;:?'\"-()" and 32) or (c.isspace() and 64) or (c.isalpha() and 2)
            )
        t[65536] = 2  # beyond the basic plane
        _table = t
    return _table


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of texts, code points of each line, lines of each text (one at least)."""
    parts = [t.split("\n") for t in texts]
    lines = [x for p in parts for x in p]
    counts = np.array([len(p) for p in parts], np.int64)
    codes = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "replace"), np.uint32)
    kinds = _kind_table()[np.minimum(codes, 65536)]
    sizes = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = np.maximum(sizes, 1)
    per = {k: np.add.reduceat((kinds >> i) & 1, starts, dtype=np.int64) for i, k in enumerate(_KINDS)}
    per["space"] -= 1  # the line end
    f = np.zeros((len(lines), len(BASE)))
    for i, k in enumerate(_KINDS[:6]):
        f[:, i] = per[k] / n
    repeated, again, ends = np.zeros(len(lines)), np.zeros(len(lines)), np.zeros(len(lines))
    i = 0
    for p in parts:
        seen: set[str] = set()
        for x in p:
            words = x.split()
            if words:
                repeated[i] = 1 - len(set(words)) / len(words)
                again[i] = x in seen
                seen.add(x)
                ends[i] = x.rstrip()[-1] in ".?!:;\"'"
            i += 1
    f[:, 6] = np.minimum(sizes / (per["space"] + 1.0), 40) / 10
    f[:, 7], f[:, 8], f[:, 9] = repeated, again, ends
    f[:, 10] = np.log1p(sizes) / 8
    f[:, 11] = sizes == 0
    first = np.zeros(len(lines), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.roll(first, -1)
    before, after = np.roll(f, 1, 0), np.roll(f, -1, 0)
    before[first], after[last] = 0, 0
    return np.hstack([f, before, after, first[:, None], last[:, None], np.ones((len(lines), 1))]), sizes, counts


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sequences by falling length: their order, where each begins, and how many have a t-th line."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    alive = [int(k) for k in np.searchsorted(-counts[order], -np.arange(1, counts.max() + 1), side="right")]
    return order, starts, alive


def forward_backward(e: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good for every line, expected transitions (2 by 2), and the sum of log partitions.

    e: a line's score for good (that for bad is 0); trans[i, j]: score of state j after state i.
    All sequences advance together, one line at a time.
    """
    order, starts, alive = _padded(counts)
    alpha, beta = np.zeros((len(e), 2)), np.zeros((len(e), 2))
    emit = np.stack([np.zeros_like(e), e], 1)
    log_z = 0.0
    for t, k in enumerate(alive):
        at = starts[:k] + t
        if t == 0:
            alpha[at] = emit[at]
        else:
            m = alpha[at - 1][:, :, None] + trans
            alpha[at] = np.logaddexp(m[:, 0], m[:, 1]) + emit[at]
    for t in range(len(alive) - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        m = trans + (emit[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(m[:, :, 0], m[:, :, 1])
    both = alpha + beta
    z = np.logaddexp(both[:, 0], both[:, 1])
    log_z = float(z[np.cumsum(counts) - 1].sum())
    pairs = np.zeros((2, 2))
    inner = np.ones(len(e), bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    if len(at):
        p = alpha[at - 1][:, :, None] + trans + (emit[at] + beta[at])[:, None, :] - z[at][:, None, None]
        pairs = np.exp(p).sum(0)
    return np.exp(both[:, 1] - z), pairs, log_z


class Model:
    """Weights of the field, the features' scale, and the calibration of a document's mean marginal."""

    def __init__(self, mean, scale, w, trans, a=1.0, b=0.0):
        self.mean, self.scale, self.w, self.trans, self.a, self.b = mean, scale, w, trans, a, b

    def means(self, x: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each text's marginals of good, weighted by line length (an empty line weighs as half a character)."""
        e = ((x - self.mean) / self.scale) @ self.w
        good, _, _ = forward_backward(e, self.trans, counts)
        weight = np.maximum(sizes, 0.5)
        at = np.cumsum(counts) - counts
        return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.calibrated(self.means(*line_features(texts))) if texts else np.zeros(0)

    def calibrated(self, mean: np.ndarray) -> np.ndarray:
        m = np.clip(mean, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.a * np.log(m / (1 - m)) + self.b)))


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Follows the gradient of a sum that is to be made small."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(texts: list[str], good: list[int], steps: int = 120, ridge: float = 1e-3) -> Model:
    """A model from labelled documents.

    Lines have no labels of their own: at first each has its document's, weighted by its share of
    the document. A line of a bad document that looks good by these is then labelled good, and
    the field is fitted on the line labels; at last a document's mean marginal is calibrated on
    the documents' labels. With one label only, the model scores everything as that label's share.
    """
    if not texts or len(set(good)) < 2:
        share = (sum(good) + 0.5) / (len(good) + 1)
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    x, sizes, counts = line_features(texts)
    y = np.array(good, float)
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale < 1e-6] = 0, 1
    xs = (x - mean) / scale
    doc = np.repeat(np.arange(len(texts)), counts)
    weight = np.maximum(sizes, 0.5)
    weight = weight / np.add.reduceat(weight, np.cumsum(counts) - counts)[doc]
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    w0 = _adam(lambda w: xs.T @ (weight * (sigmoid(xs @ w) - y[doc])) / len(texts) + ridge * w, np.zeros(WIDTH), steps, 0.05)
    label = ((y[doc] == 1) | (xs @ w0 > 0)).astype(float)
    inner = np.ones(len(label), bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at - 1].astype(int), label[at].astype(int)), 1)

    def gradient(p):
        w, trans = p[:WIDTH], p[WIDTH:].reshape(2, 2)
        marginal, pairs, _ = forward_backward(xs @ w, trans, counts)
        return np.concatenate([xs.T @ (marginal - label), (pairs - seen).ravel()]) / len(label) + ridge * p

    p = _adam(gradient, np.concatenate([w0, np.zeros(4)]), steps // 2, 0.05)
    model = Model(mean, scale, p[:WIDTH], p[WIDTH:].reshape(2, 2))
    m = np.clip(model.means(x, sizes, counts), 1e-4, 1 - 1e-4)
    logit = np.stack([np.log(m / (1 - m)), np.ones(len(m))], 1)
    # towards the middle by a count of one in ten, so that no score rests on a few documents
    model.a, model.b = _adam(lambda ab: logit.T @ (sigmoid(logit @ ab) - y) / len(y) + 1e-3 * ab, np.array([1.0, 0.0]), 400, 0.05)
    model.a = max(float(model.a), 0.05)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, limit_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, text and quality of the labelled documents to learn from.

    Those whose crc32(doc_id as text) mod 5 is 0 are held out, and null labels and ids are none. Of the
    others the limit with the smallest hashes are taken, in this order while their texts (whole
    ones) come to limit_bytes at most. Of rows that share an id the shortest text counts, then the
    least; an id with several labels has the smaller one.
    """
    key = F.col("doc_id").cast("string")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = (
        labels.filter(F.col("quality").isNotNull() & (F.crc32(key) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(*order)
        .limit(limit)
    )
    # the pick has at most limit rows of two numbers
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(pick), "doc_id")
    rows = cut(rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.octet_length("text").alias("size"), "text")).alias("t")))
    total, few = 0, 0
    for r in rows.orderBy(*order).select("t.size").collect():  # limit numbers
        total += r["size"]
        if total > limit_bytes:
            break
        few += 1
    return rows.orderBy(*order).limit(few).select("doc_id", "t.text", "quality")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, limit_bytes: int = TRAIN_BYTES) -> Model:
    """The model of training_rows(), which the driver fits: limit rows and limit_bytes of text at most."""
    rows = sorted(training_rows(docs, labels, limit, limit_bytes).collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [int(r["quality"]) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 from GOOD on).

    The whole text is scored, however long, and nothing else is an input. A null text counts as
    empty, and an empty text is one empty line. Equal texts score alike, repeated rows stay, and of a
    null id held_out is null; further columns are not read. An empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shipped.value.scores(lot) for lot in in_lots(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"]
            )

    return (
        docs.select("doc_id", "text")
        .mapInArrow(run, f"doc_id {kind}, score double")
        .select(
            "doc_id",
            (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
            "score",
            (F.col("score") >= GOOD).cast("int").alias("predicted"),
        )
    )
