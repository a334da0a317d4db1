"""Language-model scores by deleted interpolation of n-gram estimates (operator 12).

A token's probability is a mixture of its maximum-likelihood estimate after the token before it,
its estimate without context, and an even share of the vocabulary. The mixture weights depend on how
often the context was seen (a bucket for each power of two); they are learned by
expectation-maximisation on counts that are held out of the estimates: a tenth of the training
documents is deleted from the counts for that.

Texts are read once, into blocks of documents: the distinct words of a block and each text as a list
of places among them. All n-grams of a block, each once, are asked for in slices by ranges of
their hashes; a range is counted over all blocks, and each block gets its own answers back.
So no document, word or n-gram gathers more than one entry of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut
from auditloom.llm.hashing import Words, mix

#: One in FOLDS training documents is deleted from the estimates that the weights are learned for.
FOLDS = 10
#: Characters of a block, about, and n-grams of a range, about.
BLOCK, RANGE = 4_000_000, 750_000
#: Buckets of context counts: unseen, 1, 2-3, 4-7, ...
BUCKETS = 64
#: Ratios of estimates are told apart in so many steps for each factor of two when weights are learned.
STEPS = 4
ROUNDS = 60

_BEGIN, _END = mix(np.array([0xB16B00B5, 0xDEADE4D5], np.uint64))
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SLICE = "part int, block long, deleted boolean, keys binary, n binary"
_BLOCKS = "block long, deleted boolean, vocabulary binary, places binary, sizes binary, learn binary"


def _packed(a: np.ndarray) -> bytes:
    """An array compressed, byte by byte of its numbers."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def _lowered(text: str | None) -> str:
    """A-Z in lower case, and no other letter."""
    if not text:
        return ""
    return text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode("utf-8")


def _word_keys(h: np.ndarray) -> np.ndarray:
    return mix(h) & ~np.uint64(1)


def _pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(before) * _PAIR + h) | np.uint64(1)


def learns(doc_id: Column, folds: int = 7, out: int = 2) -> Column:
    """Whether counts may be learned from a document; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != out


def _deleted(doc_id: Column) -> Column:
    """The training documents that the weights are learned on."""
    return F.pmod(F.xxhash64(doc_id, F.lit(12)), F.lit(FOLDS)) == 0


def encoded(rows: DataFrame) -> DataFrame:
    """Blocks of rows (id, learn, deleted, text): the ids, and what _BLOCKS has of their texts.

    vocabulary has the hashes of the distinct tokens, the most frequent first, places each token's
    place there, sizes the tokens of each text and learn whether a text is one to learn from. A block
    holds deleted documents only, or none.
    """
    import os

    kind = rows.schema["id"].dataType.simpleString()

    def block(lot: list, deleted: bool) -> pa.RecordBatch:
        w = Words([_lowered(t) for _, _, t in lot])
        ends = np.cumsum(w.counts + 1)
        h = np.insert(w.hashes, w.offsets[1:], _END)
        words, at, n = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        assert ends[-1] == len(h)
        learn = np.array([x for _, x, _ in lot], np.uint8)
        name = int.from_bytes(os.urandom(8), "little", signed=True)  # the blocks are written once, see cut()
        ids = pa.concat_arrays([i for i, _, _ in lot])
        columns = [pa.array([name]), pa.array([deleted]), *[pa.array([_packed(a)]) for a in (words[order], rank[at], (w.counts + 1).astype(np.uint32), learn)]]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(lot)], pa.int32()), ids)], names=["block", "deleted", "vocabulary", "places", "sizes", "learn", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: dict[bool, list] = {False: [], True: []}
        chars = {False: 0, True: 0}
        for b in batches:
            learn, deleted = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i in range(b.num_rows):
                text, d = b.column(3)[i].as_py(), deleted[i]
                lots[d].append((b.column(0).slice(i, 1), learn[i], text))
                chars[d] += len(text or "")
                if chars[d] >= BLOCK:
                    yield block(lots[d], d)
                    lots[d], chars[d] = [], 0
        for d, lot in lots.items():
            if lot:
                yield block(lot, d)

    return rows.select("id", "learn", "deleted", "text").mapInArrow(run, f"{_BLOCKS}, ids array<{kind}>")


class _Block:
    """A block's tokens: hashes, the hashes before them, where texts begin, and which tokens are learned from."""

    def __init__(self, vocabulary: bytes, places: bytes, sizes: bytes, learn: bytes):
        words = _unpacked(vocabulary, np.uint64)
        self.h = words[_unpacked(places, np.uint32)]
        self.sizes = _unpacked(sizes, np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.concatenate([[_BEGIN], self.h[:-1]]).astype(np.uint64)
        self.before[self.starts] = _BEGIN
        self.learn = np.repeat(_unpacked(learn, np.uint8).astype(bool), self.sizes)
        self.texts_learned = int(_unpacked(learn, np.uint8).sum())

    def keys(self) -> np.ndarray:
        """The keys of all its n-grams, the beginning of a text among them, each once and in order."""
        words = np.unique(np.concatenate([self.h, [_BEGIN]]))
        return np.unique(np.concatenate([_word_keys(words), _pair_keys(self.before, self.h)]))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """How often each key is in the texts to learn from."""
        n = np.zeros(len(keys), np.uint32)
        h = self.h[self.learn]
        for k in (_word_keys(h), _pair_keys(self.before[self.learn], h)):
            at, m = np.unique(k, return_counts=True)
            n[np.searchsorted(keys, at)] = m
        n[np.searchsorted(keys, _word_keys(np.array([_BEGIN])))] = self.texts_learned
        return n


def _asked(blocks: DataFrame, parts: int) -> DataFrame:
    """Slices (part, block, deleted, keys, n) of all n-grams of blocks, by even ranges of the keys."""
    edges = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = _Block(*[b.column(k)[i].as_py() for k in (2, 3, 4, 5)])
                keys = block.keys()
                n = block.counts(keys)
                at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                some = np.flatnonzero(at[1:] > at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), b.column(0)[i].as_py())), pa.array(np.full(len(some), b.column(1)[i].as_py())),
                     pa.array([_packed(np.diff(keys[at[p] : at[p + 1]], prepend=np.uint64(0))) for p in some], pa.binary()), pa.array([_packed(n[at[p] : at[p + 1]]) for p in some], pa.binary())],
                    names=["part", "block", "deleted", "keys", "n"],
                )

    return blocks.drop("ids").mapInArrow(run, _SLICE)


def _answered(asked: DataFrame) -> DataFrame:
    """Rows (block, part, kept, gone, words): for the keys of a slice, how often they are in documents that are not deleted and in deleted ones.

    A row without a block has the distinct words of a range that are in either, in words.
    """

    def run(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in rows["keys"]]
        n = [_unpacked(x.as_py(), np.uint32).astype(np.int64) for x in rows["n"]]
        deleted = np.repeat(np.array(rows["deleted"].to_pylist(), bool), [len(k) for k in keys])
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        n, at = np.concatenate(n), at.ravel()
        kept = np.bincount(at, n * ~deleted, len(known)).astype(np.int64)
        gone = np.bincount(at, n * deleted, len(known)).astype(np.int64)
        begin = known == _word_keys(np.array([_BEGIN]))
        words = int((((known & np.uint64(1)) == 0) & (kept + gone > 0) & ~begin).sum())
        ends = np.cumsum([len(k) for k in keys])
        own = [at[z - len(k) : z] for k, z in zip(keys, ends)]
        part = rows["part"][0].as_py()
        return pa.table({
            "block": pa.array([*rows["block"].to_pylist(), None], pa.int64()), "part": pa.array([part] * (len(own) + 1), pa.int32()),
            "kept": pa.array([*[_packed(kept[a].astype(np.uint64)) for a in own], None], pa.binary()), "gone": pa.array([*[_packed(gone[a].astype(np.uint64)) for a in own], None], pa.binary()),
            "words": pa.array([None] * len(own) + [words], pa.int64()),
        })

    return asked.groupBy("part").applyInArrow(run, "block long, part int, kept binary, gone binary, words long")


def _known(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """blocks with parts, the answers to their slices in the order of the keys."""
    own = answers.filter("block IS NOT NULL").groupBy(F.col("block").alias("_block"))
    own = own.agg(F.array_sort(F.collect_list(F.struct("part", "kept", "gone"))).alias("parts"))
    return blocks.join(own, F.col("block") == F.col("_block")).drop("_block")


def _estimates(block: _Block, keys: np.ndarray, n: np.ndarray, total: float, words: int) -> tuple[np.ndarray, ...]:
    """For each token its context's bucket, its two maximum-likelihood estimates and its even share; and its count."""
    of = lambda k: n[np.searchsorted(keys, k)]
    context, own = of(_word_keys(block.before)), of(_word_keys(block.h))
    pair = of(_pair_keys(block.before, block.h))
    bucket = np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64).clip(0, BUCKETS - 1)
    return bucket, pair / np.maximum(context, 1), own / max(total, 1), np.full(len(own), 1 / (words + 1)), own


def _answers(parts) -> tuple[np.ndarray, np.ndarray]:
    both = [np.concatenate([_unpacked(p[k], np.uint64) for p in parts]).astype(np.float64) for k in ("kept", "gone")]
    return both[0], both[1]


def _held_out(known: DataFrame, kept_tokens: int, words: int) -> DataFrame:
    """Rows (bucket, two, one, n): how many held-out tokens have which estimates, by the bucket of the context.

    two and one are the estimates with and without context in steps of their ratio to the even share; null: the estimate is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = _Block(*[b.column(k)[i].as_py() for k in range(4)])
                if not block.learn.any():
                    continue
                bucket, two, one, even, _ = _estimates(block, block.keys(), _answers(b.column(4)[i].as_py())[0], kept_tokens, words)
                use = block.learn
                with np.errstate(divide="ignore"):
                    a, c = (np.where(p > 0, np.round(np.log2(p / even) * STEPS), -(1 << 20)).astype(np.int64)[use] for p in (two, one))
                cells, n = np.unique(np.stack([bucket[use], a, c]), axis=1, return_counts=True)
                none = lambda x: pa.array(x.astype(np.int32), mask=x == -(1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(cells[0].astype(np.int32)), none(cells[1]), none(cells[2]), pa.array(n)], names=["bucket", "two", "one", "n"])

    rows = known.select("vocabulary", "places", "sizes", "learn", "parts").mapInArrow(run, "bucket int, two int, one int, n long")
    return rows.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))


def learned(bucket: np.ndarray, ratios: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The weights (a row for each bucket) that make held-out tokens likeliest, by expectation-maximisation.

    ratios has for each kind of token its estimates over the even share: with context, without, and 1. One
    token is added to each weight, so that a bucket without tokens has even weights.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[bucket] * ratios
        share *= (n / share.sum(axis=1))[:, None]
        new = np.ones((BUCKETS, 3))
        np.add.at(new, bucket, share)
        weights = new / new.sum(axis=1, keepdims=True)
    # a context that was never seen has no estimate: its weight is given to the others
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, out: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words ([^\\x20\\x09-\\x0D]+, A-Z in lower case) and one end; a null text counts as empty
    and is one token. Documents with crc32(id as text) mod folds = out are held out, a null id counts as an empty
    text there; repeated rows count as often as they come. base_score is the sum of log10((c + 1) / (N + V + 1))
    and score the model's log10 probability of the text, of whole texts however long. All tokens that are
    not in the training documents are one word to the model. Further columns are not read. An empty
    table gives an empty result; where all documents are held out, counts are 0 and each token has the even share 1.
    """
    held = ~learns(F.col(id_col), folds, out)
    rows = docs.select(F.col(id_col).alias("id"), (~held).alias("learn"), (~held & _deleted(F.col(id_col))).alias("deleted"), F.col(text_col).alias("text"))
    blocks = cut(encoded(rows))
    sizes = blocks.select("deleted", "sizes", "learn").mapInArrow(_sizes, "deleted boolean, tokens long, learned long").groupBy("deleted")
    tokens = {r["deleted"]: (r["t"], r["n"]) for r in sizes.agg(F.sum("tokens").alias("t"), F.sum("learned").alias("n")).collect()}
    total = sum(t for t, _ in tokens.values())
    kept, train = tokens.get(False, (0, 0))[1], sum(n for _, n in tokens.values())
    answers = cut(_answered(_asked(blocks, max(1, total // RANGE))))
    words = answers.agg(F.sum("words")).first()[0] or 0
    cells = _held_out(_known(blocks.filter("deleted"), answers), kept, words).collect()  # bounded by buckets and steps
    ratio = lambda name: np.array([0.0 if r[name] is None else 2.0 ** (r[name] / STEPS) for r in cells])
    weights = learned(np.array([r["bucket"] for r in cells], int), np.stack([ratio("two"), ratio("one"), np.ones(len(cells))], axis=1), np.array([r["n"] for r in cells], float))
    return _scored(_known(blocks, answers), weights, train, words)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = [_unpacked(x.as_py(), np.uint32).astype(np.int64) for x in b.column(1)]
        learn = [_unpacked(x.as_py(), np.uint8) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([int(s.sum()) for s in sizes], pa.int64()), pa.array([int((s * x).sum()) for s, x in zip(sizes, learn)], pa.int64())], names=["deleted", "tokens", "learned"]
        )


def _scored(known: DataFrame, weights: np.ndarray, train: int, words: int) -> DataFrame:
    kind = known.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = _Block(*[b.column(k)[i].as_py() for k in range(4)])
                bucket, two, one, even, own = _estimates(block, block.keys(), sum(_answers(b.column(4)[i].as_py())), train, words)
                w = weights[bucket]
                # where nothing was learned there is nothing but the even share
                p = w[:, 0] * two + w[:, 1] * one + w[:, 2] * even if train else even
                base = np.log10((own + 1) / (train + words + 1))
                ids, starts = b.column(5)[i].values, block.starts
                learn = _unpacked(b.column(3)[i].as_py(), np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(~learn), pa.array(block.sizes), pa.array(np.add.reduceat((own > 0).astype(np.int64), starts)), pa.array(np.full(len(starts), train)),
                     pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = known.select("vocabulary", "places", "sizes", "learn", "parts", "ids")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
