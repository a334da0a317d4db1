"""Near-duplicate detection by improved consistent weighted sampling (operator 6).

A text is its multiset of five-word shingles, a shingle weighing its count times its inverse
document frequency. Each of BANDS * ROWS samples picks a shingle (and a quantised weight) so
that two texts agree with a probability of their weighted Jaccard similarity; texts that agree
in a whole band meet, and every pair that is looked at is verified by its exact similarity.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, dealt_anew, give_back, in_lots, rows_that_stay, sparing, text_or_empty
from auditloom.llm.hashing import Words, mix
from auditloom.llm.ngram_lm import _packed, _unpacked

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 meets in a band with probability 0.51 and in none of 9 with 0.0016.
BANDS, ROWS = 9, 3
#: The floor of document frequencies, as a share of the rows: under one row of any table, so there is none.
FREQUENT = 2.0**-63
#: Characters of a block of texts, and shingles of a range of hashes, about.
BLOCK, RANGE = 6_000_000, 1_500_000
#: Bytes of texts for each part of the tables about them, about, and the least number of parts.
PART, PARTS = 8_000_000, 48
#: A pair of texts that share several shingles comes once if they are among the first so many, else more often.
_FEW = 64

_steps = 1 << 16
_uniform = (np.arange(_steps) + 0.5) / _steps


def _gamma_quantiles() -> np.ndarray:
    """The quantiles of Gamma(2, 1) at the middles of 2^16 equal steps."""
    x = np.linspace(0, 40, 400_001)
    return np.interp(_uniform, 1 - np.exp(-x) * (1 + x), x).clip(1e-4)


_R = _gamma_quantiles().astype(np.float32)
_LOG_C = np.log(_R)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _short(w: Words, i: int) -> np.ndarray:
    """The one shingle of a text under SHINGLE words."""
    return mix(np.array([int.from_bytes(hashlib.blake2b(w.text(i), digest_size=8).digest(), "little")], np.uint64))


def shingles(lot: list[str]) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Each text's distinct shingles as sorted hashes, with counts.

    A text under SHINGLE words has one shingle, all its words; a text without words has none.
    """
    w = Words(lot)
    h, _ = w.windows(SHINGLE)
    out = []
    for i, n in enumerate(w.counts):
        a = w.offsets[i]
        if n >= SHINGLE:
            own = np.sort(h[a : a + n - SHINGLE + 1])
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out.append((own[edge], np.diff(edge, append=len(own))))
        elif n:
            out.append((_short(w, i), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return w, out


class Weights:
    """Inverse document frequencies of some shingles among n rows, by hash."""

    def __init__(self, n: int, hashes: np.ndarray, df: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], 1 + np.log(n / df[order])

    def of(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        return count * self.idf[np.searchsorted(self.hashes, h)]


def bands(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A key for each band of a weighted set."""
    log_w = np.log(weight).astype(np.float32)
    picks = np.zeros(BANDS * ROWS, np.uint64)
    step = max(1, 20_000 // len(h))  # cells that stay in a core's cache
    for k in range(0, len(picks), step):
        seeds = _SEEDS[k : k + step, None]
        u = mix(h[None, :] ^ seeds).view(np.uint16).reshape(-1, len(h), 4)
        r, log_c = _R[u[..., 0].astype(np.intp)], _LOG_C[u[..., 1].astype(np.intp)]
        beta = (u[..., 2].astype(np.float32) + np.float32(0.5)) * np.float32(1 / _steps)
        t = np.floor(log_w / r + beta)
        best = np.argmin(log_c - r * (t - beta + 1), axis=1)
        rows = np.arange(len(best))
        picks[k : k + step] = mix(h[best] ^ mix(t[rows, best].astype(np.int64).view(np.uint64)))
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + picks.reshape(BANDS, ROWS)[:, j])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: Weights) -> float:
    """Weighted Jaccard of two texts' shingles: the sum of least weights over the sum of largest."""
    (ha, ca), (hb, cb) = a, b
    wa, wb = weights.of(ha, ca), weights.of(hb, cb)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    least = float(np.minimum(wa[i], wb[j]).sum())
    total = float(wa.sum() + wb.sum()) - least
    return least / total if total else 0.0


def digest(text: str) -> bytes:
    """128 bits that stand for the words of a text."""
    return hashlib.blake2b(b" ".join(text.encode("utf-8", "replace").split()), digest_size=16).digest()


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of rows (id, sha, text): block, ids, shas, sizes and texts, all texts of a block packed as one."""
    kind = rows.schema["id"].dataType.simpleString()

    def block(lot: list) -> pa.RecordBatch:
        raw = [text.encode("utf-8") for _, _, text in lot]
        name = int.from_bytes(os.urandom(8), "little", signed=True)  # the blocks are written once, see cut()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(lot)], pa.int32()), pa.concat_arrays([x[k] for x in lot])) for k in (0, 1)]
        packed = [pa.array([_packed(a)], pa.binary()) for a in (np.array([len(x) for x in raw], np.uint32), np.frombuffer(b"".join(raw), np.uint8))]
        return pa.RecordBatch.from_arrays([pa.array([name]), *lists, *packed], names=["block", "ids", "shas", "sizes", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, chars = [], 0
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                lot.append((b.column(0).slice(i, 1), b.column(1).slice(i, 1), text))
                chars += len(text)
                if chars >= BLOCK:
                    yield block(lot)
                    lot, chars = [], 0
        if lot:
            yield block(lot)

    return rows.select("id", "sha", "text").mapInArrow(sparing(run), f"block long, ids array<{kind}>, shas array<binary>, sizes binary, texts binary")


def _texts(sizes: bytes, texts: bytes) -> list[str]:
    ends = np.cumsum(_unpacked(sizes, np.uint32).astype(np.int64)).tolist()
    raw = _unpacked(texts, np.uint8).tobytes()
    return [raw[a:z].decode("utf-8") for a, z in zip([0, *ends], ends)]


def _sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """shingles() of many texts, a lot at a time."""
    out, a, size = [], 0, 0
    for z, text in enumerate(texts, 1):
        size += len(text)
        if size >= 250_000 or z == len(texts):
            out += shingles(texts[a:z])[1]
            a, size = z, 0
    return out


def _asked(blocks: DataFrame, parts: int) -> DataFrame:
    """Slices (part, block, keys, n) of the distinct shingles of blocks, by even ranges of hashes; n texts of the block have one."""
    edges = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h = np.concatenate([h for h, _ in _sets(_texts(b.column(1)[i].as_py(), b.column(2)[i].as_py()))])
                keys, n = np.unique(h, return_counts=True)
                at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                some = np.flatnonzero(at[1:] > at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), b.column(0)[i].as_py())),
                     pa.array([_packed(np.diff(keys[at[p] : at[p + 1]], prepend=np.uint64(0))) for p in some], pa.binary()), pa.array([_packed(n[at[p] : at[p + 1]].astype(np.uint64)) for p in some], pa.binary())],
                    names=["part", "block", "keys", "n"],
                )

    return blocks.select("block", "sizes", "texts").mapInArrow(sparing(run), "part int, block long, keys binary, n binary")


def _answered(asked: DataFrame) -> DataFrame:
    """Rows (block, part, df): how many texts of all blocks have each shingle of a slice."""

    def run(rows: pa.Table) -> pa.Table:
        try:
            return counted(rows)
        finally:
            give_back()

    def counted(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in rows["keys"]]
        n = np.concatenate([_unpacked(x.as_py(), np.uint64) for x in rows["n"]]).astype(np.float64)
        at = np.unique(np.concatenate(keys), return_inverse=True)[1].ravel()
        df = np.bincount(at, n).astype(np.uint64)[at]
        ends = np.cumsum([len(k) for k in keys])
        return pa.table({"block": rows["block"], "part": rows["part"], "df": pa.array([_packed(df[z - len(k) : z]) for k, z in zip(keys, ends)], pa.binary())})

    return asked.groupBy("part").applyInArrow(run, "block long, part int, df binary")


class Frequencies:
    """The document frequencies of all shingles of n rows with texts of so many bytes, beside the blocks of these texts (known)."""

    def __init__(self, known: DataFrame, n: int, size: int):
        self.known, self.n, self._found = known, n, {}
        self.parts = max(PARTS, size // PART)

    def of(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The weights of a few shingles, which are looked up one by one."""
        new = np.array(sorted(set(h.tolist()) - set(self._found)), np.uint64)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, _, sets, dfs in _in_blocks(batches):
                for (own, _), df in zip(sets, dfs):
                    hit = np.isin(own, new)
                    yield pa.RecordBatch.from_arrays([pa.array(own[hit].view(np.int64)), pa.array(df[hit].astype(np.int64))], names=["h", "df"])

        if len(new):
            rows = self.known.mapInArrow(sparing(found), "h bigint, df bigint").distinct().collect()
            self._found |= {int(np.int64(r["h"]).view(np.uint64)): r["df"] for r in rows}
        return Weights(self.n, h, np.array([self._found[x] for x in h.tolist()], np.int64)).of(h, count) if len(h) else np.zeros(0)

    def beside(self, texts: DataFrame) -> DataFrame:
        """texts with df, what signatures() has in it; looked up by the text if it is not there yet."""
        if "df" in texts.columns:
            return texts
        own = signatures(self).select("sha", "df").dropDuplicates(["sha"])
        return texts.join(own, text_sha("text") == F.col("sha")).drop("sha")


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list[str], list, list[np.ndarray]]]:
    """Of each block: ids, shas, texts, and each text's shingles() and their document frequencies."""
    for b in batches:
        for i in range(b.num_rows):
            texts = _texts(b.column(2)[i].as_py(), b.column(3)[i].as_py())
            sets = _sets(texts)
            h = np.concatenate([h for h, _ in sets])
            df = [_unpacked(x["df"], np.uint64) for x in b.column(4)[i].as_py() or []]
            if df:
                h = np.concatenate(df)[np.unique(h, return_inverse=True)[1].ravel()]
            yield b.column(0)[i].values, b.column(1)[i].values, texts, sets, np.split(h, np.cumsum([len(x) for x, _ in sets])[:-1])


def document_frequencies(docs: DataFrame, text_col: str = "text", id_col: str | None = None) -> Frequencies:
    """In how many rows of docs each shingle is: of every shingle, whatever the number of rows.

    Texts are read once, into blocks. The distinct shingles of a block are asked for in slices by ranges of their
    hashes; a range is counted over all blocks, and each block gets its own answers back. So a shingle, however
    frequent, has one entry of each block.
    """
    own = F.col(id_col) if id_col else F.lit(None).cast("long")
    blocks = cut(blocks_of(docs.select(own.alias("id"), text_sha(text_col).alias("sha"), text_or_empty(text_col).alias("text"))))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [_unpacked(x.as_py(), np.uint32).astype(np.int64) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in n], pa.int64()), pa.array([int(x.sum()) for x in n], pa.int64())], names=["n", "bytes"])

    total = blocks.select("sizes").mapInArrow(sparing(sizes), "n bigint, bytes bigint").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    # about six bytes a word
    answers = cut(_answered(_asked(blocks, max(1, (total["bytes"] or 0) // 6 // RANGE))))
    answers = answers.groupBy(F.col("block").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("part", "df"))).alias("parts"))
    known = blocks.join(answers, F.col("block") == F.col("_block"), "left").select("ids", "shas", "sizes", "texts", "parts")
    return Frequencies(known, total["n"] or 0, total["bytes"] or 0)


def signatures(weights: Frequencies) -> DataFrame:
    """Rows (doc_id, t, bands, sha, df): t is a digest of the words, bands is empty for a text without words, sha is of the text as it stands.

    df has the document frequencies of the text's shingles in the order of shingles(), packed.
    """
    n, kind = weights.n, weights.known.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shas, texts, sets, dfs in _in_blocks(batches):
            digests, keys, packed, known = [], [], [], {}
            for text, (h, c), df in zip(texts, sets, dfs):
                t = digest(text)
                if t not in known:
                    known[t] = (bands(h, c * (1 + np.log(n / df))).view(np.int64), _packed(df)) if len(h) else (np.zeros(0, np.int64), b"")
                digests.append(t)
                keys.append(known[t][0])
                packed.append(known[t][1])
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))), shas, pa.array(packed, pa.binary())],
                names=["doc_id", "t", "bands", "sha", "df"],
            )

    return weights.known.mapInArrow(sparing(run), f"doc_id {kind}, t binary, bands array<bigint>, sha binary, df binary")


def text_sha(text_col: str) -> Column:
    return F.unhex(F.sha2(F.encode(text_or_empty(text_col), "UTF-8"), 256))


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """pairs (a, b) with sim, the exact similarity. texts: t, text, df."""
    both = (
        pairs.join(texts.select(F.col("t").alias("a"), F.col("text").alias("x"), F.col("df").alias("p")), "a")
        .join(texts.select(F.col("t").alias("b"), F.col("text").alias("y"), F.col("df").alias("q")), "b")
        .select("a", "b", "x", "y", "p", "q")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            x, y, p, q = (batch.column(k) for k in range(2, 6))
            for i in range(batch.num_rows):
                _, both = shingles([x[i].as_py(), y[i].as_py()])
                df = [_unpacked(z[i].as_py(), np.uint64) for z in (p, q)]
                sims.append(similarity(*both, Weights(n, np.concatenate([h for h, _ in both]), np.concatenate(df))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return both.mapInArrow(sparing(run), "a binary, b binary, sim double")


def _cut(df: DataFrame, parts: int) -> DataFrame:
    """cut() in so many parts at most: where files are local, Hadoop starts a process for each one that a checkpoint has."""
    return cut(df.coalesce(parts))


def components(links: DataFrame, parts: int = PARTS) -> DataFrame:
    """Rows (t, c): for each end of links (a, b) the least end of its component.

    Each round takes the least label of the neighbours and then that label's own label, so the
    number of rounds grows with the logarithm of a component's diameter.
    """
    edges = _cut(links.select("a", "b").union(links.select("b", "a")).distinct(), parts)
    labels = _cut(edges.groupBy(F.col("a").alias("t")).agg(F.min("b").alias("m")).select("t", F.least("t", "m").alias("c")), parts)
    while True:
        beside = edges.join(labels, F.col("b") == F.col("t")).groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(beside, F.col("t") == F.col("a")).select("t", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("t").alias("j"), F.col("c").alias("k"))
        new = _cut(step.join(jump, F.col("c") == F.col("j"), "left").select("t", "old", F.least("c", F.coalesce("k", "c")).alias("c")), parts)
        done = new.filter("c <> old").isEmpty()
        labels = new.select("t", "c")
        if done:
            return labels


def _centred(placed: DataFrame, parts: int = PARTS) -> DataFrame:
    """Rows (band, key, t, a): the texts of each group of two and more, with the group's centre.

    The centre is the text that meets the most others over all bands (of these the least): in a
    group of copies with changes that is the text they come from, if it is there.
    """
    sizes = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select(F.col("band").alias("_band"), dealt_anew(F.col("key")).alias("_key"), "n")
    shared = _cut(placed.join(sizes, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))).select("band", "key", "t", "n"), parts)
    met = shared.groupBy("t").agg(F.sum("n").alias("meets")).select(F.col("t").alias("_t"), "meets")
    shared = shared.join(met, F.col("t") == F.col("_t")).select("band", "key", "t", "meets")
    centres = shared.groupBy("band", "key").agg(F.min(F.struct(-F.col("meets"), F.col("t").alias("a"))).alias("m"))
    return _cut(shared.join(centres.select("band", "key", "m.a"), ["band", "key"]).select("band", "key", "t", "a"), parts)


def _prefixes(texts: DataFrame, n: int) -> DataFrame:
    """Rows (t, h, before, total, rest): of each text those shingles one of which every text like it shares.

    The shingles that the fewest of all rows have come first, until those left weigh less than
    SIMILARITY of the text: texts whose first shingles are all different cannot be alike. In a group of copies
    with changes the first ones are the changed ones, so only copies that share changes meet.
    before has the shingles before this one, if they are _FEW or fewer, total is the text's weight
    and rest that of this shingle and those after it; shingles of one row only are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pick, hashes, totals, rests, before, done = [], [], [], [], [], 0
            for lot in in_lots(b.column(1)):
                for i, (h, c) in enumerate(shingles(lot)[1], done):
                    df = _unpacked(b.column(2)[i].as_py(), np.uint64)
                    order = np.lexsort((h, df))
                    h, df = h[order].view(np.int64), df[order]
                    w = c[order] * (1 + np.log(n / df))
                    total = w.sum()
                    rest = total - np.cumsum(w) + w
                    some = (rest >= (SIMILARITY - 1e-6) * total) & (df > 1)
                    pick.append(np.full(some.sum(), i))
                    hashes.append(h[some])
                    totals.append(np.full(some.sum(), total))
                    rests.append(rest[some])
                    own = h[some].tolist()
                    before += [own[:k] if k <= _FEW else [] for k in range(len(own))]
                done += len(lot)
            if pick:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.concatenate(pick))), pa.array(np.concatenate(hashes)), pa.array(before, pa.list_(pa.int64())), pa.array(np.concatenate(totals)), pa.array(np.concatenate(rests))],
                    names=["t", "h", "before", "total", "rest"],
                )

    return texts.select("t", "text", "df").mapInArrow(sparing(run), "t binary, h bigint, before array<bigint>, total double, rest double")


def _across(met: DataFrame, sims: DataFrame, labels: DataFrame, texts: DataFrame, weights: Frequencies) -> DataFrame:
    """Pairs (a, b) of different components that can be alike, each once, of the groups that hold several components.

    Weighted Jaccard distance obeys the triangle inequality, so two texts with similarities s and s'
    to one centre can only be alike if these differ by 1 - SIMILARITY at most.
    """
    wide = sims.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    wide = wide.select(F.concat("a", F.lit(b"")).alias("_a"), "n")  # as a fresh expression, see dealt_anew
    near = (
        sims.select("a", F.col("b").alias("t"), "sim").union(wide.select("_a", F.col("_a").alias("t"), F.lit(1.0)))
        .join(wide, F.col("a") == F.col("_a")).groupBy("t").agg(F.max(F.struct("n", "a", "sim")).alias("m"))
        .select("t", F.col("m.a").alias("to"), F.col("m.sim").alias("sim"))
    )
    rows = met.join(labels, "t", "left").select("band", "key", "t", F.coalesce("c", "t").alias("c"))
    mixed = rows.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    open_ = rows.join(mixed.select("band", "key"), ["band", "key"], "left_semi").groupBy("t").agg(F.first("c").alias("c"))
    open_ = _cut(open_, weights.parts)
    first = _prefixes(weights.beside(texts.join(open_, "t", "left_semi")), weights.n)
    first = _cut(first.join(open_.join(near, "t"), "t"), weights.parts)
    several = first.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    first = first.join(several.select(dealt_anew(F.col("h")).alias("_h")), F.col("h") == F.col("_h"), "left_semi")
    other = first.select("h", F.col("t").alias("u"), F.col("c").alias("d"), F.col("before").alias("e"), F.col("total").alias("z"), F.col("rest").alias("r"), F.col("to").alias("v"), F.col("sim").alias("s"))
    # for the first shingle that two texts share, all that they share is in the rest of both
    shared = (F.col("total") + F.col("z")) * (SIMILARITY / (1 + SIMILARITY) - 1e-6)
    return (
        first.join(other, "h")
        .filter((F.col("t") < F.col("u")) & (F.col("c") != F.col("d")))
        .filter((F.least("rest", "r") >= shared) & ((F.col("to") != F.col("v")) | (F.abs(F.col("sim") - F.col("s")) <= 1 - SIMILARITY + 1e-6)))
        .filter(~F.arrays_overlap("before", "e"))
        .select(F.col("t").alias("a"), F.col("u").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, class_id, class_size, kept.

    Texts with the same words are one text, whatever the white space; a null text counts as
    empty, and all texts without words are one text that is like no other. Two texts are linked
    if they meet in a band and their weighted Jaccard similarity is SIMILARITY or more; a class
    holds all that links connect. class_id is the smallest id in it, whose row is kept; class_size
    counts rows. In a band's group every text is compared with the group's centre. Where these
    links leave a group in several components, all pairs across them are compared that a prefix
    filter, which is exact, lets through; so no class is left apart.
    Rows that repeat an id and its text count as rows of their class. Null ids sort last: a class that
    has no other id has a null class_id, and all its rows with a null id are marked kept. Whole texts are
    read, however long. Further columns are not read, and an empty table gives an empty result.
    """
    signed, rows, classes = _classes(docs, id_col, text_col)
    classes = classes.select("c", "class_id", "class_size")
    texts_of = rows.join(classes, "c").select("t", "class_id", "class_size")
    return signed.select("doc_id", "t").join(texts_of, "t").select(
        "doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures of docs; rows with t and the class c of each text; and c, class_id, class_size, first of each class.

    first (none, id, sha) is the one row of a class that stays: the smallest id, null last, and of
    its texts the one with the smallest digest.
    """
    weights = document_frequencies(docs, text_col, id_col)
    signed = cut(signatures(weights))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "sha")).alias("first")
    distinct = signed.groupBy("t").agg(first, F.first("bands").alias("bands"), F.first("df").alias("df"))
    met = _centred(distinct.select("t", F.posexplode("bands").alias("band", "key")), weights.parts)

    pairs = met.filter("t <> a").select("a", F.col("t").alias("b")).distinct()
    # a digest of words is read from one row, told by id and text: as a struct, a null id is a value like others
    needed = distinct.join(met.select("t").distinct(), "t").select("t", "df", F.struct("first.id", "first.sha").alias("_own"))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), text_sha(text_col).alias("sha")).alias("_row"), text_or_empty(text_col).alias("text"))
    texts = cut(rows.join(needed, F.col("_row") == F.col("_own")).select("t", "text", "df").dropDuplicates(["t"]))
    sims = cut(_verified(pairs, texts, weights.n))
    links = sims.filter(F.col("sim") >= SIMILARITY - 1e-9).select("a", "b")
    labels = components(links, weights.parts)
    rest = _cut(_across(met, sims, labels, texts, weights), weights.parts)
    if not rest.isEmpty():
        more = cut(_verified(rest, texts, weights.n).filter(F.col("sim") >= SIMILARITY - 1e-9).select("a", "b"))
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links, weights.parts)
    rows = signed.groupBy("t").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), first)
    rows = rows.join(labels, "t", "left").withColumn("c", F.coalesce("c", "t"))
    classes = rows.groupBy("c").agg(F.min("rep").alias("class_id"), F.sum("rows").alias("class_size"), F.min("first").alias("first"))
    return signed, rows, classes


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each class.

    Rows are told apart by id and text: a null id, or one id on different texts, takes no other row
    along, and of repeated rows the one with the least hash of its columns stays. Null texts, empty ones
    and those without words are one class, so one of these rows stays. Whole texts count, however long,
    and an empty table gives an empty one.
    """
    stays = _classes(docs, id_col, text_col)[2].select(F.col("first.id").alias("_id"), F.col("first.sha").alias("_sha"))
    return rows_that_stay(docs, stays, F.col(id_col), text_sha(text_col))
