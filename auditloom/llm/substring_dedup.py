"""Substring deduplication by level-wise doubling (operator 8).

Windows that repeat at one length alone are extended to about twice that length, until the
length asked for is reached or no candidates survive. At the shorter lengths not every window
is sent: every run of windows that makes up a window of the full length has its least hash as
its anchor, equal passages have equal anchors, and a full window can repeat only if its anchor
does. So nothing that repeats is lost, and about a tenth of the windows moves. At the shorter
lengths a hash of 64 bits can only let too many windows through; what is removed is decided by
96 bits of the full window from two independent hashes. Texts that have to meet their windows again
move compressed, and once for all levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, dealt_anew, in_lots, packed_text
from auditloom.llm.hashing import Words, sliding

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def levels(length: int, least: int = 10) -> list[int]:
    """The lengths from the shortest on, each at most twice the one before, up to length."""
    out = [length]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _anchored(w: Words, level: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of a level, the anchor's hash of each full window, and where full windows are."""
    h, _ = w.windows(level)
    h = np.minimum(h, _NONE - np.uint64(1))
    _, full = w.windows(length)
    return h, sliding(h, length - level + 1, True), full


def _candidates(w: Words, level: int, length: int, survivors: np.ndarray | None, before: int) -> np.ndarray:
    """Full windows that can still repeat: those whose anchor at the level before is a survivor (word numbers)."""
    if survivors is None:
        return w.windows(length)[1]
    h, anchor, full = _anchored(w, before, length)
    kept = np.full(len(h), _NONE)
    kept[survivors] = h[survivors]
    return full & (sliding(kept, length - before + 1, True) == anchor)


def _send(w: Words, level: int, length: int, survivors: np.ndarray | None, before: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words at which the windows to compare at this level begin, and their hashes: 64 bits, and at the full length 32 more."""
    alive = _candidates(w, level, length, survivors, before)
    if level == length:
        at = np.flatnonzero(alive)
        other = (w.windows(length, 1)[0][at] >> np.uint64(32)).astype(np.uint32)
        return at, [w.windows(length)[0][at].view(np.int64), other.view(np.int32)]
    h, anchor, _ = _anchored(w, level, length)
    width = length - level + 1
    runs = np.where(alive, anchor, np.uint64(0))
    # a window is the anchor of a run that it stands in if its hash is the run's; runs end where it begins, at the latest
    last = np.concatenate([np.zeros(width - 1, np.uint64), runs])
    at = np.flatnonzero((sliding(last, width, False)[: len(h)] == h) & (h > 0))
    return at, [h[at].view(np.int64)]


def _windows(docs: DataFrame, level: int, length: int, before: int) -> DataFrame:
    """Rows (doc_id, t, copied, pos, h and at the full length g) of the windows to compare.

    docs: doc_id, t, copied, text and, after the first level, at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = _keys(level == length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for lot in in_lots(b.column(3), 1_000_000):
                w = Words(lot)
                survivors = None
                if b.num_columns > 4:
                    lists = b.column(4).slice(done, len(lot))
                    sizes = np.diff(lists.offsets.to_numpy())
                    survivors = lists.flatten().to_numpy() + np.repeat(w.offsets[:-1], sizes)
                at, hashes = _send(w, level, length, survivors, before)
                row = np.searchsorted(w.offsets, at, side="right") - 1
                pick = pa.array(done + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(i).take(pick) for i in range(3)],
                        pa.array((at - w.offsets[row]).astype(np.int32)),
                        *[pa.array(h) for h in hashes],
                    ],
                    names=["doc_id", "t", "copied", "pos", *keys],
                )
                done += len(lot)

    return docs.mapInArrow(run, f"doc_id {kind}, t bigint, copied boolean, pos int, " + ", ".join(f"{k} {t}" for k, t in keys.items()))


def _keys(last: bool) -> dict[str, str]:
    return {"h": "bigint", "g": "int"} if last else {"h": "bigint"}


def _repeated(windows: DataFrame, last: bool) -> DataFrame:
    """Rows (_d, _t, at): for each text the places whose window starts anywhere else, too.

    A copied text stands for all its copies, so its windows count twice. At the last level nothing
    more has to be found out about it, and its windows are counted only.
    """
    keys = _keys(last)
    again = (
        windows.groupBy(*keys)
        .agg(F.sum(F.when(F.col("copied"), 2).otherwise(1)).alias("n"))
        .filter("n > 1")
        .select(dealt_anew(F.col("h")).alias("_h"), *[F.col(k).alias(f"_{k}") for k in keys if k != "h"])
    )
    same = F.col("h") == F.col("_h")
    return (
        (windows.filter(~F.col("copied")) if last else windows)
        .join(again, same & (F.col("g") == F.col("_g")) if last else same, "left_semi")
        .groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t"))
        .agg(F.array_sort(F.collect_set("pos")).alias("at"))
    )


def _copies(docs: DataFrame) -> DataFrame:
    """Rows (_id, _x, first) of the texts that several rows have: the row's id, the text's hash, whether it stands for all."""
    ids = docs.select("doc_id", F.xxhash64("text").alias("t"), F.xxhash64(F.lit("second"), "text").alias("g"))
    groups = (
        ids.groupBy("t", "g")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
        .filter("n > 1")
        .select(dealt_anew(F.col("t")).alias("_t"), F.col("g").alias("_g"), "least")
    )
    return (
        ids.join(groups, (F.col("t") == F.col("_t")) & (F.col("g") == F.col("_g")))
        .select(F.col("doc_id").alias("_id"), F.col("t").alias("_x"), F.col("doc_id").eqNullSafe(F.col("least")).alias("first"))
        .distinct()
    )


def _movable(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, t, text): t is a hash of the text, which is packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                packs = pa.array([packed_text(x) for x in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packs], names=["doc_id", "t", "text"])

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {kind}, t bigint, text binary")


def repeated_windows(docs: DataFrame, length: int, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, t, text packed), and rows (_d, _t, at, copied) of texts with repeated windows.

    at has the first words of these windows; of a copied text all windows repeat, and at is null.
    After the first level one of the copies of a text is compared for all of them.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # no t is null; the filter is what the inner joins below would add, so that all joins share one exchange of the texts
    texts = _movable(docs).filter("t IS NOT NULL")
    copies = cut(_copies(docs))
    every = copies.select(F.col("_id").alias("_d"), F.col("_x").alias("_t"), F.lit(None).cast("array<int>").alias("at"), F.lit(True).alias("copied"))
    found, before = None, 0
    for level in levels(length, least):
        if found is None:
            here = docs.select("doc_id", F.xxhash64("text").alias("t"), F.lit(False).alias("copied"), "text")
        else:
            one = found.join(copies, _same("_x", "_id", "_t", "_d"), "left").filter(F.coalesce("first", F.lit(True)))
            here = texts.join(one, _same("t", "doc_id", "_t", "_d")).select(
                "doc_id", "t", F.col("first").isNotNull().alias("copied"), "text", "at"
            )
        found, before = _repeated(_windows(here, level, length, before), level == length), level
        if level != length and before == levels(length, least)[0]:
            # The first level needs no text to move. If no window repeats at its length, none does at the full one,
            # and no text of that length has copies. The later levels are one job, in which the texts move once for
            # all of them; where a level has no survivors, adaptive execution leaves out those after it.
            found = cut(found)
            if found.isEmpty():
                break
    single = found.join(copies, _same("_x", "_id", "_t", "_d"), "left_anti").select("_d", "_t", "at", F.lit(False).alias("copied"))
    return texts, single.union(every)


def _same(t: str, d: str, t2: str, d2: str):
    return (F.col(t) == F.col(t2)) & F.col(d).eqNullSafe(F.col(d2))


def substring_dedup(docs: DataFrame, length: int = 35, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Words are [^\\x20\\x09-\\x0D]+, unchanged; a null or empty text has none. Each word covered by a
    window of length words whose word sequence also starts anywhere else, in the same text or
    another, is removed; windows are judged on the input, so no copy stays. Windows of the full length
    are compared by 96 bits of two independent hashes of their words, and whole texts by 128. Repeated
    rows are copies of each other; rows that share an id or have none are told apart by their text.
    Texts under length words stay whole, and long ones are read whole. Further columns are not read.
    An empty table gives an empty result.
    """
    texts, found = repeated_windows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), length, least)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, n, removed, kept = 0, [], [], []
            for lot in in_lots(b.column(1)):
                w = Words(lot)
                places, copied = b.column(2).slice(done, len(lot)), b.column(3).slice(done, len(lot)).to_pylist()
                for i, at in enumerate(places):
                    count = int(w.counts[i])
                    edge = np.zeros(count + 1, np.int64)
                    if at.is_valid:
                        at = at.values.to_numpy()
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + length, -1)
                    elif copied[i] and count >= length:
                        edge[0] = 1
                    gone = np.cumsum(edge)[:count] > 0
                    n.append(count)
                    removed.append(int(gone.sum()))
                    kept.append(w.text(i, gone).decode())
                done += len(lot)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return (
        texts.join(found, _same("t", "doc_id", "_t", "_d"), "left")
        .select("doc_id", "text", "at", "copied")
        .mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
    )


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS ws FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) AS u(p)
), twice AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), hit AS (
  SELECT DISTINCT doc_id, p + k AS i FROM win JOIN twice USING (h), unnest(range(0, 35)) AS v(k)
), words AS (
  SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(i)
), m AS (
  SELECT words.doc_id, words.i, word, hit.i IS NOT NULL AS gone
  FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.i = words.i
), s AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM m GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON s.doc_id = w.doc_id
"""
