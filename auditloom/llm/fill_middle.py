"""Fill-in-middle transformation with a table-driven byte automaton (operator 13).

One scan over the UTF-8 bytes of many texts takes each byte from a state to the next by a table and
emits what the transition counts: the begin of a code point (any byte but a continuation), the begin of a
unit (a line with its end), and the last byte of a sentinel. A second pass over the marked
transitions finds the bytes where the drawn units begin, which is where a text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that are scanned at once, but for a longer text.
LOT = 4_000_000

#: Classes of bytes: any other, continuation, line end, and the three places of a sentinel.
OTHER, CONTINUED, LINE_END, OPEN, LETTER, CLOSE = range(6)
#: States: where a unit begins, inside one, after "<", and after "<" and a sentinel's letter.
BEGIN, INSIDE, OPENED, LETTERED = range(4)
#: What a transition counts, as bits.
CODE_POINT, UNIT, SENTINEL = 1, 2, 4

_class = np.full(256, OTHER, np.uint8)
_class[0x80:0xC0] = CONTINUED
_class[ord("\n")] = LINE_END
_class[[ord(s[0]) for s in (PREFIX, SUFFIX, MIDDLE)]] = OPEN
_class[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = LETTER
_class[[ord(s[2]) for s in (PREFIX, SUFFIX, MIDDLE)]] = CLOSE


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the counts of each state and class."""
    to = np.full((4, 6), INSIDE, np.uint8)
    to[:, LINE_END], to[:, OPEN], to[OPENED, LETTER] = BEGIN, OPENED, LETTERED
    counts = np.zeros((4, 6), np.uint8)
    counts[:, [c for c in range(6) if c != CONTINUED]] |= CODE_POINT
    counts[BEGIN] |= UNIT
    counts[LETTERED, CLOSE] |= SENTINEL
    return to, counts


NEXT, COUNTS = _tables()
#: The state after two bytes is the same from any state, so a lot is scanned without a loop over its bytes.
AFTER_TWO = NEXT[NEXT[INSIDE]]
assert all((NEXT[NEXT[s]] == AFTER_TWO).all() for s in range(len(NEXT)))


def scan(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What the transition at each byte of data counts; each of starts, ascending, is the first byte of a text."""
    if not len(data):
        return np.zeros(0, np.uint8)
    kind = _class[data]
    state = np.empty(len(data), np.uint8)
    state[2:] = AFTER_TWO[kind[:-2], kind[1:-1]]
    first = starts[starts < len(data)]
    second = first + 1
    second = second[second < len(data)]
    state[second] = NEXT[BEGIN, kind[second - 1]]
    state[first] = BEGIN  # after the second bytes: a text of one byte is followed by the next one's first
    return COUNTS[state, kind]


def transformed(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, plain: np.ndarray, turned: np.ndarray) -> list[tuple]:
    """For each text (n, form, prefix_chars, middle_chars, output). texts has no nulls; turned: suffix before prefix."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    base, end = offsets[0], offsets[-1]
    data = np.frombuffer(raw, np.uint8)[base:end] if raw is not None and end > base else np.zeros(0, np.uint8)
    at = offsets - base
    counted = scan(data, at[:-1])
    points = np.concatenate([[0], np.cumsum(counted & CODE_POINT, dtype=np.int64)])
    units = np.flatnonzero(counted & UNIT)
    own = np.searchsorted(units, at)  # the first unit of each text
    marked = np.searchsorted(np.flatnonzero(counted & SENTINEL), at)
    n = np.diff(own)
    plain = plain | (np.diff(at) == 0) | (np.diff(marked) > 0)
    draws = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    # the second pass: a draw of k units ends where the unit after them begins, or with the text
    ends = np.concatenate([units, [len(data)]])
    a, z = (np.where(k < n, ends[own[:-1] + np.minimum(k, n)], at[1:]) for k in draws)
    view = memoryview(raw)[base:end] if len(data) else memoryview(b"")
    out = []
    for i in range(len(texts)):
        s, e = at[i], at[i + 1]
        if plain[i]:
            out.append((n[i], "plain", None, None, bytes(view[s:e])))
            continue
        prefix, middle, suffix = view[s : a[i]], view[a[i] : z[i]], view[z[i] : e]
        parts = (SUFFIX, suffix, PREFIX, prefix) if turned[i] else (PREFIX, prefix, SUFFIX, suffix)
        whole = b"".join([x.encode() if isinstance(x, str) else x for x in (*parts, MIDDLE, middle)])
        out.append((n[i], "spm" if turned[i] else "psm", points[a[i]] - points[s], points[z[i]] - points[a[i]], whole))
    return out


def _draw(seed: int, doc_id: Column, k: int) -> Column:
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 8 * k - 7, 8)
    return F.conv(digits, 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """One row for each row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    n is the number of lines ([^\\n]*\\n|[^\\n]+). Two cuts between lines are drawn by the id, so repeated rows are
    cut alike; a null id draws as an empty text would. Of 100 texts about rate are cut, and of these about
    spm_rate have their suffix first. form is plain, with the text as output and null lengths, for the others, for
    empty and null texts, and for texts with a sentinel in them. A text of one line and a draw at its ends give empty
    parts. Whole texts are cut, however long. Further columns are not read. An empty table gives an empty result.
    """
    own = F.col(id_col)
    rows = docs.select(
        own.alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), _draw(seed, own, 1).alias("h1"), _draw(seed, own, 2).alias("h2"),
        (_draw(seed, own, 3) % 100 >= rate).alias("plain"), (_draw(seed, own, 4) % 100 < spm_rate).alias("turned"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset : b.column(1).offset + b.num_rows + 1].astype(np.int64)) if b.num_rows else np.zeros(0, np.int64)
            lot = np.cumsum(sizes) // LOT
            edges = [0, *np.flatnonzero(np.diff(lot)) + 1, b.num_rows]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                found = transformed(part.column(1), *[part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5)])
                columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
                columns[4] = columns[4].view(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() made output of. A text with a sentinel is plain, so an output has each of them once."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), l AS (
  SELECT doc_id, t, CASE WHEN t = '' THEN []::VARCHAR[] ELSE regexp_extract_all(t, '[^\n]*\n|[^\n]+') END AS u,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS z,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM l
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:z], '') AS middle, array_to_string(u[z + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
