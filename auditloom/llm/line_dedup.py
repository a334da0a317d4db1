"""Line deduplication (operator 10): lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import SPACE, cut, dealt_anew, packed, text_or_empty

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.regexp_replace(line, rf"^[{SPACE}]+|[{SPACE}]+\z", ""), _UPPER, _LOWER)


def text_digest(text: Column) -> list[Column]:
    """Two hashes, _d and _e, that tell the texts of one id (or of null ids) apart."""
    return [F.xxhash64(text).alias("_d"), F.xxhash64(F.lit("second"), text).alias("_e")]


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """Rows (doc_id, _d, _e, _p): the places of lines to drop in the text with this id and digest.

    Each line is exploded and hashed to 128 bits; documents are counted once for each hash and
    repeated rows once for each id. A hot line is counted in part before it moves.
    """
    text = text_or_empty(text_col)
    # digests are taken before lines are exploded, once for each text
    texts = docs.select(F.col(id_col).alias("doc_id"), *text_digest(text), F.split(text, "\n", -1).alias("_lines"))
    lines = texts.select("doc_id", "_d", "_e", F.posexplode("_lines").alias("_p", "_l")).filter(F.length("_l") >= min_chars)
    keyed = lines.select("doc_id", "_d", "_e", "_p", line_key(F.col("_l")).alias("_k")).filter(F.length("_k") >= min_chars)
    # read twice below; about an eighth of the texts as hashes
    hashed = cut(
        keyed.select("doc_id", "_d", "_e", "_p", F.xxhash64("_k").alias("_h"), F.xxhash64(F.lit("second"), "_k").alias("_g"))
    )
    over = (
        hashed.groupBy("_h", "_g")
        .agg(F.count_distinct("doc_id").alias("_n"), F.max("doc_id").alias("_keep"))
        .filter(F.col("_n") >= min_docs)
        .select(dealt_anew(F.col("_h")).alias("_oh"), F.col("_g").alias("_og"), "_keep")
    )
    return hashed.join(
        over, (F.col("_h") == F.col("_oh")) & (F.col("_g") == F.col("_og")) & ~F.col("doc_id").eqNullSafe(F.col("_keep"))
    ).select("doc_id", "_d", "_e", "_p")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """docs with its text reassembled from the lines that stay, and n_lines, n_dropped.

    Lines are parted by \\n only; a null or empty text is one empty line. Lines whose key (see
    line_key) has at least min_chars code points and stands in at least min_docs documents go,
    but for all those of the largest id that holds it. Rows that repeat an id count as one
    document, and each loses the shared lines of its own text; rows with a null id are in no count
    and lose their shared lines only. One id on several texts holds all their lines as one document.
    A document may lose every line; its text is then empty. Whole texts are split, however long: only the hashes of
    their lines meet, a row for each line. An empty table gives an empty result. All
    further columns of docs stay as they are; if docs has an n_lines or n_dropped of its own, the
    counts are named with as many underscores at the end as it takes to differ.
    """
    places = (
        shared_lines(docs, id_col, text_col, min_chars, min_docs)
        .groupBy("doc_id", "_d", "_e")
        .agg(F.collect_set("_p").alias("_gone"))
        .select(F.col("doc_id").alias("_id"), F.col("_d").alias("_id_d"), F.col("_e").alias("_id_e"), "_gone")
    )
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    d, e = text_digest(text_or_empty(text_col))
    rows = packed(docs, _own=F.col(id_col), _d=d, _e=e)
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_id_d")) & (F.col("_e") == F.col("_id_e"))
    out = (
        rows.join(places, same, "left")
        .withColumn("_lines", F.split(text, "\n", -1))
        .withColumn("_stay", F.when(F.col("_gone").isNotNull(), stay))
    )
    kept = F.when(
        F.col("_stay").isNotNull(), F.array_join(F.transform("_stay", lambda i: F.get(F.col("_lines"), i)), "\n")
    ).otherwise(text)
    n_lines = F.size("_lines").cast("long")
    counts = {"n_lines": n_lines, "n_dropped": F.coalesce(n_lines - F.size("_stay"), F.lit(0)).cast("long")}
    return out.select(
        *[kept.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns],
        *[c.alias(_free(n, docs.columns)) for n, c in counts.items()],
    )


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


ORACLE = """
WITH l AS (
  SELECT doc_id, p, lines[p] AS line,
         translate(regexp_replace(lines[p], '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
       unnest(range(1, len(lines) + 1)) AS u(p)
), over_threshold AS (
  SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, p, line, o.k IS NOT NULL AND l.doc_id <> o.keep AS gone FROM l LEFT JOIN over_threshold o ON l.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
