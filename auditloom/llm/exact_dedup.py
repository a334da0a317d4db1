"""Exact deduplication by content-defined chunk recipes (operator 4), in DataFrame functions only.

A text is cut at places that its content decides, so equal passages give equal chunks wherever
they stand. Chunks are deduplicated to identifiers, which are verified: an identifier whose
chunks are not all the same string gets an ordinal for each string. A document is then the
ordered list of its identifiers, about a hundredth of its text, and only these lists are
compared and moved. Equal lists mean equal texts, as the chunks put together give the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut, dealt_anew, one_space, rows_that_stay, text_or_empty

#: A cut comes at a space after such characters: about every 700 characters of prose.
CUT = r"(?<=[aehnst][dgnrst][.,!?;:*%&#$|]) "
#: Text without such places is cut at this length.
LONGEST = 8192


def normalised(text: Column) -> Column:
    """Texts are equal if these are: runs of white space as one space."""
    return one_space(text)


def chunks(text: Column, cut_at: str = CUT, longest: int = LONGEST) -> Column:
    """The ordered chunks of a text. Put together they give the text and one space."""
    return F.flatten(
        F.transform(
            F.split(text, cut_at),
            lambda c: F.when(F.length(c) < longest, F.array(F.concat(c, F.lit(" ")))).otherwise(
                F.regexp_extract_all(F.concat(c, F.lit(" ")), F.lit(f"(?s).{{1,{longest}}}"), F.lit(0))
            ),
        )
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    cut_at: str = CUT,
    longest: int = LONGEST,
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they agree after each run of [\\x20\\x09-\\x0D] becomes one space; a null
    text counts as empty, and all empty texts are one group. The smallest id of a group is
    keep_id, and its row is kept. Rows that repeat an id with an equal text are all kept and all
    count in group_size (see keep_first to keep one of them); a null id sorts last. Whole texts are
    compared, however long: a text is a list of chunks of at most `longest` characters, and only the lists
    move as a whole. Further columns of docs are not read. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(text_or_empty(text_col)).alias("_t"))
    pieces = chunks(F.col("_t"), cut_at, longest)
    ids = F.transform(pieces, lambda c: chunk_hash(c))
    recipes = base.select("doc_id", F.sha2(F.encode("_t", "UTF-8"), 256).alias("text_sha256"), ids.alias("_recipe"))

    # Every chunk moves once, to be compared with the others of its identifier.
    spread = base.select(F.explode(pieces).alias("_c"))
    ambiguous = (
        spread.groupBy(chunk_hash(F.col("_c")).alias("_h"))
        .agg(F.min("_c").alias("_a"), F.max("_c").alias("_b"))
        .filter("_a <> _b")
        .select("_h")
    )
    ambiguous = cut(ambiguous)
    if not ambiguous.isEmpty():
        recipes = _with_ordinals(base, recipes, pieces, ambiguous, chunk_hash)

    groups = recipes.groupBy("_recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Only the lists of groups of two and more have to meet their rows again.
    several = groups.filter("group_size > 1").select(
        F.transform("_recipe", dealt_anew).alias("_r"), "keep_id", "group_size"
    )
    return recipes.join(several, F.col("_recipe") == F.col("_r"), "left").select(
        "doc_id",
        F.when(F.col("_r").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("_r").isNull(), F.lit(True))
        .otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .alias("kept"),
        "text_sha256",
    )


def _with_ordinals(base, recipes, pieces, ambiguous, chunk_hash) -> DataFrame:
    """Recipes in which each ambiguous identifier is followed by the ordinal of its string."""
    from pyspark.sql import Window

    distinct = (
        base.select(F.explode(pieces).alias("_c"))
        .withColumn("_h", chunk_hash(F.col("_c")))
        .join(ambiguous, "_h", "left_semi")
        .distinct()
    )
    ordinals = distinct.select(
        "_c", "_h", F.row_number().over(Window.partitionBy("_h").orderBy("_c")).cast("long").alias("_n")
    )
    places = (
        base.select("doc_id", F.sha2(F.encode("_t", "UTF-8"), 256).alias("text_sha256"), F.posexplode(pieces).alias("_p", "_c"))
        .withColumn("_h", chunk_hash(F.col("_c")))
        .join(ordinals, ["_h", "_c"])
        .groupBy("doc_id", "text_sha256")
        # a repeated row gives each place twice, with the same ordinal
        .agg(F.array_sort(F.collect_set(F.struct("_p", "_n"))).alias("_at"))
        .select("doc_id", "text_sha256", F.flatten(F.transform("_at", lambda x: F.array(x["_p"].cast("long"), x["_n"]))).alias("_more"))
    )
    places = places.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "_more")
    return recipes.join(
        places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left"
    ).select(
        "doc_id",
        "text_sha256",
        F.concat("_recipe", F.array(F.lit(-1).cast("long")), F.coalesce("_more", F.array().cast("array<bigint>"))).alias("_recipe"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: for each text the row with the smallest id.

    Of repeated rows (the same id and an equal text) one stays. Rows are told apart by id and text,
    so rows with a null id, or with one id and different texts, are judged each by its own text.
    """
    stays = (
        exact_dedup(docs.select(id_col, text_col), id_col, text_col)
        .filter("kept")
        .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
        .distinct()
    )
    sha = F.sha2(F.encode(normalised(text_or_empty(text_col)), "UTF-8"), 256)
    return rows_that_stay(docs, stays, F.col(id_col), sha)


ORACLE = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
