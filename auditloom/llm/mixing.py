"""Mixing sources to target weights (operator 5): capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import cut, one_space, packed, text_or_empty

#: A document's place in the seeded order of its source has 3 x 12 bits, refined 12 at a time.
_BITS, _LEVELS = 12, 3


def n_words(text: Column) -> Column:
    """The number of words of a text, by the spaces between them."""
    t = F.trim(one_space(text))
    return (
        F.when(t == "", F.lit(0)).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
    ).cast("long")


def _fresh(source: Column) -> Column:
    return F.concat(source.cast("string"), F.lit(""))


def _place(key: Column, seed: int) -> Column:
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digits, 1, _BITS * _LEVELS // 4), 16, 10).cast("long")


def _in_order(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with _n, their number in an order from 0, and for each of sums the sum over all rows before.

    Rows are sorted by ranges, each range in its own task, and what a range holds is added up for
    those behind it (a row for each range goes to the driver), so no task sees all rows.
    """
    ranges = cut(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_range")))
    totals = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    before, so_far = [], [0] + [0.0] * len(sums)
    for r in totals.orderBy("_range").collect():
        before.append((r["_range"], *so_far))
        so_far = [a + b for a, b in zip(so_far, r[1:])]
    schema = "_at int, _n0 long" + "".join(f", {k}0 double" for k in sums)
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, schema))
    inside = Window.partitionBy("_range").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.select("*", (F.row_number().over(inside) - 1).alias("_n1"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"{k}1") for k, c in sums.items()])
        .join(offsets, F.col("_range") == F.col("_at"))
        .select(*rows.columns, (F.col("_n0") + F.col("_n1")).alias("_n"), *[(F.col(f"{k}0") + F.col(f"{k}1")).alias(k) for k in sums])
    )


def targets(sources: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size) with target: capped water-filling.

    The i-th source by code point (null last) weighs weights[i mod n], weights being above 0. All
    sources together get share times the sum of sizes, split by weight. A source above max_epochs
    times its size is clamped there; what it leaves over goes to the others by weight, until none is
    above. If all are clamped, the rest is not given out.

    The sources that are clamped are those with the least room for their weight, so one pass in the
    order of room finds the level: the first source that is not above its cap when all before it are
    clamped sets the rate. The table has a row for each source, and there may be many.
    """
    numbered = _in_order(sources, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights)).cast("int") + 1)
    cap = F.col("source_size") * float(max_epochs)
    level = cut(numbered.select("source", "source_size", weight.alias("_w"), cap.alias("_cap"), (cap / weight).alias("_room")))
    sizes, all_weights = level.agg(F.sum("source_size"), F.sum("_w")).first()
    total = float(sizes or 0) * share
    filled = _in_order(level, [F.col("_room"), F.col("source").isNull(), F.col("source")], _caps=F.col("_cap"), _ws=F.col("_w"))
    rate = F.greatest(F.lit(total) - F.col("_caps"), F.lit(0.0)) / (F.lit(all_weights or 1.0) - F.col("_ws"))
    first = filled.filter(F.col("_w") * rate <= F.col("_cap")).agg(F.min(F.struct("_n", rate.alias("rate"))).alias("m")).first()["m"]
    share_of = F.col("_w") * F.lit(first["rate"]) if first else F.col("_cap")
    return level.select("source", "source_size", F.least(share_of, F.col("_cap")).alias("target"))


def mix(
    docs: DataFrame,
    weights: list[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, times, taken.

    size is the number of words (null text: 0) and source_size their sum over the source (a null
    source is a source). target comes from targets(). Every document of a source is taken
    floor(target / source_size) times, and those at the front of the source's seeded order once
    more, until the words of the source come as near to its target as whole documents allow.
    The order depends on seed and id alone, so reruns agree; rows that repeat an id stand at one
    place and are taken alike. taken is size * times. A source without words has target 0.
    The front is found by sums over parts of the order (4096 at most at a time for a source),
    so a source that holds most rows is never sorted or gathered in one place. Null ids are one
    place in the order. Further columns are not read, and an empty table gives an empty result.
    """
    sized = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(text_or_empty(text_col)).alias("size"),
            _place(F.col(id_col), seed).alias("_u"),
        )
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sources, list(weights), share, max_epochs).withColumn(
        "_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    )
    plan = plan.withColumn("_whole", F.least("_whole", F.floor(F.lit(float(max_epochs))))).withColumn(
        "_need", F.col("target") - F.col("_whole") * F.col("source_size")
    )
    plan = cut(plan.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long")))

    shift = _BITS * (_LEVELS - 1)
    for level in range(_LEVELS):
        here = plan.select(_fresh(F.col("source")).alias("_s"), F.col("_prefix").alias("_at"))
        part = F.shiftright("_u", shift)
        in_reach = sized.withColumn("_part", part)
        if level:
            in_reach = in_reach.join(
                here, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_part", _BITS) == F.col("_at"))
            )
        parts = in_reach.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
        running = Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumnRenamed("source", "_src").withColumn(
            "_sofar", F.coalesce(F.sum("_sum").over(running), F.lit(0))
        )
        last = level == _LEVELS - 1
        joined = parts.join(plan, F.col("_src").eqNullSafe(F.col("source")))
        start = F.col("_before") + F.col("_sofar")
        # At the last level a part is in if its middle is; before that, the part that holds the need is looked into.
        inside = start + (F.col("_sum") / 2 if last else F.lit(0)) <= F.col("_need")
        front = (
            joined.filter(inside)
            .groupBy("source")
            .agg(F.max(F.struct("_part", (F.col("_before") + F.col("_sofar")).alias("_b"))).alias("_m"))
        )
        plan = cut(
            plan.join(front.select(F.col("source").alias("_s"), "_m"), F.col("source").eqNullSafe(F.col("_s")), "left")
            # with no part inside, the front ends just before the part that was looked into
            .withColumn("_prefix", F.coalesce(F.col("_m._part"), F.shiftleft("_prefix", _BITS) - 1))
            .withColumn("_before", F.coalesce(F.col("_m._b"), F.col("_before")))
            .drop("_s", "_m")
        )
        shift -= _BITS
    # as a fresh expression, so that a hot source can be split, see dealt_anew
    ends = plan.select(_fresh(F.col("source")).alias("_s"), "source_size", "target", "_whole", "_prefix", "_need")
    placed = sized.join(ends, F.col("source").eqNullSafe(F.col("_s")))
    times = F.col("_whole") + F.when((F.col("_u") <= F.col("_prefix")) & (F.col("_need") > 0), 1).otherwise(0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", times.cast("long").alias("times")
    ).withColumn("taken", F.col("size") * F.col("times"))


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs as the mix takes them, with all their columns, whatever their names: each as often as times says.

    Rows are taken by id and source, so rows that share both (null ids too) are taken alike. An empty
    table gives an empty one.
    """
    id_col, source_col = settings.get("id_col", "doc_id"), settings.get("source_col", "source")
    times = (
        mix(docs, **settings).filter("times > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), "times").distinct()
    )
    rows = packed(docs, _own=F.col(id_col), _from=F.col(source_col))
    return rows.join(times, F.col("_own").eqNullSafe(F.col("_id")) & F.col("_from").cast("string").eqNullSafe(F.col("_src"))).select(
        "row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_copy")
    ).select("row.*")


ORACLE = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || doc_id), 1, 9) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2.0 * sum(size) AS DOUBLE) AS cap,
         CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS w
  FROM sized GROUP BY source
), fill AS (
  SELECT 0 AS round, source, source_size, cap, w, FALSE AS full_up,
         CAST(1.5 * sum(source_size) OVER () AS DOUBLE) / sum(w) OVER () AS rate FROM s
  UNION ALL
  SELECT round + 1, source, source_size, cap, w, now_full,
         coalesce(greatest(total * 1.5 - coalesce(sum(CASE WHEN now_full THEN cap END) OVER (), 0), 0)
           / nullif(sum(CASE WHEN NOT now_full THEN w END) OVER (), 0), 0)
  FROM (SELECT *, full_up OR w * rate > cap AS now_full, sum(source_size) OVER () AS total FROM fill WHERE round < 25)
), plan AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS BIGINT) AS whole
  FROM (SELECT source, source_size, CASE WHEN full_up THEN cap ELSE w * rate END AS target
        FROM fill WHERE round = (SELECT max(round) FROM fill))
), parts AS (
  SELECT source, u, sum(size) AS z, sum(sum(size)) OVER (PARTITION BY source ORDER BY u) - sum(size) AS sofar
  FROM sized GROUP BY source, u
)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.whole + CASE WHEN q.sofar + q.z / 2 <= p.target - p.whole * p.source_size
                                      AND p.target - p.whole * p.source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
JOIN parts q ON q.source IS NOT DISTINCT FROM d.source AND q.u = d.u
"""
