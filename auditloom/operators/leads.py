"""The serving layer: filters, paging, statistics and progress over leads and their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(leads: DataFrame, text: str, columns: list[str]) -> DataFrame:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).ilike(f"%{text}%")
    return leads.filter(out)


def page(leads: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of leads in an order; number from 1, size from 1 to 500."""
    size = min(max(size, 1), 500)
    return leads.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def having(leads: DataFrame, others: DataFrame, on: Column, yes: bool) -> DataFrame:
    return leads.join(others, on, "left_semi" if yes else "left_anti")


def statistics(leads: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Rows (dimension, value, n) for several dimensions in one pass by grouping sets; empty values get dimensions' label."""
    names = list(dimensions)
    rows = leads.select(*[F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit(label)).alias(d) for d, label in dimensions.items()])
    sets = rows.groupingSets([[d] for d in names], *names).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_{i}") for i, d in enumerate(names)])
    which = [F.when(F.col(f"_{i}") == 0, F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"))) for i, d in enumerate(names)]
    return sets.select(F.coalesce(*which).alias("x"), "n").select("x.dimension", "x.value", "n")


def children(parents: DataFrame, rows: DataFrame, key: str, order: str, value: str, k: int) -> DataFrame:
    """key and the first k values of its rows, by order, joined; a row for each parent.

    Ranks are limited before rows meet, so a parent with most of the rows stays bounded.
    """
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), value))
    best = rows.withColumn("_n", at).filter(F.col("_n") <= k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", value))).alias("_v"))
    joined = F.concat_ws(" | ", F.transform("_v", lambda x: x[value].cast("string")))
    return parents.join(best, key, "left").select(key, F.coalesce(joined, F.lit("")).alias("values"))


def progress(items: DataFrame, key: str, status: Column, done: list[str], failed: list[str]) -> DataFrame:
    """For each key: total, done, failed and percent (one decimal, of whole thousandths)."""
    out = items.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status.isin(done)).alias("done"), F.count_if(status.isin(failed)).alias("failed")
    )
    return out.withColumn("percent", F.floor(F.col("done") * 1000 / F.col("total")) / 10)


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """rows with duplicate_of: the first row's order for each non-empty key, null on that row itself."""
    keyed = rows.withColumn("_k", key)
    first = keyed.filter("_k <> ''").groupBy("_k").agg(F.min(order).alias("_first"))
    # a fresh expression, so that adaptive execution can split a hot key
    first = first.select(F.concat("_k", F.lit("")).alias("_kk"), "_first")
    return keyed.join(first, F.col("_k") == F.col("_kk"), "left").select(
        *rows.columns, F.when(F.col("_first") != F.col(order), F.col("_first")).alias("duplicate_of")
    )


def requeued(status: Column, resume: bool) -> Column:
    """An item's status on retry (failed ones again) or on resume (those left running again); completed ones stay."""
    return F.when(status == ("running" if resume else "failed"), "pending").otherwise(status)


#: Orders of a list of leads: column, falling, nulls first, key falling (fixed values).
ORDERS = {
    "score_desc": ("score", True, False, False), "score_asc": ("score", False, True, False), "name_asc": ("name", False, False, False),
    "name_desc": ("name", True, False, False), "row_asc": ("row_index", False, False, False), "recent": ("processed_at", True, False, True),
}


def ordered(name: str, columns: dict[str, str], key: str) -> list[Column]:
    """The order of that name over columns (score, name, processed_at, row_index to the caller's own), ties by key; an unknown one is score_desc."""
    column, falling, first, key_falling = ORDERS.get(name, ORDERS["score_desc"])
    c, k = F.col(columns[column]), F.col(key)
    by = (c.desc_nulls_first() if first else c.desc_nulls_last()) if falling else (c.asc_nulls_first() if first else c.asc_nulls_last())
    return [by, k.desc() if key_falling else k]


def newest_jobs(jobs_: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The jobs with the largest keys, 1 to 200 of them."""
    return jobs_.orderBy(F.col(key).desc()).limit(min(max(limit, 1), 200))


def counted_page(leads: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of leads, with total: how many there are before paging. Both are one query; a page without rows tells no total."""
    total = leads.agg(F.count(F.lit(1))).scalar()
    return page(leads, order, number, size).withColumn("total", total)


def detail(key_value, key: str, lead: DataFrame, **children: DataFrame) -> DataFrame:
    """One lead by its key with its children as arrays of structs, each of which has the key, too. No row if there is none."""
    out = lead.filter(F.col(key) == key_value)
    for name, rows in children.items():
        own = rows.filter(F.col(key) == key_value)
        listed = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias(name))
        out = out.join(listed, key, "left")
    return out


def cascade_delete(keys: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """tables without the rows of keys, parents and children alike."""
    return [t.join(keys.select(key), key, "left_anti") for t in tables]


def jobs(items: DataFrame, key: str, status: Column, started: Column, now: Column, done: list[str], failed: list[str]) -> DataFrame:
    """progress() of each job with rate (items a minute since it started) and eta_seconds of what is left; null while nothing is done."""
    out = items.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status.isin(done)).alias("done"), F.count_if(status.isin(failed)).alias("failed"),
        (F.max(now).cast("double") - F.min(started).cast("double")).alias("_s"),
    )
    ended = F.col("done") + F.col("failed")
    rate = F.when((F.col("_s") > 0) & (ended > 0), ended * 60 / F.col("_s"))
    out = out.withColumn("percent", F.floor(F.col("done") * 1000 / F.col("total")) / 10).withColumn("_rate", rate).withColumn("rate", F.round("_rate", 4))
    return out.withColumn("eta_seconds", F.round((F.col("total") - ended) * 60 / F.col("_rate")).cast("long")).drop("_s", "_rate")


def reranked(rows: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """rows with rank in their key, and share, the part of the key's sum of value (four decimals; null if that is 0).

    The sums are taken before they meet their rows, so a hot key is not gathered for them.
    """
    sums = rows.groupBy(key).agg(F.sum(value).alias("_sum")).withColumnRenamed(key, "_key")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.join(sums, F.col(key) == F.col("_key")).withColumn("share", F.round(F.col(value) / F.nullif("_sum", F.lit(0)), 4)).drop("_key", "_sum")


def mark_sent(drafts: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """drafts with sent_manually set where keys are among sent."""
    marks = sent.select(*keys, F.lit(True).alias("_sent")).distinct()
    return drafts.join(marks, keys, "left").withColumn("sent_manually", F.coalesce("_sent", "sent_manually")).drop("_sent").select(drafts.columns)


def uploads_to_remove(jobs: DataFrame, deleted: DataFrame, job: str, upload: str) -> DataFrame:
    """The stored uploads (upload) of deleted jobs that no job left refers to; a null upload is none.

    jobs has a row for each job as before the delete; an upload is counted by the jobs that are left, in one grouping.
    """
    gone = deleted.select(F.col(job).alias("_job")).distinct()
    marked = jobs.filter(F.col(upload).isNotNull()).join(gone, F.col(job) == F.col("_job"), "left")
    left = marked.groupBy(upload).agg(F.count_if(F.col("_job").isNull()).alias("left"), F.count("_job").alias("gone"))
    return left.filter("left = 0 AND gone > 0").select(upload)


def regenerated(drafts: DataFrame, new: DataFrame, lead: str = "lead", channel: str = "channel") -> tuple[DataFrame, DataFrame]:
    """What a store's commit takes to regenerate drafts: the new rows, and the keys (lead, channel) whose old ones go.

    Drafts that were sent stay as they are, and so does what is drafted for their lead and channel.
    """
    sent = drafts.filter("sent_manually").select(F.struct(lead, channel).alias("_sent")).distinct()
    rows = new.withColumn("_own", F.struct(lead, channel)).join(sent, F.col("_own") == F.col("_sent"), "left_anti").drop("_own")
    return rows, rows.select(lead, channel).distinct()
