"""The stream gives what the batch query gives."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from auditloom.sources.tables import table
from auditloom.streaming import events

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = table(spark, SF, "events")
    rows.repartition(3).write.parquet(f"{folder}/in")
    query = events.stream_windows(spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination(120)
    out = {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()}
    batch = {tuple(r) for r in events.per_window(rows.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert out and out <= batch
    # only windows that the watermark has not passed are still open
    last = max(r[0] for r in batch)
    assert all((last - r[0]).total_seconds() <= 86_400 + 3_600 for r in batch - out)


def test_transitions_over_restarts(spark):
    """Two runs of the stream, each with later files, give what one query over all events gives."""
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = table(spark, SF, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).filter("user_id % 5 = 0")
    half = rows.approxQuantile("event_id", [0.5], 0.0)[0]
    order = rows.withColumn("ts", F.timestamp_seconds("event_id"))  # later ids are later events
    for part in (order.filter(F.col("event_id") <= half), order.filter(F.col("event_id") > half)):
        part.write.mode("append").parquet(f"{folder}/in")
        query = events.stream_transitions(spark, f"{folder}/in", order.schema, f"{folder}/out", f"{folder}/checkpoint")
        query.awaitTermination(120)
    out = {tuple(r) for r in spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "from_status", "to_status").collect()}
    batch = {tuple(r) for r in events.transitions(order, "user_id", "event_type").select("event_id", "user_id", "from_status", "to_status").collect()}
    assert out == batch and out


def test_a_log_is_appended_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = table(spark, SF, "events")
    for _ in range(2):
        rows.limit(50).write.mode("append").parquet(f"{folder}/in")
        events.stream_log(spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/checkpoint").awaitTermination(120)
    assert spark.read.parquet(f"{folder}/out").count() == 100


def test_bounded_queues_over_restarts(spark):
    """Queues kept as state over three runs, one batch of which runs twice, are the newest events of one query over all."""
    from auditloom.sources.store import Store

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = table(spark, SF, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id") % 11).alias("user_id"), "event_type")
    store = Store(spark, f"{folder}/store", "user_id", 4)
    for part in range(3):
        rows.filter(F.col("event_id") % 3 == part).union(rows.filter("event_id % 100 = 7")).write.mode("append").parquet(f"{folder}/in")
        if part == 1:  # the first try of this run dies before its batch is committed
            dies = Store(spark, f"{folder}/store", "user_id", 4)
            dies._publish = lambda manifest: (_ for _ in ()).throw(RuntimeError("dies"))
            q = events.stream_fan_out(spark, f"{folder}/in", rows.schema, dies, "queues", f"{folder}/checkpoint", "user_id", 5, ["event_id long", "event_type string"])
            with pytest.raises(Exception):
                q.awaitTermination(120)
        q = events.stream_fan_out(spark, f"{folder}/in", rows.schema, store, "queues", f"{folder}/checkpoint", "user_id", 5, ["event_id long", "event_type string"])
        q.awaitTermination(120)
        assert max(r["count"] for r in store.read("queues").groupBy("user_id").count().collect()) <= 5
    got = {tuple(r) for r in store.read("queues").select("user_id", "event_id", "event_type").collect()}
    assert got == {tuple(r) for r in events.fan_out(rows, "user_id", 5).select("user_id", "event_id", "event_type").collect()} and len(got) > 40


def test_readers_follow_a_feed_by_their_own_cursors(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = table(spark, SF, "events").select("event_id", "event_type").limit(90)
    for part in range(3):
        rows.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    q = events.stream_feed(spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/checkpoint")
    q.awaitTermination(120)
    # a crash after the last batch was written and before it was committed: it is run again
    last = max(int(n) for n in os.listdir(f"{folder}/checkpoint/commits") if n.isdigit())
    for n in (str(last), f".{last}.crc"):
        os.remove(f"{folder}/checkpoint/commits/{n}")
    events.stream_feed(spark, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/checkpoint").awaitTermination(120)
    feed = spark.read.parquet(f"{folder}/out")
    assert feed.count() == rows.count() == feed.select("event_id").distinct().count()
    whole = [tuple(r) for r in feed.select("batch", "event_id").orderBy("batch", "event_id").collect()]
    snapshot = [tuple(r) for r in events.follow(feed, None, 10, recent=20).select("batch", "event_id").collect()]
    assert snapshot == whole[-20:]
    seen, cursor = [], (-1, -1)
    while got := [tuple(r) for r in events.follow(feed, cursor, 37).select("batch", "event_id").collect()]:
        seen, cursor = seen + got, got[-1]
    assert seen == whole
