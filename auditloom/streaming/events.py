"""The event feed: bounded views, transitions and progress, as batch queries and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def newest(events: DataFrame, n: int) -> DataFrame:
    """The n events with the largest ids (a top-n, never a whole sort): what retention and recent views keep."""
    return events.orderBy(F.col("event_id").desc()).limit(n)


def fan_out(events: DataFrame, key: str, capacity: int) -> DataFrame:
    """For each subscriber (key) its newest events, capacity at most: full queues drop the oldest."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.col("event_id").desc()))
    return events.withColumn("_n", at).filter(F.col("_n") <= capacity).drop("_n")


def transitions(events: DataFrame, key: str, status: str) -> DataFrame:
    """Rows where the status of a key differs from the one before: from_status, to_status."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("from_status", F.lag(status).over(w)).filter(F.col("from_status").isNotNull() & (F.col("from_status") != F.col(status))).select(
        "event_id", key, "ts", "from_status", F.col(status).alias("to_status")
    )


def per_window(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts for each time window and type; the same on a stream as on a table."""
    return (
        events.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "errors")
    )


def stream_windows(spark: SparkSession, path: str, schema, out: str, checkpoint: str, width: str = "1 hour", late: str = "1 day"):
    """Starts the streaming form of per_window over a folder of Parquet files; rows are final once the watermark has passed."""
    feed = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    query = per_window(feed, width).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return query.outputMode("append").trigger(availableNow=True).start()


def since(events: DataFrame, after: int, n: int = 100) -> DataFrame:
    """The n events after an id, in order: what a reader with a cursor asks for next."""
    return events.filter(F.col("event_id") > after).orderBy("event_id").limit(n)


def merged(server: DataFrame, client: DataFrame, n: int) -> DataFrame:
    """The newest n of two logs, each event once; where both have one the server's counts."""
    rows = server.withColumn("_at", F.lit(0)).unionByName(client.withColumn("_at", F.lit(1)), allowMissingColumns=True)
    once = rows.groupBy("event_id").agg(F.min_by(F.struct(*server.columns), "_at").alias("m"))
    return newest(once.select("m.*"), n)


def stream_log(spark: SparkSession, path: str, schema, out: str, checkpoint: str):
    """Starts a stream that appends the events of a folder to a table, each once, and goes on where its checkpoint ends."""
    feed = spark.readStream.schema(schema).parquet(path)
    query = feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return query.outputMode("append").trigger(availableNow=True).start()


def stream_transitions(spark: SparkSession, path: str, schema, out: str, checkpoint: str, key: str = "user_id", status: str = "event_type"):
    """Starts the streaming form of transitions(): the last status of each key is state, kept over restarts by the checkpoint.

    Within a batch events are taken by ts and event_id; an event that comes after later ones of its
    key is compared with the status at that point, as a feed would show it.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = {f.name: f.dataType.simpleString() for f in schema}
    result = f"event_id {kind['event_id']}, {key} {kind[key]}, ts timestamp, from_status string, to_status string"

    def step(k, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        found = []
        for e, at, s in zip(rows["event_id"], rows["ts"], rows[status]):
            if last is not None and s != last:
                found.append((e, k[0], at, last, s))
            last = s
        state.update((last,))
        yield pd.DataFrame(found, columns=["event_id", key, "ts", "from_status", "to_status"])

    feed = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    changes = feed.groupBy(key).applyInPandasWithState(step, result, "last string", "append", GroupStateTimeout.NoTimeout)
    query = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return query.outputMode("append").trigger(availableNow=True).start()


def bounded_queue(key: str, capacity: int, columns: list[str]):
    """A state processor that keeps the newest events of each key, capacity at most, and returns the key's queue after each batch.

    State is a list of events by event_id; what does not fit any more is dropped, the oldest first, as frames come in,
    so neither the state nor a task holds more of a key than capacity events and one frame. An event that comes
    twice is one.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Queue(StatefulProcessor):
        def init(self, handle):
            self.queue = handle.getListState("queue", ", ".join(columns))

        def handleInputRows(self, k, frames, timers):
            names = [c.split()[0] for c in columns]
            held = pd.DataFrame(list(self.queue.get()), columns=names)
            for frame in frames:
                held = pd.concat([held, frame[names]]).drop_duplicates("event_id").sort_values("event_id").tail(capacity)
            self.queue.put([tuple(r) for r in held.itertuples(index=False)])
            out = held.copy()
            out.insert(0, key, k[0])
            yield out

        def close(self):
            pass

    return Queue()


def stream_fan_out(spark: SparkSession, path: str, schema, store, table: str, checkpoint: str, key: str, capacity: int, columns: list[str]):
    """Starts the streaming form of fan_out(): the queue of each subscriber is state and, after each batch, its rows of a store's table.

    A batch that runs again after a crash replaces the same subscribers' rows by the same queues. columns are
    those of a queued event with their types, event_id first. The session needs RocksDB as its state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    queue = bounded_queue(key, capacity, columns)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
    changed = feed.groupBy(key).transformWithStateInPandas(queue, f"{key} {kinds[key]}, {', '.join(columns)}", "Update", "None")

    def write(rows: DataFrame, _: int) -> None:
        rows = rows.persist()  # the commit reads it more than once
        try:
            store.commit({table: rows})
        finally:
            rows.unpersist()

    query = changed.writeStream.foreachBatch(write).outputMode("update")
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_feed(spark: SparkSession, path: str, schema, out: str, checkpoint: str):
    """Starts a stream that appends the events of a folder to a feed that readers follow by cursors, each event once.

    A batch's events lie in a folder of its number, which a batch that runs again after a crash writes anew; its place in
    the feed is (batch, event_id).
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def follow(feed: DataFrame, cursor: tuple[int, int] | None, n: int, recent: int = 50) -> DataFrame:
    """What a reader gets next of a feed (batch, event_id, ...), in order: the newest recent events at first, then n after its cursor.

    A reader's next cursor is the last row's (batch, event_id). Each reader has its own, and none changes the feed. Only
    the folders of batches from the cursor's on are read.
    """
    if cursor is None:
        return feed.orderBy(F.col("batch").desc(), F.col("event_id").desc()).limit(recent).orderBy("batch", "event_id")
    batch, event = cursor
    return feed.filter((F.col("batch") > batch) | ((F.col("batch") == batch) & (F.col("event_id") > event))).orderBy("batch", "event_id").limit(n)
