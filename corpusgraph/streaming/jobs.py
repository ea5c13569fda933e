"""Jobs as a stream of state changes: idempotent queue, latest state, recovery, retries, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import best_by

#: Times a failed job may be started again; parts of the state of a stream that ends once it has read what is there.
RETRIES, STATE_PARTS = 3, 16


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's zone should be UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def latest_states(changes: DataFrame, job: str, order: list[str]) -> DataFrame:
    """The newest change of each job."""
    return best_by(changes, [job], [F.desc(c) for c in order])


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart, jobs that were waiting or running wait again, with one more try counted."""
    lost = F.col("status").isin("pending", "processing")
    return jobs.withColumns({
        "status": F.when(lost, "pending").otherwise(F.col("status")),
        "retry_count": F.col("retry_count") + lost.cast("int"),
        "stage": F.when(lost, "recovered").otherwise(F.col("stage")),
    })


def may_retry(status: Column, retry_count: Column) -> Column:
    return (status == "failed") & (F.coalesce(retry_count, F.lit(0)) < RETRIES)


def resumable(runs: DataFrame, books: DataFrame, run: str, book: str, confirmed: str) -> DataFrame:
    """Runs that wait for their reader and whose books (run, book, confirmed) are all confirmed go on."""
    ready = books.groupBy(run).agg(F.bool_and(F.coalesce(F.col(confirmed), F.lit(False))).alias("_ready"))
    j = runs.join(ready, run, "left")
    go = (F.col("status") == "waiting_user") & F.coalesce("_ready", F.lit(False))
    return j.withColumn("status", F.when(go, "pending").otherwise(F.col("status"))).drop("_ready")


def applied_writes(writes: DataFrame, key: str, expected: str, arrival: str) -> DataFrame:
    """Optimistic writes: of the writes of a key, in order of arrival, each that expects the revision so far is applied and raises it by one.

    Sequential by nature: one key is one group of small rows."""
    kind = writes.schema[key].dataType.simpleString()
    seen = writes.schema[arrival].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f, revision, done = f.sort_values(arrival), 0, []
        for e in f[expected]:
            done.append(e == revision)
            revision += int(e == revision)
        return f[[key, arrival]].assign(applied=done)

    return writes.groupBy(key).applyInPandas(run, f"{key} {kind}, {arrival} {seen}, applied boolean")


def event_windows(events: DataFrame, length: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums of each event type in windows of ``length``; in a stream, rows later than ``late`` are left out."""
    e = with_event_time(events)
    if late:
        e = e.withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    got = e.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Runs of a user's events with no pause of ``gap``."""
    e = with_event_time(events)
    if late:
        e = e.withWatermark("ts", late)
    got = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def progress_stream(events: DataFrame) -> DataFrame:
    """For each job (user_id) its number of changes, failures and last state so far, from a stream of changes.

    State is four values for each job ever seen; it is not forgotten, for a job may
    change after any time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, failed, last, at = state.get if state.exists else (0, 0, "", -1)
        for f in frames:
            n += len(f)
            failed += int((f["event_type"] == "error").sum())
            i = f["event_id"].idxmax()
            if f["event_id"][i] > at:
                last, at = f["event_type"][i], int(f["event_id"][i])
        state.update((n, failed, last, at))
        yield pd.DataFrame([(key[0], n, failed, last)], columns=["user_id", "n", "failed", "last"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, failed long, last string", "n long, failed long, last string, at long", "update", GroupStateTimeout.NoTimeout)


def queue_sink(changes: DataFrame, path: str, checkpoint: str, key: str = "event_id"):
    """A query that appends each batch's new keys to ``path`` once, also when a batch is run again."""

    def put(batch: DataFrame, number: int) -> None:
        # a batch has a folder of its own: running it again replaces it
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def stream_of(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def audit_log(reviews: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """window_start, action, n, targets: an append-only stream of review events, counted by window; what comes later than ``late`` is left out."""
    r = reviews.withWatermark("ts", late) if reviews.isStreaming else reviews
    got = r.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("n"), F.approx_count_distinct("target").alias("targets"))
    return got.select(F.col("w.start").alias("window_start"), "action", "n", "targets")


def run_available(stream: DataFrame, mode: str, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there and ends; results are written batch by batch, and running a batch again replaces it."""
    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    conf = stream.sparkSession.conf
    parts = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(min(int(parts), STATE_PARTS)))
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set("spark.sql.shuffle.partitions", parts)
