"""Streams over files give what the batch form gives; the queue is idempotent; writes are ordered."""

from corpusgraph.streaming import jobs as J

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), i % 4, ["view", "error", "click"][i % 3], float(i), "{}") for i in range(90)]
    return spark.createDataFrame(rows, SCHEMA)


def run(stream, mode, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").start()
    q.processAllAvailable()
    q.stop()


def test_windows_progress_and_queue(spark, tmp_path):
    e = events(spark)
    for k in range(3):
        e.where(f"event_id >= {30 * k} AND event_id < {30 * k + 30}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = J.stream_of(spark, f"{tmp_path}/in", SCHEMA)
    run(J.event_windows(stream, "1 hour", "30 days"), "complete", "windows", tmp_path)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, J.event_windows(e, "1 hour").collect()))
    run(J.progress_stream(J.stream_of(spark, f"{tmp_path}/in", SCHEMA)), "update", "progress", tmp_path)
    last = {}
    for r in spark.table("progress").collect():
        last[r.user_id] = max(last.get(r.user_id, (0,)), (r.n, r.failed, r.last))
    assert {k: v[:2] for k, v in last.items()} == {u: (len([i for i in range(90) if i % 4 == u]), len([i for i in range(90) if i % 4 == u and i % 3 == 1])) for u in range(4)}
    for _ in range(2):
        q = J.queue_sink(J.stream_of(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/out", f"{tmp_path}/cp-queue").start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 90


def test_recovery_resume_and_writes(spark):
    d = spark.createDataFrame([("pending", 0, "a"), ("processing", 2, "b"), ("failed", 3, "c"), ("completed", 0, "d")], "status string, retry_count int, stage string")
    assert [(r.status, r.retry_count) for r in J.recovered(d).collect()] == [("pending", 1), ("pending", 3), ("failed", 3), ("completed", 0)]
    runs = spark.createDataFrame([(1, "waiting_user"), (2, "waiting_user"), (3, "failed")], "run int, status string")
    books = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", True), (2, "b", None)], "run int, book string, ok boolean")
    assert {r.run: r.status for r in J.resumable(runs, books, "run", "book", "ok").collect()} == {1: "pending", 2: "waiting_user", 3: "failed"}
    w = spark.createDataFrame([("k", 0, 1), ("k", 0, 2), ("k", 1, 3), ("j", 1, 1)], "key string, expected int, at int")
    assert {(r.key, r.at): r.applied for r in J.applied_writes(w, "key", "expected", "at").collect()} == {("k", 1): True, ("k", 2): False, ("k", 3): True, ("j", 1): False}
