from pyspark.sql import functions as F

from chainwitness.catalog import streams
from chainwitness.schemas import LEDGER
from chainwitness.sources.ledger import write_batch
from chainwitness.streaming import live

H = "a" * 64
SLIM = "id string, session_id string, seq int, prev_chain_hash string, chain_hash string, created_at timestamp"


def records(spark, rows):
    """Full ledger rows from (id, session, seq)."""
    fixed = dict(device_id="d", started_at=0, ended_at=5, frame_count=1, byte_size=1, mime_type="video/webm",
                 segment_hash=H, prev_chain_hash=H, chain_hash=H, signature="x")
    df = spark.createDataFrame(rows, "id string, session_id string, seq int")
    for name, value in fixed.items():
        df = df.withColumn(name, F.lit(value))
    for name in LEDGER.names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER.fields])


def test_ingest_replay_changes_nothing(spark, tmp_path):
    path, rejected = str(tmp_path / "ledger"), str(tmp_path / "rejected")
    live.prepare_ledger(spark, path)
    write = live.ingest_batch(path, rejected, now=F.timestamp_millis(F.lit(0)))
    batch = records(spark, [("a", "s", 0), ("b", "s", 0), ("c", "s", 1), ("bad", "s", -1)])
    content = lambda: sorted((r["id"], r["seq"]) for r in live.read_ledger(spark, path).collect())
    write(batch, 0)
    assert content() == [("a", 0), ("c", 1)]
    write(batch, 0)  # the same batch after a failure
    assert content() == [("a", 0), ("c", 1)]
    write(records(spark, [("d", "s", 1), ("e", "s", 2)]), 1)
    assert content() == [("a", 0), ("c", 1), ("e", 2)]
    assert [r["id"] for r in spark.read.parquet(rejected).collect()] == ["bad"]


def test_late_predecessor_still_yields_its_link(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")

    def arrive(*rows):
        df = spark.createDataFrame(rows, "id string, session_id string, seq int, prev_chain_hash string, chain_hash string")
        df.withColumn("created_at", F.timestamp_seconds(F.col("seq") + 1000)).coalesce(1).write.mode("append").parquet(feed)

    schema = spark.createDataFrame([], SLIM).schema

    def run():
        read = lambda: live.read_stream(spark, feed, schema)
        live.drain(live.link_results(read(), read(), "1 day").writeStream.foreachBatch(live.rollup_batch(out)), str(tmp_path / "state"))
        return sorted((r["id"], r["link_ok"]) for r in spark.read.parquet(out).collect())

    arrive(("r2", "s", 2, "h1", "h2"), ("r4", "s", 4, "wrong", "h4"))
    assert run() == []
    arrive(("r1", "s", 1, "h0", "h1"))
    assert run() == [("r2", True)]
    arrive(("r3", "s", 3, "h2", "h3"))
    assert run() == [("r2", True), ("r3", True), ("r4", False)]


def test_running_state_is_the_newest_batch(spark, tmp_path):
    path = str(tmp_path / "out")
    row = lambda n: spark.createDataFrame([("s", n)], "session_id string, n int")
    write_batch(row(1), path, 9)
    write_batch(row(2), path, 10)
    assert [tuple(r) for r in live.current_journeys(spark, path).collect()] == [("s", 2)]


def test_warm_start_adds_known_predecessors(spark, tmp_path):
    known, feed, out = (str(tmp_path / n) for n in ("known", "feed", "out"))
    make = lambda *rows: spark.createDataFrame(rows, "id string, session_id string, seq int, prev_chain_hash string, chain_hash string").withColumn(
        "created_at", F.timestamp_seconds(F.col("seq") + 1000))
    make(("r0", "s", 0, "g", "h0")).write.parquet(known)
    make(("r1", "s", 1, "h0", "h1")).write.parquet(feed)
    schema = spark.createDataFrame([], SLIM).schema
    before = live.warm_start(live.read_stream(spark, feed, schema), live.read_stream(spark, known, schema))
    links = live.link_results(live.read_stream(spark, feed, schema), before, "1 day")
    live.drain(links.writeStream.foreachBatch(live.rollup_batch(out)), str(tmp_path / "state"))
    assert [(r["id"], r["link_ok"]) for r in spark.read.parquet(out).collect()] == [("r1", True)]


def arrivals(spark, feed, rows):
    """A file of records (id, session, second of arrival) of device d."""
    df = spark.createDataFrame(rows, "id string, session_id string, second long").select(
        "id", "session_id", F.lit("d").alias("device_id"), (F.col("second") * 1000 - 500).alias("started_at"), (F.col("second") * 1000).alias("ended_at"),
        F.timestamp_seconds("second").alias("created_at"), F.when(F.col("id").endswith("7"), "bad").otherwise("ok").alias("check"))
    df.coalesce(1).write.mode("append").parquet(feed)
    return df.schema


def test_state_of_windows_that_are_over_goes(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    day = 86_400
    for k in range(10):  # ten days, twelve sessions a day; session s0 every day
        schema = arrivals(spark, feed, [(f"r{k}-{i}", f"s{0 if i == 0 else k * 100 + i}", k * day + i) for i in range(12)])
    schema = arrivals(spark, feed, [("late7", "s0", 5), ("last", "s0", 9 * day + 90)])  # the first is days too late
    rollup = live.windowed_journeys(live.read_stream(spark, feed, schema, files_per_batch=1), "1 day", "1 day")
    query = live.drain(rollup.writeStream.outputMode("update").foreachBatch(live.rollup_batch(out)), str(tmp_path / "state"))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 12
    found = {r["session_id"]: r for r in live.merged_journeys(spark, out).collect()}
    assert len(found) == 1 + 10 * 11
    assert (found["s0"]["n_records"], found["s0"]["n_bad"], found["s0"]["first_at"], found["s0"]["last_at"]) == (11, 0, -500, (9 * day + 90) * 1000)


def test_windows_are_given_out_once(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    arrivals(spark, feed, [("a", "s", 10), ("b", "s", 20), ("a", "s", 10), ("c", "s", 400)])
    arrivals(spark, feed, [("b", "s", 20), ("d", "t", 290)])
    schema = arrivals(spark, feed, [("clock", "x", 100_000)])
    windows = live.closed_windows(live.read_stream(spark, feed, schema, files_per_batch=1), "5 minutes", "1 hour")
    query = live.drain(windows.writeStream.outputMode("append").foreachBatch(live.rollup_batch(out)), str(tmp_path / "state"))
    rows = sorted((r["window_ms"], r["n_records"], r["n_delayed"]) for r in spark.read.parquet(out).collect())
    assert rows == [(0, 3, 0), (300_000, 1, 0)]
    assert all(s["numRowsTotal"] <= 1 for s in query.lastProgress["stateOperators"])


def test_timely_feed_is_written_by_many_tasks_and_counts_the_same(spark, tmp_path, monkeypatch):
    few = spark.range(2).select("id")
    streams._append_files(few, str(tmp_path / "feed"), 5)
    assert len(spark.read.parquet(f"{tmp_path}/feed/*").inputFiles()) == 5 and spark.read.parquet(f"{tmp_path}/feed/*").count() == 2
    one = sorted(tuple(r) for r in streams.stream_daily_rollup(spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    feed = streams._timely_feed(spark, "/root/testdata/sf0.001")
    assert feed.isStreaming
    monkeypatch.setattr(streams.live, "read_stream", lambda own, path, schema, files_per_batch: (path, files_per_batch))
    path, files = streams._timely_feed(spark, "/root/testdata/sf0.001")
    assert files > 1 and len(spark.read.parquet(path).inputFiles()) == streams.SLICES * files + 1
    monkeypatch.undo()
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    assert sorted(tuple(r) for r in streams.stream_daily_rollup(spark, "/root/testdata/sf0.001").collect()) == one and one
