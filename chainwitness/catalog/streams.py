"""Queries that run a stream over all available input and return its stored result."""

import uuid

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.catalog import sql as S
from chainwitness.catalog.ledger import big
from chainwitness.functions import records as R
from chainwitness.plans.monitor import monitor_counters
from chainwitness.session import new_dir
from chainwitness.streaming import arrival, live
from chainwitness.testing import fixtures as X

# replayed input spans months in a few batches, so nothing counts as late
REPLAY = "3650 days"
SLICES = 4
CLOCK = "clock"
FILE_ROWS = 50_000  # of a timely feed, about


def _feed(rows, spark, slice_of, copies=1):
    """Store rows as a folder of files in a shuffled arrival order; return its path."""
    path = new_dir(spark, "feed")
    for _ in range(copies):
        rows.repartition(SLICES, slice_of % SLICES).write.mode("append").parquet(path)
    return path


def _run(frame, mode, spark, write):
    out, state = new_dir(spark, "stream-out"), new_dir(spark, "stream-state")
    live.drain(frame.writeStream.outputMode(mode).foreachBatch(write(out)), state)
    return out


def _store(path):
    return live.rollup_batch(path)


def stream_ingest_dedup(spark, d):
    """A feed with every record sent twice, appended to an empty ledger."""
    source = X.conv_ledger(spark, d).drop("conv_id").select(*live.LEDGER.names)
    feed = _feed(source, spark, F.xxhash64("id"), copies=2)
    path, rejected = new_dir(spark, "ledger"), new_dir(spark, "rejected")
    live.prepare_ledger(spark, path)
    now = F.timestamp_millis(F.lit(1800000000000))
    writer = live.read_stream(spark, feed, files_per_batch=2).writeStream.foreachBatch(
        live.ingest_batch(path, rejected, X.devices(spark, d), now)
    )
    live.drain(writer, new_dir(spark, "stream-state"))
    return live.read_ledger(spark, path).select(
        "id", "session_id", *big("seq"), "chain_hash", F.unix_millis("created_at").alias("created_ms"),
        F.unix_millis("expires_at").alias("expires_ms"),
    )


def _conv_feed(spark, d):
    rows = X.conv_ledger(spark, d).drop("conv_id").select(*live.LEDGER.names)
    return _feed(rows, spark, F.xxhash64("id"))


def _links(spark, feed):
    read = lambda: live.read_stream(spark, feed, files_per_batch=1)
    out = _run(live.link_results(read(), read(), REPLAY), "append", spark, _store)
    return spark.read.parquet(out)


def stream_links(spark, d):
    """Link results of a feed that arrives out of order."""
    return _links(spark, _conv_feed(spark, d)).select("session_id", *big("seq"), "link_ok")


def _checked(spark, d, feed, known=None):
    """Rows of the check on arrival over a feed."""
    own = arrival.session_for_state(spark)
    checked = live.arrival_checks(live.read_stream(own, feed, files_per_batch=1), X.devices(own, d))
    out = _run(arrival.check_links(checked, known and known(own)), "append", own, _store)
    return spark.read.parquet(out)


def stream_live_check(spark, d):
    """Check on arrival with the links found so far; records arrive out of order and some twice."""
    rows = X.conv_ledger(spark, d).drop("conv_id").select(*live.LEDGER.names)
    feed = _feed(rows.unionByName(rows.where("seq % 4 = 1")), spark, F.xxhash64("id", "seq"))
    return arrival.status(_checked(spark, d, feed)).select("id", "session_id", *big("seq"), "check", "note")


def stream_warm_start(spark, d):
    """A check that starts with the first half of every session stored, and sees the rest arrive."""
    rows = X.conv_ledger(spark, d).drop("conv_id").select(*live.LEDGER.names)
    feed = _feed(rows.where("seq >= 3"), spark, F.xxhash64("id"))
    stored = new_dir(spark, "stored")
    rows.where("seq < 3").write.parquet(stored)
    results = _checked(spark, d, feed, lambda own: own.read.schema(live.LEDGER).parquet(stored))
    found = arrival.status(results)
    return found.select("id", "session_id", *big("seq"), "link_ok", "check")


def _event_feed(spark, d):
    rows = X.evt_rows(spark, d).drop("_ts")
    return _feed(rows, spark, F.col("event_id") % 7), rows.schema


def stream_rollup(spark, d):
    """Running journey index over the arrival feed."""
    feed, schema = _event_feed(spark, d)
    stream = live.read_stream(spark, feed, schema, files_per_batch=1)
    out = _run(live.live_journeys(stream), "update", spark, _store)
    return live.current_journeys(spark, out)


def _append_files(rows, path, n):
    """Append rows to a folder as ``n`` files, written by as many tasks; where there are too few rows, some files hold none."""
    spark, own = rows.sparkSession, f"{path}/{uuid.uuid4().hex}"
    rows.repartition(n).write.parquet(own)
    for _ in range(n - len(spark.read.parquet(own).inputFiles())):
        spark.createDataFrame([], rows.schema).write.mode("append").parquet(own)


def _timely_feed(spark, d, again=False):
    """The arrival feed in order of time, a batch of files for each of SLICES equal spans; at the end a record of a later month.

    With ``again`` a fifth of the records are sent twice. The last record moves the clock of the stream past all windows.
    All spans have one number of files, so that no batch holds a part of the next span, whose times would make others late.
    """
    rows = X.evt_rows(spark, d).drop("_ts")
    at = F.unix_millis("created_at")
    first, last, n = rows.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    path, span = new_dir(spark, "feed"), (last - first) // SLICES + 1
    files = max(1, min(spark.sparkContext.defaultParallelism, n // (SLICES * FILE_ROWS)))
    for k in range(SLICES):
        part = rows.where((at >= first + k * span) & (at < first + (k + 1) * span))
        part = part.unionByName(part.where("event_id % 5 = 0")) if again else part
        _append_files(part, path, files)
    clock = rows.limit(1).withColumn("id", F.lit(CLOCK)).withColumn("session_id", F.lit(CLOCK))
    clock.withColumn("created_at", F.timestamp_millis(F.lit(last + 40 * 86_400_000))).coalesce(1).write.parquet(f"{path}/{CLOCK}")
    return live.read_stream(spark, f"{path}/*", rows.schema, files_per_batch=files)


def stream_daily_rollup(spark, d):
    """Journey index from windows of a day, whose state ends a day after them."""
    out = _run(live.windowed_journeys(_timely_feed(spark, d)), "update", spark, _store)
    return live.merged_journeys(spark, out).where(F.col("session_id") != CLOCK)


def stream_closed_windows(spark, d):
    """Arrivals per five minutes, counted by the stream and given out when a window is over; some arrive twice."""
    out = _run(live.closed_windows(_timely_feed(spark, d, again=True)), "append", spark, _store)
    return spark.read.parquet(out).drop(live.BATCH)


def stream_counters(spark, d):
    """Running totals of the feed; the last stored row is the current state."""
    feed, schema = _event_feed(spark, d)
    stream = live.read_stream(spark, feed, schema, files_per_batch=1)
    out = _run(monitor_counters(stream), "complete", spark, _store)
    return spark.read.parquet(out).orderBy(F.desc(live.BATCH)).limit(1).drop(live.BATCH)


def stream_arrival_windows(spark, d):
    """Arrivals per five minutes, repeats of an id dropped on the way."""
    feed, schema = _event_feed(spark, d)
    stream = live.distinct_arrivals(live.read_stream(spark, feed, schema, files_per_batch=1), REPLAY)
    late = R.is_late_anchor(R.anchor_delay_ms())
    out = _run(
        stream.select("id", "created_at", late.alias("delayed")), "append", spark, _store
    )
    return spark.read.parquet(out).groupBy(F.window("created_at", "5 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if("delayed").alias("n_delayed")
    ).select(F.unix_millis("w.start").alias("window_ms"), "n_records", "n_delayed")


QUERIES = {
    f.__name__: f
    for f in (
        stream_ingest_dedup, stream_links, stream_live_check, stream_warm_start, stream_rollup, stream_daily_rollup, stream_counters,
        stream_arrival_windows, stream_closed_windows,
    )
}

_NOTE = S.joined(
    ("not chain_ok", f"'{V.LIVE_BAD_CHAIN}'"), ("not signature_ok", f"'{V.LIVE_BAD_SIGNATURE}'"),
    ("not coalesce(link_ok, true)", f"'{V.LIVE_BAD_LINK}'"), sep=", ",
)

_JOURNEYS = S.with_events("""select session_id, any_value(device_id) as device_id, count(*) as n_records, min(started_at) as first_at, max(ended_at) as last_at,
  count(*) filter ("check" = 'bad') as n_bad, greatest(max(created_ms - ended_at), 0) as max_delay_ms from evt group by 1""")
_WINDOWS = S.with_events("""select created_ms // 300000 * 300000 as window_ms, count(*) as n_records,
  count(*) filter (created_ms - ended_at > 60000) as n_delayed from evt group by 1""")

ORACLES = {
    "stream_ingest_dedup": S.with_ledger(
        "select id, session_id, seq, chain_hash, 1800000000000 as created_ms, 1800000000000 + 30 * 86400000::bigint as expires_ms from led",
        checks=False),
    "stream_links": S.with_ledger("select session_id, seq, link_ok from chk where seq > 0 and link_ok is not null"),
    "stream_live_check": S.with_ledger(
        f"select id, session_id, seq, case when n = '' then 'ok' else 'bad' end as \"check\", n as note from (select id, session_id, seq, {_NOTE} as n from chk) t"),
    "stream_warm_start": S.with_ledger(
        f"select id, session_id, seq, link_ok, case when n = '' then 'ok' else 'bad' end as \"check\" from (select id, session_id, seq, link_ok, {_NOTE} as n from chk where seq >= 3) t"),
    "stream_rollup": _JOURNEYS,
    "stream_daily_rollup": _JOURNEYS,
    "stream_counters": S.with_events("""select count(*) as n_total, count(*) filter ("check" = 'ok') as n_ok, count(*) filter ("check" = 'bad') as n_bad,
  count(*) filter (created_ms - ended_at > 60000) as n_delayed from evt"""),
    "stream_arrival_windows": _WINDOWS,
    "stream_closed_windows": _WINDOWS,
}
