"""Queries on validity, ingest, retention, holds, delivery and arrival rollups."""

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.catalog import sql as S
from chainwitness.catalog.ledger import SEP, big
from chainwitness.functions import records as R
from chainwitness.plans import lifecycle as life
from chainwitness.plans import monitor
from chainwitness.session import new_dir, spread
from chainwitness.sources import ledger as src
from chainwitness.sources.store import LedgerStore
from chainwitness.testing import fixtures as X


def _with_now(df, spark, d):
    """Attach the clock, one millisecond after the last event, as a scalar subquery."""
    last = X.evt_rows(spark, d).agg((F.max("ended_at") + 1).alias("now_ms"))
    return df.withColumn("now_ms", last.scalar())


# -- validity and ingest on order lines -----------------------------------------------


def _order_lines(spark, d):
    order, line, kind = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_orderkey") % 13
    text = F.concat_ws("|", order.cast("string"), line.cast("string"), F.col("l_partkey").cast("string"))
    digest = F.col("digest")
    ship = R.epoch_ms(F.col("l_shipdate"))
    return spread(X.table(spark, d, "lineitem")).withColumn("digest", F.sha2(text, 256)).select(
        F.concat_ws(":", order.cast("string"), line.cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"),
                    F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("id"),
        F.when(kind == 4, "999").otherwise((F.col("l_suppkey") % 8).cast("string")).alias("device_id"),
        order.cast("string").alias("session_id"),
        F.when(kind == 5, -line).otherwise(line).alias("seq"),
        F.when(kind == 2, F.upper(digest)).otherwise(digest).alias("segment_hash"),
        digest.alias("prev_chain_hash"),
        digest.alias("chain_hash"),
        F.when(kind == 6, F.lit(None)).otherwise(F.lit("c2ln")).alias("signature"),
        ship.alias("started_at"),
        F.when(kind == 3, ship - 1).otherwise(ship + 5000).alias("ended_at"),
        F.when(kind == 7, -1).otherwise(75).alias("frame_count"),
        F.when(kind == 1, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("bigint").alias("byte_size"),
        F.lit("video/webm").alias("mime_type"),
    )


def _supplier_devices(spark, d):
    return X.table(spark, d, "supplier").select((F.col("s_suppkey") % 8).cast("string").alias("id")).distinct()


def ledger_valid(spark, d):
    good = life.valid_rows(_order_lines(spark, d), _supplier_devices(spark, d))
    return good.select("id", "session_id", *big("seq"), "device_id")


def ledger_quarantine(spark, d):
    bad = life.quarantined_rows(_order_lines(spark, d), _supplier_devices(spark, d))
    return bad.select("id", "session_id", F.array_join("failed", SEP).alias("failed"))


def idempotent_ingest(spark, d):
    """Order lines appended to a ledger that already holds every third order; the batch arrives twice."""
    good = life.valid_rows(_order_lines(spark, d))
    now = F.timestamp_millis(F.lit(1700000000000))
    store = LedgerStore(spark, new_dir(spark, "ledger"), src.stamp(good, now).schema, buckets=8)
    store.append(good.where(F.col("session_id").cast("bigint") % 3 == 0), "stored", ["id"], lambda new: src.stamp(new, now))
    store.append(good, "arrivals", ["id"], lambda new: src.stamp(new, now))
    added = store.append(good, "arrivals", ["id"], lambda new: src.stamp(new, now))  # a replay adds nothing
    return added.select("id", "session_id", *big("seq"), F.unix_millis("created_at").alias("created_ms"),
                        F.unix_millis("expires_at").alias("expires_ms"))


def register_devices(spark, d):
    """Customers as devices; those of the first ten nations are registered already."""
    rows = X.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("label"),
        "c_nationkey", F.timestamp_millis(F.col("c_custkey")).alias("created_at"),
    )
    again = rows.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    added = src.append_devices(rows.unionByName(again), rows.where("c_nationkey < 10"))
    return added.select("id", "label", F.unix_millis("created_at").alias("created_ms"))


def snapshot_drift(spark, d):
    """Two snapshots of the orders: one removes, one adds and one changes some rows."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = X.table(spark, d, "orders").select(key.alias("id"), "o_custkey", "o_orderstatus", price.alias("price"))
    before = rows.where(F.col("id") % 11 != 0)
    after = rows.where(F.col("id") % 13 != 0).withColumn(
        "price", F.when(F.col("id") % 17 == 0, F.col("price") + 1).otherwise(F.col("price"))
    ).withColumn("o_orderstatus", F.when(F.col("id") % 34 == 0, None).otherwise(F.col("o_orderstatus")))
    out = life.drift(before, after)
    return out.select("id", "change", F.array_join("columns", SEP).alias("columns"))


# -- arrival rollups --------------------------------------------------------------------


def anchor_delay(spark, d):
    delay = R.anchor_delay_ms()
    return X.evt_rows(spark, d).select("event_id", delay.alias("delay_ms"), R.is_late_anchor(delay).alias("delayed"))


def journey_index(spark, d):
    return monitor.latest_journeys(X.evt_rows(spark, d))


def monitor_counters(spark, d):
    return monitor.monitor_counters(X.evt_rows(spark, d))


def arrival_rollup(spark, d):
    return monitor.arrival_rollup(X.evt_rows(spark, d))


def newest_300(spark, d):
    rows = X.evt_ledger(spark, d)
    return src.newest(rows).select("event_id", "session_id", *big("seq"), F.unix_millis("created_at").alias("created_ms"))


def session_picker(spark, d):
    picked = monitor.session_picker(X.evt_ledger(spark, d))
    return picked.withColumn("seqs", F.concat_ws(",", F.transform("seqs", lambda s: s.cast("string"))))


def video_library(spark, d):
    return monitor.video_library(X.evt_rows(spark, d)).orderBy(F.desc("started_at"))


def distinct_arrivals(spark, d):
    rows = X.evt_rows(spark, d).select("id", "session_id", "started_at")
    return src.distinct_arrivals(rows.unionByName(rows))


def expiry_projection(spark, d):
    rows = _with_now(X.evt_rows(spark, d), spark, d)
    left = R.seconds_left(F.col("ended_at"), F.col("now_ms"), V.CACHE_RETENTION_MS * 20)
    return rows.select("event_id", left.alias("seconds_left"), (left == 0).alias("expiring"))


# -- retention and holds -------------------------------------------------------------------


def _purge(spark, d):
    rows = _with_now(X.evt_rows(spark, d), spark, d).withColumn(
        "expires_at", F.col("created_at") + F.expr("INTERVAL 15 DAYS")
    )
    objects = X.table(spark, d, "events").select("user_id").distinct().where("user_id % 5 = 0").select(
        F.lit("evidence").alias("bucket_id"), F.concat(F.col("user_id").cast("string"), F.lit("/clip.webm")).alias("name")
    )
    return life.purge(rows, objects, F.timestamp_millis("now_ms"))


def purge_survivors(spark, d):
    return _purge(spark, d)[0].select("event_id", "session_id")


def purge_count(spark, d):
    return life.purge_count(_purge(spark, d)[1])


def _cache(spark, d):
    return X.evt_rows(spark, d).withColumn("key", F.format_string("%012d", "event_id"))


def cache_retention(spark, d):
    rows = _with_now(_cache(spark, d), spark, d)
    fates = life.cache_retention(rows, F.col("now_ms"), retention_ms=10 * 86_400_000)
    return fates.select("event_id", "device_id", "fate")


def incident_locks(spark, d):
    held = life.incident_holds(_cache(spark, d), X.incidents(spark, d))
    return held.select("event_id", "held", "newly_held")


def chosen_locks(spark, d):
    """Clips held by an incident, or by the caller's rule: longer than 4.5 s and started in an odd minute."""
    rule = lambda start, end: (end - start > 4500) & (F.floor(start / 60000) % 2 == 1)
    return life.incident_holds(_cache(spark, d), X.incidents(spark, d), should_lock=rule).select("event_id", "held", "newly_held")


def evidence_hold(spark, d):
    cached = _cache(spark, d)
    sent = cached.where("byte_size % 2 = 0 and event_type = 'error'")
    return life.hold_submitted(cached, sent).select("event_id", "locked")


# -- delivery -----------------------------------------------------------------------------------


def _attempts(spark, d):
    order = F.col("o_orderkey")
    tries = X.table(spark, d, "orders").where(order % 6 > 0).select(
        order.alias("key"), F.explode(F.sequence(F.lit(1).cast("bigint"), order % 6)).alias("n")
    )
    codes = F.array(F.lit(None), *[F.lit(c) for c in (503, 429, 408, 400, 201)])
    return tries.select(
        "key", (F.lit(1700000000000) + F.col("n") * 60000).alias("attempt_at"),
        F.get(codes, ((F.col("key") + F.col("n")) % 6).cast("int")).alias("status"),
    )


def backoff_ladder(spark, d):
    return life.backoff_ladder(_attempts(spark, d)).select("key", "attempt_at", "kind", "failures_in_row", "wait_ms")


def _outbox(spark, d):
    order = F.col("o_orderkey")
    outbox = X.table(spark, d, "orders").select(order.alias("key"), (order * 1000).alias("queued_at"))
    stored = X.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("key"))
    return life.outbox_state(outbox, stored, _attempts(spark, d))


def outbox_pending(spark, d):
    return _outbox(spark, d).orderBy("queued_at", "key")


def outbox_counts(spark, d):
    return life.outbox_counts(_outbox(spark, d))


def sent_marks(spark, d):
    order = F.col("o_orderkey")
    cached = X.table(spark, d, "orders").select(order.alias("key"), (order % 9 == 0).alias("sent"))
    stored = X.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("key"))
    return life.mark_sent(cached, stored)


QUERIES = {
    f.__name__: f
    for f in (
        ledger_valid, ledger_quarantine, idempotent_ingest, register_devices, snapshot_drift,
        anchor_delay, journey_index, monitor_counters, arrival_rollup, newest_300, session_picker,
        video_library, distinct_arrivals, expiry_projection, purge_survivors, purge_count,
        cache_retention, incident_locks, chosen_locks, evidence_hold, backoff_ladder, outbox_pending,
        outbox_counts, sent_marks,
    )
}

_LINES = """lines as (
  select l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_quantity::int || ':' || l_extendedprice::decimal(18,2) as id,
    l_orderkey % 13 as kind, l_orderkey::varchar as session_id, l_linenumber as line, (l_suppkey % 8)::varchar as dev from lineitem
)"""
_FAILED = """case kind when 1 then 'byte_size is not positive' when 2 then 'segment_hash is no SHA-256 hash'
  when 3 then 'ended_at is before started_at' when 4 then 'device is unknown' when 5 then 'seq is negative'
  when 6 then 'signature is missing' when 7 then 'frame_count is negative' end"""
_NOW = "(select max(ended_at) + 1 from evt)"
_ATTEMPTS = """tries as (
  select o_orderkey as key, n, 1700000000000 + n * 60000 as attempt_at,
    ([null, 503, 429, 408, 400, 201])[(o_orderkey + n) % 6 + 1] as status
  from orders, unnest(range(1, o_orderkey % 6 + 1)) as u(n)),
kinds as (select *, case when status = 201 then 'sent' when coalesce(status, 0) = 0 or status >= 500 or status in (408, 429) then 'retry' else 'refused' end as kind from tries)"""
_OUTBOX = f"""{_ATTEMPTS},
state as (select key, queued_at, coalesce(attempts, 0) as attempts, coalesce(rejected, false) as rejected
  from (select o_orderkey as key, o_orderkey * 1000 as queued_at from orders) o
  left join (select key, count(*) filter (kind <> 'sent') as attempts, bool_or(kind = 'refused') as rejected, bool_or(kind = 'sent') as done
    from kinds group by 1) k using (key)
  where not coalesce(done, false) and key not in (select l_orderkey from lineitem where l_quantity > 45))"""

ORACLES = {
    "ledger_valid": f"with {_LINES} select id, session_id, line::bigint as seq, dev as device_id from lines where {_FAILED} is null",
    "ledger_quarantine": f"with {_LINES} select id, session_id, {_FAILED} as failed from lines where {_FAILED} is not null",
    "idempotent_ingest": f"""with {_LINES} select min(id) as id, session_id, line::bigint as seq, 1700000000000 as created_ms,
  1700000000000 + 30 * 86400000::bigint as expires_ms from lines where kind not in (1, 2, 3, 5, 6, 7) and session_id::bigint % 3 <> 0 group by session_id, line""",
    "register_devices": "select c_custkey::varchar as id, c_name as label, c_custkey as created_ms from customer where c_nationkey >= 10",
    "snapshot_drift": """select o_orderkey as id, case when o_orderkey % 11 = 0 then 'added' when o_orderkey % 13 = 0 then 'removed' else 'changed' end as change,
  case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then '' when o_orderkey % 34 = 0 then 'o_orderstatus | price' else 'price' end as columns
from orders where (o_orderkey % 11 = 0) <> (o_orderkey % 13 = 0) or (o_orderkey % 17 = 0 and o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0)""",
    "anchor_delay": S.with_events("select event_id, created_ms - ended_at as delay_ms, created_ms - ended_at > 60000 as delayed from evt"),
    "journey_index": S.with_events("""select session_id, any_value(device_id) as device_id, count(*) as n_records, min(started_at) as first_at, max(ended_at) as last_at,
  count(*) filter ("check" = 'bad') as n_bad, greatest(max(created_ms - ended_at), 0) as max_delay_ms from evt group by 1"""),
    "monitor_counters": S.with_events("""select count(*) as n_total, count(*) filter ("check" = 'ok') as n_ok, count(*) filter ("check" = 'bad') as n_bad,
  count(*) filter (created_ms - ended_at > 60000) as n_delayed from evt"""),
    "arrival_rollup": S.with_events("""select created_ms // 300000 * 300000 as window_ms, count(*) as n_records,
  count(*) filter (created_ms - ended_at > 60000) as n_delayed, max(created_ms - ended_at) as max_delay_ms from evt group by 1"""),
    "newest_300": S.with_events("select event_id, session_id, seq, created_ms from evt order by created_ms desc, seq desc, id desc limit 300"),
    "session_picker": S.with_events("""select session_id, any_value(device_id) as device_id, count(*) as n_segments, string_agg(seq::varchar, ',' order by seq) as seqs
from (select * from evt order by created_ms desc, seq desc, id desc limit 500) t group by 1"""),
    "video_library": S.with_events("select session_id, count(*) as n_clips, min(started_at) as started_at, max(ended_at) as ended_at, sum(byte_size)::bigint as n_bytes from evt group by 1"),
    "distinct_arrivals": S.with_events("select id, session_id, started_at from evt"),
    "expiry_projection": S.with_events(f"""select event_id, s as seconds_left, s = 0 as expiring from (
  select event_id, greatest(ceil((ended_at + 3600000 - {_NOW}) / 1000.0::double), 0)::bigint as s from evt) t"""),
    "purge_survivors": S.with_events(f"select event_id, session_id from evt where created_ms + 15 * 86400000::bigint >= {_NOW} or session_id::bigint % 5 = 0"),
    "purge_count": S.with_events(f"select count(*) as n_removed from evt where created_ms + 15 * 86400000::bigint < {_NOW} and session_id::bigint % 5 <> 0"),
    "cache_retention": S.with_events(f"""select event_id, device_id, case when expired then 'expired' when not locked and r <= kept - 400 then 'evicted' else 'kept' end as fate
from (select *, count(*) filter (not expired) over (partition by device_id) as kept,
    count(*) filter (not expired and not locked) over (partition by device_id order by started_at, event_id) as r
  from (select *, not locked and ended_at < {_NOW} - 864000000 as expired from evt) t) u"""),
    "incident_locks": S.with_events("""select event_id, hit or locked as held, hit and not locked as newly_held from (
  select *, exists (select 1 from evt i where i.event_type = 'error' and i.event_id % 97 = 0 and i.device_id = e.device_id
    and e.ended_at >= i.started_at - 30000 and e.started_at <= i.started_at + 30000) as hit from evt e) t"""),
    "chosen_locks": S.with_events("""select event_id, hit or locked as held, hit and not locked as newly_held from (
  select *, (ended_at - started_at > 4500 and (started_at // 60000) % 2 = 1) or exists (select 1 from evt i where i.event_type = 'error' and i.event_id % 97 = 0
    and i.device_id = e.device_id and e.ended_at >= i.started_at - 30000 and e.started_at <= i.started_at + 30000) as hit from evt e) t"""),
    "evidence_hold": S.with_events("select event_id, locked or (byte_size % 2 = 0 and event_type = 'error') as locked from evt"),
    "backoff_ladder": f"""with {_ATTEMPTS},
marked as (select *, count(*) filter (kind = 'sent') over (partition by key order by n) as g from kinds),
counted as (select *, case when kind = 'retry' then count(*) filter (kind = 'retry') over (partition by key, g order by n) else 0 end as f from marked)
select key, attempt_at, kind, f as failures_in_row, case when f > 0 then least(30000, 1000 * pow(2, f - 1))::bigint else 0 end as wait_ms from counted""",
    "outbox_pending": f"with {_OUTBOX} select * from state",
    "outbox_counts": f"with {_OUTBOX} select count(*) filter (not rejected) as n_pending, count(*) filter (rejected) as n_rejected, coalesce(sum(attempts), 0)::bigint as n_attempts from state",
    "sent_marks": "select o_orderkey as key, o_orderkey % 9 = 0 or o_orderkey in (select l_orderkey from lineitem where l_quantity > 45) as sent from orders",
}
