"""The ledger as a stream: idempotent ingest, check on arrival, links and rollups.

Nothing here is keyed by session alone except counters, which combine before the
shuffle. Links are joined on (session, seq), so one busy session spreads over all
state partitions, and either side of a link may arrive first.
"""

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import records as R
from chainwitness.functions.ecdsa import signature_ok
from chainwitness.operators.audit import texts
from chainwitness.plans.lifecycle import quarantined_rows, valid_rows
from chainwitness.plans.monitor import journey_index
from chainwitness.schemas import LEDGER
from chainwitness.sources.ledger import stamp, write_batch
from chainwitness.sources.store import BUCKET, LedgerStore

BATCH = "batch"


def read_stream(spark, path, schema=LEDGER, files_per_batch=None):
    """Records appended to a folder of Parquet files, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(writer, checkpoint):
    """Run a streaming write over all available input, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# -- ingest --------------------------------------------------------------------------


def prepare_ledger(spark, path, schema=LEDGER, **layout):
    """An empty ledger that ingest can append to and readers can open."""
    return LedgerStore(spark, path, schema, **layout)


def read_ledger(spark, path, schema=LEDGER):
    return LedgerStore(spark, path, schema).read().drop(BUCKET)


def ingest_batch(path, rejected_path, devices=None, now=None, schema=LEDGER, **layout):
    """A ``foreachBatch`` function: validate, drop known keys, stamp, append.

    A batch that is committed is not added again, so a replay after a failure changes nothing. The first arrival of a
    (session_id, seq) stays. Only the buckets of the batch's keys are read, see ``sources.store``.
    """
    def write(rows, batch_id):
        clock = F.current_timestamp() if now is None else now
        store = LedgerStore(rows.sparkSession, path, schema, **layout)
        store.append(valid_rows(rows, devices), batch_id, finish=lambda new: stamp(new, clock))
        write_batch(quarantined_rows(rows, devices), rejected_path, batch_id)

    return write


# -- check on arrival ------------------------------------------------------------------


def distinct_arrivals(stream, lateness="1 day"):
    """Records seen once: repeats of an id within the lateness are dropped."""
    return stream.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["id"])


def arrival_checks(stream, devices, protocol=V.DEFAULT_PROTOCOL, verify_with=signature_ok):
    """Chain hash and signature of each record as it arrives; needs no state.

    The link of a first record is known at once and judged here as well.
    """
    key = F.col("public_key")
    keys = devices.select(
        F.col("id").alias("device_id"), key["kty"].alias("kty"), key["crv"].alias("crv"),
        key["x"].alias("x"), key["y"].alias("y"),
    )
    chain_bad = R.chain_hash(protocol) != F.col("chain_hash")
    first_bad = (F.col("seq") == 0) & (
        F.col("prev_chain_hash") != R.genesis_hash(F.col("session_id"))
    )
    checked = stream.join(keys, "device_id", "left").withColumn(
        "_signed", verify_with("kty", "crv", "x", "y", "chain_hash", "signature")
    )
    notes = texts(
        (chain_bad, F.lit(V.LIVE_BAD_CHAIN)),
        (~F.col("_signed"), F.lit(V.LIVE_BAD_SIGNATURE)),
        (first_bad, F.lit(V.LIVE_BAD_LINK)),
    )
    return checked.withColumn("note", F.array_join(notes, ", ")).withColumn(
        "check", F.when(F.col("note") == "", "ok").otherwise("bad")
    ).drop("_signed", "kty", "crv", "x", "y")


def link_results(records, predecessors, lateness="1 day"):
    """Link of each record to the one before it, as soon as both have arrived.

    Pass the same feed twice (two reads of one source). State of a record is dropped
    once its partner can no longer arrive within ``lateness``. A late predecessor
    still yields its result; a record without one yields none.
    """
    here = records.select(
        "id", "session_id", "seq", "prev_chain_hash", F.col("created_at").alias("at")
    ).withWatermark("at", lateness)
    before = predecessors.select(
        F.col("session_id").alias("p_session"), (F.col("seq") + 1).alias("p_next"),
        F.col("chain_hash").alias("p_chain"), F.col("created_at").alias("p_at"),
    ).withWatermark("p_at", lateness)
    span = F.expr(f"INTERVAL {lateness}")
    return here.join(
        before,
        (F.col("session_id") == F.col("p_session"))
        & (F.col("seq") == F.col("p_next"))
        & (F.col("p_at") >= F.col("at") - span)
        & (F.col("p_at") <= F.col("at") + span),
    ).select(
        "id", "session_id", "seq", "at", (F.col("prev_chain_hash") == F.col("p_chain")).alias("link_ok")
    )


def warm_start(feed, recent):
    """The feed preceded by records known before it started.

    ``recent`` is a stream over a folder with the newest stored records; they enter
    the link state as predecessors.
    """
    return recent.unionByName(feed)


def live_status(arrivals, links):
    """Stored arrival checks joined with the link results that exist so far."""
    found = links.groupBy("id").agg(F.bool_and("link_ok").alias("link_ok"))
    broken = ~F.coalesce(F.col("link_ok"), F.lit(True))
    note = F.concat_ws(
        ", ", F.when(F.col("note") != "", F.col("note")), F.when(broken, V.LIVE_BAD_LINK)
    )
    return (
        arrivals.join(found, "id", "left")
        .withColumn("note", note)
        .withColumn("check", F.when(note == "", "ok").otherwise("bad"))
    )


# -- rollups -----------------------------------------------------------------------------


def windowed_journeys(stream, width="1 day", lateness="1 day"):
    """Journey index by session and window of arrival; write it in update mode with ``rollup_batch``.

    State holds the windows that records may still arrive for: those that end within ``lateness`` of the latest arrival.
    A record later than that is not counted here; the ledger has it. ``merged_journeys`` puts the windows of a session together.
    """
    delay = R.anchor_delay_ms()
    return stream.withWatermark("created_at", lateness).groupBy("session_id", F.window("created_at", width).alias("w")).agg(
        F.min(F.struct("started_at", "id", "device_id")).alias("first"),
        F.count(F.lit(1)).alias("n_records"),
        F.max("ended_at").alias("last_at"),
        F.count_if(F.col("check") == "bad").alias("n_bad"),
        F.max(delay).alias("max_delay_ms"),
    ).select("session_id", F.col("w.start").alias("since"), "first", "n_records", "last_at", "n_bad", "max_delay_ms")


def merged_journeys(spark, path):
    """Journey index of every session from the newest stored state of its windows."""
    rows = spark.read.parquet(path)
    keys = ["session_id", "since"]
    fields = [c for c in rows.columns if c not in (BATCH, *keys)]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), BATCH).alias("state")).select(*keys, "state.*")
    return latest.groupBy("session_id").agg(
        F.min("first").alias("first"), F.sum("n_records").alias("n_records"), F.max("last_at").alias("last_at"),
        F.sum("n_bad").alias("n_bad"), F.greatest(F.max("max_delay_ms"), F.lit(0)).cast("bigint").alias("max_delay_ms"),
    ).select("session_id", "first.device_id", "n_records", F.col("first.started_at").alias("first_at"), "last_at", "n_bad", "max_delay_ms")


def closed_windows(stream, width="5 minutes", lateness="1 day"):
    """Arrivals and delays per window, each id once, as the stream counts them; append mode.

    A window is given out once, when the latest arrival is ``lateness`` past its end, and its state goes; so do the ids of that time.
    """
    return distinct_arrivals(stream, lateness).groupBy(F.window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(R.is_late_anchor(R.anchor_delay_ms())).alias("n_delayed"),
    ).select(F.unix_millis("w.start").alias("window_ms"), "n_records", "n_delayed")


def rollup_batch(path):
    """A ``foreachBatch`` function that stores the sessions changed by a batch."""

    def write(rows, batch_id):
        write_batch(rows, path, batch_id)

    return write


def live_journeys(stream):
    """Running journey index; write it in update mode with ``rollup_batch``."""
    return journey_index(stream)


def current_journeys(spark, path):
    """Newest stored state of every session."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in (BATCH, "session_id")]
    latest = rows.groupBy("session_id").agg(
        F.max_by(F.struct(*fields), BATCH).alias("state")
    )
    return latest.select("session_id", "state.*")
