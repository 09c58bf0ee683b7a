"""Ledger lookups, feeds, and idempotent sinks for ledgers, devices and objects."""

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.operators.ordered import first_per_key


def find_by_hashes(ledger, hashes, col="segment_hash"):
    """Ledger rows whose content hash occurs in ``hashes`` (any number of them)."""
    return ledger.join(hashes.select(F.col(col).alias("segment_hash")).distinct(), "segment_hash", "left_semi")


def find_sessions(ledger, sessions):
    """Ledger rows of the given sessions; pass a one-column DataFrame of ids."""
    return ledger.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def session_rows(ledger, session_id):
    """All rows of one session in sequence order."""
    return ledger.where(F.col("session_id") == session_id).orderBy("seq")


def with_devices(ledger, devices):
    """Rows with the label and public key of their device; null where unknown."""
    known = devices.select(
        F.col("id").alias("device_id"), F.col("label").alias("device_label"), "public_key"
    )
    return ledger.join(known, "device_id", "left")


def one_record_per_hash(records, *carry):
    """One record per content hash: the latest, then by session and seq."""
    rank = F.struct("created_at", "session_id", "seq")
    return records.groupBy("segment_hash").agg(
        F.max_by(F.struct("session_id", "seq", *carry), rank).alias("record")
    )


def newest(ledger, n=V.FEED_NEWEST):
    """The n newest rows, newest first."""
    return ledger.orderBy(F.desc("created_at"), F.desc("seq"), F.desc("id")).limit(n)


def distinct_arrivals(rows):
    return rows.dropDuplicates(["id"])


def not_yet_stored(rows, stored, key, order):
    """First row per key among ``rows`` whose key is not stored yet.

    Rows are reduced to one per key first; the anti join then reuses their partitioning.
    """
    return first_per_key(rows, list(key), order).join(stored.select(*key), list(key), "left_anti")


def stamp(rows, now, retention_days=V.LEDGER_RETENTION_DAYS):
    """Server time on arrival; a client cannot choose it. ``now`` is a timestamp column."""
    return rows.withColumn("created_at", now).withColumn(
        "expires_at", F.col("created_at") + F.expr(f"INTERVAL {retention_days} DAYS")
    )


def append_records(rows, ledger, now):
    """The rows an idempotent append adds: new (session, seq) pairs, stamped."""
    return stamp(not_yet_stored(rows, ledger, ["session_id", "seq"], ["id"]), now)


def append_devices(rows, devices):
    return not_yet_stored(rows, devices, ["id"], ["created_at"])


def append_objects(rows, objects):
    """New evidence objects; one that exists is a success and stays as it is."""
    return not_yet_stored(rows, objects, ["bucket_id", "name"], ["created_at"])


def write_batch(rows, path, batch_id):
    """Write one batch into its own folder; a repeated batch overwrites itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_hash_list(records, path):
    """Selected content hashes, one per line, in session and sequence order."""
    hash_list(records).write.mode("errorifexists").text(path)


def hash_list(records):
    return records.orderBy("session_id", "seq").select("segment_hash")
