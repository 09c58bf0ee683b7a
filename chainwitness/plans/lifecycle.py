"""Ledger and cache lifecycle: validity, drift, retention, incident holds, delivery."""

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import records as R
from chainwitness.operators.audit import texts
from chainwitness.operators.ordered import BLOCK, BLOCK_ROWS, block_of, last_known, row_blocks, running_count
from chainwitness.sources.evidence import held_sessions

HOUR_MS = 3_600_000
REQUIRED = (
    "id", "device_id", "session_id", "seq", "segment_hash", "prev_chain_hash", "chain_hash",
    "signature", "started_at", "ended_at", "frame_count", "byte_size", "mime_type",
)


# -- validity ------------------------------------------------------------------------


def _broken(cond):
    return ~F.coalesce(cond, F.lit(True))


def rules(columns, with_devices=False):
    """(condition of breaking it, name) for each table rule that the columns allow."""
    out = [(F.col(c).isNull(), f"{c} is missing") for c in REQUIRED if c in columns]
    out.append((_broken(F.col("seq") >= 0), "seq is negative"))
    for c in ("segment_hash", "prev_chain_hash", "chain_hash"):
        if c in columns:
            out.append((_broken(F.col(c).rlike(V.HEX64_PATTERN)), f"{c} is no SHA-256 hash"))
    out.append((_broken(F.col("ended_at") >= F.col("started_at")), "ended_at is before started_at"))
    out.append((_broken(F.col("byte_size") > 0), "byte_size is not positive"))
    if "frame_count" in columns:
        out.append((_broken(F.col("frame_count") >= 0), "frame_count is negative"))
    if with_devices:
        out.append((F.col("_known").isNull() & F.col("device_id").isNotNull(), "device is unknown"))
    return out


def _with_known(rows, devices):
    if devices is None:
        return rows
    known = devices.select(F.col("id").alias("device_id"), F.lit(True).alias("_known")).distinct()
    return rows.join(known, "device_id", "left")


def _any_broken(rows, devices):
    broken = F.lit(False)
    for cond, _ in rules(rows.columns, devices is not None):
        broken = broken | cond
    return broken


def valid_rows(rows, devices=None):
    """Records that break no rule, by one boolean filter."""
    return _with_known(rows, devices).where(~_any_broken(rows, devices)).drop("_known")


def quarantined_rows(rows, devices=None):
    """Records that break a rule, with the names of the broken rules in ``failed``."""
    names = texts(*[(c, F.lit(t)) for c, t in rules(rows.columns, devices is not None)])
    bad = _with_known(rows, devices).where(_any_broken(rows, devices))
    return bad.withColumn("failed", names).drop("_known")


def drift(before, after, key="id", columns=None):
    """Rows that differ between two snapshots of an append-only table.

    ``added`` rows are expected; ``changed`` and ``removed`` rows break immutability.
    """
    compared = columns or [c for c in before.columns if c != key]
    old = before.select(key, F.struct(*compared).alias("_old"))
    new = after.select(key, F.struct(*compared).alias("_new"))
    differs = [
        (~F.col("_old")[c].eqNullSafe(F.col("_new")[c]), F.lit(c)) for c in compared
    ]
    return (
        old.join(new, key, "full_outer")
        .withColumn(
            "change",
            F.when(F.col("_old").isNull(), "added")
            .when(F.col("_new").isNull(), "removed")
            .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed"),
        )
        .where(F.col("change").isNotNull())
        .select(
            key, "change",
            F.when(F.col("change") == "changed", texts(*differs))
            .otherwise(F.array().cast("array<string>")).alias("columns"),
        )
    )


# -- retention --------------------------------------------------------------------------


def purge(ledger, objects, now):
    """(survivors, removed): expired records go unless their session holds evidence."""
    expired = F.coalesce(F.col("expires_at") < now, F.lit(False))
    removed = ledger.where(expired).join(held_sessions(objects), "session_id", "left_anti")
    # one pass: the hold decides only for expired rows
    held = held_sessions(objects).withColumn("_held", F.lit(True))
    survivors = (
        ledger.join(held, "session_id", "left")
        .where(~expired | F.col("_held").isNotNull())
        .drop("_held")
    )
    return survivors, removed


def purge_count(removed):
    return removed.agg(F.count(F.lit(1)).alias("n_removed"))


def cache_retention(
    cached, now_ms, retention_ms=V.CACHE_RETENTION_MS, max_rows=V.CACHE_MAX_SEGMENTS,
    owner=("device_id",), order=("started_at", "key"), block_rows=BLOCK_ROWS,
):
    """Add ``fate``: expired, evicted or kept, for the clips of each device's cache.

    Expiry spares locked clips. If more than ``max_rows`` remain, locked ones counted,
    the oldest unlocked ones are evicted until the rest fits or none is left. No task ranks more than
    about ``block_rows`` clips, also if one device has them all or they start at one instant.
    """
    expired = ~F.col("locked") & (F.col("ended_at") < now_ms - F.lit(retention_ms))
    rows = row_blocks(cached.withColumn("_expired", expired), list(owner), list(order), block_rows)
    kept = rows.where(~F.col("_expired"))
    overflow = kept.groupBy(*owner).agg(
        (F.count(F.lit(1)) - max_rows).alias("_overflow")
    ).where(F.col("_overflow") > 0)
    ranked = running_count(
        rows, list(owner), list(order), "_rank", F.col(BLOCK), ~F.col("_expired") & ~F.col("locked"),
    )
    evicted = ~F.col("_expired") & ~F.col("locked") & (F.col("_rank") <= F.col("_overflow"))
    return (
        ranked.join(overflow, list(owner), "left")
        .withColumn(
            "fate",
            F.when(F.col("_expired"), "expired").when(evicted, "evicted").otherwise("kept"),
        )
        .drop("_expired", "_rank", "_overflow")
    )


def incident_holds(
    cached, incidents, before_ms=V.INCIDENT_BEFORE_MS, after_ms=V.INCIDENT_AFTER_MS, owner="device_id", key="key",
    block_rows=BLOCK_ROWS, should_lock=None,
):
    """Add ``held`` and ``newly_held`` to clips that overlap an incident of their device.

    A clip overlaps if an incident lies in [started_at - after, ended_at + before].
    For each clip only the first incident at or after the lower end is looked up, so
    no clip/incident pairs are formed and clips may be of any length. ``key`` tells clips apart that start at one
    instant; no task looks up more than about ``block_rows`` clips and incidents. ``should_lock``, a function of the
    columns of a clip's start and end that gives a condition, holds further clips; null is no.
    """
    low = F.col("started_at") - after_ms
    marks = incidents.select(
        owner, F.col("pressed_at").alias("_at"), F.lit(0).alias("_kind")
    ).distinct()
    clips = cached.withColumn("_at", low).withColumn("_kind", F.lit(1))
    both = clips.unionByName(marks, allowMissingColumns=True)
    later_first = F.negate("_at").alias("_later")
    both = row_blocks(both.withColumn("_later", later_first), [owner], ["_later", "_kind", *([key] if key in cached.columns else [])], block_rows)
    looked_up = last_known(
        both, [owner], ["_later", "_kind"], F.when(F.col("_kind") == 0, F.col("_at")), "_next", F.col(BLOCK),
    )
    held = F.coalesce(F.col("_next") <= F.col("ended_at") + before_ms, F.lit(False))
    if should_lock is not None:
        held = held | F.coalesce(should_lock(F.col("started_at"), F.col("ended_at")), F.lit(False))
    return (
        looked_up.where(F.col("_kind") == 1)
        .withColumn("newly_held", held & ~F.col("locked"))
        .withColumn("held", held | F.col("locked"))
        .drop("_at", "_kind", "_later", "_next")
    )


def hold_submitted(cached, submitted, key="key"):
    """Clips that were submitted as evidence become locked."""
    chosen = submitted.select(key).distinct().withColumn("_sent", F.lit(True))
    return (
        cached.join(chosen, key, "left")
        .withColumn("locked", F.col("locked") | F.col("_sent").isNotNull())
        .drop("_sent")
    )


def omit(files, owner, order="ord", chosen=None):
    """Leave out chosen positions (0-based ``pos``), else the two middle files of each owner.

    ``order`` is a whole-number column that ranks the files of an owner.
    """
    owner = list(owner)
    placed = running_count(files, owner, [order], "_n", block_of(F.col(order))).withColumn(
        "pos", F.col("_n") - 1
    )
    if chosen is not None:
        return placed.join(chosen.select(*owner, "pos"), [*owner, "pos"], "left_anti").drop("_n", "pos")
    sizes = files.groupBy(*owner).agg(F.count(F.lit(1)).alias("_size"))
    middle = F.floor(F.col("_size") / 2)
    return (
        placed.join(sizes, owner)
        .where((F.col("pos") != middle) & (F.col("pos") != middle + 1))
        .drop("_n", "pos", "_size")
    )


# -- delivery ----------------------------------------------------------------------------


def delivery_state(attempts):
    """Add the kind of each delivery attempt: sent, retry or refused."""
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    return attempts.withColumn(
        "kind",
        F.when(ok, "sent").when(R.is_transient_failure(F.col("status")), "retry").otherwise("refused"),
    )


def backoff_ladder(attempts, key="key", at="attempt_at"):
    """Add the failures in a row up to each attempt and the wait that follows it."""
    failed = F.col("kind") == "retry"
    block = block_of(F.col(at), HOUR_MS)
    counted = running_count(delivery_state(attempts), [key], [at], "_n", block, failed)
    runs = last_known(
        counted, [key], [at], F.when(F.col("kind") == "sent", F.col("_n")), "_at_success", block, True
    )
    in_a_row = F.when(failed, F.col("_n") - F.coalesce("_at_success", F.lit(0))).otherwise(0)
    return (
        runs.withColumn("failures_in_row", in_a_row.cast("bigint"))
        .withColumn("wait_ms", R.backoff_ms(F.col("failures_in_row")))
        .drop("_n", "_at_success")
    )


def outbox_state(outbox, acknowledged, attempts):
    """What remains of the outbox: acknowledged rows leave, refused rows are set aside."""
    tries = delivery_state(attempts).groupBy("key").agg(
        F.count_if(F.col("kind") != "sent").alias("attempts"),
        F.bool_or(F.col("kind") == "refused").alias("rejected"),
        F.bool_or(F.col("kind") == "sent").alias("_sent"),
    )
    return (
        outbox.join(acknowledged.select("key").distinct(), "key", "left_anti")
        .join(tries, "key", "left")
        .where(~F.coalesce("_sent", F.lit(False)))
        .withColumn("attempts", F.coalesce("attempts", F.lit(0)).cast("bigint"))
        .withColumn("rejected", F.coalesce("rejected", F.lit(False)))
        .drop("_sent")
    )


def outbox_counts(state):
    return state.agg(
        F.count_if(~F.col("rejected")).alias("n_pending"),
        F.count_if("rejected").alias("n_rejected"),
        F.coalesce(F.sum("attempts"), F.lit(0)).cast("bigint").alias("n_attempts"),
    )


def mark_sent(cached, acknowledged, key="key"):
    known = acknowledged.select(key).distinct().withColumn("_ack", F.lit(True))
    return (
        cached.join(known, key, "left")
        .withColumn("sent", F.col("sent") | F.col("_ack").isNotNull())
        .drop("_ack")
    )
