"""Rollups of the arrival feed and of the clip library."""

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import records as R
from chainwitness.sources.ledger import newest


def journey_index(rows):
    """One row per session: counts, time span, failures and longest anchor delay."""
    delay = R.anchor_delay_ms()
    return rows.groupBy("session_id").agg(
        F.min_by("device_id", F.struct("started_at", "id")).alias("device_id"),
        F.count(F.lit(1)).alias("n_records"),
        F.min("started_at").alias("first_at"),
        F.max("ended_at").alias("last_at"),
        F.count_if(F.col("check") == "bad").alias("n_bad"),
        F.greatest(F.max(delay), F.lit(0)).cast("bigint").alias("max_delay_ms"),
    )


def latest_journeys(rows):
    return journey_index(rows).orderBy(F.desc("last_at"), "session_id")


def monitor_counters(rows):
    late = R.is_late_anchor(R.anchor_delay_ms())
    return rows.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("check") == "ok").alias("n_ok"),
        F.count_if(F.col("check") == "bad").alias("n_bad"),
        F.count_if(late).alias("n_delayed"),
    )


def arrival_rollup(rows, width="5 minutes"):
    """Arrivals and delays per time window of arrival."""
    delay = R.anchor_delay_ms()
    return rows.groupBy(F.window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(R.is_late_anchor(delay)).alias("n_delayed"),
        F.max(delay).alias("max_delay_ms"),
    ).select(
        F.unix_millis("w.start").alias("window_ms"), "n_records", "n_delayed", "max_delay_ms"
    )


def video_library(clips):
    """Clips per session with span and bytes."""
    return clips.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.sum("byte_size").alias("n_bytes"),
    )


def session_picker(rows, n=V.PICKER_NEWEST):
    """Sessions among the n newest records with their segments in order.

    At most n records take part, which bounds the lists.
    """
    return newest(rows, n).groupBy("session_id").agg(
        F.max_by("device_id", F.struct("created_at", "seq", "id")).alias("device_id"),
        F.count(F.lit(1)).alias("n_segments"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda s: s["seq"]).alias("seqs"),
    )


def size_change(originals, altered, key="session_id"):
    """Files and bytes before and after a change, per key, with the loss in percent."""
    total = lambda df, tag: df.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"n_{tag}"), F.sum("size").alias(f"bytes_{tag}")
    )
    both = total(originals, "before").join(total(altered, "after"), key, "left")
    after = F.coalesce("bytes_after", F.lit(0)).cast("bigint")
    share = F.when(F.col("bytes_before") > 0, after / F.col("bytes_before"))
    return both.select(
        key, "n_before", F.coalesce("n_after", F.lit(0)).cast("bigint").alias("n_after"),
        "bytes_before", after.alias("bytes_after"),
        (F.col("n_before") - F.coalesce("n_after", F.lit(0))).alias("n_removed"),
        F.floor((1 - share) * 100 + F.lit(0.5)).cast("bigint").alias("percent_smaller"),
    )
