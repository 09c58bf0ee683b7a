"""Gaps, runs and their text form over the sequence numbers of sessions."""

from pyspark.sql import functions as F

from chainwitness.operators.ordered import BLOCK_ROWS, block_of, last_known, running_count

EXPAND_CHUNK = 10_000
PART_RANGES = 1_000


def gaps(df, keys, seq="seq", block_rows=BLOCK_ROWS):
    """One row per gap: (keys, from_seq, to_seq, n_missing) between neighbours.

    Gaps stay ranges: a single far-off sequence number may leave billions missing.
    """
    distinct = df.select(*keys, seq).distinct()
    placed = last_known(
        distinct, keys, [seq], F.col(seq), "_prev", block_of(F.col(seq), block_rows)
    )
    return placed.where(F.col(seq) > F.col("_prev") + 1).select(
        *keys,
        (F.col("_prev") + 1).cast("bigint").alias("from_seq"),
        (F.col(seq) - 1).cast("bigint").alias("to_seq"),
        (F.col(seq) - F.col("_prev") - 1).cast("bigint").alias("n_missing"),
    )


def expand(ranges, keys, out="seq", chunk=EXPAND_CHUNK):
    """One row per number of each range, generated in chunks of bounded size."""
    starts = ranges.select(
        *keys,
        "to_seq",
        F.explode(F.sequence("from_seq", "to_seq", F.lit(chunk).cast("bigint"))).alias("_start"),
    )
    last = F.least(F.col("_start") + (chunk - 1), F.col("to_seq"))
    return starts.select(*keys, F.explode(F.sequence(F.col("_start"), last)).alias(out))


def runs(df, keys, seq="seq", block_rows=BLOCK_ROWS):
    """Maximal runs of consecutive numbers: (keys, from_seq, to_seq)."""
    distinct = df.select(*keys, seq).distinct()
    numbered = running_count(
        distinct, keys, [seq], "_n", block_of(F.col(seq), block_rows)
    )
    return (
        numbered.groupBy(*keys, (F.col(seq) - F.col("_n")).alias("_island"))
        .agg(
            F.min(seq).cast("bigint").alias("from_seq"),
            F.max(seq).cast("bigint").alias("to_seq"),
        )
        .drop("_island")
    )


def _as_text(first, last):
    return F.when(first == last, F.concat(F.lit("#"), first.cast("string"))).otherwise(
        F.concat(F.lit("#"), first.cast("string"), F.lit("–#"), last.cast("string"))
    )


def range_parts(ranges, keys, out, size=PART_RANGES, block_rows=BLOCK_ROWS):
    """The ranges of each key as texts like ``#1–#3, #5``: rows (keys, part, out).

    A part lists ``size`` consecutive ranges, the last one of a key what is left. Together
    the parts hold all ranges, and no row gathers more than ``size`` of them.
    """
    keys = list(keys)
    numbered = running_count(ranges, keys, ["from_seq"], "_n", block_of(F.col("from_seq"), block_rows))
    part = F.floor((F.col("_n") - 1) / size).cast("bigint")
    return numbered.groupBy(*keys, part.alias("part")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("from_seq", "to_seq"))),
                lambda r: _as_text(r["from_seq"], r["to_seq"]),
            ),
            ", ",
        ).alias(out)
    )
