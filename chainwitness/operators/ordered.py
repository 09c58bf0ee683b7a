"""Ordered look-back inside a group without putting the whole group in one task.

A window over ``partitionBy(key)`` sends all rows of a key to one task, and one
hot session may hold a large share of a ledger. The operators here cut each group
into blocks, contiguous ranges of the order column. Rows are windowed per
(key, block); one summary row per block is windowed per key; the summary is joined
back on (key, block). Results equal those of the plain window. A key with n rows
costs one task n / rows-per-block summary rows, not n rows.

Where values of the order say little about how many rows lie between them, ``row_blocks``
makes blocks of about equal numbers of rows, whatever the values are.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainwitness.session import stage

BLOCK_ROWS = 100_000
BLOCK = "_block"
BEFORE = Window.unboundedPreceding


def block_of(order: Column, size=BLOCK_ROWS):
    """Block number of a whole-number order column; grows with the order."""
    return F.floor(order.cast("bigint") / F.lit(size)).cast("bigint")


def row_blocks(df: DataFrame, keys, order, rows=BLOCK_ROWS):
    """Add the block column: ranges of (keys, order) that hold about ``rows`` rows each.

    Spark finds the ranges from a sample, so a key with a third of all rows, or all rows within one instant, is
    cut like any other; only rows equal in all ``order`` columns stay together, which therefore should end with a unique
    one. The rows are written once, since another look at the sample might draw other lines.
    """
    n = max(1, -(-df.count() // rows))
    return stage(df.repartitionByRange(n, *keys, *order).withColumn(BLOCK, F.spark_partition_id()), "blocks")


def last_known(df: DataFrame, keys, order, value: Column, out, block: Column, inclusive=False):
    """Add ``out``: the last non-null ``value`` before each row (or up to it)."""
    end = 0 if inclusive else -1
    rows = df.withColumn(BLOCK, block).withColumn("_value", value)
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(BEFORE, end)
    across = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(BEFORE, -1)
    position = F.struct(*order)
    tails = rows.groupBy(*keys, BLOCK).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), position)).alias("_tail")
    )
    carried = (
        tails.withColumn("_carried", F.last("_tail", ignorenulls=True).over(across))
        .where(F.col("_carried").isNotNull())
        .select(*keys, BLOCK, "_carried")
    )
    return (
        rows.withColumn("_near", F.last("_value", ignorenulls=True).over(within))
        .join(carried, [*keys, BLOCK], "left")
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop(BLOCK, "_value", "_near", "_carried")
    )


def running_count(df: DataFrame, keys, order, out, block: Column, flag: Column = None):
    """Add ``out``: how many rows (where ``flag`` holds) up to and including each row.

    Without a flag this is ``row_number()``.
    """
    one = F.lit(1) if flag is None else F.when(flag, 1).otherwise(0)
    rows = df.withColumn(BLOCK, block).withColumn("_one", one.cast("bigint"))
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(BEFORE, 0)
    across = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(BEFORE, -1)
    carried = (
        rows.groupBy(*keys, BLOCK)
        .agg(F.sum("_one").alias("_n"))
        .withColumn("_carried", F.sum("_n").over(across))
        .where(F.col("_carried") > 0)
        .select(*keys, BLOCK, "_carried")
    )
    return (
        rows.withColumn("_near", F.sum("_one").over(within))
        .join(carried, [*keys, BLOCK], "left")
        .withColumn(out, F.col("_near") + F.coalesce("_carried", F.lit(0)))
        .drop(BLOCK, "_one", "_near", "_carried")
    )


def mark_first(df: DataFrame, keys, order, out):
    """Add the boolean ``out``: is the row the first of its key group.

    The first position is found by an aggregate, which combines before the
    shuffle, so copies of one key never meet in one task.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return (
        df.join(first, list(keys), "left")
        .withColumn(out, F.struct(*order) == F.col("_first"))
        .drop("_first")
    )


def first_per_key(df: DataFrame, keys, order):
    """The first row of each key group, by one aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return firsts.select(*keys, "_row.*").select(*df.columns)
