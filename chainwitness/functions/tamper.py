"""Alterations of file bytes and records that a verification must detect."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _size(content):
    return F.octet_length(content)


def flip_one_bit(content):
    """Lowest bit of the middle byte; empty content stays as it is."""
    at = F.floor(_size(content) / 2).cast("int")
    byte = F.conv(F.hex(F.substring(content, at + 1, F.lit(1))), 16, 10).cast("int")
    flipped = F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.lit(1)).cast("bigint")), 2, "0"))
    return F.when(
        _size(content) > 0,
        F.concat(F.substring(content, F.lit(1), at), flipped, F.substring(content, at + 2, _size(content))),
    ).otherwise(content)


def zero_block(content, share=0.6, block=4096):
    start = F.floor(_size(content) * F.lit(share)).cast("int")
    length = F.least(F.lit(block), _size(content) - start)
    return F.concat(
        F.substring(content, F.lit(1), start),
        F.unhex(F.repeat(F.lit("00"), length)),
        F.substring(content, start + length + 1, _size(content)),
    )


def truncate(content, share=0.8):
    return F.substring(content, F.lit(1), F.floor(_size(content) * F.lit(share)).cast("int"))


@F.pandas_udf(T.BinaryType())
def _xor_range(
    content: pd.Series, start: pd.Series, length: pd.Series, mask: pd.Series
) -> pd.Series:
    def one(data, at, n, m):
        if data is None:
            return None
        changed = np.frombuffer(data, np.uint8).copy()
        changed[at : at + n] ^= np.uint8(m)
        return changed.tobytes()

    return pd.Series([one(*v) for v in zip(content, start, length, mask)], dtype=object)


def shift_block(content, share=0.3, block=8192):
    """Add 128 to a block of bytes, modulo 256."""
    start = F.floor(_size(content) * F.lit(share)).cast("int")
    return _xor_range(content, start, F.least(F.lit(block), _size(content) - start), F.lit(128))


def invert_block(content, share=0.2, length_share=0.1):
    """Invert a tenth of the bytes."""
    start = F.floor(_size(content) * F.lit(share)).cast("int")
    return _xor_range(content, start, F.floor(_size(content) * F.lit(length_share)).cast("int"), F.lit(255))


def swap_names(files, pair):
    """Exchange names inside each pair of files; ``pair`` names the columns of a pair id.

    A pair has two rows, so a window over it is bounded.
    """
    w = Window.partitionBy(*pair).orderBy("ord")
    other = F.coalesce(F.lead("name").over(w), F.lag("name").over(w), F.col("name"))
    return files.withColumn("name", other)


def shift_times(seq, by_ms=60_000):
    """A ledger change: stored times of one sequence number moved back."""

    def change(rows):
        moved = F.when(F.col("seq") == seq, F.lit(by_ms)).otherwise(F.lit(0))
        return rows.withColumn("started_at", F.col("started_at") - moved).withColumn(
            "ended_at", F.col("ended_at") - moved
        )

    return change
