"""Helpers that the operators of this folder share."""

from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness.session import let_go, ship_package
from chainwitness.session import stage as _stage

SLICE_BYTES = 4_000_000


def table(spark, sf_dir, name):
    """One of the given tables, with this package on the executors."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, and let go of its shuffle files."""
    staged = _stage(df, name)
    let_go(df.sparkSession)
    return staged


def text_key(text):
    """A name of 128 bits for a text; null has the empty name."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def identified(docs: DataFrame, id_col="doc_id", text_col="text", carry=False) -> DataFrame:
    """``_id``, ``_hash`` and ``_text``: rows with equal (_id, _hash) hold the same id and text.

    Only these columns go on, so further columns of the input may bear any name; with
    ``carry`` the whole row follows as one struct, ``_row``. Ids may repeat or be null: ``_hash``
    (``text_key``) still tells different texts apart.
    """
    columns = [F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_hash"), F.col(text_col).alias("_text")]
    if carry:
        columns.append(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return docs.select(*columns)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``_id`` and ``_hash`` are not in ``gone``, which is staged so that Spark knows its size."""
    gone = stage(gone.select(F.col("_id").alias("i"), F.col("_hash").alias("h")).distinct(), "gone")
    return docs.join(gone, docs["_id"].eqNullSafe(gone["i"]) & (docs["_hash"] == gone["h"]), "left_anti")


_held = {}


def sole(make):
    """Keep the last result of ``make``, and of all functions marked so only the one called last.

    Python workers live on from job to job; so a worker holds the model or the stores of one operator
    at a time, not of all that have run in it.
    """

    @wraps(make)
    def held(*args):
        if (make, args) not in _held:
            _held.clear()
            _held[make, args] = make(*args)
        return _held[make, args]

    return held


def small_slices(batches, column="_text", max_bytes=SLICE_BYTES):
    """Slices of Arrow batches of about ``max_bytes`` of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for row, size in enumerate(sizes):
            if total and total + size > max_bytes:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += int(size)
        yield batch.slice(start)


def arrow_rows(schema: pa.Schema, *columns):
    """A record batch of the given arrays under the schema's names and types."""
    arrays = [
        c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == f.type else pa.array(c, type=f.type)
        for c, f in zip(columns, schema)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
