"""Building hash chains: each chain hash covers the hash before it."""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwitness import fixed_values as V
from chainwitness.functions import records as R

_CUT = "\x00"


def build_chains(core: DataFrame, protocol=V.DEFAULT_PROTOCOL) -> DataFrame:
    """Add ``prev_chain_hash`` and ``chain_hash`` to records that lack them.

    A SHA-256 chain is serial by definition: record i needs the hash of record
    i - 1. Sessions are spread over tasks and sorted there; each task then streams
    its rows in Arrow batches and carries one hash, so no session is ever held in
    memory, however long it is.
    """
    slotted = core.withColumn("prev_chain_hash", F.lit(_CUT))
    sorted_rows = (
        slotted.withColumn("_record", R.canonical_record(protocol))
        .drop("prev_chain_hash")
        .withColumn("_genesis", R.genesis_hash(F.col("session_id")))
        .repartition("session_id")
        .sortWithinPartitions("session_id", "seq")
    )
    schema = T.StructType(
        [f for f in sorted_rows.schema.fields if f.name not in ("_record", "_genesis")]
        + [
            T.StructField("prev_chain_hash", T.StringType()),
            T.StructField("chain_hash", T.StringType()),
        ]
    )

    def fold(batches):
        session, last = None, None
        for batch in batches:
            before, after = [], []
            for sid, genesis, text in zip(
                batch.column("session_id").to_pylist(),
                batch.column("_genesis").to_pylist(),
                batch.column("_record").to_pylist(),
            ):
                if sid != session:
                    session, last = sid, genesis
                before.append(last)
                last = hashlib.sha256((text[: -len(_CUT)] + last).encode()).hexdigest()
                after.append(last)
            kept = batch.drop_columns(["_record", "_genesis"])
            columns = kept.columns + [pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(
                columns, names=kept.schema.names + ["prev_chain_hash", "chain_hash"]
            )

    return sorted_rows.mapInArrow(fold, schema)
