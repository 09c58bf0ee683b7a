"""Evidence objects with their bytes: contents under the hash of what they hold, and names that point to them.

A file of its own for each object would be millions of small files, so contents are rows of a bucketed
table. A name that exists is a success and stays as it is; equal contents are stored once.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwitness.operators.ordered import first_per_key
from chainwitness.session import release, stage
from chainwitness.sources.store import BUCKET, BUCKETS, KeyedStore

CONTENTS = T.StructType([
    T.StructField("address", T.StringType()), T.StructField("size", T.LongType()), T.StructField("content", T.BinaryType()),
])
NAMES = T.StructType([
    T.StructField("bucket_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("address", T.StringType()),
    T.StructField("size", T.LongType()), T.StructField("created_at", T.TimestampType()),
])
_NAME = ["bucket_id", "name"]


class ObjectStore:
    """Objects under ``path``: ``contents`` by address (SHA-256), ``names`` by (bucket_id, name)."""

    def __init__(self, spark, path, buckets=BUCKETS):
        self.contents = KeyedStore(spark, f"{path}/contents", CONTENTS, ("address",), buckets)
        self.names = KeyedStore(spark, f"{path}/names", NAMES, _NAME, buckets)

    def put(self, files, batch, now=None, order=("_arrival",)):
        """Store files (bucket_id, name, content) whose name is new; returns the index rows added.

        ``batch`` names the upload: a replay adds nothing, and completes one that was lost half-way. Contents are committed before
        the names that point to them, so a name never lacks its bytes. Of several files with one name in a
        batch the first by ``order`` (columns of ``files``) stays; across batches the earlier one. Rows without bucket,
        name or content are left out; empty contents are contents. Only bytes of new names with unknown contents are shuffled.
        """
        extra = [c for c in order if c != "_arrival"]
        rows = files.where(F.col("bucket_id").isNotNull() & F.col("name").isNotNull() & F.col("content").isNotNull())
        addressed = rows.select(*_NAME, F.sha2("content", 256).alias("address"), F.octet_length("content").cast("bigint").alias("size"), "content", *extra)
        index = addressed.drop("content")
        if "_arrival" in order:
            index = index.withColumn("_arrival", F.monotonically_increasing_id())
        index = stage(index, "object-names")  # stored, so that both steps see the same order of arrival
        new = first_per_key(index, _NAME, list(order)).join(self.names.read().select(*_NAME), _NAME, "left_anti")
        wanted = new.select("address").distinct().join(self.contents.read().select("address"), "address", "left_anti")
        self.contents.append(addressed.join(wanted, "address", "left_semi").select(*CONTENTS.names), batch)
        clock = F.current_timestamp() if now is None else now
        ranked = index.withColumnRenamed("_arrival", "_first")  # in place of the store's own number
        order = ["_first" if c == "_arrival" else c for c in order]
        added = self.names.append(ranked, batch, order, finish=lambda rows: rows.withColumn("created_at", clock))
        release(index)
        return added.drop(BUCKET)

    def listing(self):
        """Index rows of all objects, as ``evidence.folder_listing`` and the others take them."""
        return self.names.read().drop(BUCKET)

    def get(self, wanted=None):
        """Objects with their bytes: all, or those whose (bucket_id, name) is in ``wanted``."""
        names = self.listing()
        if wanted is not None:
            names = names.join(wanted.select(*_NAME).distinct(), _NAME, "left_semi")
        return names.join(self.contents.read().select("address", "content"), "address")

    def compact(self):
        self.contents.compact()
        self.names.compact()
