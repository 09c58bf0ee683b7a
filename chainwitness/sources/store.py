"""A ledger table that an append reads only in part: key buckets, versions and commit records.

Rows lie in ``rows/version=N/bucket=B``. A bucket is a hash of the session and of a stretch of its sequence
numbers, so a batch of a few sessions touches a few buckets, and a session that owns a third
of all rows still lies in many. A version counts once its record ``commits/N.json`` exists, which gets its
name when it is complete: a writer that is lost leaves rows nobody reads, and of two writers of one
version one is refused and may try again. A compaction is a version that replaces those before it.
"""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
BLOCK = 4096
BUCKET = "bucket"


class Conflict(Exception):
    """Another writer has committed the same version."""


class LedgerStore:
    """Rows with unique (session_id, seq) under ``path``; ``buckets`` and ``block`` belong to the table's layout."""

    KEYS = ("session_id", "seq")

    def __init__(self, spark, path, schema, buckets=BUCKETS, block=BLOCK):
        self.spark, self.path, self.schema, self.buckets, self.block = spark, path, schema, buckets, block
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- commit records -----------------------------------------------------------------

    def _path(self, *parts):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _commits(self):
        """All commit records by version; versions that a compaction has replaced may be among them."""
        folder, found = self._path("commits"), {}
        if self._fs.exists(folder):
            for status in self._fs.listStatus(folder):
                name = status.getPath().getName()
                if name.endswith(".json"):
                    stream = self._fs.open(status.getPath())
                    try:
                        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                    finally:
                        stream.close()
                    if text:
                        found[int(name[:-5])] = json.loads(text)
        return found

    def live_versions(self, commits=None):
        """Versions that make up the table now."""
        commits = self._commits() if commits is None else commits
        gone = {v for record in commits.values() for v in record["replaces"]}
        return sorted(set(commits) - gone)

    def _commit(self, version, record):
        path, own = self._path("commits", f"{version}.json"), self._path("commits", f".{version}-{id(record)}")
        stream = self._fs.create(own, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        if self._fs.exists(path) or not self._fs.rename(own, path):
            self._fs.delete(own, False)
            raise Conflict(f"version {version} is there already")

    # -- reading ------------------------------------------------------------------------

    def bucket_of(self):
        stretch = F.floor(F.col("seq") / F.lit(self.block))
        return F.pmod(F.xxhash64("session_id", stretch), F.lit(self.buckets)).cast("int")

    def _read(self, versions):
        full = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        folders = [str(self._path("rows", f"version={v}")) for v in versions]
        if not folders:
            return self.spark.createDataFrame([], full)
        base = str(self._path("rows"))
        return self.spark.read.schema(full).option("basePath", base).parquet(*folders).select(*full.names)

    def read(self, buckets=None):
        """The table, or its rows in some ``buckets``, with the bucket as a further column."""
        rows = self._read(self.live_versions())
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(*buckets) if buckets else F.lit(False))

    # -- writing ------------------------------------------------------------------------

    def _write(self, rows, version, record):
        dealt = rows.repartition(F.col(BUCKET)).sortWithinPartitions(BUCKET, *self.KEYS)
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(str(self._path("rows", f"version={version}")))
        self._commit(version, record)

    def append(self, rows, batch, order=("_arrival",), finish=None):
        """Add the rows whose key (session_id, seq) is not stored yet; returns the rows added.

        ``batch`` names the batch: one that is committed is not added again, which makes a replay after a failure
        harmless. Of several rows with one key in a batch the first by ``order`` stays, by default the first
        that Spark reads; across batches the earlier one. Only buckets of the batch are read. ``finish`` is applied
        to the new rows, for stamps of the server. The batch is read twice, first for its buckets; whole rows are
        shuffled twice, to their keys and the new ones to their buckets.
        """
        commits = self._commits()
        done = [v for v, record in commits.items() if record["batch"] == str(batch)]
        if done:
            return self._read([v for v in done if v in self.live_versions(commits)])
        if "_arrival" in order:
            rows = rows.withColumn("_arrival", F.monotonically_increasing_id())
        rows = rows.withColumn(BUCKET, self.bucket_of())
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
        new = self._first_arrivals(rows, list(order), touched, self.live_versions(commits))
        new = finish(new) if finish else new
        version = max(commits, default=-1) + 1
        self._write(new.select(*self.schema.names, BUCKET), version, {"batch": str(batch), "replaces": []})
        return self._read([version])

    def _first_arrivals(self, rows, order, touched, versions):
        """The first row of each key that is not stored; stored keys meet the rows in the aggregate that finds the first."""
        keys = [BUCKET, *self.KEYS]
        rest = [c for c in rows.columns if c not in keys]
        seen = F.col(BUCKET).isin(*touched) if touched else F.lit(False)
        moved = F.raise_error(F.lit("the batch gave other rows when it was read again")).cast("boolean")
        arrived = rows.select(*keys, F.struct(*rest).alias("_row"), F.struct(*order).alias("_order"), F.when(seen, False).otherwise(moved).alias("_stored"))
        if touched and versions:
            stored = self._read(versions).where(seen).dropna(subset=list(self.KEYS)).select(*keys, F.lit(True).alias("_stored"))
            arrived = arrived.unionByName(stored, allowMissingColumns=True)
        firsts = arrived.groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row"), F.bool_or("_stored").alias("_stored"))
        return firsts.where("not _stored").select(*keys, "_row.*").select(*rows.columns)

    def compact(self):
        """Write all live versions as one; the batches they stand for stay known. Readers see the old or the new one."""
        commits = self._commits()
        live = self.live_versions(commits)
        if len(live) > 1:
            self._write(self._read(live), max(commits) + 1, {"batch": "compaction", "replaces": live})

    def vacuum(self):
        """Delete the rows of versions that were replaced; run it when no reader is left on them."""
        commits = self._commits()
        for version in set(commits) - set(self.live_versions(commits)):
            self._fs.delete(self._path("rows", f"version={version}"), True)


class KeyedStore(LedgerStore):
    """The same table for rows with other unique ``keys``, dealt out by their hash."""

    def __init__(self, spark, path, schema, keys, buckets=BUCKETS):
        super().__init__(spark, path, schema, buckets)
        self.KEYS = tuple(keys)

    def bucket_of(self):
        return F.pmod(F.xxhash64(*self.KEYS), F.lit(self.buckets)).cast("int")
