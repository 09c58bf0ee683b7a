"""Evidence objects: listings, contents and the choice of where a session's files come from."""

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import records as R

EVIDENCE_BUCKET = "evidence"


def folder_listing(objects, bucket=EVIDENCE_BUCKET):
    """Files inside folders, one row each, folders descending and files ascending.

    Files at the root are no evidence of a session and are left out. Each folder
    stays as many rows as it has files, so no folder is gathered into one row.
    """
    parts = F.split("name", "/")
    return (
        objects.where((F.col("bucket_id") == bucket) & (F.size(parts) == 2))
        .select(
            parts[0].alias("folder"),
            parts[1].alias("file_name"),
            F.col("name").alias("path"),
            F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
            "created_at",
        )
        .orderBy(F.desc("folder"), F.asc("file_name"))
    )


def held_sessions(objects, bucket=EVIDENCE_BUCKET):
    """Sessions that have evidence objects, as the first part of the object name."""
    return (
        objects.where((F.col("bucket_id") == bucket) & F.contains("name", F.lit("/")))
        .select(F.split_part("name", F.lit("/"), F.lit(1)).alias("session_id"))
        .distinct()
    )


def read_contents(spark, path):
    """Evidence files under a folder with their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "path",
        F.col("length").alias("size"),
        "content",
    )


def admit(files, mime=None):
    """Video files by media type or name ending, in name order."""
    return files.where(R.is_video_file(F.col("name"), mime)).orderBy("name")


def hashed(files, prefix=V.DEFAULT_FILE_PREFIX):
    """Files with content hash, size and name hint; the bytes go no further.

    Hashing is a map over the scan, so contents are never shuffled.
    """
    return files.select(
        *[c for c in files.columns if c not in ("content", "size")],
        F.sha2("content", 256).alias("actual_hash"),
        F.octet_length("content").cast("bigint").alias("size"),
        R.hinted_session(F.col("name"), prefix).alias("hint_session"),
        R.hinted_seq(F.col("name"), prefix).alias("hint_seq"),
    )


def grouped_selection(files, prefix=V.DEFAULT_FILE_PREFIX):
    """Selected files per session named in them, or ``unidentified``."""
    session = F.coalesce(R.hinted_session(F.col("name"), prefix), F.lit("unidentified"))
    return files.groupBy(session.alias("session_id")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes")
    )


def session_files(records, cached, objects, prefix=V.DEFAULT_FILE_PREFIX, bucket=EVIDENCE_BUCKET):
    """Files of each session from its best source, decided per session.

    The local cache comes first, then the evidence bucket, then placeholders that
    stand for the session's records. Placeholder rows carry a note and no bytes.
    """
    sessions = records.select("session_id").distinct()
    local = (
        records.select("session_id", R.segment_key(F.col("session_id"), F.col("seq")).alias("key"))
        .join(cached.select("key", "file_name", "size"), "key")
        .select("session_id", F.lit(1).alias("rank"), "file_name", "size",
                F.lit("local").alias("origin"), F.lit(None).cast("string").alias("note"))
    )
    cloud = (
        folder_listing(objects, bucket)
        .withColumnRenamed("folder", "session_id")
        .join(sessions, "session_id", "left_semi")
        .select("session_id", F.lit(2).alias("rank"), "file_name", "size",
                F.lit("cloud").alias("origin"), F.lit(None).cast("string").alias("note"))
    )
    stand_in = records.select(
        "session_id", F.lit(3).alias("rank"),
        R.segment_file_name(F.col("session_id"), F.col("seq"), F.col("mime_type"), prefix).alias("file_name"),
        F.lit(None).cast("bigint").alias("size"),
        F.lit("local").alias("origin"), F.lit(V.PLACEHOLDER_NOTE).alias("note"),
    )
    found = local.unionByName(cloud)
    best = found.groupBy("session_id").agg(F.min("rank").alias("best"))
    choice = found.unionByName(stand_in).join(best, "session_id", "left")
    return choice.where(F.col("rank") == F.coalesce("best", F.lit(3))).drop("rank", "best")
