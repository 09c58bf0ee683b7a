"""Explicit schemas of the stored tables and streamed inputs."""

from pyspark.sql import types as T

PUBLIC_KEY = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("kty", "crv", "x", "y")]
)

DEVICES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("public_key", PUBLIC_KEY),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# fields covered by the chain hash, in canonical order
CANONICAL_FIELDS = (
    "device_id",
    "session_id",
    "seq",
    "started_at",
    "ended_at",
    "frame_count",
    "byte_size",
    "mime_type",
    "width",
    "height",
    "latitude",
    "longitude",
    "segment_hash",
    "prev_chain_hash",
)

LEDGER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("started_at", T.LongType()),
        T.StructField("ended_at", T.LongType()),
        T.StructField("frame_count", T.IntegerType()),
        T.StructField("byte_size", T.LongType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("segment_hash", T.StringType()),
        T.StructField("prev_chain_hash", T.StringType()),
        T.StructField("chain_hash", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)

EVIDENCE_FILES = T.StructType(
    [
        T.StructField("submission_id", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("origin", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)
