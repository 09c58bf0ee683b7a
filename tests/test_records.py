import hashlib

from pyspark.sql import functions as F

from chainwitness.functions import records as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_canonical_record_keeps_empty_fields(spark):
    row = spark.sql(
        """select 'dev' device_id, 'ses' session_id, 3 seq, 10L started_at, 20L ended_at, 5 frame_count,
        7L byte_size, 'video/webm' mime_type, cast(null as int) width, 720 height,
        cast(null as double) latitude, 1.5D longitude, 'aa' segment_hash, 'bb' prev_chain_hash"""
    )
    text = row.select(R.canonical_record("tag")).first()[0]
    assert text == "tag|dev|ses|3|10|20|5|7|video/webm||720||1.500000|aa|bb"
    digest = row.select(R.chain_hash("tag")).first()[0]
    assert digest == hashlib.sha256(text.encode()).hexdigest()


def test_exact_coordinates_round_the_binary_value(spark):
    row = one(spark, below=R.coordinate_text(F.lit(49.3837425)), tie=R.coordinate_text(F.lit(0.0078125)))
    assert row == {"below": "49.383742", "tie": "0.007813"}


def test_names_and_hints(spark):
    session = "0a1b2c3d-0000-1111-2222-333344445555"
    row = one(
        spark,
        name=R.segment_file_name(F.lit(session), F.lit(7), F.lit("video/mp4")),
        long=R.segment_file_name(F.lit(session), F.lit(1234567), F.lit("video/webm")),
        key=R.segment_key(F.lit(session), F.lit(7)),
        inside=R.hinted_seq(F.lit(f"copy of CLIP_{session.upper()}_00012.webm")),
        session=R.hinted_session(F.lit(f"copy of CLIP_{session.upper()}_00012.webm")),
        none=R.hinted_session(F.lit("holiday.webm")),
        huge=R.hinted_seq(F.lit(f"clip_{session}_99999999999999999999999.webm")),
        mime=R.base_mime(F.lit("video/webm;codecs=vp8")),
    )
    assert row["name"] == f"clip_{session}_00007.mp4"
    assert row["long"] == f"clip_{session}_1234567.webm"
    assert row["key"] == f"{session}:000007"
    assert (row["session"], row["inside"]) == (session, 12)
    assert row["none"] is None and row["huge"] is None and row["mime"] == "video/webm"


def test_durations_and_rounding(spark):
    cases = {499: "0 s", 500: "1 s", 59499: "59 s", 60800: "1 min 1 s", 90000: "1 min 30 s", 3720000: "1 h 2 min"}
    for ms, text in cases.items():
        assert one(spark, t=R.duration_text(F.lit(ms)))["t"] == text
    # halves go towards positive infinity
    row = one(spark, a=R.round6(F.lit(0.0000005)), b=R.round6(F.lit(-0.0000005)))
    assert row["a"] == 0.000001 and row["b"] == 0.0


def test_delivery_rules(spark):
    status = [None, 0, 200, 400, 404, 408, 429, 500, 503]
    rows = spark.createDataFrame([(s,) for s in status], "s int").select(R.is_transient_failure(F.col("s")))
    assert [r[0] for r in rows.collect()] == [True, True, False, False, False, True, True, True, True]
    waits = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 6, 40, 10**9)], "n bigint").select(R.backoff_ms(F.col("n")))
    assert [r[0] for r in waits.collect()] == [0, 1000, 2000, 16000, 30000, 30000, 30000]


def test_fingerprint_and_files(spark):
    digest = hashlib.sha256(b"P-256|xx|yy").hexdigest()
    row = one(
        spark, f=R.key_fingerprint(F.lit("P-256"), F.lit("xx"), F.lit("yy")),
        v=R.is_video_file(F.lit("A.MKV")), t=R.is_video_file(F.lit("a.txt"), F.lit("text/plain")),
        m=R.is_video_file(F.lit("a.avi"), F.lit("video/x-msvideo")), h=R.is_sha256_hex(F.lit(None).cast("string")),
    )
    assert row["f"] == ":".join(digest[i : i + 4] for i in (0, 4, 8, 12))
    assert (row["v"], row["t"], row["m"], row["h"]) == (True, False, True, False)
