import random

from pyspark.sql import functions as F

from chainwitness.plans import lifecycle as life
from chainwitness.plans import monitor
from chainwitness.sources import evidence as src
from chainwitness.sources import ledger

HASH = "a" * 64


def record(**changes):
    base = dict(
        id="r", device_id="d", session_id="s", seq=0, segment_hash=HASH, prev_chain_hash=HASH, chain_hash=HASH,
        signature="x", started_at=1, ended_at=1, frame_count=0, byte_size=1, mime_type="video/webm",
    )
    return {**base, **changes}


SCHEMA = (
    "id string, device_id string, session_id string, seq int, segment_hash string, prev_chain_hash string, "
    "chain_hash string, signature string, started_at bigint, ended_at bigint, frame_count int, byte_size bigint, mime_type string"
)


def test_rules(spark):
    rows = [
        record(id="good"), record(id="seq", seq=-1), record(id="hex", chain_hash="A" * 64),
        record(id="time", ended_at=0), record(id="size", byte_size=0), record(id="frames", frame_count=-1),
        record(id="null", signature=None), record(id="device", device_id="x"), record(id="two", seq=-1, byte_size=0),
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    devices = spark.createDataFrame([("d",)], "id string")
    bad = {r["id"]: r["failed"] for r in life.quarantined_rows(df, devices).collect()}
    assert bad == {
        "seq": ["seq is negative"], "hex": ["chain_hash is no SHA-256 hash"], "time": ["ended_at is before started_at"],
        "size": ["byte_size is not positive"], "frames": ["frame_count is negative"], "null": ["signature is missing"],
        "device": ["device is unknown"], "two": ["seq is negative", "byte_size is not positive"],
    }
    assert [r["id"] for r in life.valid_rows(df, devices).collect()] == ["good"]


def test_append_is_idempotent(spark):
    now = F.timestamp_millis(F.lit(86_400_000))
    rows = spark.createDataFrame([("b", "s", 0), ("a", "s", 0), ("c", "s", 1)], "id string, session_id string, seq int")
    first = ledger.append_records(rows, rows.where("false"), now)
    got = sorted((r["id"], r["seq"]) for r in first.collect())
    assert got == [("a", 0), ("c", 1)]
    assert first.select((F.unix_millis("expires_at") - F.unix_millis("created_at")).alias("d")).first()["d"] == 30 * 86_400_000
    assert ledger.append_records(rows, first, now).count() == 0


def test_drift(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", 1), (2, "z", 5), (4, "d", 4)], "id int, x string, y int")
    got = {r["id"]: (r["change"], r["columns"]) for r in life.drift(old, new).collect()}
    assert got == {2: ("changed", ["x", "y"]), 3: ("removed", []), 4: ("added", [])}


def test_purge_is_strict_and_spares_evidence(spark):
    at = lambda ms: F.timestamp_millis(F.lit(ms))
    rows = spark.createDataFrame([("old", 99), ("edge", 100), ("held", 1), ("hel", 1)], "session_id string, ms bigint")
    rows = rows.withColumn("expires_at", F.timestamp_millis("ms"))
    objects = spark.createDataFrame(
        [("evidence", "held/x.webm"), ("evidence", "old"), ("other", "old/x.webm")], "bucket_id string, name string")
    kept, gone = life.purge(rows, objects, at(100))
    assert sorted(r["session_id"] for r in kept.collect()) == ["edge", "held"]
    assert life.purge_count(gone).first()["n_removed"] == 2


def test_cache_retention(spark):
    rnd = random.Random(5)
    rows = [(f"k{i:03d}", rnd.choice("ab"), t, t + 5, rnd.random() < 0.3)
            for i in range(300) for t in [rnd.randrange(1000)]]
    df = spark.createDataFrame(rows, "key string, device_id string, started_at bigint, ended_at bigint, locked boolean")
    for cap in (20, 60, 500):
        got = {r["key"]: r["fate"] for r in life.cache_retention(df, F.lit(1000), 700, cap).collect()}
        want = {}
        for device in "ab":
            mine = [r for r in rows if r[1] == device]
            kept = [r for r in mine if r[4] or not r[3] < 300]
            want.update({r[0]: "expired" for r in mine if r not in kept})
            want.update({r[0]: "kept" for r in kept})
            unlocked = sorted((r for r in kept if not r[4]), key=lambda r: (r[2], r[0]))
            want.update({r[0]: "evicted" for r in unlocked[: max(0, len(kept) - cap)]})
        assert got == want


def test_incident_holds_equal_brute_force(spark):
    rnd = random.Random(6)
    hour = 3_600_000
    clips = [(i, rnd.choice("abc"), t, t + rnd.choice([0, 5000, 30 * hour]), rnd.random() < 0.2)
             for i in range(300) for t in [rnd.randrange(-hour, 40 * hour)]]
    marks = [(i, rnd.choice("ab"), rnd.randrange(-hour, 90 * hour)) for i in range(12)]
    # both ends of the interval count
    clips += [(900, "a", marks[0][2] + 30_000, marks[0][2] + 30_001, False), (901, "a", marks[0][2] - 40_000, marks[0][2] - 30_000, False)]
    marks = [(marks[0][0], "a", marks[0][2]), *marks[1:]]
    got = life.incident_holds(
        spark.createDataFrame(clips, "id int, device_id string, started_at bigint, ended_at bigint, locked boolean"),
        spark.createDataFrame(marks, "incident_id int, device_id string, pressed_at bigint"),
    )
    hit = lambda c: any(m[1] == c[1] and c[3] >= m[2] - 30_000 and c[2] <= m[2] + 30_000 for m in marks)
    want = {c[0]: (hit(c) or c[4], hit(c) and not c[4]) for c in clips}
    assert {r["id"]: (r["held"], r["newly_held"]) for r in got.collect()} == want
    assert want[900][0] and want[901][0]


def test_outbox_and_backoff(spark):
    tries = [("a", 1, None), ("a", 2, 503), ("a", 3, 201), ("a", 4, 429), ("b", 1, 400), ("c", 1, 500), ("c", 2, 0)]
    df = spark.createDataFrame(tries, "key string, attempt_at bigint, status int")
    ladder = {(r["key"], r["attempt_at"]): (r["failures_in_row"], r["wait_ms"]) for r in life.backoff_ladder(df).collect()}
    assert ladder == {
        ("a", 1): (1, 1000), ("a", 2): (2, 2000), ("a", 3): (0, 0), ("a", 4): (1, 1000),
        ("b", 1): (0, 0), ("c", 1): (1, 1000), ("c", 2): (2, 2000),
    }
    outbox = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    state = life.outbox_state(outbox, spark.createDataFrame([("d",)], "key string"), df)
    assert {r["key"]: (r["attempts"], r["rejected"]) for r in state.collect()} == {"b": (1, True), "c": (2, False), "e": (0, False)}
    assert tuple(life.outbox_counts(state).first()) == (2, 1, 3)


def test_omit(spark):
    files = spark.createDataFrame([(o, i) for o, n in (("x", 5), ("y", 2), ("z", 1)) for i in range(n)], "owner string, ord int")
    left = sorted(map(tuple, life.omit(files, ["owner"]).collect()))
    assert left == [("x", 0), ("x", 1), ("x", 4), ("y", 0)]
    chosen = spark.createDataFrame([("x", 0), ("z", 0)], "owner string, pos bigint")
    assert sorted(map(tuple, life.omit(files, ["owner"], chosen=chosen).collect())) == [("x", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 0), ("y", 1)]


def test_listing_and_sources(spark):
    objects = spark.createDataFrame(
        [("evidence", "s1/b.webm", 2), ("evidence", "s1/a.webm", None), ("evidence", "root.webm", 1), ("evidence", "s2/c.webm", 3)],
        "bucket_id string, name string, size bigint").withColumn("created_at", F.current_timestamp())
    rows = [(r["folder"], r["file_name"], r["size"]) for r in src.folder_listing(objects).collect()]
    assert rows == [("s2", "c.webm", 3), ("s1", "a.webm", 0), ("s1", "b.webm", 2)]
    records = spark.createDataFrame([("s1", 0), ("s1", 1), ("s2", 0), ("s3", 0)], "session_id string, seq int").withColumn("mime_type", F.lit("video/webm"))
    cached = spark.createDataFrame([("s1:000001", "local.webm", 9)], "key string, file_name string, size bigint")
    got = sorted((r["session_id"], r["file_name"], r["origin"], r["note"] is None) for r in src.session_files(records, cached, objects).collect())
    assert got == [("s1", "local.webm", "local", True), ("s2", "c.webm", "cloud", True), ("s3", "clip_s3_00000.webm", "local", False)]


def test_read_contents(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "a.webm").write_bytes(b"\x00\x01")
    row = src.read_contents(spark, str(tmp_path)).first()
    assert (row["name"], row["size"], bytes(row["content"])) == ("a.webm", 2, b"\x00\x01")


def test_size_change(spark):
    before = spark.createDataFrame([("a", 10), ("a", 10), ("b", 5)], "session_id string, size bigint")
    after = spark.createDataFrame([("a", 15)], "session_id string, size bigint")
    got = {r["session_id"]: (r["n_removed"], r["bytes_after"], r["percent_smaller"]) for r in monitor.size_change(before, after).collect()}
    assert got == {"a": (1, 15, 25), "b": (1, 0, 100)}


def test_hash_list(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0, "h2"), ("a", 1, "h1"), ("a", 0, "h0")], "session_id string, seq int, segment_hash string")
    ledger.write_hash_list(rows.coalesce(1), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["h0", "h1", "h2"]
