"""End-to-end scenarios: six segments of 50,000 bytes per session, many submissions in one job."""

import base64
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from chainwitness.functions import tamper
from chainwitness.operators import audit
from chainwitness.operators.chain import build_chains
from chainwitness.plans import evidence, manifest
from chainwitness.schemas import DEVICES, LEDGER
from chainwitness.testing import signing

SESSIONS = {name: f"00000000-0000-4000-8000-00000000000{i}" for i, name in enumerate(
    ("clean", "shifted", "deleted", "forged", "doubled"))}
DEVICE = "11111111-0000-4000-8000-000000000001"


def blob(session, seq):
    return random.Random(f"{session}/{seq}").randbytes(50_000)


def name(session, seq):
    return f"clip_{SESSIONS[session]}_{seq:05d}.webm"


@pytest.fixture(scope="module")
def world(spark):
    core = [
        (f"{s}-{i}", DEVICE, sid, i, 10**12 + i * 5000, 10**12 + i * 5000 + 5000, 75, 50_000, "video/webm",
         1280, 720, 48.85, 2.35, hashlib.sha256(blob(s, i)).hexdigest())
        for s, sid in SESSIONS.items() for i in range(6)
    ]
    fields = [f for f in LEDGER.fields if f.name not in ("prev_chain_hash", "chain_hash", "signature", "created_at", "expires_at")]
    df = spark.createDataFrame(core, type(LEDGER)(fields))
    tag = F.when((F.col("session_id") == SESSIONS["forged"]) & (F.col("seq") == 3), "EVIL").otherwise("KEY")
    signed = (
        build_chains(df)
        .withColumn("signature", signing.sign_udf(tag, F.col("device_id"), F.col("chain_hash")))
        .withColumn("created_at", F.timestamp_millis(F.col("ended_at") + 800))
        .withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 30 DAYS"))
    )
    of = lambda s: F.col("session_id") == SESSIONS[s]
    moved = F.when(of("shifted") & (F.col("seq") == 2), 60_000).otherwise(0)
    ledger = signed.withColumn("started_at", F.col("started_at") - moved).withColumn("ended_at", F.col("ended_at") - moved)
    ledger = ledger.where(~(of("deleted") & (F.col("seq") == 3)))
    again = ledger.where(of("doubled") & (F.col("seq") == 1)).withColumn("id", F.lit("zz")).withColumn(
        "device_id", F.lit("someone else"))
    ledger = ledger.unionByName(again).cache()
    key = signing.public_key("KEY", DEVICE)
    devices = spark.createDataFrame([(DEVICE, "phone", tuple(key.values()), None)], DEVICES)
    return ledger, devices


def submissions():
    out = []

    def add(sid, files):
        out.extend((sid, i, n, b) for i, (n, b) in enumerate(files))

    plain = lambda s: [(name(s, i), blob(s, i)) for i in range(6)]
    files = plain("clean")
    add(1, files)
    flipped = bytearray(files[1][1])
    flipped[25_000] ^= 1
    add(2, [files[0], (files[1][0], bytes(flipped)), *files[2:]])
    add(3, [*files[:2], (files[2][0], files[2][1][:30_000] + bytes(4096) + files[2][1][34_096:]), *files[3:]])
    add(4, [*files[:5], (files[5][0], files[5][1][:40_000])])
    add(5, files[:2] + files[3:])
    add(6, [(files[1][0], files[0][1]), (files[0][0], files[1][1]), *files[2:]])
    add(7, [*files, ("holiday.webm", b"something else")])
    add(8, [*files, ("again.webm", files[4][1])])
    for n, s in enumerate(("shifted", "deleted", "forged", "doubled")):
        add(9 + n, plain(s))
    add(13, [(name("clean", 77), b"never registered")])
    return out


@pytest.fixture(scope="module")
def report(spark, world):
    files = spark.createDataFrame(submissions(), "submission_id bigint, ord int, name string, content binary")
    return evidence.verify_evidence(files, *world)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_verdicts(report):
    got = {k[0]: r["verdict"] for k, r in by_key(report.verdicts, "submission_id").items()}
    assert got == {
        1: "AUTHENTIC", 2: "TAMPERED", 3: "TAMPERED", 4: "TAMPERED", 5: "INCOMPLETE", 6: "AUTHENTIC",
        7: "TAMPERED", 8: "AUTHENTIC", 9: "TAMPERED", 10: "TAMPERED", 11: "TAMPERED", 12: "TAMPERED", 13: "TAMPERED",
    }


def test_file_statuses(report):
    files = by_key(report.files, "submission_id", "ord")
    assert {files[1, i]["status"] for i in range(6)} == {"AUTHENTIC"}
    assert [files[s, i]["status"] for s, i in ((2, 1), (3, 2), (4, 5))] == ["MODIFIED"] * 3
    assert len(files[2, 1]["problems"]) == 1 and len(files[4, 5]["problems"]) == 2
    assert files[4, 5]["problems"][1] == "Size 40,000 B ≠ recorded 50,000 B."
    assert files[6, 0]["renamed"] and files[6, 0]["seq"] == 0 and files[6, 1]["seq"] == 1
    assert files[7, 6]["status"] == "UNKNOWN" and files[8, 6]["status"] == "DUPLICATE"
    assert files[9, 2]["status"] == "FORGED" and files[11, 3]["status"] == "FORGED"
    # the deleted record leaves only its name; the session stays linked where it can be judged
    assert files[10, 3]["status"] == "UNKNOWN"
    assert files[13, 0]["problems"][0].startswith("No server record")


def test_sessions(report):
    rows = by_key(report.sessions(), "submission_id", "session_id")
    clean = rows[5, SESSIONS["clean"]]
    assert clean["missing_in_evidence"] == "#2" and clean["n_signature_ok"] == 6
    deleted = rows[10, SESSIONS["deleted"]]
    assert deleted["missing_in_db"] == "#3" and deleted["n_links_broken"] == 0
    doubled = rows[12, SESSIONS["doubled"]]
    assert doubled["n_records"] == 7 and doubled["bad_seqs"] == "#1"


def test_written_report(spark, report, tmp_path):
    path = str(tmp_path / "report")
    evidence.write_report(report, path)
    rows = spark.read.text(path)
    assert rows.where("part = 'verdict'").count() == 13
    fields = rows.where("part = 'file'").select(F.json_object_keys("value")).first()[0]
    assert fields[:3] == ["name", "status", "sha256"]
    sessions = rows.where("part = 'session'").select(F.from_json("value", "session_id string, genesis_ok boolean, key_fingerprint string, n_records long").alias("s")).select("s.*")
    clean = sessions.where(F.col("session_id") == SESSIONS["clean"]).first()
    assert clean["genesis_ok"] is True and len(clean["key_fingerprint"]) == 19 and clean["n_records"] == 6
    records = rows.where("part = 'record'").select(F.get_json_object("value", "$.session_id").alias("s"), F.get_json_object("value", "$.problems").alias("p"))
    assert records.where(F.col("s") == SESSIONS["doubled"]).where("p like '%Duplicate sequence number%'").count() > 0


def test_record_checks(world):
    ledger, devices = world
    plain = by_key(audit.check_records(ledger, devices), "id")
    assert plain["shifted-2",]["chain_ok"] is False and plain["shifted-2",]["signature_ok"] is True
    assert plain["deleted-4",]["link_ok"] is None and plain["deleted-4",]["n_missing_before"] == 1
    assert plain["zz",]["problems"][-1] == "Duplicate sequence number."
    assert "Record signed by a different device." in plain["zz",]["problems"]
    assert plain["doubled-2",]["link_ok"] is True
    # the size of the blocks that sessions are cut into changes nothing, nor does the row order
    cut = by_key(audit.check_records(ledger.repartition(9), devices, block_rows=2), "id")
    assert {k: (r["link_ok"], r["problems"], r["gap_ms"]) for k, r in cut.items()} == {
        k: (r["link_ok"], r["problems"], r["gap_ms"]) for k, r in plain.items()
    }
    gaps = {(r["session_id"], r["seq"]): r["warning"] for r in audit.time_gaps(audit.check_records(ledger, devices)).collect()}
    assert gaps == {(SESSIONS["shifted"], 3): "Time gap of 1 min 0 s before seq 3."}


def test_missing_device_fails_every_signature(world):
    ledger, devices = world
    rows = audit.audit_sessions(audit.check_records(ledger, devices.where("false"))).collect()
    assert all(r["n_signature_ok"] == 0 and r["problems"][0].startswith("Device public key") for r in rows)


def test_changed_ledger_is_noticed(spark, world):
    files = spark.createDataFrame([r for r in submissions() if r[0] == 1], "submission_id bigint, ord int, name string, content binary")
    changed = evidence.verify_evidence(files, *world, mutate=tamper.shift_times(2))
    assert changed.verdicts.first()["verdict"] == "TAMPERED"
    assert {r["ord"]: r["status"] for r in changed.files.collect()}[2] == "FORGED"


def test_manifest_statuses(spark, world):
    digest = lambda s, i: hashlib.sha256(blob(s, i)).hexdigest()
    lists = [
        (1, "\n".join([digest("clean", 0), "0" * 64, digest("clean", 0), digest("clean", 1).upper()])),
        (2, digest("shifted", 0)),
        (3, "\n".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(205))),
        (4, "nonsense"),
    ]
    report = manifest.verify_manifests(spark.createDataFrame(lists, "list_id bigint, body string"), *world)
    rows = by_key(report.entries, "list_id", "line")
    assert [rows[1, i]["status"] for i in (1, 2, 3, 4)] == ["REGISTERED", "NOT_FOUND", "DUPLICATE", "REGISTERED"]
    assert (rows[1, 4]["session_id"], rows[1, 4]["seq"]) == (SESSIONS["clean"], 1)
    # one altered record spoils the whole session
    assert rows[2, 1]["status"] == "INVALID_RECORD"
    assert sum(k[0] == 3 for k in rows) == 205
    assert [tuple(r) for r in report.errors.collect()] == [(4, "Line 1 must start with a 64-character SHA-256 hash.")]
    assert {r["session_id"] for r in report.sessions().collect()} == {SESSIONS["clean"], SESSIONS["shifted"]}
    counts = by_key(manifest.manifest_counts(report.entries), "list_id")
    assert tuple(counts[1,])[1:] == (4, 2, 1, 1)


def test_signature_text_is_base64(world):
    assert len(base64.b64decode(world[0].first()["signature"])) == 64


def test_copies_of_a_record_are_repeats_and_count_once(world):
    ledger, devices = world
    clean = ledger.where((F.col("session_id") == SESSIONS["clean"]) & F.col("seq").isin(0, 3))
    twice = clean.unionByName(clean.where("seq = 3"))
    checks = audit.check_records(twice, devices)
    rows = checks.orderBy("seq", "repeated_seq").select("seq", "repeated_seq", "n_missing_before").collect()
    assert [tuple(r) for r in rows] == [(0, False, 0), (3, False, 2), (3, True, 0)]
    row = audit.audit_sessions(checks).first()
    assert (row["part"], row["n_missing_in_db"], row["missing_in_db"], row["bad_seqs"]) == (0, 2, "#1–#2", "#3")


def test_files_with_one_turn_are_not_multiplied(world, spark):
    ledger, devices = world
    files = spark.createDataFrame(
        [("tie", 0, name("clean", 1), blob("clean", 1)), ("tie", 0, "copy.webm", blob("clean", 1))],
        "submission_id string, ord int, name string, content binary")
    rows = evidence.verify_evidence(files, ledger, devices).files.orderBy("name").collect()
    assert [(r["name"], r["status"]) for r in rows] == [(name("clean", 1), "AUTHENTIC"), ("copy.webm", "DUPLICATE")]


def test_a_missing_hash_breaks_the_link(world):
    ledger, devices = world
    clean = ledger.where(F.col("session_id") == SESSIONS["clean"]).withColumn(
        "prev_chain_hash", F.when(F.col("seq") != 2, F.col("prev_chain_hash")))
    bad = {r["seq"]: (r["chain_ok"], r["link_ok"]) for r in audit.check_records(clean, devices).collect()}
    assert bad[2] == (False, False) and bad[1] == (True, True)


def test_staged_tables_can_be_released(world, spark, tmp_path):
    ledger, devices = world
    files = spark.createDataFrame([("one", 0, name("clean", 1), blob("clean", 1))], "submission_id string, ord int, name string, content binary")
    report = evidence.verify_evidence(files, ledger, devices)
    folders = {f.rsplit("/", 1)[0].removeprefix("file://") for df in report.staged for f in df.inputFiles()}
    assert len(folders) == 4 and all(os.path.isdir(f) for f in folders)
    report.release()
    assert not any(os.path.isdir(f) for f in folders)
