from chainwitness.sources import manifest

H = "ab" * 32
G = "cd" * 32
BOM, NBSP = chr(0xFEFF), chr(0xA0)


def parse(spark, body, max_hashes=None):
    row = manifest.parse(spark.createDataFrame([(1, body)], "list_id int, body string"), max_hashes=max_hashes).first()
    return row["error"], [tuple(e) for e in row["entries"] or []]


def test_accepted_lines(spark):
    text = f"{BOM}{H.upper()}\r\n{NBSP} \r\n{G}  *clip one.webm{NBSP}\r\n"
    assert parse(spark, text) == (None, [(1, H), (3, G)])
    assert parse(spark, f"  {H}\tname") == (None, [(1, H)])


def test_rejected_lists(spark):
    assert parse(spark, "")[0] == parse(spark, " \n\n")[0] == "Add at least one SHA-256 hash."
    assert parse(spark, f"{H}\nxyz")[0] == "Line 2 must start with a 64-character SHA-256 hash."
    assert parse(spark, H + "x")[0].startswith("Line 1 ")
    assert parse(spark, "\n".join([H] * 2001))[0] is None
    assert parse(spark, "\n".join([H] * 2000), 2000)[0] is None
    assert parse(spark, "\n".join([H] * 2001), 2000)[0] == "Use no more than 2,000 hashes per list."
    # whichever failure comes first rejects the list
    assert parse(spark, "\n".join([H] * 2001 + ["bad"]), 2000)[0] == "Use no more than 2,000 hashes per list."
    assert parse(spark, "\n".join(["bad"] + [H] * 2001), 2000)[0].startswith("Line 1 ")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(H)
    (tmp_path / "b.TXT").write_text("x" * 1_000_001)
    (tmp_path / "c.csv").write_text(H)
    rows = {r["path"][-5:]: (r["accepted"], r["body"]) for r in manifest.read_manifests(spark, str(tmp_path), 1_000_000).collect()}
    assert rows == {"a.txt": (True, H), "b.TXT": (False, None), "c.csv": (False, None)}


def test_documents_of_hash_lists(spark):
    from pyspark.sql import functions as F

    from chainwitness.plans import manifest
    from chainwitness.testing import fixtures as X

    small = "/root/testdata/sf0.001"
    report = manifest.verify_manifests(X.conv_manifests(spark, small), X.conv_ledger(spark, small), X.devices(spark, small))
    documents = manifest.manifest_documents(report).cache()
    n = {r["part"]: r["count"] for r in documents.groupBy("part").count().collect()}
    assert n["entry"] == report.entries.count() and n["list"] == report.entries.select("list_id").distinct().count()
    assert n.get("error", 0) == report.errors.count() and n["record"] >= n["session"] > 0
    first = documents.where("part = 'list'").select(F.json_object_keys("document")).first()[0]
    assert first == ["n_supplied", "n_registered", "n_not_valid", "n_repeated", "content_checked"]
