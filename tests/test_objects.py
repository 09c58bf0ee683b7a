import pytest
from pyspark.sql import functions as F

from chainwitness.plans.lifecycle import incident_holds
from chainwitness.session import new_dir
from chainwitness.sources.evidence import folder_listing
from chainwitness.sources.objects import ObjectStore
from chainwitness.sources.store import KeyedStore


@pytest.fixture
def store(spark):
    return ObjectStore(spark, new_dir(spark, "objects"), buckets=8)


def files(spark, *found):
    return spark.createDataFrame([("evidence", *f) for f in found], "bucket_id string, name string, content binary, bucket int").coalesce(1)


def one(name, content, extra=1):
    return name, None if content is None else content.encode(), extra


def held(store):
    return sorted((r["name"], bytes(r["content"]).decode()) for r in store.get().collect())


def test_a_name_is_never_overwritten(spark, store):
    assert held(store) == [] and store.listing().count() == 0
    added = store.put(files(spark, one("s/a", "first"), one("s/a", "second"), one("s/b", ""), one(None, "x"), one("s/c", None)), 0)
    assert sorted((r["name"], r["size"]) for r in added.collect()) == [("s/a", 5), ("s/b", 0)]
    added = store.put(files(spark, one("s/a", "third"), one("s/d", "first")), 1)
    assert [r["name"] for r in added.collect()] == ["s/d"]
    assert held(store) == [("s/a", "first"), ("s/b", ""), ("s/d", "first")]
    # equal contents once, contents of refused names not at all
    assert sorted(bytes(r["content"]) for r in store.contents.read().collect()) == [b"", b"first"]
    assert [r["path"] for r in folder_listing(store.listing()).collect()] == ["s/a", "s/b", "s/d"]


def test_a_replay_adds_nothing(spark, store):
    batch = files(spark, one("s/a", "x"), one("s/b", "y"))
    assert store.put(batch, 0).count() == 2 and store.put(batch, 0).count() == 2
    assert store.listing().count() == 2 and store.contents.read().count() == 2
    store.put(files(spark, one("s/c", "z")), 1)
    store.compact()
    assert held(store) == [("s/a", "x"), ("s/b", "y"), ("s/c", "z")]


def test_an_upload_lost_between_contents_and_names_is_completed(spark, store, monkeypatch):
    plain, batch = KeyedStore._commit, files(spark, one("s/a", "x"))

    def lost(self, version, record):
        if "name" in self.KEYS:
            raise RuntimeError("lost")
        plain(self, version, record)

    with monkeypatch.context() as patch:
        patch.setattr(KeyedStore, "_commit", lost)
        with pytest.raises(RuntimeError):
            store.put(batch, 0)
    assert held(store) == []
    assert store.put(batch, 0).count() == 1
    assert held(store) == [("s/a", "x")] and store.contents.read().count() == 1


def test_some_objects_by_name_and_many_copies(spark, store):
    copies = spark.range(500).select(F.lit("evidence").alias("bucket_id"), F.format_string("s/%03d", "id").alias("name"), F.encode(F.lit("same"), "UTF-8").alias("content"))
    assert store.put(copies, "copies").count() == 500
    assert store.contents.read().count() == 1
    wanted = spark.createDataFrame([("evidence", "s/007"), ("evidence", "s/007"), ("evidence", "none"), ("other", "s/008")], "bucket_id string, name string")
    assert [(r["name"], bytes(r["content"])) for r in store.get(wanted).collect()] == [("s/007", b"same")]


def test_lock_rule_of_the_caller(spark):
    clips = spark.createDataFrame([("d", "a", 0, 10, False), ("d", "b", 10, 90, False), ("d", "c", 90, 99, True), ("d", "e", None, 5, False)],
                                  "device_id string, key string, started_at long, ended_at long, locked boolean")
    none = spark.createDataFrame([], "device_id string, pressed_at long")
    out = incident_holds(clips, none, should_lock=lambda start, end: end - start > 20).collect()
    assert {r["key"]: (r["held"], r["newly_held"]) for r in out} == {"a": (False, False), "b": (True, True), "c": (True, False), "e": (False, False)}
