import pytest
from pyspark.sql import functions as F

from chainwitness.session import new_dir
from chainwitness.sources.store import BUCKET, Conflict, LedgerStore

SCHEMA = "id string, session_id string, seq int"


@pytest.fixture
def store(spark):
    return LedgerStore(spark, new_dir(spark, "store"), spark.createDataFrame([], SCHEMA).schema, buckets=16, block=4)


def rows(spark, *found):
    return spark.createDataFrame(found, SCHEMA)


def content(store):
    return sorted((r["id"], r["session_id"], r["seq"]) for r in store.read().collect())


def test_first_arrival_stays_and_replays_add_nothing(spark, store):
    assert content(store) == []
    store.append(rows(spark, ("z", "s", 0), ("b", "s", 1)).coalesce(1), 0)
    added = store.append(rows(spark, ("a", "s", 0), ("y", "t", 5), ("c", "t", 5)).coalesce(1), 1)
    assert [r["id"] for r in added.collect()] == ["y"]  # not the smallest id
    again = store.append(rows(spark, ("a", "s", 0), ("q", "t", 6)), 1)
    assert [r["id"] for r in again.collect()] == ["y"]
    assert content(store) == [("b", "s", 1), ("y", "t", 5), ("z", "s", 0)]
    assert store.append(rows(spark), 2).count() == 0


def test_an_append_reads_only_its_buckets(spark, store, monkeypatch):
    store.append(spark.range(400).selectExpr("cast(id as string) as id", "cast(id % 50 as string) as session_id", "cast(id / 50 as int) as seq"), 0)
    read = []
    plain = LedgerStore._read
    monkeypatch.setattr(LedgerStore, "_read", lambda self, versions: read.append(plain(self, versions)) or read[-1])
    one = rows(spark, ("n", "7", 3), ("m", "7", 900))
    written = []
    write = LedgerStore._write
    monkeypatch.setattr(LedgerStore, "_write", lambda self, new, v, record: written.append(new._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) or write(self, new, v, record))
    assert [r["id"] for r in store.append(one, 1).collect()] == ["m"]
    assert "PartitionFilters" in written[0] and f"{BUCKET}#" in written[0].split("PartitionFilters", 1)[1].split("\n")[0]
    buckets = {r[0] for r in one.withColumn(BUCKET, store.bucket_of()).select(BUCKET).distinct().collect()}
    assert len(buckets) < 16 and {r[BUCKET] for r in store.read(sorted(buckets)).select(BUCKET).distinct().collect()} <= buckets


def test_a_busy_session_lies_in_many_buckets(spark, store):
    store.append(spark.range(200).selectExpr("cast(id as string) as id", "'s' as session_id", "cast(id as int) as seq"), 0)
    sizes = [r["count"] for r in store.read().groupBy(BUCKET).count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 40


def test_a_lost_attempt_leaves_nothing(spark, store, monkeypatch):
    store.append(rows(spark, ("a", "s", 0)), 0)

    def lost(self, version, record):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as patch:
        patch.setattr(LedgerStore, "_commit", lost)
        with pytest.raises(RuntimeError):
            store.append(rows(spark, ("half", "s", 1), ("half2", "u", 1)), 1)
    assert content(store) == [("a", "s", 0)]
    store.append(rows(spark, ("b", "s", 1)), 1)
    assert content(store) == [("a", "s", 0), ("b", "s", 1)]


def test_of_two_writers_one_is_refused(spark, store):
    store.append(rows(spark, ("a", "s", 0)), 0)
    with pytest.raises(Conflict):
        store._commit(0, {"batch": "other", "replaces": []})
    assert content(store) == [("a", "s", 0)]


def test_compaction_keeps_rows_and_batches(spark, store):
    for n in range(4):
        store.append(rows(spark, (f"r{n}", "s", n), (f"again{n}", "s", 0)).coalesce(1), n)
    before = content(store)
    store.compact()
    assert content(store) == before and len(store.live_versions()) == 1
    store.vacuum()
    store.append(rows(spark, ("late", "s", 2), ("new", "s", 9)), 2)  # a replay of a batch that was merged
    store.append(rows(spark, ("late", "s", 2), ("new", "s", 9)), 7)
    assert content(store) == sorted([*before, ("new", "s", 9)])


def test_stamps(spark, store):
    added = store.append(rows(spark, ("a", "s", 0)), 0, finish=lambda new: new.withColumn("id", F.lit("stamped")))
    assert [r["id"] for r in added.collect()] == ["stamped"]


def test_an_append_moves_rows_to_their_keys_once(spark, store, monkeypatch):
    """Stored keys meet the rows in the aggregate that finds first arrivals; no join moves the rows again."""
    plans, write = [], LedgerStore._write
    monkeypatch.setattr(LedgerStore, "_write", lambda self, new, v, record: plans.append(
        new._jdf.queryExecution().executedPlan().toString()) or write(self, new, v, record))
    store.append(rows(spark, ("a", "s", 0), ("n", None, 1)), 0)
    added = store.append(rows(spark, ("b", "s", 0), ("c", "s", 1), ("m", None, 1)), 1)
    assert sorted(r["id"] for r in added.collect()) == ["c", "m"]  # a key with a null is never stored already
    assert "Join" not in plans[1] and plans[1].count("Exchange") == 1
