import time

from pyspark.sql import functions as F

from chainwitness.session import new_dir
from chainwitness.streaming import arrival, live

SCHEMA = "id string, session_id string, seq int, prev_chain_hash string, chain_hash string, note string"


class Feed:
    """A folder that records are put into, checked batch by batch by one query that goes on from its checkpoint."""

    def __init__(self, spark, known=None, ttl_ms=86_400_000):
        self.spark, self.own = spark, arrival.session_for_state(spark)
        self.feed, self.out, self.state = (new_dir(spark, n) for n in ("feed", "out", "state"))
        self.known, self.ttl_ms, self.query = known, ttl_ms, None

    def arrive(self, *rows):
        self.spark.createDataFrame([(*r, "") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(self.feed)
        stream = live.read_stream(self.own, self.feed, self.spark.createDataFrame([], SCHEMA).schema)
        known = None if self.known is None else self.own.createDataFrame([(*r, "") for r in self.known], SCHEMA)
        links = arrival.check_links(stream, known, self.ttl_ms)
        self.query = live.drain(links.writeStream.outputMode("append").foreachBatch(live.rollup_batch(self.out)), self.state)
        return sorted((r["id"], r["link_ok"]) for r in arrival.status(self.spark.read.parquet(self.out)).collect())

    def state_rows(self):
        return sum(o["numRowsTotal"] for o in self.query.lastProgress["stateOperators"])


def test_late_predecessors_copies_and_wrong_links(spark):
    feed = Feed(spark)
    assert feed.arrive(("r2", "s", 2, "h1", "h2"), ("r4", "s", 4, "wrong", "h4"), ("r2", "s", 2, "h1", "h2")) == [("r2", None), ("r4", None)]
    assert feed.arrive(("r1", "s", 1, "h0", "h1"), ("r2", "s", 2, "h1", "h2")) == [("r1", None), ("r2", True), ("r4", None)]
    found = feed.arrive(("r3", "s", 3, "h2", "h3"), ("t1", "t", 1, "h0", "x"), ("again", "s", 2, "other", "h2b"))
    assert found == [("again", False), ("r1", None), ("r2", True), ("r3", True), ("r4", False), ("t1", None)]
    results = spark.read.parquet(feed.out)
    assert results.where("id = 'r2'").count() == 2  # on arrival, and when its link became known; none for copies


def test_a_stretch_ends_between_two_records(spark):
    last = arrival.STRETCH - 1
    rows = [("a", "s", last, "h", "h0"), ("b", "s", last + 1, "h0", "h1"), ("c", "s", last + 2, "bad", "h2")]
    assert Feed(spark).arrive(*rows) == [("a", None), ("b", True), ("c", False)]


def test_warm_start(spark):
    feed = Feed(spark, known=[("k0", "s", 0, "g", "h0"), ("k9", "t", 9, "x", "h9")])
    found = feed.arrive(("r1", "s", 1, "h0", "h1"), ("t10", "t", 10, "no", "h10"), ("u1", "u", 1, "?", "?"))
    assert found == [("r1", True), ("t10", False), ("u1", None)]


def test_state_ends_after_its_time(spark):
    feed = Feed(spark, ttl_ms=1500)
    for n in range(4):
        feed.arrive(*((f"r{n}.{k}", f"s{n}", k, "h", "h") for k in range(0, 40, 2)))
        time.sleep(1.6)
    first = feed.state_rows()
    feed.arrive(("end", "e", 1, "h", "h"))
    feed.arrive(("end2", "e2", 1, "h", "h"))
    assert feed.state_rows() < 20 < first + 200  # the 80 records of before have left
    found = dict(feed.arrive(("late", "s0", 1, "h", "h")))
    assert found["late"] is None  # its predecessor is no longer known


def test_notes_and_links_make_the_status(spark):
    rows = spark.createDataFrame([("a", "s", 1, "", None), ("a", "s", 1, "", False), ("b", "s", 2, "note", True), ("c", "s", 3, "", None)], arrival.RESULT)
    found = {r["id"]: (r["check"], r["note"]) for r in arrival.status(rows.repartition(3, F.rand(1))).collect()}
    assert found["b"] == ("bad", "note") and found["c"] == ("ok", "") and found["a"][0] == "bad" and found["a"][1]
