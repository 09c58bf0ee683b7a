import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainwitness.operators import ranges
from chainwitness.operators.ordered import block_of, last_known, mark_first, running_count


def rows(spark, n=400, seed=3):
    """A hot key with half of the rows, and small ones."""
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(20)}"
        value = rnd.randrange(100) if rnd.random() < 0.4 else None
        data.append((i, key, rnd.randrange(-50, 300), value))
    return spark.createDataFrame(data, "id int, key string, at int, value int").repartition(7)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_last_known_equals_the_plain_window(spark):
    df = rows(spark).cache()
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    for inclusive, frame in ((False, w), (True, w.rowsBetween(Window.unboundedPreceding, 0))):
        want = df.withColumn("x", F.last("value", ignorenulls=True).over(frame))
        for size in (1, 7, 1000):
            got = last_known(df, ["key"], ["at", "id"], F.col("value"), "x", block_of(F.col("at"), size), inclusive)
            same(got.select("id", "x"), want.select("id", "x"))


def test_running_count_equals_the_plain_window(spark):
    df = rows(spark, seed=4).cache()
    w = Window.partitionBy("key").orderBy("at", "id")
    flag = F.col("value").isNotNull()
    want = df.withColumn("n", F.row_number().over(w)).withColumn(
        "m", F.sum(F.when(flag, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    for size in (1, 11, 1000):
        got = running_count(df, ["key"], ["at", "id"], "n", block_of(F.col("at"), size))
        got = running_count(got, ["key"], ["at", "id"], "m", block_of(F.col("at"), size), flag)
        same(got.select("id", "n", "m"), want.select("id", "n", "m"))


def test_mark_first(spark):
    got = mark_first(rows(spark), ["key"], ["at", "id"], "first").where("first").groupBy("key").count()
    assert all(r["count"] == 1 for r in got.collect())


def test_gaps_runs_and_text(spark):
    numbers = {"a": [1, 2, 3, 5], "b": [4], "c": [0, 10, 10, 11, 40]}
    df = spark.createDataFrame([(k, v) for k, vs in numbers.items() for v in vs], "key string, seq bigint")
    for size in (1, 3, 1000):
        text = ranges.range_parts(ranges.runs(df, ["key"], block_rows=size), ["key"], "t", block_rows=size)
        assert {r["key"]: r["t"] for r in text.collect()} == {"a": "#1–#3, #5", "b": "#4", "c": "#0, #10–#11, #40"}
        gaps = ranges.gaps(df, ["key"], block_rows=size)
        missing = ranges.expand(gaps, ["key"], chunk=4)
        got = {}
        for r in missing.collect():
            got.setdefault(r["key"], []).append(r["seq"])
        assert {k: sorted(v) for k, v in got.items()} == {
            "a": [4], "c": [*range(1, 10), *range(12, 40)]
        }


def test_parts_of_a_long_text_hold_all_ranges(spark):
    df = spark.range(25_000).select(F.lit("a").alias("key"), (F.col("id") * 2).alias("seq"))
    df = df.union(spark.createDataFrame([("b", 1), ("b", 3)], df.schema))
    parts = ranges.range_parts(ranges.runs(df, ["key"]), ["key"], "t", size=1000).orderBy("key", "part").collect()
    assert [r["part"] for r in parts] == [*range(25), 0]
    assert all(r["t"].count("#") <= 1000 for r in parts)
    assert ", ".join(r["t"] for r in parts if r["key"] == "a") == ", ".join(f"#{2 * i}" for i in range(25_000))


def test_a_far_off_number_stays_one_range(spark):
    df = spark.createDataFrame([("a", 0), ("a", 2**40)], "key string, seq bigint")
    assert [tuple(r) for r in ranges.gaps(df, ["key"]).collect()] == [("a", 1, 2**40 - 1, 2**40 - 1)]
