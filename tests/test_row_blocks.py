import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chainwitness.operators.ordered import BLOCK, last_known, row_blocks, running_count
from chainwitness.plans import lifecycle as life

CLIPS = "key string, device_id string, started_at bigint, ended_at bigint, locked boolean"


def clips(spark, kind, n=600):
    """One device with nearly all clips: spread over years, within one instant, or both."""
    rng, rows = random.Random(kind), []
    for i in range(n):
        start = 0 if kind == "instant" else rng.randrange(10**10) if kind == "spread" else rng.choice([5, 6, rng.randrange(10**8)])
        rows.append((f"c{i:05d}", "hot" if i % 20 else f"d{i % 3}", start, start + rng.randrange(100_000), rng.random() < 0.2))
    return rows, spark.createDataFrame(rows, CLIPS).repartition(5)


@pytest.mark.parametrize("kind", ["instant", "spread", "both"])
def test_no_block_is_far_above_its_bound(spark, kind):
    _, df = clips(spark, kind)
    blocks = row_blocks(df, ["device_id"], ["started_at", "key"], 50)
    sizes = [r["count"] for r in blocks.groupBy(BLOCK).count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 125 and len(sizes) >= 8
    plain = Window.partitionBy("device_id").orderBy("started_at", "key")
    want = df.withColumn("x", F.row_number().over(plain).cast("bigint"))
    got = running_count(blocks, ["device_id"], ["started_at", "key"], "x", F.col(BLOCK))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    before = F.last(F.when(F.col("locked"), F.col("key")), ignorenulls=True).over(plain.rowsBetween(Window.unboundedPreceding, -1))
    got = last_known(blocks, ["device_id"], ["started_at", "key"], F.when(F.col("locked"), F.col("key")), "x", F.col(BLOCK))
    assert sorted(map(str, got.select("key", "x").collect())) == sorted(map(str, df.select("key", before.alias("x")).collect()))


@pytest.mark.parametrize("kind", ["instant", "spread", "both"])
def test_retention_and_holds_of_one_busy_device(spark, kind):
    rows, df = clips(spark, kind)
    now, keep, cap = 5 * 10**9, 4 * 10**9, 100
    got = {r["key"]: r["fate"] for r in life.cache_retention(df, F.lit(now), keep, cap, block_rows=40).collect()}
    want = {}
    for device in {r[1] for r in rows}:
        left = []
        for key, _, start, end, locked in sorted((r for r in rows if r[1] == device), key=lambda r: (r[2], r[0])):
            want[key] = "expired" if not locked and end < now - keep else "kept"
            if want[key] == "kept":
                left.append((key, locked))
        for key in [k for k, locked in left if not locked][: max(len(left) - cap, 0)]:
            want[key] = "evicted"
    assert got == want
    rng = random.Random(9)
    pressed = [(rng.choice(["hot", "d0", "zz"]), rng.choice([0, 5, rng.randrange(10**8), rng.randrange(10**10)])) for _ in range(80)]
    incidents = spark.createDataFrame(pressed, "device_id string, pressed_at bigint")
    got = {r["key"]: (r["held"], r["newly_held"]) for r in life.incident_holds(df, incidents, 3000, 2000, block_rows=40).collect()}
    for key, device, start, end, locked in rows:
        hit = any(d == device and end >= at - 3000 and start <= at + 2000 for d, at in pressed)
        assert got[key] == (hit or locked, hit and not locked)


def test_few_rows_and_none_are_one_block(spark):
    _, df = clips(spark, "spread", 10)
    assert [r[0] for r in row_blocks(df, ["device_id"], ["started_at"]).select(BLOCK).distinct().collect()] == [0]
    assert row_blocks(df.limit(0), ["device_id"], ["started_at"]).count() == 0
