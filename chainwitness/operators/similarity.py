"""Exact search for near-equal 64-bit hashes."""

from itertools import combinations

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions.frames import hamming

BANDS, BAND_BITS = 4, 16
HOT_BUCKET = 100_000


def band_radii(max_distance, bands=BANDS):
    """Per-band radii: a pair beyond its radius in every band is beyond the distance."""
    share, rest = divmod(max_distance + 1, bands)
    return [share + (1 if i < rest else 0) - 1 for i in range(bands)]


def _masks(radius):
    return [
        sum(1 << p for p in places)
        for r in range(radius + 1)
        for places in combinations(range(BAND_BITS), r)
    ]


def _band(bits, i):
    return F.shiftrightunsigned(bits, BAND_BITS * i).bitwiseAND(0xFFFF).cast("int")


def _near_values(bits, i, radius):
    """The values of band i within a radius of its own value, as (band, v)."""

    def flipped(mask):
        return F.struct(F.lit(i).alias("band"), _band(bits, i).bitwiseXOR(mask).alias("v"))

    return F.transform(F.array(*[F.lit(m) for m in _masks(radius)]), flipped)


def distinct_hashes(rows, bits="bits"):
    """Each hash once with the number of rows that have it."""
    return rows.groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))


def _others(band):
    return [j for j in range(BANDS) if j != band]


def _split_hot(a, b, max_distance):
    """Join of overfull buckets on a second band as well.

    Inside a bucket the other three bands must hold the whole distance, so the same
    argument applies to them once more, and a bucket falls apart by their values.
    """
    spark = a.sparkSession
    radii = band_radii(max_distance, BANDS - 1)
    used = [(i, p, j) for i in range(BANDS) for p, j in enumerate(_others(i)) if radii[p] >= 0]
    exact = spark.createDataFrame(used, "band int, place int, second int")
    near = spark.createDataFrame(
        [(i, p, j, m) for i, p, j in used for m in _masks(radii[p])],
        "band int, place int, second int, mask int",
    )
    second = "cast(shiftrightunsigned({}, 16 * second) & 65535 as int)"
    # both tables are constants of at most a few thousand rows
    left = a.join(F.broadcast(exact), "band").withColumn("w", F.expr(second.format("hash_a")))
    right = (
        b.join(F.broadcast(near), "band")
        .withColumn("w", F.expr(second.format("hash_b")).bitwiseXOR(F.col("mask")))
        .drop("mask", "place")
    )
    apart = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    first = F.lit(True)
    for i, p, j in used:
        at_or_after = (F.col("band") != i) | (F.col("place") <= p)
        first = first & (at_or_after | (F.bit_count(_band(apart, j)) > radii[p]))
    return left.join(right.hint("merge"), ["band", "v", "second", "w"]).where(first).drop("place", "second", "w")


def near_hashes(rows, bits="bits", max_distance=V.MAX_HAMMING, hot_bucket=HOT_BUCKET):
    """Pairs of distinct hashes within a Hamming distance, with their row counts.

    Equal rows are counted, not paired: ``n_a * n_b`` row pairs stand behind one
    result row, and the rows themselves are found by joining back on the hash.

    The hash is cut into bands. If two hashes are close, they are very close in at
    least one band, so one side looks up every band value and the other side is
    spread over the few values near its own. A pair is kept in the first band where
    it is very close, so no pair appears twice and nothing is de-duplicated later.
    Buckets with more than ``hot_bucket`` hashes are split by a second band. Both sides
    are merged: Spark's size check sees the hashes, not the hundreds of rows that each
    becomes, and would send all of those through the driver.
    """
    # each hash becomes hundreds of rows below: keep the small distinct set spread out
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = distinct_hashes(rows, bits).repartition(partitions)
    radii = band_radii(max_distance)
    used = [i for i in range(BANDS) if radii[i] >= 0]
    own = F.array(*[F.struct(F.lit(i).alias("band"), _band(F.col("bits"), i).alias("v")) for i in used])
    near = F.concat(*[_near_values(F.col("bits"), i, radii[i]) for i in used])
    a = hashes.select(F.col("bits").alias("hash_a"), F.col("n").alias("n_a"), F.inline(own))
    b = hashes.select(F.col("bits").alias("hash_b"), F.col("n").alias("n_b"), F.inline(near))
    # at most 4 * hashes / hot_bucket rows, which bounds the broadcast
    hot = F.broadcast(
        a.groupBy("band", "v").agg(F.count(F.lit(1)).alias("_size"))
        .where(F.col("_size") > hot_bucket).select("band", "v")
    )
    bucket = ["band", "v"]
    pairs = (
        a.join(hot, bucket, "left_anti").join(b.hint("merge"), bucket)
        .unionByName(_split_hot(a.join(hot, bucket, "left_semi"), b.join(hot, bucket, "left_semi"), max_distance))
    )
    apart = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    first_band = F.lit(True)
    for i in used:
        earlier = (F.col("band") <= i) | (F.bit_count(_band(apart, i)) > radii[i])
        first_band = first_band & earlier
    distance = hamming(F.col("hash_a"), F.col("hash_b"))
    return pairs.where(
        (F.col("hash_a") < F.col("hash_b")) & (distance <= max_distance) & first_band
    ).select("hash_a", "hash_b", "n_a", "n_b", distance.alias("distance"))
