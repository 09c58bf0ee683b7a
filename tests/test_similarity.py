import random
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import digests, frames, tamper, vectors
from chainwitness.operators import similarity
from chainwitness.plans import evaluation as ev
from plan_checks import physical


def test_near_hashes_equal_brute_force(spark):
    rnd = random.Random(1)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    values = []
    for s in seeds:
        values += [s, s]
        for _ in range(4):
            v = s
            for p in rnd.sample(range(64), rnd.randrange(1, 16)):
                v ^= 1 << p
            values.append(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "bits bigint")
    counts = {v: signed.count(v) for v in signed}
    for limit, hot in ((0, 100), (2, 1), (3, 100), (10, 100), (10, 1), (10, 4), (13, 2)):
        want = {
            (a, b): (counts[a], counts[b], ((a ^ b) & (2**64 - 1)).bit_count())
            for a in counts for b in counts if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= limit
        }
        got = [tuple(r) for r in similarity.near_hashes(df, max_distance=limit, hot_bucket=hot).collect()]
        assert len(got) == len(want)  # no pair twice
        assert {(a, b): (n, m, d) for a, b, n, m, d in got} == want


def test_near_hashes_send_no_exploded_rows_to_the_driver(spark):
    """A hash becomes hundreds of rows, which Spark's size check does not see."""
    text = physical(similarity.near_hashes(spark.range(100).select(F.xxhash64("id").alias("bits"))))
    assert text.count("SortMergeJoin [band") == 2
    inner = [x for x in text.split("\n") if "BroadcastHashJoin" in x and "Inner" in x]
    assert not [x for x in inner if "second, " in x or " v#" in x]


def fuzzy_by_definition(data):
    """The piecewise digest with every value computed in full, byte by byte."""
    size = 3
    while size * 64 < len(data):
        size *= 2
    out = []
    for k in (size, 2 * size):
        letters, s, product, xor = "", 5381, 0.0, 0
        for i, b in enumerate(data):
            xor ^= b
            product = (product * 1756695921.0 + b) % 2.0**32
            window = sum((data[i - j] - (data[i - j - 7] if i - j >= 7 else 0)) * 32**j for j in range(min(i + 1, 40)))
            s = ((s * 33) ^ b) % 2**32
            if (window + xor + int(product)) % 2**32 % k == k - 1:
                letters, s = letters + V.FUZZY_ALPHABET[s % 64], 5381
        out.append(letters + V.FUZZY_ALPHABET[s % 64])
    return size, *out


def locality_by_definition(data):
    counts = [0] * 256
    for i in range(4, len(data)):
        h = 0
        for b in reversed(data[i - 4 : i + 1]):
            h = (h * 31 + b) % 256
        counts[h] += 1
    q1, q2 = sorted(counts)[64], sorted(counts)[128]
    codes = [sum(c >= limit for limit in (q1, q2, 2 * q2)) if q1 <= q2 <= 2 * q2 else None for c in counts[:128]]
    body = bytes(sum(codes[4 * i + j] << (2 * j) for j in range(4)) for i in range(32))
    bucket = min(255, int(np.floor(np.log2(max(len(data), 1)) * 10)))
    return sum(data) % 256, bucket, body


SAMPLES = [b"", b"a", b"abcdef", b"abcdefg", bytes(3000), bytes(range(256)) * 9, b"\xff" * 700] + [
    random.Random(i).randbytes(n) for i, n in enumerate((1, 6, 8, 191, 193, 5000, 12345))
]


def test_digests_equal_their_definition(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, c binary")
    rows = df.select("i", digests.fuzzy_digest("c").alias("f"), digests.locality_digest("c").alias("l")).collect()
    for r in rows:
        data = SAMPLES[r["i"]]
        assert tuple(r["f"]) == fuzzy_by_definition(data)
        checksum, bucket, body = r["l"]
        assert (checksum, bucket, bytes(body)) == locality_by_definition(data)


def test_digest_comparison(spark):
    rows = [((3, "abc", "x"), (3, "abd", "y")), ((3, "abc", "x"), (12, "abc", "x")), ((3, "a", "same"), (6, "b", "same"))]
    kind = "struct<block_size:bigint,h1:string,h2:string>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    assert [r[0] for r in df.select(digests.fuzzy_similarity(F.col("a"), F.col("b"))).collect()] == [67, 0, 100]
    kind = "struct<checksum:int,length_bucket:int,body:binary>"
    pair = ((1, 100, bytes([0b11100100] * 32)), (2, 98, bytes([0b00011011] * 32)))
    df = spark.createDataFrame([pair], f"a {kind}, b {kind}")
    assert df.select(digests.locality_distance(F.col("a"), F.col("b"))).first()[0] == 24 + 1 + 32 * (3 + 1 + 1 + 3)


def frame(seed, w=64, h=64):
    return [abs(((seed * 17 + (i % w) * 3 + i // w * 7) * 131) % 256) for i in range(w * h)]


def test_hashes_of_other_sizes(spark):
    """Against plain loops on a frame whose sides differ from every sample grid."""
    w, h = 50, 37
    g = np.random.default_rng(2).integers(0, 256, w * h).tolist()
    at = lambda x, y, n, m: g[min(int(y * (h / m)), h - 1) * w + min(int(x * (w / n)), w - 1)]
    small = [at(x, y, 8, 8) for y in range(8) for x in range(8)]
    average = [int(v >= sum(small) / 64) for v in small]
    difference = [int(at(x, y, 9, 8) > at(x + 1, y, 9, 8)) for y in range(8) for x in range(8)]
    px = np.array([[at(x, y, 32, 32) for x in range(32)] for y in range(32)], float)
    cos = lambda k, n: np.cos(np.pi / 32 * (n + 0.5) * k)
    terms = [sum(px[y, x] * cos(ky, y) * cos(kx, x) for y in range(32) for x in range(32))
             for ky in range(8) for kx in range(8)][1:]
    dct = [int(t >= sum(terms) / 63) for t in terms]
    hexed = lambda bits: f"{int(''.join(map(str, bits)).ljust(64, '0'), 2):016x}"
    df = spark.createDataFrame([(g, w, h)], "grey array<int>, width int, height int")
    r = ev.frame_hashes(df).select(*[
        frames.hash_hex(F.col(m), 63 if m == "dct" else 64).alias(m) for m in ev.METHODS]).first()
    assert (r["average"], r["difference"], r["dct"]) == (hexed(average), hexed(difference), hexed(dct))


def test_identical_and_foreign_frames(spark):
    df = spark.createDataFrame([(1, frame(42), frame(42)), (2, frame(42), frame(999))], "id int, x array<int>, y array<int>")
    base = df.withColumns({"width": F.lit(64), "height": F.lit(64)})
    for side, col in (("a_", "x"), ("b_", "y")):
        base = base.withColumn("content", frames.grey_to_bytes(col))
        base = ev.describe(base, grey=col, prefix=side)
    rows = {r["id"]: r for r in base.select("id", *[c.alias(n) for n, c in ev.metric_columns().items()]).collect()}
    assert tuple(rows[1])[1:] == (0, 0, 0, 0, 100, 0, 0.0, 0.0, 0.0)
    assert rows[2]["l1"] > 0
    compared = ev.compare_hashes(base.select("id", *[f"{s}{m}" for s in ("a_", "b_") for m in ev.METHODS]))
    assert compared.where("id = 1 and is_match and similarity = 1.0").count() == 4


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(vectors.l1_distance(a, b), vectors.l2_distance(a, b), vectors.cosine_similarity(a, b)).collect()
    assert [tuple(r) for r in rows] == [(7.0, 5.0, 0.0), (2.0, 2**0.5, 0.0)]


def test_published_rates(spark):
    """Confusion counts at seven thresholds and the rates printed beside them."""
    table = {
        5: (18, 0, 20, 12, 100.0, 60.0, 75.0, 76.0), 8: (25, 0, 20, 5, 100.0, 83.3, 90.9, 90.0),
        10: (28, 0, 20, 2, 100.0, 93.3, 96.6, 96.0), 12: (29, 1, 19, 1, 96.7, 96.7, 96.7, 96.0),
        15: (30, 2, 18, 0, 93.8, 100.0, 96.8, 96.0), 20: (30, 5, 15, 0, 85.7, 100.0, 92.3, 90.0),
    }
    counts = spark.createDataFrame([(t, *v[:4]) for t, v in table.items()], "threshold int, tp int, fp int, tn int, fn int")
    for r in ev.with_rates(counts).collect():
        got = tuple(round(100 * r[c], 1) for c in ("precision", "recall", "f1", "accuracy"))
        assert got == table[r["threshold"]][4:]


def test_sweep_directions(spark):
    rows = [("m", 1.0, True), ("m", 5.0, True), ("m", 5.0, False), ("m", 9.0, False)]
    df = spark.createDataFrame(rows, "metric string, score double, is_genuine boolean")
    low = ev.evaluate_thresholds(df, (0, 5)).orderBy("threshold").collect()
    assert [(r.tp, r.fp, r.tn, r.fn) for r in low] == [(0, 0, 2, 2), (2, 1, 1, 0)]
    assert low[0].precision == low[0].f1 == 0.0
    high = ev.evaluate_thresholds(df, (5,), higher_is_better=True).first()
    assert (high.tp, high.fp, high.tn, high.fn) == (1, 2, 0, 1)


def test_noise_repeats_and_stays_in_range(spark):
    df = spark.createDataFrame([(1, [128] * 4096), (2, [128] * 4096)], "id bigint, g array<int>").repartition(2)
    noisy = df.select("id", frames.gaussian_like(F.col("g"), 16.0, F.col("id")).alias("n"),
                      frames.salt_and_pepper(F.col("g"), 0.1, F.col("id")).alias("s"))
    a, b = noisy.orderBy("id").collect(), noisy.orderBy("id").collect()
    assert a == b and a[0]["n"] != a[1]["n"]
    assert 7.5 < np.std(a[0]["n"]) < 8.7  # about half of the nominal deviation
    assert 300 < sum(v != 128 for v in a[0]["s"]) < 520


def test_byte_changes(spark):
    data = bytes(range(100))
    c = F.col("c")
    row = spark.createDataFrame([(data,)], "c binary").select(
        tamper.flip_one_bit(c).alias("bit"), tamper.zero_block(c, block=8).alias("zero"), tamper.truncate(c).alias("cut"),
        tamper.shift_block(c, block=5).alias("shift"), tamper.invert_block(c).alias("inv"),
        tamper.flip_one_bit(F.unhex(F.lit(""))).alias("empty"),
    ).first()
    assert bytes(row["bit"]) == data[:50] + bytes([51]) + data[51:]
    assert bytes(row["zero"]) == data[:60] + bytes(8) + data[68:]
    assert bytes(row["cut"]) == data[:80]
    assert bytes(row["shift"]) == data[:30] + bytes((v + 128) % 256 for v in data[30:35]) + data[35:]
    assert bytes(row["inv"]) == data[:20] + bytes(255 - v for v in data[20:30]) + data[30:]
    assert bytes(row["empty"]) == b""


def test_hashing_many_frames_takes_little_memory():
    rng = np.random.default_rng(3)
    some = [rng.integers(0, 256, 64 * h, dtype=np.int32) for h in (1, 2, 3, 40, 64, 70)] + [None, np.zeros(0, np.int32)]
    grey = pd.Series(some * 400)
    height = pd.Series([0 if g is None else len(g) // 64 for g in grey])
    width = pd.Series(64, index=grey.index)
    for udf in (frames.wavelet_hash, frames.dct_hash):
        tracemalloc.start()
        many = udf.func(grey, width, height)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20_000_000  # all samples at once are 75 MB and more
        each = [udf.func(*(c.iloc[i:i + 1] for c in (grey, width, height))).iloc[0] for i in range(len(some))]
        assert many.isna().tolist() == [e is pd.NA for e in each] * 400
        assert many.dropna().tolist() == [e for e in each if e is not pd.NA] * 400


def test_packed_frames_give_the_same_results(spark):
    rng = np.random.default_rng(5)
    sizes = [(64, 1), (64, 30), (7, 5), (20, 40), (64, 64)]
    rows = [(i, rng.integers(0, 256, w * h, dtype=np.uint8).tobytes(), w, h) for i, (w, h) in enumerate(sizes)]
    df = spark.createDataFrame(rows, "id int, packed binary, width int, height int")
    df = df.withColumn("grey", frames.bytes_to_grey("packed"))
    plain = ev.describe(df, content="packed", prefix="p_")
    both = ev.describe(plain, grey="packed", content="packed", prefix="q_", packed=True)
    for row in both.collect():
        for name in ("average", "difference", "dct", "wavelet", "vector"):
            assert row["p_" + name] == row["q_" + name] is not None
    w, h = F.col("width"), F.col("height")
    changed = df.select(
        frames.altered(F.col("packed"), w, [frames.brighter(30), frames.marked(), frames.turned]).alias("got"),
        F.array(*map(frames.grey_to_bytes, (
            frames.brightness(F.col("grey"), 30), frames.watermark(F.col("grey"), w, h), F.reverse("grey")))).alias("want"),
    )
    assert all(row["got"] == row["want"] for row in changed.collect())


def test_copies_of_long_batches_go_out_in_parts():
    data = pd.Series([b"ab" * 700_000, None, b"", b"xyz", b"q" * 1_500_000, b"r" * 900_000])
    parts = list(frames._slices(data))
    assert len(parts) == 3 and [c for p in parts for c in p] == data.tolist()


def test_frames_and_their_copies_share_a_worker(spark):
    contents = [bytes(range(64)) * 3, b"\xfe" * 64, b"a" * 6400]
    df = spark.createDataFrame([(i, c, c, 64, len(c) // 64) for i, c in enumerate(contents)],
                               "id int, content binary, grey binary, width int, height int")
    changes = {"brighter": frames.brighter(30), "reversed": frames.turned}
    pairs = ev.described_copies(df, changes)
    assert physical(pairs).count("ArrowEvalPython") == 2
    got = {(r["id"], r["variant"]): r for r in pairs.collect()}
    assert len(got) == len(contents) * len(changes)
    for kind, change in changes.items():
        copies = [(i, change(np.frombuffer(c, np.uint8), 64).tobytes(), 64, len(c) // 64) for i, c in enumerate(contents)]
        alone = ev.describe(spark.createDataFrame(copies, "id int, grey binary, width int, height int"), content="grey", prefix="b_", packed=True)
        for row in alone.collect():
            assert all(got[row["id"], kind][c] == row[c] for c in alone.columns if c.startswith("b_"))
