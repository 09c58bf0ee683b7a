"""Fuzzy near-duplicate classes, edit distances and components against their definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import digests
from chainwitness.operators import fuzzy
from chainwitness.operators.components import components

DIGEST = "struct<block_size:bigint,h1:string,h2:string>"


def edits(s, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def score(a, b):
    """From the definition; 0 where a digest is not whole."""
    if not all(x and x[0] is not None and x[1] and x[2] for x in (a, b)) or a[0] not in (b[0], 2 * b[0]) and 2 * a[0] != b[0]:
        return 0
    return max(int(np.floor((1 - edits(a[k], b[k]) / max(len(a[k]), len(b[k]))) * 100 + 0.5)) for k in (1, 2))


def brute(rows, threshold):
    near = [[j for j in range(len(rows)) if j != i and score(rows[i][1], rows[j][1]) >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def altered(rng, text, n):
    letters = list(text)
    for _ in range(n):
        at = rng.randrange(len(letters) + 1)
        letters[at:at + rng.randrange(2)] = rng.choice(V.FUZZY_ALPHABET) * rng.randrange(2)
    return "".join(letters) or "A"


def mixed_rows(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices(V.FUZZY_ALPHABET, k=n))
    seeds = [(rng.choice((3, 6, 12, 24)), word(rng.choice((1, 2, 5, 9, 15, 31, 60, 64, 70))), word(rng.choice((1, 4, 12, 30)))) for _ in range(14)]
    rows = []
    for size, h1, h2 in seeds:
        for _ in range(rng.randrange(1, 9)):
            rows.append((rng.choice((size, size, 2 * size)), altered(rng, h1, rng.randrange(8)), altered(rng, h2, rng.randrange(5))))
    rows += [seeds[0]] * 5 + [(3, "A" * 50, "A" * 20), (3, "A" * 45, "A" * 25), (3, "AB" * 20, "BA" * 9), (6, "AB" * 19, "C")]
    rows = [(10 + i, r) for i, r in enumerate(rows)]
    rows += [(1, (3, None, "a")), (2, (None, "ab", "ab")), (3, None), (4, (3, "", "")), (None, seeds[1]), (None, (999, "zz", "yy")), (5, seeds[0]), (5, seeds[0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("threshold", [50, 66, 80, 92, 100])
def test_equals_all_pairs(spark, threshold):
    rows = mixed_rows(threshold)
    df = spark.createDataFrame([(i, d, 1) for i, d in rows], f"id bigint, digest {DIGEST}, node int").repartition(3)
    found = fuzzy.fuzzy_classes(df, threshold, block=4)
    assert found.columns == ["id", "n_links", "class_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, threshold)


def test_no_rows_and_bad_thresholds(spark):
    empty = spark.createDataFrame([], f"id bigint, digest {DIGEST}")
    assert fuzzy.fuzzy_classes(empty).collect() == []
    with pytest.raises(ValueError):
        fuzzy.fuzzy_classes(empty, 0)


def test_blocks_not_pairs_of_a_large_group(spark):
    """Hundreds of digests that share their segments meet in blocks of bounded size and give few rows."""
    rng = random.Random(3)
    base = "".join(rng.choices(V.FUZZY_ALPHABET, k=60))
    made = {base[:p] + c + base[p + 1:] for p in range(40) for c in "abcdefgh"}
    rows = [(i, (3, h, "x" * 30)) for i, h in enumerate(sorted(made))]
    df = spark.createDataFrame(rows, f"id bigint, digest {DIGEST}").select("id", "digest.*")
    texts = df.select(F.col("id").alias("node"), F.col("block_size").alias("size"), "h1", "h2", F.lit(1).cast("bigint").alias("n"))
    rule = fuzzy._Rule(80)
    blocks = fuzzy._packed(fuzzy._keyed(texts, rule), 64).cache()
    assert blocks.agg(F.max(F.size("node"))).first()[0] <= 64
    found = fuzzy._compared(blocks, rule).cache()
    assert found.groupBy("node").agg(F.sum("n").alias("n")).agg(F.min("n"), F.max("n")).first()[:] == (len(made) - 1,) * 2
    assert found.count() < 12 * len(made)


def test_unrelated_digests_are_left_out_of_blocks(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices(V.FUZZY_ALPHABET, k=n))
    rows = [(i, 3, word(60), word(30), 1) for i in range(300)]
    texts = spark.createDataFrame(rows, "node bigint, size bigint, h1 string, h2 string, n bigint")
    rule = fuzzy._Rule(80)
    keyed = fuzzy._keyed(texts, rule)
    blocks = fuzzy._packed(keyed, 128)
    assert blocks.count() < keyed.count() / 20


def test_edit_distances():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdeé", k=n))
    for longest in (10, 64, 200):
        pairs = [(word(rng.randrange(longest + 1)), word(rng.randrange(longest + 1))) for _ in range(80)]
        pairs += [(w, altered(rng, w, 3)) for w, _ in pairs]
        assert fuzzy.edit_distances(*zip(*pairs)).tolist() == [edits(s, t) for s, t in pairs]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5000, i) for i in range(200, 400)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)]
    edges += [(7, 7), (None, 3), (100, 101)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in components(df).collect()} == {v: root(v) for v in parent}
    assert components(df.where("a < 0")).count() == 0


def test_digests_side_by_side(spark):
    """Many contents of one batch, more and fewer than go side by side."""
    from test_similarity import fuzzy_by_definition

    rng = random.Random(7)
    contents = [rng.randbytes(rng.choice((0, 1, 7, 40, 300, 900))) for _ in range(2 * digests.SIDE_BY_SIDE)] + [rng.randbytes(4000)] * 3 + [None]
    df = spark.createDataFrame(list(enumerate(contents)), "i int, c binary").coalesce(1)
    for r in df.select("i", digests.fuzzy_digest("c").alias("f")).collect():
        expected = (None,) * 3 if contents[r["i"]] is None else fuzzy_by_definition(contents[r["i"]])
        assert tuple(r["f"]) == expected


def test_a_segment_in_common_far_apart_makes_no_block(spark):
    """Digests that all hold a segment of one of them, but of sizes or at places that no link allows, do not meet under it."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices(V.FUZZY_ALPHABET, k=n))
    places = [(3, 0)] + [(size, p) for size in (3, 12, 48, 192) for p in (20, 29, 38, 44, 52)]  # only the first begins with a segment
    rows = [(size, word(p) + "QQQQ" + word(56 - p), word(30)) for size, p in places]
    texts = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "node bigint, size bigint, h1 string, h2 string, n bigint")
    blocks = fuzzy._packed(fuzzy._keyed(texts, fuzzy._Rule(80)), 128)
    assert blocks.where(F.size("node") > 5).count() == 0


def test_blocks_of_a_common_key_are_shared_out(spark):
    blocks = [(key, long, i, i, [1000 * key + i]) for key, n in ((1, 9), (2, 1), (3, 40)) for long in (True, False) for i in range(n)]
    frame = spark.createDataFrame(blocks, "key bigint, long boolean, size_from bigint, at_from int, node array<bigint>")
    short, long = fuzzy._shared_out(frame, 4)
    assert sorted(r["node"][0] for r in short.collect()) == sorted(b[4][0] for b in blocks if not b[1])
    met = short.alias("s").join(long.alias("l"), ["key", "share"]).groupBy("key", "share").count().collect()
    by_key = {key: [r["count"] for r in met if r["key"] == key] for key in (1, 2, 3)}
    assert {key: sum(found) for key, found in by_key.items()} == {1: 81, 2: 1, 3: 1600}
    assert len(by_key[3]) > 5 and max(by_key[3]) < 1600 / 3


@pytest.mark.parametrize("threshold", [60, 80, 90])
def test_equals_all_pairs_with_few_letters(spark, threshold, monkeypatch):
    """Segments that stand at many places, and in one digest several times."""
    monkeypatch.setattr(fuzzy, "SHORTS", 1)
    rng = random.Random(threshold)
    rows = []
    for k, n in ((1, 40), (2, 12), (2, 33), (3, 60), (3, 64)):
        base, other = ("".join(rng.choices("aéZ"[:k], k=m)) for m in (n, n // 2))
        for _ in range(14):
            h1 = altered(rng, base, rng.randrange(9)).replace("+", "a")
            at = rng.randrange(4)
            rows.append((rng.choice((3, 6, 12)), h1[at:] + h1[:at], altered(rng, other, rng.randrange(3))))
    rows = [(i, r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, f"id bigint, digest {DIGEST}").repartition(3)
    assert sorted(map(tuple, fuzzy.fuzzy_classes(df, threshold, block=4).collect()), key=repr) == brute(rows, threshold)
