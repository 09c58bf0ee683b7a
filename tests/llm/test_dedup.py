import collections

import numpy as np
from brute import edited, mixed_texts, prose, rooted, words
from pyspark.sql import functions as F

from chainwitness.llm import embedding_dedup, jaccard_join, line_dedup, lm_scoring, substring_dedup
from chainwitness.llm.common import identified
from chainwitness.llm.components import components


def test_components_of_paths_and_stars(spark, documents):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    nodes = {n for e in edges for n in e}
    assert dict(map(tuple, found.collect())) == rooted(nodes, edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _removed(texts, window):
    found = {i: words(t) for i, t in texts}
    uses = collections.Counter(tuple(w[s:s + window]) for w in found.values() for s in range(len(w) - window + 1))
    out = {}
    for i, w in found.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if uses[tuple(w[s:s + window])] > 1:
                gone[s:s + window] = [True] * window
        out[i] = len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()
    return out


def test_substring_dedup_equals_its_definition(documents):
    passage = prose(500, 50)
    texts = mixed_texts() + [(100 + i, f"{prose(200 + i, 40)} {passage} {prose(300 + i, 30)}") for i in range(5)]
    texts += [(200, prose(7, 30) + " z " * 80), (201, "z " * 36 + prose(8, 50)), (202, "p q " * 50), (203, "p q " * 17)]
    kept = substring_dedup.remove_repeats(identified(documents(texts)))
    found = {r["_id"]: (r["_n_words"], r["_n_removed"], r["_kept"]) for r in kept.collect()}
    assert found == _removed(texts, 35)


def test_substring_dedup_of_repeated_rows_and_none(documents):
    rows = [(1, prose(1, 40)), (1, prose(1, 40)), (None, prose(2, 40)), (2, prose(3, 34)), (3, prose(3, 34))]
    found = substring_dedup.remove_repeats(identified(documents(rows).withColumn("_text", F.lit(1)))).collect()
    assert sorted(r["_n_removed"] for r in found) == [0, 0, 0, 40, 40]
    assert substring_dedup.remove_repeats(identified(documents([]))).count() == 0


def test_recompression_names_depend_on_content_alone():
    rng = np.random.default_rng(3)
    shared = rng.integers(1, 50, 60).astype(np.uint64)
    a = np.concatenate((rng.integers(1, 50, 37).astype(np.uint64), shared))
    b = np.concatenate((rng.integers(1, 50, 11).astype(np.uint64), shared, rng.integers(1, 50, 20).astype(np.uint64)))
    inside = []
    for x, at in ((a, 37), (b, 11)):
        names, _, low, high = substring_dedup.symbols(x, np.zeros(len(x), int))
        fits = (low >= at) & (high <= at + 60)
        inside.append(list(zip(names[fits], low[fits] - at, high[fits] - at)))
    assert inside[0] and inside[0] == inside[1]


def _links(texts):
    sets = {}
    for i, t in texts:
        w = words(t, lower=True)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, links


def test_jaccard_join_equals_all_pairs(documents):
    base = [prose(i, 150, 5000) for i in range(3)]
    texts = mixed_texts() + [(100 + i, edited(base[i % 3], i, 0.002 * i)) for i in range(30)]
    texts += [(200, "ONE two three"), (201, "one Two three"), (202, "one two"), (203, "É x"), (204, "é x")]
    found = {r["_id"]: r for r in jaccard_join.linked(identified(documents(texts))).collect()}
    sets, links = _links(texts)
    roots = rooted(sets, links)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == {i: (len(sets[i]), roots[i]) for i in sets}
    assert {i for i, r in found.items() if r["kept"]} == set(roots.values())


def test_a_link_of_exactly_the_threshold_counts(documents):
    a = prose(1, 94, 10**6).split(" ")  # 90 shingles
    texts = [(1, " ".join(a)), (2, " ".join(a[:89] + ["y"] * 5)), (3, " ".join(a[:76] + prose(9, 18, 10**6).split(" ")))]
    sets, links = _links(texts)
    found = {r["_id"]: r["component_id"] for r in jaccard_join.linked(identified(documents(texts))).collect()}
    assert found == rooted(sets, links)


def test_jaccard_join_of_odd_rows(documents):
    text = prose(5, 30)
    rows = [(None, text), (4, text), (4, text), (5, None), (5, ""), (None, " ")]
    found = jaccard_join.linked(identified(documents(rows).withColumn("row", F.lit(1)))).collect()
    assert sorted((str(r["_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in found) == sorted([
        ("None", 26, "4", False), ("4", 26, "4", True), ("4", 26, "4", False),
        ("5", 0, "5", True), ("5", 0, "5", True), ("None", 0, "None", True),
    ])
    assert jaccard_join.linked(identified(documents([]))).count() == 0


def _distance_at_most_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _kept_lines(texts):
    places, out = {}, {}
    for i, t in sorted((x for x in texts if x[1] is not None), key=lambda x: x[0]):
        for n, line in enumerate(t.split("\n")):
            if words(line):
                places.setdefault(tuple(words(line, lower=True)), (i, n))
    first = sorted(places, key=places.get)
    near = {b for k, b in enumerate(first) for a in first[:k] if min(len(a), len(b)) >= 10 and _distance_at_most_one(a, b)}
    for i, t in texts:
        out[i] = None if t is None else "\n".join(
            x for n, x in enumerate(t.split("\n"))
            if not words(x) or (places[key := tuple(words(x, lower=True))] == (i, n) and key not in near))
    return out


def test_line_dedup_equals_all_pairs(documents):
    line = prose(1, 14)
    w = line.split(" ")
    lines = [line, line.upper(), " ".join(w[:5] + ["new"] + w[6:]), " ".join(w[:5] + w[6:]), " ".join(w + ["more"]),
             " ".join(["start"] + w), " ".join(w[1:] + ["end"]), "  " + line + "\t", " ".join(w[:9]), " ".join(w[:10]), "",
             "w w w w w w w w w w", "w w w w w w w w w w w", "short line", "short lines", "short line"]
    texts = [(i, "\n".join(lines[i::5] + [prose(50 + i, 12)])) for i in range(5)] + mixed_texts()[9:20]
    texts = [(n, t) for n, (_, t) in enumerate(texts)] + [(90, None), (91, ""), (92, "\n\n"), (93, "a\r\nb\n" + line)]
    kept = line_dedup.remove_lines(identified(documents(texts).withColumn("_lines", F.lit(1))))
    assert {r["_id"]: r["_kept"] for r in kept.collect()} == _kept_lines(texts)


def test_line_dedup_of_repeated_rows_and_none(documents):
    rows = [(1, "same line"), (1, "same line"), (2, "same line"), (None, "Same  LINE")]
    found = line_dedup.remove_lines(identified(documents(rows))).collect()
    assert sorted((str(r["_id"]), r["_kept"]) for r in found) == [
        ("1", ""), ("1", ""), ("2", ""), ("None", "Same  LINE")]
    assert line_dedup.remove_lines(identified(documents([]))).count() == 0


def test_embedding_links_equal_all_pairs(spark, documents):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    points = np.concatenate([c + rng.normal(size=(25, 16)) * s for c, s in zip(centres, np.linspace(0, 0.4, 12))])
    points = np.concatenate((points, 2 * points[:5], points[:7], rng.normal(size=(60, 16)))).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(points)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None]),
           (1005, [float("inf")] * 16), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("unit", F.lit(0))
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    roots = rooted(range(len(points)), zip(*np.nonzero(close)))
    expected = {i: (int(close[i].sum()), roots[i]) for i in range(len(points))} | {i: (0, i) for i, _ in odd}
    expected |= {1006: (1, 1006), 1007: (1, 1006)}
    for block in (2048, 40):
        found = embedding_dedup.linked(frame, block=block).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == expected
        assert {r["vec_id"] for r in found if r["kept"]} == {i for i, (_, c) in expected.items() if i == c}
    assert embedding_dedup.linked(frame.limit(0)).count() == 0


def test_cover_trees_rule_out_no_near_pair():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(size=(30, 3)) * 0.05 for c in rng.normal(size=(8, 3))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = x[::2], x[1::2]
    trees = [embedding_dedup.cover_tree(p, 2.0, 0.1) for p in (a, b)]
    at, bt = embedding_dedup.dual_traversal(a, trees[0], b, trees[1], 0.2)
    i, j = np.nonzero(np.linalg.norm(a[:, None] - b[None], axis=2) <= 0.2)
    assert set(i) <= set(at) and set(j) <= set(bt) and len(trees[0]) > 2


def test_embedding_blocks_are_not_shuffled_for_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(150, 24)).astype(np.float32)
    points[100:] = points[:50] + rng.normal(size=(50, 24)).astype(np.float32) / 50
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id bigint, embedding array<float>")
    plans, plain = {}, embedding_dedup.stage

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(embedding_dedup, "stage", noted)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = embedding_dedup.linked(frame, block=10).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sorted((r["vec_id"], r["component_id"]) for r in found) == [(i, i % 100) for i in range(150)]
    assert "hashpartitioning" in plans["blocks"] and "hashpartitioning" not in plans["links"]


def test_each_pair_of_near_blocks_comes_once(spark):
    cells = {0: [0, 1], 1: [0, 1, 2], 2: [1, 2], 3: [3]}
    blocks = [(c, b) for c, n in enumerate((3, 1, 4, 2)) for b in range(n)]
    stored = spark.createDataFrame([(8, c, b) for c, b in blocks], "size int, cell bigint, block int").repartition(3)
    near = spark.createDataFrame(list(cells.items()), "cell bigint, near array<bigint>")
    pairs = embedding_dedup._pairs(stored, near, 1).collect()
    met = [tuple(sorted(((r["cell_a"], r["block_a"]), (r["cell_b"], r["block_b"])))) for r in pairs]
    assert sorted(met) == sorted((x, y) for x in blocks for y in blocks if x <= y and y[0] in cells[x[0]])


def test_leading_directions_rule_out_no_near_pair(spark):
    rng = np.random.default_rng(3)
    for size in (3, 40):
        x = rng.normal(size=(12, size))[rng.integers(12, size=90)] + rng.normal(size=(90, size)) * 0.1 + 0.5
        nodes = spark.createDataFrame([(i, bytes([i]), v.tobytes()) for i, v in enumerate(x)], "node bigint, key binary, vector binary")
        units = embedding_dedup._units(x)
        for sample in (embedding_dedup._Sample(nodes, 20, np.float64), embedding_dedup._Sample(nodes.limit(0), 20, np.float64)):
            left, right = sample.leading(units)
            assert (left @ right.T >= units @ units.T - 1 - embedding_dedup._ROUNDED).all()


def _staged(monkeypatch, module):
    """Records the number of rows of each staged table."""
    counts, plain = collections.defaultdict(list), module.stage

    def counted(df, name):
        found = plain(df, name)
        counts[name].append(found.count())
        return found

    monkeypatch.setattr(module, "stage", counted)
    return counts


def test_near_texts_of_many_equal_rows_are_one_pair(documents, monkeypatch):
    counts = _staged(monkeypatch, jaccard_join)
    a = prose(1, 200, 5000)
    b = edited(a, 3, 0.01)
    found = jaccard_join.linked(identified(documents([(1, a), (2, b)] * 200))).collect()
    assert len(found) == 400 and {r["component_id"] for r in found} == {1} and sum(r["kept"] for r in found) == 1
    assert max(counts["texts"]) == 2 and max(counts["links"]) == 1


def test_near_lines_of_many_equal_rows_are_one_pair(documents, monkeypatch):
    counts = _staged(monkeypatch, line_dedup)
    line = prose(1, 14)
    found = line_dedup.remove_lines(identified(documents([(1, line), (2, line + " more")] * 200))).collect()
    assert collections.Counter((r["_id"], r["_kept"]) for r in found) == {(1, line): 200, (2, ""): 200}
    assert counts["lines"] == [2] and counts["near"] == [1]


def test_near_lines_are_found_without_moving_whole_texts(documents, monkeypatch):
    plans, plain = {}, line_dedup.stage

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(line_dedup, "stage", noted)
    line = prose(1, 14)
    rows = documents([(1, line), (2, prose(2, 300) + "\n" + line + " more"), (3, prose(3, 14))])
    removed = {r["_id"]: r["_n_removed"] for r in line_dedup.remove_lines(identified(rows)).collect()}
    assert removed == {1: 0, 2: 1, 3: 0}
    assert "Join" not in plans["lines"] and "_hash" not in plans["met"]


def _same_short_hash(spark):
    """Two texts of different length that one 32-bit hash cannot tell apart."""
    text = F.concat(F.expr("repeat('word ', cast(id % 7 as int))"), F.lit("n"), "id")
    rows = spark.range(500_000).select(text.alias("t"), F.hash(text).alias("h"))
    pair = rows.groupBy("h").agg(F.min(F.struct(F.length("t"), "t")).alias("a"), F.max(F.struct(F.length("t"), "t")).alias("b"))
    found = pair.where("size(split(a.t, ' ')) <> size(split(b.t, ' '))").select("a.t", "b.t").first()
    return tuple(found)


def test_texts_under_one_id_are_told_apart(spark, documents):
    a, b = _same_short_hash(spark)
    rows = [(5, a), (5, b), (None, a), (None, b), (5, None), (5, "")]
    keys = identified(documents(rows)).select("_id", "_hash").distinct().count()
    assert keys == 6
    scored = lm_scoring.score(identified(documents(rows))).collect()
    n = [len(words(t)) + 1 for _, t in rows]
    assert sorted((str(r["_id"]), r["n_tokens"]) for r in scored) == sorted((str(i), k) for (i, _), k in zip(rows, n))
    kept = line_dedup.remove_lines(identified(documents(rows))).where("_id = 5").collect()
    assert sorted(str(r["_kept"]) for r in kept) == sorted(["", "", "", "None"])  # null ids come first


def test_texts_and_their_spans_are_kept_once(documents):
    rows = [(i, " ".join(f"w{(i % 3) * 50 + k}" for k in range(60))) for i in range(6)]
    kept = substring_dedup.remove_repeats(identified(documents(rows)))
    read = {name.split("/")[-2].rsplit("-", 1)[0] for name in kept.inputFiles()}
    assert read == {"texts", "windows"}  # the table itself is not read and dealt out again
