"""Nearest neighbours against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainwitness.operators.nearest import nearest


def brute(rows, asks, k):
    """Every query against every row, from the definition."""
    sound = [(i, x) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    out = {}
    for q, x in sound:
        if asks(q):
            best = out.setdefault(q, {})
            for i, y in sound:
                if i != q and len(x) == len(y):
                    d = round(float(np.linalg.norm(np.array(x) - np.array(y))), 9)
                    best[i] = min(d, best.get(i, np.inf))
    return {(q, r + 1): (i, d) for q, best in out.items() for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k])}


def found(df):
    return {(r["query_id"], r["rank"]): (r["id"], pytest.approx(r["distance"], abs=1e-8)) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(3)


def test_equals_all_pairs_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 8)) * 5
    points = np.concatenate([c + rng.normal(size=(40, 8)) for c in centres])
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(1000 + i, [1.0] * 8) for i in range(300)]  # one vector under many ids: ties go to the smallest id
    rows += [(2000, [0.0, 1.0]), (2010, [5.0, 1.0]), (2020, [1.0])]  # other lengths
    rows += [(None, [1.0] * 8), (3000, None), (3010, []), (3020, [float("nan")] * 8), (3030, [None] * 8), (3040, [float("inf")] * 8)]
    rows += [(0, points[0].tolist())] * 30 + [(1000, [1.0] * 8)] * 200 + [(20, points[7].tolist())]  # repeated ids
    for pivots in (16, 1):
        df = nearest(frame(spark, rows).withColumn("cell", F.lit("x")), F.col("id") % 10 == 0, 5, pivots=pivots)
        assert found(df) == brute(rows, lambda q: q % 10 == 0, 5)


def test_fewer_than_k_and_none(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])]
    assert found(nearest(frame(spark, rows), F.col("id") == 1, 10)) == {(1, 1): (3, 1.0), (1, 2): (2, 5.0)}
    assert nearest(frame(spark, []), F.col("id") == 1).count() == 0


def test_queries_are_dealt_out_in_small_parts():
    """What a task holds does not grow with the queries of a batch."""
    from chainwitness.operators import nearest as module

    rng = np.random.default_rng(6)
    n, at = 500, rng.normal(size=(64, 4))
    vectors = pa.array(rng.normal(size=(n, 4)).tolist(), pa.list_(pa.float64()))
    whole = pa.record_batch([pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([0.0] * n), vectors, pa.array([np.inf] * n)],
                            names=["id", "cell", "gap", "vector", "limit"])
    parts = list(module._reached([whole], {4: (0, at)}, np.array([[0.0, 9.0]] * 64)))
    assert sum(p.num_rows for p in parts) == n * 63 and max(p.num_rows for p in parts) <= 64 * 63
    rows = pa.Table.from_batches(parts).select(["id", "vector"]).to_pylist()
    assert all(r["vector"] == vectors[r["id"]].as_py() for r in rows[::97])


def test_far_cells_are_not_met(spark, monkeypatch):
    """Clusters far apart: a query meets the blocks of its own cluster only."""
    from chainwitness.operators import nearest as module

    met, plain = [], module._other_cells

    def counted(*args):
        other = plain(*args)
        met.append(other.count())
        return other

    monkeypatch.setattr(module, "_other_cells", counted)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + 1000 * (i % 6)).tolist()) for i in range(600)]
    df = module.nearest(frame(spark, rows), F.col("id") % 100 == 0, 3, pivots=60)
    assert found(df) == brute(rows, lambda q: q % 100 == 0, 3)
    assert met[0] <= 6 * 25
