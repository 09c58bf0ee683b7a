"""Exact nearest neighbours of a stated set of query vectors, by distances to pivots.

Every vector belongs to the cell of its nearest pivot and lies in a ring around it. Within a
partition the vectors of a cell are packed into blocks by their distance from the pivot, so
a block is a narrow ring. By the triangle inequality a vector is no nearer to a query than the
two distances to a common pivot differ. Each query first meets the blocks of its own cell; the
k-th distance found there bounds the rings of the other cells that it has to meet.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainwitness.session import stage

PIVOTS = 128
BLOCK_ROWS, PACK_ROWS = 128, 32
AT_ONCE = 32  # queries that are dealt out to other cells, and pairs of blocks that are compared, before their rows go on
DECIMALS = 9
_CELLED = "id bigint, cell int, gap double, vector array<double>"
_PACKED = "cell int, low double, high double, ids array<bigint>, vectors array<double>, gaps array<double>, limits array<double>"
_FOUND = "query_id bigint, id bigint, distance double"


def _lists(parts, of):
    stops = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(stops, pa.array(np.concatenate(parts) if parts else [], of))


def _matrices(column):
    """The lists of a column as arrays, without a Python object per number."""
    numbers, stops = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [numbers[a:b] for a, b in zip(stops[:-1], stops[1:])]


def _pivots(rows, n):
    """Up to ``n`` vectors picked by hash; they decide the work, never the result."""
    picked = rows.select("vector").orderBy(F.xxhash64("vector")).limit(n).collect()
    by_size = {}
    for (vector,) in picked:
        by_size.setdefault(len(vector), []).append(vector)
    pivots, first = {}, 0
    for size, vectors in sorted(by_size.items()):
        vectors = np.unique(np.array(vectors), axis=0)
        pivots[size] = first, vectors
        first += len(vectors)
    return pivots


def _distances(x, y):
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))


def _to_cells(rows, pivots):
    """``cell`` and ``gap``: nearest pivot and distance; a length without a pivot is one cell (-length)."""
    schema = pa.schema([("id", pa.int64()), ("cell", pa.int32()), ("gap", pa.float64()), ("vector", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            vectors = _matrices(batch.column("vector"))
            cells, gaps = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            for row, vector in enumerate(vectors):
                if len(vector) in pivots:
                    first, at = pivots[len(vector)]
                    apart = _distances(vector[None], at)[0]
                    cells[row], gaps[row] = first + apart.argmin(), apart.min()
                else:
                    cells[row] = -len(vector)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cells), pa.array(gaps), batch.column("vector")], schema=schema)

    return rows.mapInArrow(run, _CELLED)


def _packed(rows, size):
    """Blocks of at most ``size`` rows of one cell and one partition, in order of ``gap``; nothing is shuffled."""
    schema = pa.schema([("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.list_(pa.int64())),
                        *((n, pa.list_(pa.float64())) for n in ("vectors", "gaps", "limits"))])

    def block(rows):
        ids, vectors, gaps, limits = zip(*(r[1:] for r in rows))
        return rows[0][0], min(gaps), max(gaps), list(ids), np.concatenate(vectors), list(gaps), list(limits)

    def made(blocks):
        cell, low, high, ids, vectors, gaps, limits = zip(*blocks)
        floats = [_lists(x, pa.float64()) for x in (vectors, gaps, limits)]
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(low), pa.array(high), _lists(ids, pa.int64()), *floats], schema=schema)

    def run(batches):
        held = []
        for batch in batches:
            blocks = []
            columns = [batch.column(c).to_pylist() for c in ("cell", "id")]
            columns += [_matrices(batch.column("vector")), *(batch.column(c).to_pylist() for c in ("gap", "limit"))]
            for row in zip(*columns):
                if held and (held[0][0] != row[0] or len(held) == size):
                    blocks.append(block(held))
                    held = []
                held.append(row)
            if blocks:
                yield made(blocks)
        if held:
            yield made([block(held)])

    return rows.select(*("cell", "id", "vector", "gap"), "limit").sortWithinPartitions("cell", "gap").mapInArrow(run, _PACKED)


def _met(packs, blocks, k):
    """The ``k`` nearest ids that each query of a pack finds in each block."""
    asked = packs.select("cell", *(F.col(c).alias("q_" + c) for c in ("ids", "vectors", "gaps", "limits")),
                         F.array_min(F.zip_with("gaps", "limits", lambda g, x: g - x)).alias("near"),
                         F.array_max(F.zip_with("gaps", "limits", lambda g, x: g + x)).alias("far"))
    pairs = asked.join(blocks.drop("gaps", "limits"), "cell").where("high >= near and low <= far").drop("near", "far")
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def run(batches):
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            low, high = (batch.column(c).to_pylist() for c in ("low", "high"))
            lists = (_matrices(batch.column(c)) for c in ("q_ids", "q_vectors", "q_gaps", "q_limits", "ids", "vectors"))
            for low, high, queries, x, gaps, limits, ids, y in zip(low, high, *lists):
                x, y = x.reshape(len(queries), -1), y.reshape(len(ids), -1)
                meets = (gaps - limits <= high) & (gaps + limits >= low)
                apart = np.round(_distances(x[meets], y), DECIMALS)
                for query, row, limit in zip(queries[meets], apart, limits[meets]):
                    order = np.lexsort((ids, row))
                    order = order[(ids[order] != query) & (row[order] <= limit)]
                    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]  # an id counts once
                    out[0].append(np.full(len(first), query))
                    out[1].append(ids[order[first]])
                    out[2].append(row[order[first]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)

    found = pairs.mapInArrow(run, _FOUND)
    return found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))


def _best(found, k):
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reached(batches, pivots, rings):
    """The rows of ``_other_cells``; a query may become a row for each pivot, so batches go out in small parts."""
    schema = pa.schema([("id", pa.int64()), ("cell", pa.int32()), ("gap", pa.float64()), ("vector", pa.list_(pa.float64())), ("limit", pa.float64())])
    for whole in batches:
        for batch in (whole.slice(at, AT_ONCE) for at in range(0, whole.num_rows, AT_ONCE)):
            rows = [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("id", "cell", "limit"))
            for id_, home, limit, vector in zip(*columns, _matrices(batch.column("vector"))):
                if len(vector) not in pivots:
                    continue
                first, at = pivots[len(vector)]
                apart = _distances(vector[None], at)[0]
                ring = rings[first:first + len(at)]
                meets = np.flatnonzero((apart - limit <= ring[:, 1]) & (apart + limit >= ring[:, 0]) & (np.arange(len(at)) + first != home))
                for cell in meets:
                    for column, value in zip(rows, (id_, first + cell, apart[cell], vector, limit)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.float64()),
                                              _lists(rows[3], pa.float64()), pa.array(rows[4], pa.float64())], schema=schema)


def _other_cells(queries, pivots, rings):
    """Each query once for every other cell whose ring reaches within its ``limit``."""
    return queries.mapInArrow(lambda batches: _reached(batches, pivots, rings), _CELLED + ", limit double")


def nearest(rows: DataFrame, is_query, k=10, id_col="id", vector_col="vector", pivots=PIVOTS) -> DataFrame:
    """The ``k`` nearest vectors (Euclid) of every row for which ``is_query`` holds, exactly.

    Result: ``query_id``, ``rank`` from 1, ``id``, ``distance`` (to nine decimals; so compared, ties to the
    smallest id). For cosine pass unit vectors. Rows of the query's own id are not its neighbours; an
    id that repeats counts once, by its nearest vector, and a repeated query by the nearest of its vectors.
    Rows without an id, and vectors that are null, empty or hold null or non-finite numbers take no
    part; only vectors of one length are compared. Fewer than ``k`` others: all of them. Broadcast are
    ``pivots`` vectors and as many rings. Further columns may bear any name.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = F.size(x) > 0
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col(id_col).isNotNull() & F.coalesce(sound & ~bad, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"), x.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    pivots = _pivots(rows, pivots)
    celled = _to_cells(rows.select("id", "vector"), pivots)
    everywhere = F.lit(float("inf"))
    blocks = stage(_packed(celled.withColumn("limit", F.lit(0.0)), BLOCK_ROWS), "vector-blocks")
    rings = np.full((sum(len(v) for _, v in pivots.values()), 2), [np.inf, -np.inf])
    for cell, low, high in blocks.where("cell >= 0").groupBy("cell").agg(F.min("low"), F.max("high")).collect():
        rings[cell] = low, high
    queries = stage(_to_cells(rows.where("asks").select("id", "vector"), pivots), "query-vectors")
    home = stage(_met(_packed(queries.withColumn("limit", everywhere), PACK_ROWS), blocks, k), "home-neighbours")
    bound = _best(home, k).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("distance").alias("bound"))
    slack = F.col("bound") * (1 + 1e-9) + 10.0 ** (1 - DECIMALS)
    limited = queries.join(bound, F.col("id") == F.col("q"), "left").select("id", "cell", "gap", "vector", F.coalesce(slack, everywhere).alias("limit"))
    away = _met(_packed(_other_cells(limited, pivots, rings), PACK_ROWS), blocks, k)
    both = home.union(away).groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return _best(both, k).select("query_id", "rank", "id", "distance")
