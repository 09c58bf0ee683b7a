"""Vectors with a cosine of at least a threshold, by dual traversal of cover trees.

Equal directions become one node with a weight. The top level of the tree is a bounded set of
centres, picked farthest first from a sample; every vector belongs to its nearest centre. Below,
each cell, cut into blocks of bounded size, has nested levels with halving radii. Pairs of cells,
then pairs of tree nodes level by level, are dropped when the distance of their centres exceeds
both covering radii and the threshold together; what is left is compared, first in a few leading
directions of the sample, where a distance can only be too small, then exactly. On the unit
sphere a cosine c is the distance sqrt(2 - 2c). Pairs are never emitted: a pair of blocks gives,
for each vector, its number of links and one edge to the smallest vector it is connected with.
Blocks are stored once and never shuffled for a comparison: a task reads some of them against some others.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwitness.llm.common import arrow_rows, stage
from chainwitness.llm.components import components
from chainwitness.session import release

THRESHOLD = 0.95
BLOCK = 2048
SAMPLE = 4096
CELLS = 512
LEADING = 16  # directions that are compared before all
SIDE_BYTES = 32_000_000  # of vectors on either side of a task
HELD_BYTES = 100_000_000  # of unpacked blocks that a task keeps
_SLACK = 1e-9  # covering bounds are rounded; they may only be too wide
_ROUNDED = 1e-4  # of half a squared distance in single precision


def _units(x):
    """Unit vectors of rows that have a direction."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0  # + 0.0: no negative zeros


def _directions(vectors):
    """128-bit name of the direction of every row, and its components as given; null if it has no direction.

    Components stay in single precision if they come so: their unit vector in doubles is made anew where it is needed.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("vector", pa.binary())])
    kind = _kind(vectors.schema["_vector"].dataType)

    def run(batches):
        for batch in batches:
            column = batch.column("_vector")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
            starts = np.cumsum(sizes) - sizes
            keys, given = [None] * len(sizes), [None] * len(sizes)
            for size in set(sizes.tolist()) - {0}:
                rows = np.flatnonzero(sizes == size)
                x = values[starts[rows][:, None] + np.arange(size)]
                sound = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                rows, x = rows[sound], x[sound]
                for row, own, unit in zip(rows.tolist(), x.astype(kind), _units(x)):
                    keys[row], given[row] = hashlib.blake2b(unit.tobytes(), digest_size=16).digest(), own.tobytes()
            yield arrow_rows(schema, batch.column("vec_id"), keys, given)

    return vectors.mapInArrow(run, "vec_id bigint, key binary, vector binary")


def _kind(column):
    """How the components of a column of vectors are stored."""
    return np.float32 if isinstance(column.elementType, T.FloatType) else np.float64


def farthest_first(points, k):
    """Indices of up to ``k`` points, each the farthest from those before: nets of falling radius."""
    chosen, distance = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < k and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        np.minimum(distance, np.linalg.norm(points - points[chosen[-1]], axis=1), out=distance)
    return chosen


def _leading(points):
    """Mean of a sample and the orthonormal directions in which it is spread most."""
    centred = points - points.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return points.mean(axis=0), axes[:, ::-1][:, :LEADING]


class _Sample:
    """Of each dimension the centres of its cells, as many as blocks are needed, up to CELLS, and the leading directions.

    Dimensions that the sample lacks have the origin as centre and as mean, and their first axes.
    """

    def __init__(self, nodes, block, kind):
        n = max(1, nodes.count())
        cells = min(CELLS, max(1, n // block))
        rank = F.xxhash64("key")
        few = nodes.where(rank <= F.lit(min(2**63 - 1, int(2**64 * 2 * SAMPLE / n) - 2**63)))  # about twice as many as are taken
        found = few.orderBy(rank, "node").limit(SAMPLE).select("vector").toArrow().column("vector").to_pylist()
        by_size = {}
        for vector in found:
            by_size.setdefault(len(vector) // np.dtype(kind).itemsize, []).append(np.frombuffer(vector, kind).astype(np.float64))
        units = {size: _units(np.stack(x)) for size, x in by_size.items()}
        self.centres = {size: x[farthest_first(x, cells)] for size, x in units.items()}
        self.axes = {size: _leading(x) for size, x in units.items()}

    def centres_of(self, size):
        return self.centres.get(size, np.zeros((1, size)))

    def leading(self, points):
        """Single-precision rows whose product is minus half of a squared distance that no pair of ``points`` falls short of."""
        mean, axes = self.axes.get(points.shape[1], (0.0, np.eye(points.shape[1], LEADING)))
        centred = points - mean
        led = centred @ axes
        rest = np.sqrt(np.maximum(0, (centred * centred).sum(axis=1) - (led * led).sum(axis=1)))
        led = np.column_stack((led, rest))
        half, one = -(led * led).sum(axis=1) / 2, np.ones(len(led))
        return np.column_stack((led, half, one)).astype(np.float32), np.column_stack((led, one, half)).astype(np.float32)


def _assigned(nodes, shared, kind):
    """Dimension and cell of each node."""
    schema = pa.schema([
        ("node", pa.int64()), ("key", pa.binary()), ("vector", pa.binary()), ("weight", pa.int64()), ("size", pa.int32()), ("cell", pa.int32()),
    ])

    def run(batches):
        for batch in batches:
            vectors = [np.frombuffer(v, kind) for v in batch.column("vector").to_pylist()]
            sizes, cells = np.array([len(v) for v in vectors], np.int32), np.zeros(len(vectors), np.int32)
            for size in set(sizes.tolist()):
                rows = np.flatnonzero(sizes == size)
                x = _units(np.stack([vectors[row] for row in rows]).astype(np.float64))
                cells[rows] = (x @ shared.value.centres_of(size).T).argmax(axis=1)
            yield arrow_rows(schema, *(batch.column(c) for c in ("node", "key", "vector", "weight")), sizes, cells)

    return nodes.select("node", "key", "vector", "weight").mapInArrow(
        run, "node bigint, key binary, vector binary, weight bigint, size int, cell int"
    )


def cover_tree(points, radius, least):
    """Levels of a cover tree: per level the tree node of every point, each node's centre point and its covering radius.

    A node is split by taking members as centres until all lie within the level's radius, half
    that of the level above. Levels stop when they no longer put points together.
    """
    n, levels = len(points), [_level(points, np.zeros(len(points), np.int64), np.zeros(1, np.int64))]
    norms = (points * points).sum(axis=1)
    squares = norms[:, None] + norms - 2 * (points @ points.T)
    while radius > least:
        radius /= 2
        above, nodes, centres = levels[-1][0], np.empty(n, np.int64), []
        order = np.argsort(above, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(above[order])) + 1):
            while len(members):
                near = squares[members[0]][members] <= radius * radius
                near[0] = True
                nodes[members[near]] = len(centres)
                centres.append(members[0])
                members = members[~near]
                if len(centres) > n // 2:
                    return levels
        levels.append(_level(points, nodes, np.array(centres)))
    return levels


def _level(points, nodes, centres):
    radii = np.zeros(len(centres))
    np.maximum.at(radii, nodes, np.linalg.norm(points - points[centres[nodes]], axis=1))
    return nodes, centres, radii


def dual_traversal(a, tree_a, b, tree_b, reach):
    """Points of ``a`` and of ``b`` that some pair of nodes not ruled out holds, as two index arrays."""
    alive = np.ones((1, 1), bool)
    above = (np.zeros(len(a), np.int64), np.zeros(len(b), np.int64))
    for depth in range(max(len(tree_a), len(tree_b))):
        (na, ca, ra), (nb, cb, rb) = (tree[min(depth, len(tree) - 1)] for tree in (tree_a, tree_b))
        distance = np.sqrt(np.maximum(0, 2 - 2 * a[ca] @ b[cb].T))
        alive = alive[above[0][ca]][:, above[1][cb]] & (distance <= ra[:, None] + rb[None, :] + reach + 1e-7)
        if not alive.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        above = na, nb
    return np.flatnonzero(alive.any(1)[above[0]]), np.flatnonzero(alive.any(0)[above[1]])


def _blocks(cells, shared, reach, kind):
    """One row per block: its radius around the centre of its cell, its nodes, weights, vectors and cover tree."""
    schema = pa.schema([
        ("size", pa.int32()), ("cell", pa.int32()), ("block", pa.int32()), ("radius", pa.float64()), ("nodes", pa.binary()),
        ("weights", pa.binary()), ("vectors", pa.binary()), ("tree", pa.binary()),
    ])

    def run(key, rows):
        size, cell, block = (k.as_py() for k in key)
        vectors = b"".join(rows.column("vector").to_pylist())
        points = _units(np.frombuffer(vectors, kind).reshape(len(rows), size).astype(np.float64))
        radius = np.linalg.norm(points - shared.value.centres_of(size)[cell], axis=1).max()
        tree = cover_tree(points, 2.0, reach / 2)
        packed = np.concatenate([np.concatenate(([len(c)], nodes, c)) for nodes, c, _ in tree]).astype(np.int32)
        return pa.table([
            pa.array([x], f.type) for x, f in zip((
                size, cell, block, radius, rows.column("node").to_numpy().astype(np.int64).tobytes(),
                rows.column("weight").to_numpy().astype(np.int64).tobytes(), vectors, packed.tobytes(),
            ), schema)
        ], schema=schema)

    return cells.groupBy("size", "cell", "block").applyInArrow(
        run, "size int, cell int, block int, radius double, nodes binary, weights binary, vectors binary, tree binary"
    )


class _Block:
    """A block as it is compared."""

    def __init__(self, size, nodes, weights, vectors, tree, kind, sample):
        self.nodes, self.weights = np.frombuffer(nodes, np.int64).copy(), np.frombuffer(weights, np.int64).copy()
        n, packed, at = len(self.nodes), np.frombuffer(tree, np.int32), 0
        self.points, self.tree = _units(np.frombuffer(vectors, kind).reshape(n, size).astype(np.float64)), []
        while at < len(packed):
            k = packed[at]
            self.tree.append(_level(self.points, packed[at + 1:at + 1 + n].copy(), packed[at + 1 + n:at + 1 + n + k].copy()))
            at += 1 + n + k
        self.left, self.right = sample.leading(self.points)
        self.bytes = self.points.nbytes + self.left.nbytes + self.right.nbytes + 16 * n * (1 + len(self.tree))


def _links(a, at, b, bt, threshold, tile=256):
    """Places in ``at`` and in ``bt`` of the pairs of points that link.

    Leading directions rule pairs out; where they leave many, all directions of all pairs are compared.
    """
    cut, right, found = threshold - 1 - _ROUNDED, b.right[bt].T, []
    for start in range(0, len(at), tile):
        rows = at[start:start + tile]
        near = a.left[rows] @ right >= cut
        if 16 * np.count_nonzero(near) > near.size:
            i, j = np.nonzero(a.points[rows] @ b.points[bt].T >= threshold)
        else:
            i, j = np.divmod(np.flatnonzero(near), len(bt))
            linked = [np.einsum("ij,ij->i", a.points[rows[i[k:k + 4096]]], b.points[bt[j[k:k + 4096]]]) >= threshold for k in range(0, len(i), 4096)]
            linked = np.concatenate([np.zeros(0, bool), *linked])
            i, j = i[linked], j[linked]
        found.append((i + start, j))
    return (np.concatenate(x) for x in zip(*found))


def _smallest(link, left, right):
    """Smallest label that each row and each column is connected with."""
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(link, right[None, :], top).min(1))
        new_right = np.minimum(right, np.where(link, new_left[:, None], top).min(0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _compared(pairs, shared, threshold, reach, kind):
    """For each node of each pair of blocks that has links there: their weight, and a node it is connected with."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(batches):
        held, last, total = {}, {}, 0

        def block(batch, row, side):
            nonlocal total
            name = tuple(batch.column(f"{c}_{side}")[row].as_py() for c in ("cell", "block"))
            known = held.get(name) or (last[side][1] if side in last and last[side][0] == name else None)
            if known is None:
                parts = (batch.column(f"{c}_{side}")[row].as_buffer() for c in ("nodes", "weights", "vectors", "tree"))
                known = _Block(batch.column(f"size_{side}")[row].as_py(), *parts, kind, shared.value)
                if total + known.bytes <= HELD_BYTES:  # the others are unpacked each time they come
                    held[name], total = known, total + known.bytes
            last[side] = name, known
            return name, known

        for batch in batches:
            for row in range(batch.num_rows):
                (name_a, a), (name_b, b) = (block(batch, row, side) for side in "ab")
                same = name_a == name_b
                at, bt = dual_traversal(a.points, a.tree, b.points, b.tree, reach)
                if not len(at) or not len(bt):
                    continue
                i, j = _links(a, at, b, bt, threshold)
                if same:
                    apart = at[i] != bt[j]
                    i, j = i[apart], j[apart]
                if not len(i):
                    continue
                (rows, i), (columns, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
                at, bt, link = at[rows], bt[columns], np.zeros((len(rows), len(columns)), bool)
                link[i, j] = True
                left, right = _smallest(link, a.nodes[at], b.nodes[bt])
                yield arrow_rows(schema, a.nodes[at], link @ b.weights[bt], left)
                if not same:
                    yield arrow_rows(schema, b.nodes[bt], link.T @ a.weights[at], right)

    return pairs.mapInArrow(run, "node bigint, links bigint, other bigint")


def _pairs(blocks, near, n_bytes):
    """Every pair of blocks of near cells once, in one order or the other, which evens tasks out.

    A task reads a share of the stored blocks for either side, so no vector is shuffled or stored again; the shares are of
    bounded size, and their pairs keep all cores busy.
    """
    sides = max(math.ceil(2 * math.sqrt(blocks.sparkSession.sparkContext.defaultParallelism)), math.ceil(n_bytes / SIDE_BYTES))
    one = blocks.join(F.broadcast(near), "cell").coalesce(sides)
    a, b = (side.select(*(F.col(c).alias(f"{c}_{mark}") for c in side.columns)) for side, mark in ((one, "a"), (blocks.coalesce(sides), "b")))
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("block_a") == F.col("block_b"))
    lower = (F.col("cell_a") < F.col("cell_b")) | ((F.col("cell_a") == F.col("cell_b")) & (F.col("block_a") < F.col("block_b")))
    even = F.pmod(F.col("cell_a") + F.col("cell_b") + F.col("block_a") + F.col("block_b"), F.lit(2)) == 0
    return a.join(b.hint("shuffle_replicate_nl"), F.array_contains("near_a", F.col("cell_b")) & (same | (~same & (lower == even)))).drop("near_a")


def linked(vectors: DataFrame, id_col="vec_id", vector_col="embedding", threshold=THRESHOLD, block=BLOCK) -> DataFrame:
    """Links of at least ``threshold`` cosine between all vectors, whatever else the rows hold.

    Result, one row per input row: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id``
    (smallest non-null id reachable), ``kept`` (``vec_id = component_id``). Vectors that are null, empty,
    zero or hold null or non-finite components have no links and a component of their own, as
    have vectors of another length than all others. Repeated rows are vectors of their own and link
    with each other. An empty table gives an empty result. Equal directions are compared once; a
    cell with very many vectors is cut into blocks of about ``block``, so no task holds a group.

    Disk grows with the rows: a few copies of the distinct vectors, at their own precision, exist at once. Time grows with the
    pairs of blocks that are not ruled out, among random vectors with their square.
    """
    spark, reach = vectors.sparkSession, math.sqrt(2 - 2 * threshold)
    vectors = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_vector"))
    kind = _kind(vectors.schema["_vector"].dataType)
    units = stage(_directions(vectors), "units")
    rows = stage(units.select("vec_id", "key"), "rows")
    nodes = units.where("key is not null").groupBy("key").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.min("vector").alias("vector")
    )
    vectors = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    release(units)
    sample = _Sample(vectors, block, kind)
    shared = spark.sparkContext.broadcast(sample)
    assigned = _assigned(vectors, shared, kind)
    extent = assigned.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    extent = stage(extent, "extent")
    cells = assigned.join(F.broadcast(extent), ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    blocks = stage(_blocks(cells.select("size", "cell", "block", "node", "vector", "weight"), shared, reach, kind), "blocks")
    nodes = stage(vectors.drop("vector"), "nodes")
    release(vectors)
    radii = blocks.groupBy("size", "cell").agg(F.max("radius").alias("radius"), F.sum(F.length("vectors")).alias("n")).collect()
    near = spark.createDataFrame(_near_cells(radii, sample, reach), "cell bigint, near array<bigint>")
    blocks = blocks.drop("radius").withColumn("cell", F.col("size").cast("bigint") * CELLS + F.col("cell"))
    pairs = _pairs(blocks, near, sum(row["n"] for row in radii))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # a row holds two blocks
    try:
        links = stage(_compared(pairs, shared, threshold, reach, kind), "links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    release(blocks)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.join(found, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    named = named.join(least, "class").join(counts, "node", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    return rows.join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _near_cells(radii, sample, reach):
    """For each cell the cells that may hold vectors linked with its own: a bounded table, as the number of centres is."""
    known = {}
    for row in radii:
        known.setdefault(row["size"], []).append((row["cell"], row["radius"]))
    near = []
    for size, found in known.items():
        cells, covering = (np.array(x) for x in zip(*sorted(found)))
        points = sample.centres_of(size)[cells]
        for cell, point, radius in zip(cells.tolist(), points, covering):
            may = np.linalg.norm(points - point, axis=1) <= covering + radius + reach + _SLACK
            near.append((size * CELLS + cell, [size * CELLS + other for other in cells[may].tolist()]))
    return near
