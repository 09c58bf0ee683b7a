"""Connected components of a table of edges, by turning it into stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness.session import release, stage


def _star(edges, larger):
    """Neighbours of each node move to the least one of the node and its neighbours: the larger ones, or the smaller ones and the node itself."""
    one, other = ("a", "b"), ("b", "a")
    sides = edges.select(*(F.col(c).alias(n) for c, n in zip(one, ("u", "v"))))
    if larger:
        sides = sides.union(edges.select(*(F.col(c).alias(n) for c, n in zip(other, ("u", "v")))))
    least = sides.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    moved = sides.where("v > u") if larger else sides
    links = moved.join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    links = links if larger else links.union(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
    return links.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it can reach, of every node on an edge (columns ``a``, ``b``).

    Edges always point from the larger node to the smaller. Rounds go on until every node points to the
    root of its star; their number grows with the logarithm of the table. Least neighbours are aggregates that
    combine before the shuffle, and only they are joined to the edges, so a node with very many edges
    is split by adaptive execution. Null nodes and loops are ignored; repeated edges count once.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, before = mark, edges
        edges = stage(_star(_star(edges, larger=True), larger=False), "stars")
        release(before)
    pointed = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pointed.union(edges.select("b", "b").distinct())
