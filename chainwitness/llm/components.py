"""Connected components of a table of edges, by contraction in Spark rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest node, of every node on an edge (columns ``a``, ``b``).

    Each round every node moves to the neighbour that a hash puts first, if that one precedes it,
    and edges follow; at least half of the nodes are expected to go each time, so rounds grow
    with the logarithm of the table. All reductions are aggregates that combine before the
    shuffle, so a node with very many edges is no hot task. Null nodes and loops are ignored.
    """
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = F.struct(F.xxhash64("b").alias("rank"), F.col("b"))
        move = both.groupBy("a").agg(F.min(rank).alias("least"))
        move = move.where(F.col("least") < F.struct(F.xxhash64("a"), F.col("a")))
        move = stage(move.select(F.col("a").alias("old"), F.col("least.b").alias("new")), "moves")
        first, second = move.toDF("old_a", "new_a"), move.toDF("old_b", "new_b")
        moved = edges.join(first, edges["a"] == first["old_a"], "left").join(second, edges["b"] == second["old_b"], "left")
        moved = moved.select(F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"))
        edges = stage(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        labels = stage(
            labels.join(move, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")),
            "labels",
        )
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return stage(labels.join(smallest, "label").select("node", "component"), "components")
