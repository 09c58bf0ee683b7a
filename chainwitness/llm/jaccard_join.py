"""Near-duplicate documents: an exact Jaccard join over word shingles by grouped prefixes.

Shingles are put in one global order, rare ones first as a sketch of fixed size counts them.
Of two sets with the wanted similarity, the first fifth of each shares a shingle. Documents
with the same set are one node; nodes with the same size and the same first fifth are one
group, and only groups are joined. A group whose shingles meet others is expanded, and the
sets themselves are compared. As only classes of linked documents are wanted, pairs inside
one class need no comparison: each node is first compared with the leaders that most of its
shingles have, and what is then left between different classes is compared in full.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainwitness.llm.common import arrow_rows, small_slices, stage
from chainwitness.llm.components import components
from chainwitness.llm.words import Words, mixed, span_names

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 18
LEADERS = 2


def _sets(column, shingle):
    """The sorted distinct shingle names of every text."""
    words = Words(column, lower=True)
    grams, at = words.grams(shingle)
    places = np.searchsorted(at, words.first)
    counts = words.counts()
    for row in range(len(counts)):
        if counts[row] >= shingle:
            yield np.unique(grams[places[row]:places[row + 1]])
        elif counts[row]:
            first = words.first[row:row + 2]
            yield span_names(words.names, first[:1], first[1:])
        else:
            yield np.zeros(0, np.uint64)


def _order(docs, shingle):
    """How common the shingles of each of 2**SKETCH_BITS hash buckets are, as 8-bit ranks.

    All texts are counted. The table has a fixed size, whatever the input; it decides which
    shingles stand first, never which documents are linked.
    """

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in small_slices(batches):
            grams, _ = Words(batch.column("_text"), lower=True).grams(shingle)
            counts += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(counts[used])})

    table = docs.select("_text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << SKETCH_BITS)
    rows = table.toArrow()
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return docs.sparkSession.sparkContext.broadcast((8 * np.log2(1 + counts)).clip(0, 255).astype(np.uint64))


def _prefixes(docs, shingle, percent):
    """Per row: set size, name of the set (two words), first shingles, and the name of those."""
    order = _order(docs, shingle)
    schema = pa.schema([
        ("_id", pa.int64()), ("_hash", pa.binary()), ("n", pa.int64()), ("name", pa.int64()), ("check", pa.int64()),
        ("prefix", pa.list_(pa.int64())), ("start", pa.int64()),
    ])

    def run(batches):
        ranks = order.value
        for batch in small_slices(batches):
            sizes, names, prefixes = [], [], []
            for found in _sets(batch.column("_text"), shingle):
                n = len(found)
                sizes.append(n)
                names.append((mixed(found).sum(), mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum()))
                keep = n - (percent * n + 99) // 100 + 1 if n else 0
                place = ranks[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(56) | found >> np.uint64(8)
                prefixes.append(found[np.argsort(place, kind="stable")[:keep]])
            names = np.array(names, np.uint64).view(np.int64)
            stops = np.cumsum([0, *map(len, prefixes)])
            tokens = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            starts = span_names(tokens, stops[:-1], stops[1:]).view(np.int64)
            yield arrow_rows(
                schema, batch.column("_id"), batch.column("_hash"), sizes, names[:, 0], names[:, 1],
                pa.ListArray.from_arrays(stops.astype(np.int32), tokens.view(np.int64)), starts,
            )

    return docs.mapInArrow(
        run, "_id bigint, _hash binary, n bigint, name bigint, check bigint, prefix array<bigint>, start bigint"
    )


def _verified(edges, docs, rows, shingle, percent):
    """The edges (``a``, ``b``) whose two sets are as similar as wanted; only their texts are fetched, once for all equal rows."""
    edges = stage(edges, "pairs")
    ends = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "row")
    wanted = rows.select("row", "_id", "_hash").join(ends, "row")
    wanted = wanted.select(F.col("row").alias("node"), F.col("_id").alias("i"), F.col("_hash").alias("h"))
    texts = stage(
        docs.join(wanted, docs["_id"].eqNullSafe(wanted["i"]) & (docs["_hash"] == wanted["h"])).select("node", "_text")
        .dropDuplicates(["node"]), "texts",
    )
    first = texts.select(F.col("node").alias("a"), F.col("_text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("_text").alias("text_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in small_slices(batches, "text_a"):
            good = []
            for x, y in zip(_sets(batch.column("text_a"), shingle), _sets(batch.column("text_b"), shingle)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            good = pa.array(good, pa.bool_())
            yield arrow_rows(schema, batch.column("a").filter(good), batch.column("b").filter(good))

    return edges.join(first, "a").join(second, "b").mapInArrow(run, "a bigint, b bigint")


def _classes(nodes, links):
    """``nodes`` with the class that the links so far put them in."""
    found = components(links)
    return stage(
        nodes.join(found, "node", "left").select(*nodes.columns, F.coalesce("component", "node").alias("class")), "classes"
    )


def linked(docs: DataFrame, shingle=SHINGLE, percent=PERCENT) -> DataFrame:
    """Classes of documents that links of at least ``percent`` % Jaccard similarity connect.

    ``docs`` comes from ``common.identified``. A set holds the distinct runs of ``shingle`` lower-case
    words, or the whole text if that has fewer. Result, one row per input row: ``_id``, ``_hash``,
    ``n_shingles``, ``component_id`` (smallest non-null id in its class) and ``kept``, true in one row
    of each class: the one with the smallest id (null ids last, repeated rows decided by a row
    number). Texts that are null or hold no word have an empty set and a class of their own.
    """
    docs = docs.select("_id", "_hash", "_text")
    rows = stage(_prefixes(docs, shingle, percent).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    sets = rows.where("n > 0").groupBy("name", "check", "n", "start").agg(F.min("row").alias("node"))
    groups = sets.groupBy("n", "start").agg(F.min("node").alias("group"), F.count(F.lit(1)).alias("members"))
    sets = stage(sets.join(groups, ["n", "start"]), "sets")
    leaders = sets.where("node = group").select(F.col("group").alias("row"))
    tokens = rows.join(leaders, "row", "left_semi").select(
        F.col("row").alias("group"), "n", F.posexplode("prefix").alias("place", "token")
    )
    shared = tokens.groupBy("token").agg(F.min("group").alias("lead"), F.count(F.lit(1)).alias("uses")).where("uses > 1")
    shared = stage(shared.select("token", "lead"), "shared")
    tokens = stage(tokens.join(shared, "token"), "tokens")
    meeting = tokens.select("group").distinct()
    nodes = stage(
        sets.join(meeting.withColumn("meets", F.lit(True)), "group", "left").where("members > 1 or meets")
        .select("node", "group", "n"), "nodes",
    )
    edges = _led(tokens, percent).join(nodes, "group").select(F.col("node").alias("a"), F.col("lead").alias("b")).union(
        nodes.where("node <> group").select(F.col("node").alias("a"), F.col("group").alias("b"))
    )
    links = stage(_verified(edges, docs, rows, shingle, percent), "links")
    edges = _open_pairs(tokens, _classes(nodes, links), percent)
    links = stage(links.union(_verified(edges, docs, rows, shingle, percent)), "links")
    return _result(rows, sets, links)


def _may_link(met, percent):
    """Those pairs (``n_a``, ``n_b``, ``common``, ``last_a``, ``last_b``) whose sets can be similar enough.

    In the common order, what both sets share beyond the counted shingles follows the last of those.
    """
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    rest = F.least(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b")) - 1
    return met.where((100 * least >= percent * most) & (F.col("common") + rest >= _overlap(percent)))


def _overlap(percent):
    return F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))


def _led(tokens, percent):
    """``group`` and ``lead``: each group with the leaders of most of its shingles, if they may be linked."""
    votes = tokens.where("group <> lead").groupBy("group", "lead").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("group").orderBy(F.desc("votes"), "lead")
    best = votes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS).select("group", "lead")
    own = tokens.select("token", "group", F.col("n").alias("n_a"), F.col("place").alias("place_a"))
    other = tokens.select("token", F.col("group").alias("lead"), F.col("n").alias("n_b"), F.col("place").alias("place_b"))
    met = best.join(own, "group").join(other, ["token", "lead"]).groupBy("group", "lead", "n_a", "n_b").agg(
        F.count(F.lit(1)).alias("common"), F.max("place_a").alias("last_a"), F.max("place_b").alias("last_b")
    )
    return _may_link(met, percent).select("group", "lead")


def _open_pairs(tokens, classed, percent):
    """Pairs of nodes of different classes that may still be linked.

    Shingles met by one class only are out. The rest are joined under three bounds: the sizes
    must allow the similarity, the first common shingle must leave enough of both sets behind it,
    and the common ones counted plus what follows the last of them must reach the overlap.
    """
    used = tokens.select("token", "group", "place").join(classed, "group")
    mixed_tokens = used.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    used = stage(used.join(mixed_tokens.select("token"), "token").select("token", "node", "n", "place", "class"), "open")
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    left = used.select("token", *(F.col(c).alias(c + "_a") for c in ("node", "n", "place", "class")), band.alias("band"))
    right = used.select(
        "token", *(F.col(c).alias(c + "_b") for c in ("node", "n", "place", "class")),
        F.explode(F.array(band - 2, band - 1, band, band + 1)).alias("band"),
    )
    pairs = left.join(right, ["token", "band"]).where("class_a <> class_b").where(
        (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    ).where(100 * F.col("n_a") >= percent * F.col("n_b"))
    pairs = pairs.where(F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= _overlap(percent))
    met = pairs.groupBy("node_a", "node_b", "n_a", "n_b").agg(
        F.count(F.lit(1)).alias("common"), F.max("place_a").alias("last_a"), F.max("place_b").alias("last_b")
    )
    across = _may_link(met, percent).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    split = classed.groupBy("group").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    inside = classed.join(split.select("group"), "group")
    one, two = inside.select("group", F.col("node").alias("a"), F.col("class").alias("ca")), inside.select(
        "group", F.col("node").alias("b"), F.col("class").alias("cb"))
    within = one.join(two, "group").where("a < b and ca <> cb").select("a", "b")
    return across.union(within).distinct()


def _result(rows, sets, links):
    """Class, smallest id and kept mark of every row."""
    found = components(links)
    node = sets.join(found, "node", "left").select("name", "check", "n", F.coalesce("component", "node").alias("class"))
    classed = rows.select("_id", "_hash", "n", "name", "check", "row").join(node, ["name", "check", "n"], "left")
    classed = classed.withColumn("class", F.coalesce("class", F.col("row")))
    least = classed.groupBy("class").agg(
        F.min("_id").alias("component_id"), F.min(F.struct(F.col("_id").isNull(), "_id", "row")).getField("row").alias("least")
    )
    return classed.join(least, "class").select(
        "_id", "_hash", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("least")).alias("kept")
    )
