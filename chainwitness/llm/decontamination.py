"""Passages of a benchmark in documents, found by spaced seeds that overlook some words.

A mask names the words of a stretch that must agree; the others may differ. Each place of a
text gives one hash per mask, benchmark and documents are joined on them, and every hit is
followed along its alignment, where substitutions are counted. The two masks leave no
passage out: whatever two words of ``WINDOW`` are replaced, one mask still fits somewhere.
Everything is expressions and joins; the table of seeds is staged, so that Spark knows its
size and broadcasts it only below its own limit.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness.llm.common import stage

WINDOW = 13
SUBSTITUTIONS = 2
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8


def words_of(text):
    """Lower-case words of a text column."""
    return F.array_remove(F.split(F.lower(text), "[ \\t-\\r]+"), "")


def _hashed(words):
    return F.transform(words, lambda word: F.xxhash64(word))


def _seeds(rows, key):
    """One row per mask and place: the hash of the words that the mask looks at."""
    places = rows.select(
        *key, "_words", F.explode(F.sequence(F.lit(0), F.size("_words") - SPAN)).alias("_place")
    )
    names = [F.xxhash64(F.lit(n), *(F.col("_words")[F.col("_place") + i] for i in mask)) for n, mask in enumerate(MASKS)]
    return places.select(*key, "_place", *(s.alias(f"_s{n}") for n, s in enumerate(names))).select(
        *key, "_place", F.explode(F.array(*(F.col(f"_s{n}") for n in range(len(MASKS))))).alias("_seed")
    )


def _runs(rows, key, lengths):
    """One row per place and length: the hash of that many words."""
    rows = rows.select(*key, "_words", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("_n")).where(F.size("_words") >= F.col("_n"))
    places = rows.select(*key, "_words", "_n", F.explode(F.sequence(F.lit(0), F.size("_words") - F.col("_n"))).alias("_place"))
    return places.select(*key, "_place", F.xxhash64("_n", F.slice("_words", F.col("_place") + 1, F.col("_n"))).alias("_seed"))


def _short_hits(texts, items, window):
    """Places where a whole item of fewer than SPAN words stands, or half of one of fewer than ``window``."""
    sizes = sorted(r[0] for r in items.where(F.size("_words") < window).select(F.size("_words")).distinct().collect())
    words = texts.select("_id", "_hash", _hashed("_words").alias("_words"))
    parts = []
    whole, halved = [n for n in sizes if n < SPAN], [n for n in sizes if n >= SPAN]
    key = ["item_id", "item_hash"]
    if whole:
        own = items.where(F.size("_words") < SPAN).select(
            *key, F.xxhash64(F.size("_words"), _hashed("_words")).alias("_seed"), F.lit(0).alias("item_place"))
        first = _runs(words, ["_id", "_hash"], whole).groupBy("_id", "_hash", "_seed").agg(F.min("_place").alias("_place"))
        parts.append(first.join(own, "_seed"))
    if halved:
        own = items.where(F.size("_words").between(SPAN, window - 1)).select(*key, _hashed("_words").alias("_words"))
        half = F.floor(F.size("_words") / 2).cast("int")
        cuts = F.array(F.struct(F.lit(0).alias("at"), half.alias("n")), F.struct(half.alias("at"), (F.size("_words") - half).alias("n")))
        own = own.select(*key, "_words", F.explode(cuts).alias("c")).select(
            *key, F.xxhash64("c.n", F.slice("_words", F.col("c.at") + 1, F.col("c.n"))).alias("_seed"), F.col("c.at").alias("item_place"))
        lengths = sorted({x for n in halved for x in (n // 2, n - n // 2)})
        parts.append(_runs(words, ["_id", "_hash"], lengths).join(own, "_seed"))
    return [p.select("_id", "_hash", *key, (F.col("_place") - F.col("item_place")).alias("shift")) for p in parts]


def overlaps(docs: DataFrame, benchmark: DataFrame, window=WINDOW, substitutions=SUBSTITUTIONS, short=False) -> DataFrame:
    """Pairs of a document and a benchmark item that share a passage.

    Both inputs come from ``common.identified``. They share a passage if, with one alignment,
    ``window`` words in a row agree but for ``substitutions`` of them; of an item with fewer
    words than that, all must agree. The masks prove completeness for the default values.
    Result: ``_id``, ``_hash``, ``item_id``, ``n_item_words``, ``n_window`` (most equal words in a window)
    and ``n_equal`` (most equal words along one such alignment). One row per pair, however often
    the row, the item or the passage is repeated. Null and empty texts, and items of fewer than
    eight words, share nothing. No group is gathered: a passage in many documents makes one
    small row in each.

    With ``short`` no item is too short: fewer than eight words are found word for word, and items
    of eight words up to ``window`` may differ in the same share of words as a window, rounded
    down (one word by default, so that one half agrees).
    """
    items = benchmark.where("_text is not null").select(
        F.col("_id").alias("item_id"), F.col("_hash").alias("item_hash"), words_of(F.col("_text")).alias("_words")
    ).where(F.size("_words") >= (1 if short else SPAN)).dropDuplicates(["item_id", "item_hash"])
    items = stage(items, "items")
    seeds = stage(
        _seeds(items.where(F.size("_words") >= SPAN).withColumn("_words", _hashed("_words")), ["item_id", "item_hash"])
        .withColumnRenamed("_place", "item_place"), "seeds",
    )
    texts = docs.where("_text is not null").select("_id", "_hash", words_of(F.col("_text")).alias("_words"))
    texts = texts.where(F.size("_words") >= (1 if short else SPAN))
    hits = _seeds(texts.where(F.size("_words") >= SPAN).select("_id", "_hash", _hashed("_words").alias("_words")), ["_id", "_hash"])
    found = hits.join(seeds, "_seed").select(
        "_id", "_hash", "item_id", "item_hash", (F.col("_place") - F.col("item_place")).alias("shift")
    )
    for more in _short_hits(texts, items, window) if short else ():
        found = found.unionByName(more)
    found = found.distinct()
    found = stage(found, "hits")
    item = items.select(
        F.col("item_id").alias("i"), F.col("item_hash").alias("h"), F.col("_words").alias("_item")
    )
    doc = texts.select(F.col("_id").alias("d"), F.col("_hash").alias("dh"), "_words")
    aligned = (
        found.join(item, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("h")))
        .join(doc, F.col("_id").eqNullSafe(F.col("d")) & (F.col("_hash") == F.col("dh")))
    )
    equal = F.transform(
        "_item", lambda word, at: F.coalesce((F.get("_words", at + F.col("shift")) == word).cast("int"), F.lit(0))
    )
    compared = aligned.select("_id", "_hash", "item_id", F.size("_item").alias("n_item_words"), equal.alias("_equal"))
    length = F.least(F.lit(window), F.col("n_item_words"))
    in_window = F.array_max(F.transform(
        F.sequence(F.lit(1), F.col("n_item_words") - length + 1),
        lambda at: F.aggregate(F.slice("_equal", at, length), F.lit(0), lambda a, b: a + b),
    ))
    counted = compared.select(
        "_id", "_hash", "item_id", "n_item_words", in_window.alias("n_window"),
        F.aggregate("_equal", F.lit(0), lambda a, b: a + b).alias("n_equal"),
    )
    spared = F.floor(F.col("n_item_words") * substitutions / window) if short else F.lit(0)
    spared = F.when(F.col("n_item_words") < SPAN, 0).otherwise(spared)
    needed = F.when(F.col("n_item_words") < window, F.col("n_item_words") - spared).otherwise(window - substitutions)
    return counted.where(F.col("n_window") >= needed).groupBy("_id", "_hash", "item_id").agg(
        *(F.max(c).alias(c) for c in ("n_item_words", "n_window", "n_equal"))
    )


ORACLE = f"""
with d as (select doc_id, list_filter(string_split_regex(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') as w
           from documents where text is not null),
b as (select item_id, list_filter(string_split_regex(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') as w
      from benchmark where text is not null),
dp as (select doc_id, w, unnest(range(1, len(w) - {SPAN - 2})) as i from d where len(w) >= {SPAN}),
bp as (select item_id, w, unnest(range(1, len(w) - {SPAN - 2})) as i from b where len(w) >= {SPAN}),
ds as ({" union all ".join(f"select doc_id, i, {n} as mask, concat_ws(' ', {', '.join(f'w[i + {k}]' for k in m)}) as seed from dp" for n, m in enumerate(MASKS))}),
bs as ({" union all ".join(f"select item_id, i, {n} as mask, concat_ws(' ', {', '.join(f'w[i + {k}]' for k in m)}) as seed from bp" for n, m in enumerate(MASKS))}),
c as (select distinct ds.doc_id, bs.item_id, ds.i - bs.i as shift from ds join bs using (mask, seed)),
p as (select c.doc_id, c.item_id, c.shift, len(b.w) as n, unnest(range(1, len(b.w) + 1)) as j, d.w as dw, b.w as bw
      from c join d using (doc_id) join b using (item_id)),
e as (select doc_id, item_id, shift, n, j,
             case when j + shift between 1 and len(dw) and dw[j + shift] = bw[j] then 1 else 0 end as same from p),
s as (select *, sum(same) over (partition by doc_id, item_id, shift order by j
                                rows between {WINDOW - 1} preceding and current row) as in_window from e),
r as (select doc_id, item_id, shift, any_value(n) as n, max(in_window) as n_window, sum(same) as n_equal
      from s group by all)
select doc_id, item_id, max(n)::int as n_item_words, max(n_window)::int as n_window, max(n_equal)::int as n_equal
from r where n_window >= case when n < {WINDOW} then n else {WINDOW - SUBSTITUTIONS} end
group by doc_id, item_id
"""
