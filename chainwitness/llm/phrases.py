"""Collocations: phrases that occur far more often than their parts would by chance.

Counting goes up by length. A phrase can be frequent only if both phrases that lack its last or
its first word are, so a pass over the texts counts a phrase under the names of these two, its prefix
and its suffix. A table of bits of fixed size, filled from the frequent phrases of the pass before, keeps
most others from being counted; what it lets through by chance is counted and found to be rare.

Estimation follows the layout of external count streams: the stream of each length in prefix order
and in suffix order is merged, in lockstep over sorted keys, with the stream of the next shorter
length. The merge in prefix order gives each phrase the counts of all its beginnings, that in
suffix order those of all its endings, and both give the shorter phrase the count of its most
frequent extension. No table of all counts is looked up anywhere.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainwitness.llm.chunks import spans
from chainwitness.llm.common import arrow_rows, small_slices, stage
from chainwitness.llm.words import buffers, byte_names, mixed

NO_LANG = "und"
BITS = 25  # of a name that pick a bit: a table of 4 MB
COUNTED = 2_000_000  # phrases that a task counts before it passes them on
SLICE = 8_000_000
SALTS = 32
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(10, 14)]] = True
_APART = _BREAKS.copy()
_APART[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def paired(prefix, suffix):
    """Name of the phrase whose prefix and suffix, each one word shorter, have these names."""
    return mixed(prefix + mixed(suffix ^ np.uint64(0x632BE59BD9B4E019)))


class _Run:
    """Words of a batch of texts, named with their language, and how many words their piece goes on for."""

    def __init__(self, batch):
        offsets, data = buffers(batch.column("_text"))
        self.data = data = _LOWER[data]
        inside, n = ~_APART[data], len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1] | edge[1:n]
            closes[:-1] &= ~inside[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        lang = batch.column("_lang").dictionary_encode()
        self.lang = lang.indices.to_numpy(zero_copy_only=False)
        self.langs = lang.dictionary
        of_lang, names = buffers(self.langs)
        of_lang = byte_names(names, of_lang[:-1], of_lang[1:])
        self.names = paired(of_lang[self.lang][self.text], byte_names(data, self.starts, self.ends))
        broken = np.cumsum(_BREAKS[data]) if n else np.zeros(0, np.int64)
        goes_on = np.zeros(len(self.starts), bool)  # the next word is in the same piece
        goes_on[:-1] = (self.text[1:] == self.text[:-1]) & (broken[self.starts[1:]] == broken[self.ends[:-1] - 1])
        self.goes_on = goes_on

    def grams(self, k):
        """Names of all phrases of ``k`` words and the words at which they begin."""
        names, at = self.names, np.arange(len(self.names))
        for _ in range(k - 1):
            on = np.flatnonzero(self.goes_on[at[:-1]] & (at[1:] == at[:-1] + 1))
            names, at = paired(names[on], names[on + 1]), at[on]
        return names, at


def _summed(*columns):
    """Counts of equal (prefix, suffix), from columns prefix, suffix and count."""
    prefix, suffix, counts = columns
    order = np.argsort(paired(prefix, suffix))
    prefix, suffix, counts = prefix[order], suffix[order], counts[order]
    first = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1]))[: len(prefix)])
    return prefix[first], suffix[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _word_counts(docs):
    """Counts of the words of each language, and under a null word of all its words."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("name", pa.int64()), ("f", pa.int64())])

    def run(batches):
        for batch in small_slices(batches, max_bytes=SLICE):
            words = _Run(batch)
            _, index, counts = np.unique(words.names, return_index=True, return_counts=True)
            starts, sizes = words.starts[index], words.ends[index] - words.starts[index]
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), len(index), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.data[spans(starts, sizes)].tobytes())])
            yield arrow_rows(schema, words.langs.take(pa.array(words.lang[words.text[index]])), text, words.names[index].view(np.int64), counts)
            totals = np.bincount(words.lang[words.text], minlength=len(words.langs))
            none = pa.nulls(len(totals))
            yield arrow_rows(schema, words.langs, none, none, totals)

    found = docs.mapInArrow(run, "lang string, word string, name bigint, f bigint")
    return found.groupBy("lang", "word", "name").agg(F.sum("f").alias("f"))


def _bit_table(names: DataFrame):
    """A bit for each value of the top bits of a name: a table of fixed size, whatever the number of names."""
    place = F.shiftrightunsigned("name", 64 - BITS)
    cells = names.groupBy(F.shiftright(place, 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(1 << BITS - 6, np.int64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return table.view(np.uint64)


def _has_bit(table, names):
    place = names >> np.uint64(64 - BITS)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _phrase_counts(docs, k, names):
    """Counts of phrases of ``k`` words by the names of their prefix and suffix, at least of all that can be frequent."""
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(names))
    schema = pa.schema([("p", pa.int64()), ("s", pa.int64()), ("f", pa.int64())])

    def run(batches):
        kept, waiting = [], 0
        for batch in small_slices(batches):
            words = _Run(batch)
            shorter, at = words.grams(k - 1)
            often = _has_bit(table.value, shorter)
            on = np.flatnonzero(often[:-1] & often[1:] & words.goes_on[at[:-1]] & (at[1:] == at[:-1] + 1))
            kept.append(_summed(shorter[on], shorter[on + 1], np.ones(len(on), np.int64)))
            waiting += len(kept[-1][0])
            if waiting > COUNTED:
                kept = [_summed(*map(np.concatenate, zip(*kept)))]
                waiting = len(kept[0][0])
                if waiting > COUNTED // 2:
                    p, s, f = kept.pop()
                    yield arrow_rows(schema, p.view(np.int64), s.view(np.int64), f)
                    waiting = 0
        if kept:
            p, s, f = _summed(*map(np.concatenate, zip(*kept)))
            yield arrow_rows(schema, p.view(np.int64), s.view(np.int64), f)

    return docs.mapInArrow(run, "p bigint, s bigint, f bigint").groupBy("p", "s").agg(F.sum("f").alias("f"))


def _named(counts):
    """Adds the phrase's own name."""
    schema = pa.schema([("p", pa.int64()), ("s", pa.int64()), ("f", pa.int64()), ("name", pa.int64())])

    def run(batches):
        for batch in batches:
            p, s = (batch.column(c).to_numpy().view(np.uint64) for c in ("p", "s"))
            yield arrow_rows(schema, *(batch.column(c) for c in ("p", "s", "f")), paired(p, s).view(np.int64))

    return counts.mapInArrow(run, "p bigint, s bigint, f bigint, name bigint")


def _merged(longer, shorter):
    """The stream of one length, with the counts of all beginnings and endings of its phrases."""
    prefix = shorter.select(
        F.col("name").alias("p"), "lang", F.col("phrase").alias("_head"), F.concat("lefts", F.array("f")).alias("lefts"))
    suffix = shorter.select(F.col("name").alias("s"), "last", F.concat("rights", F.array("f")).alias("rights"))
    merged = longer.join(prefix.hint("merge"), "p").join(suffix.hint("merge"), "s")
    return merged.select("p", "s", "name", "f", "lang", F.concat_ws(" ", "_head", "last").alias("phrase"), "last", "lefts", "rights")


def _extension(longer):
    """How often the most frequent phrase occurs that has one word more, behind or in front."""
    sides = longer.select(F.col("p").alias("e"), "f").unionAll(longer.select(F.col("s").alias("e"), "f"))
    return sides.groupBy("e").agg(F.max("f").alias("most"))


def mine(docs: DataFrame, text_col="text", lang_col="lang", least=100, longest=5) -> DataFrame:
    """All phrases of 2 to ``longest`` words that occur ``least`` times or more in a language and do not always stand
    inside one longer such phrase.

    Letters A-Z are lowered; ``[.,;:!?]`` and line ends part pieces, space and tab words. Result: ``lang``, ``phrase``
    (words joined by one space), ``a`` (occurrences within pieces, overlaps included), ``cut``, ``l`` and ``r`` (the cut
    into first words and rest with the lowest score, smallest first part on a tie, and both parts' counts), ``n`` (all
    words of the language), ``score`` = floor(1000 * a * n / (l * r)), in exact arithmetic. Null texts are empty, a null
    language is ``und``, as is that label itself; repeated rows count each time. Texts may be of any length;
    only ``text_col`` and ``lang_col`` are read. An empty table gives no rows.

    A pass reads the texts once. Every count is a sum that combines before its shuffle, so a phrase in a third of all
    texts is one row per task; what is broadcast is the bit table of 4 MB. A phrase is inside a longer one as often as
    it occurs only if one with a single word more has its count, so only these are compared.
    """
    texts = docs.select(F.col(text_col).alias("_text"), F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("_lang"))
    words = stage(_word_counts(texts).where(F.col("word").isNull() | (F.col("f") >= least)), "words")
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))
    none = F.array().cast("array<bigint>")
    level = words.where("word is not null").select(
        "name", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("lefts"), none.alias("rights"))
    found = None
    for k in range(2, longest + 1):
        counts = stage(_named(_phrase_counts(texts, k, level).where(F.col("f") >= least)), f"counts-{k}")
        longer = stage(_merged(counts, level), f"phrases-{k}")
        if found is not None:
            kept = level.join(_extension(counts).hint("merge"), F.col("name") == F.col("e"), "left")
            found.append(kept.where("most is null or most < f").select(level["*"]))
        else:
            found = []
        level = longer
    found.append(level)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    cut = F.expr("""array_min(transform(sequence(1, size(lefts)), k -> named_struct(
        'score', (cast(f as decimal(38,0)) * 1000 * n) div (cast(lefts[k - 1] as decimal(38,0)) * rights[size(rights) - k]),
        'cut', k, 'l', lefts[k - 1], 'r', rights[size(rights) - k])))""")
    return rows.join(totals, "lang").withColumn("c", cut).select(
        "lang", "phrase", F.col("f").alias("a"), "c.cut", "c.l", "c.r", "n", "c.score")


def best(phrases: DataFrame, per_lang=2000) -> DataFrame:
    """The first ``per_lang`` phrases of each language with their ``rank`` from 1: by score, then ``a``, both descending, then
    phrase in byte order. The first ones of each of SALTS parts of a language are found before all meet."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salted = phrases.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= per_lang)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= per_lang).drop("_salt", "_place")


#: The same in SQL, for ``mine`` and ``best`` with their defaults over the documents table.
ORACLE = """
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
worded as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as w from pieces),
totals as (select lang, cast(sum(len(w)) as hugeint) as n from worded group by lang),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from worded, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 100),
cuts as (
  select c.lang, c.phrase, c.k, c.f as a, unnest(range(1, c.k)) as cut, string_split(c.phrase, ' ') as w from f c where c.k >= 2),
scored as (
  select cuts.*, x.f as l, y.f as r, t.n,
    (cast(1000 as hugeint) * cuts.a * t.n) // (cast(x.f as hugeint) * y.f) as score
  from cuts join totals t on t.lang = cuts.lang
  join f x on x.lang = cuts.lang and x.phrase = array_to_string(cuts.w[1:cuts.cut], ' ')
  join f y on y.lang = cuts.lang and y.phrase = array_to_string(cuts.w[cuts.cut + 1:cuts.k], ' ')),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (
  select distinct s.lang, s.phrase from f c, unnest(range(2, c.k)) as u(k), unnest(range(1, c.k - u.k + 2)) as v(i)
  join f s on s.lang = c.lang and s.phrase = array_to_string((string_split(c.phrase, ' '))[v.i:v.i + u.k - 1], ' ')
  where c.k >= 3 and 100 * c.f >= 100 * s.f),
kept as (select * from lowest o where not exists (select 1 from inside i where i.lang = o.lang and i.phrase = o.phrase))
select lang, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score, rank from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
where rank <= 2000
"""
