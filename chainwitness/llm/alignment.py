"""Alignment of two tokenizers: which token of one covers bytes of which token of the other.

Both encode a space and the text. Over all texts of a batch together, one numpy vector holds a
pointer into A's tokens and one into B's for every lane; each step links the two tokens pointed at
and moves on the one that ends first, or both, which is a cut. A lane is a text, or, so that
a long text takes no more steps than others, a stretch of it between places where both
encodings are known to cut. Finished lanes leave the vector.

How often a pair of ids is linked in the whole corpus is counted in a first pass. A second
pass looks up the commonest pairs in a broadcast table of at most HEAD pairs; links of all other pairs
are joined with their counts.
"""

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness.llm.bpe import bytes_of_ids
from chainwitness.llm.chunks import spans
from chainwitness.llm.common import arrow_rows, small_slices, sole, stage
from chainwitness.llm.pieces import ENCODE_BYTES, library_encoder, piece_cuts
from chainwitness.llm.sentence_pieces import MARK, Model, shared_model, spaced
from chainwitness.llm.words import Words

HEAD = 1 << 19  # pairs in the broadcast table, 16 bytes each
SLOTS = 1 << 20  # of the two tables into which a process puts them
ODD = -1  # in place of ids that spell other bytes
LANE_BYTES = 256
COUNTED = 2_000_000  # pairs that a task counts before it passes them on
ALIGNED = "_id bigint, _hash binary, a array<int>, b array<int>, link_a array<int>, link_b array<int>, groups string"


class _Tokens:
    """Token sequences of all texts of a column that both tokenizers spell in the same bytes."""

    def __init__(self, pair, column):
        full = pc.fill_null(pc.greater(pc.binary_length(column), 0), False)
        whole = pc.and_(full, pc.invert(pc.fill_null(pc.match_substring(column, MARK), False)))
        self.rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        self._encode(pair, column.take(pa.array(self.rows)))
        odd = np.zeros(len(self.rows), bool)
        for side in (0, 1):
            odd[self.texts_of(side)[self.ids[side] == ODD]] = True
        if odd.any():
            self.rows = self.rows[~odd]
            self._encode(pair, column.take(pa.array(self.rows)))

    def _encode(self, pair, column):
        self.offsets, self.data = spaced(column)
        texts = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(self.offsets.tobytes()), pa.py_buffer(self.data.tobytes())])
        cuts = piece_cuts(Words(texts, named=False)), pair.b.cuts(self.offsets, self.data)
        marks = np.zeros((2, len(self.data) + 1), bool)
        self.ids, self.counts, self.ends = [], [], []
        for side, table in enumerate(pair.tables):
            ids, counts = table.encode(self.data, cuts[side][:-1], cuts[side][1:])
            text = np.searchsorted(self.offsets, cuts[side][:-1], side="right") - 1
            self.ids.append(ids)
            self.counts.append(np.bincount(text, counts, len(column)).astype(np.int64))
            self.ends.append(np.cumsum(pair.sizes[side][ids]))
            marks[side, cuts[side]] = True
        self.known, self.width = np.flatnonzero(marks[0] & marks[1]), pair.width

    def lanes(self):
        """Where lanes begin: texts, and the first known cut in each stretch of LANE_BYTES of a text."""
        starts, known = self.offsets[:-1], self.known
        text = np.searchsorted(starts, known, side="right") - 1
        inside = (text >= 0) & (known < len(self.data))
        known, text = known[inside], text[inside]
        stretch = (known - starts[text]) // LANE_BYTES
        first = np.append(True, (np.diff(text) != 0) | (np.diff(stretch) != 0))[: len(known)]
        marks = np.zeros(len(self.data) + 1, bool)
        marks[starts] = marks[known[first]] = True
        return np.flatnonzero(marks)

    def links(self):
        """Arrays of the linked tokens' places on both sides, and whether each token of A and of B ends a group."""
        starts = self.lanes()
        ends_a, ends_b = self.ends
        a = np.searchsorted(ends_a, starts, side="right")
        b = np.searchsorted(ends_b, starts, side="right")
        stop = np.append(a[1:], len(ends_a))
        cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
        found_a, found_b = [], []
        while len(a):
            found_a.append(a)
            found_b.append(b)
            end_a, end_b = ends_a[a], ends_b[b]
            on_a, on_b = end_a <= end_b, end_b <= end_a
            both = on_a & on_b
            cut_a[a[both]] = cut_b[b[both]] = True
            a, b = a + on_a, b + on_b
            left = a < stop
            if not left.all():
                a, b, stop = a[left], b[left], stop[left]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(found_a or none), np.concatenate(found_b or none), cut_a, cut_b

    def codes(self, a, b):
        return self.ids[0][a].astype(np.int64) * self.width + self.ids[1][b]

    def texts_of(self, side):
        return np.repeat(np.arange(len(self.rows)), self.counts[side])


class Pair:
    """Both tokenizers of a process, and the bytes of their ids."""

    def __init__(self, source, proto):
        self.b = Model(proto)
        self.tables = [library_encoder(source, plain_specials=True).table, self.b.table]
        of_a = bytes_of_ids(source)
        contents = [of_a.get(i, b"") for i in range(max(of_a) + 1)], self.b.content
        self.sizes = [np.array(list(map(len, c)), np.int64) for c in contents]
        self.places = [np.cumsum(s) - s for s in self.sizes]
        self.bytes = [np.frombuffer(b"".join(c), np.uint8) for c in contents]
        self.width = len(self.b.content)
        for side, table in enumerate(self.tables):
            table.encode_new = self._spelt(side, table.encode_new)
        digits = [b"%d," % i for i in range(max(map(len, contents)))]
        self.digit_sizes = np.array(list(map(len, digits)), np.int64)
        self.digit_places = np.cumsum(self.digit_sizes) - self.digit_sizes
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    @staticmethod
    def width_of(b_file):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=b_file).vocab_size()

    def _spelt(self, side, encode_new):
        """``encode_new`` that gives the one id ODD for a chunk that the ids spell in other bytes."""
        known, places, sizes = self.bytes[side], self.places[side], self.sizes[side]

        def checked(data, begins, ends):
            ids, counts = encode_new(data, begins, ends)
            counts, lengths = np.asarray(counts, np.int64), ends - begins
            of_id = np.repeat(np.arange(len(counts)), counts)
            odd = np.bincount(of_id, sizes[ids], len(counts)) != lengths
            rest = ~odd
            alike = known[spans(places[ids], sizes[ids] * rest[of_id])] == data[spans(begins[rest], lengths[rest])]
            odd[np.repeat(np.flatnonzero(rest), lengths[rest])[~alike]] = True
            if not odd.any():
                return ids, counts
            keep = ~odd[of_id]
            totals = np.where(odd, 1, counts)
            found = np.full(int(totals.sum()), ODD, np.int32)
            found[spans((np.cumsum(totals) - totals)[~odd], counts[~odd])] = ids[keep]
            return found, totals

        return checked

    def group_texts(self, tokens, cut_a, cut_b):
        """``a1,a2|b1;a3|b2,b3`` of every text: groups in order, A's ids before B's."""
        (ids_a, ids_b), n = tokens.ids, len(tokens.rows)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        place_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
        ids, ends = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        ends[place_a[cut_a]], ends[place_b[cut_b]] = ord("|"), ord(";")
        sizes = self.digit_sizes[ids]
        whole, stops = self.digits[spans(self.digit_places[ids], sizes)], np.cumsum(sizes)
        whole[stops - 1] = ends
        last = np.append(0, stops)[np.append(0, np.cumsum(tokens.counts[0] + tokens.counts[1]))]
        text = whole.tobytes()
        return [text[last[k]:last[k + 1] - 1] for k in range(n)]


@sole
def _pair(source, proto):
    return Pair(source, proto)


def _shared(spark, a_file, b_file):
    with open(a_file, encoding="utf-8") as file:
        source = spark.sparkContext.broadcast(file.read())
    proto = shared_model(spark, b_file)
    return lambda: _pair(source.value, proto.value)


def align(docs: DataFrame, a_file, b_file) -> DataFrame:
    """Tokens of both sides, their links and the groups between common cuts, per document.

    ``docs`` comes from ``common.identified``. ``link_a`` and ``link_b`` are places in ``a`` and ``b``, in order of
    A, then B; ``groups`` is ``a1,a2|b1;a3|b2,b3``. Texts that are null or empty, or that a tokenizer spells in
    other bytes, have empty arrays. One row per input row, repeated rows included; texts of any length.
    """
    pair = _shared(docs.sparkSession, a_file, b_file)
    lists = pa.list_(pa.int32())
    schema = pa.schema([("_id", pa.int64()), ("_hash", pa.binary()), ("a", lists), ("b", lists), ("link_a", lists), ("link_b", lists), ("groups", pa.string())])

    def run(batches):
        own = pair()
        for batch in small_slices(batches, max_bytes=ENCODE_BYTES):
            tokens = _Tokens(own, batch.column("_text"))
            a, b, cut_a, cut_b = tokens.links()
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            texts = [t.decode() for t in own.group_texts(tokens, cut_a, cut_b)]
            of_link = tokens.texts_of(0)[a]
            base = [np.cumsum(c) - c for c in tokens.counts]
            n_links = np.bincount(of_link, minlength=len(tokens.rows))
            parts = [*zip(tokens.ids, tokens.counts), (a - base[0][of_link], n_links), (b - base[1][of_link], n_links)]
            columns = []
            for values, counts in parts:
                per_row = np.zeros(batch.num_rows, np.int64)
                per_row[tokens.rows] = counts
                columns.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(per_row)).astype(np.int32), pa.array(values.astype(np.int32))))
            groups = np.full(batch.num_rows, "", object)
            groups[tokens.rows] = texts
            yield arrow_rows(schema, batch.column("_id"), batch.column("_hash"), *columns, groups)

    return docs.select("_id", "_hash", "_text").mapInArrow(run, ALIGNED)


def _merged(codes, counts):
    """Sums of the counts of equal codes."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def pair_counts(docs: DataFrame, a_file, b_file) -> DataFrame:
    """``code`` (A's id times the size of B's vocabulary plus B's id) and how many links of all texts hold that pair."""
    pair = _shared(docs.sparkSession, a_file, b_file)
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches):
        own, kept = pair(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in small_slices(batches, "_text", ENCODE_BYTES):
            tokens = _Tokens(own, batch.column("_text"))
            a, b, _, _ = tokens.links()
            codes = np.sort(tokens.codes(a, b))
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
            kept.append((codes[first], np.diff(np.append(first, len(codes)))))
            if sum(len(codes) for codes, _ in kept) > COUNTED:
                kept = [_merged(*map(np.concatenate, zip(*kept)))]
                if len(kept[0][0]) > COUNTED // 2:
                    yield arrow_rows(schema, *kept.pop())
                    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield arrow_rows(schema, *_merged(*map(np.concatenate, zip(*kept))))

    found = docs.select("_text").mapInArrow(run, "code bigint, n bigint")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def judged(counts: DataFrame, width) -> DataFrame:
    """Adds ``best``: whether no pair with the same id of B has a higher count."""
    most = counts.groupBy((F.col("code") % width).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("code") % width == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


class _Head:
    """Counts of the commonest pairs, each in one of two tables; ``times_two`` is twice the count, plus one if best."""

    def __init__(self, codes, times_two):
        self.tables = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            keys, values = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int64)
            slot = self._slots(codes, factor)
            keys[slot], values[slot] = codes, times_two
            self.tables.append((factor, keys, values))
            left = keys[slot] != codes
            codes, times_two = codes[left], times_two[left]  # what is left after both is joined like rare pairs

    def _slots(self, codes, factor):
        return (codes.astype(np.uint64) * np.uint64(factor) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)

    def look(self, codes):
        """``times_two`` of each code, 0 if it is in neither table."""
        found = np.zeros(len(codes), np.int64)
        for factor, keys, values in self.tables:
            slot = self._slots(codes, factor)
            found += np.where(keys[slot] == codes, values[slot], 0)
        return found


@lru_cache(maxsize=1)
def _head(key, table):
    return _Head(*(np.frombuffer(x, np.int64) for x in table))


def head_of(counts: DataFrame, limit=HEAD):
    """The commonest pairs for a broadcast, at most ``limit``: all pairs above a power of two that leaves no more."""
    power = F.floor(F.log2(F.col("n").cast("double")) + F.lit(1e-9)).cast("int")
    at, total = None, 0
    for row in sorted(counts.groupBy(power.alias("p")).count().collect(), reverse=True):  # one row per power of two
        if total + row["count"] > limit:
            break
        at, total = row["p"], total + row["count"]
    taken = counts.where(power >= at if at is not None else F.lit(False)).select("code", (F.col("n") * 2 + F.col("best").cast("long")).alias("n")).toArrow()
    return tuple(taken.column(c).to_numpy().astype(np.int64).tobytes() for c in ("code", "n"))


def summaries(docs: DataFrame, a_file, b_file, head=HEAD) -> DataFrame:
    """Per document: tokens, groups and links, how many links are with a pair that is the commonest of its id of B, and
    the sum of the pairs' counts over all links.

    ``docs`` comes from ``common.identified``. Result: ``_id``, ``_hash``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best``, ``count_sum``, ``groups_sha256`` ("" without tokens), one row per input row. Treatment of nulls, empty,
    odd and long texts as in ``align``; repeated rows count as often as they are there. ``head`` bounds the
    broadcast table and changes no result.
    """
    spark = docs.sparkSession
    pair = _shared(spark, a_file, b_file)
    width = Pair.width_of(b_file)
    counts = stage(judged(stage(pair_counts(docs, a_file, b_file), "pairs"), width), "judged")
    table, key = spark.sparkContext.broadcast(head_of(counts, head)), uuid.uuid4().hex
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    rest = pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))
    schema = pa.schema([("_id", pa.int64()), ("_hash", pa.binary()), ("_row", pa.int64()), *((n, pa.int64()) for n in numbers),
                        ("groups_sha256", pa.string()), ("rest", rest)])

    def run(batches):
        from pyspark import TaskContext

        own, row = pair(), TaskContext.get().partitionId() << 40
        head = _head(key, table.value)
        for batch in small_slices(batches, max_bytes=ENCODE_BYTES):
            tokens = _Tokens(own, batch.column("_text"))
            a, b, cut_a, cut_b = tokens.links()
            here = len(tokens.rows)
            text = tokens.texts_of(0)[a]
            codes = tokens.codes(a, b)
            times_two = head.look(codes)
            n = times_two >> 1
            low, high = (np.bincount(text, x, here).astype(np.int64) for x in (n & (1 << 26) - 1, n >> 26))  # both are exact
            found = np.zeros((6, batch.num_rows), np.int64)
            found[:, tokens.rows] = [
                *tokens.counts, np.bincount(tokens.texts_of(0)[cut_a], minlength=here), np.bincount(text, minlength=here),
                np.bincount(text, times_two & 1, here), low + (high << 26)]
            shas = np.full(batch.num_rows, "", object)
            shas[tokens.rows] = [hashlib.sha256(t).hexdigest() for t in own.group_texts(tokens, cut_a, cut_b)]
            rare = np.flatnonzero(times_two == 0)
            rare = rare[np.lexsort((codes[rare], text[rare]))]
            first = np.flatnonzero(np.append(True, (np.diff(text[rare]) != 0) | (np.diff(codes[rare]) != 0))[: len(rare)])
            times = np.diff(np.append(first, len(rare)))
            rare = rare[first]
            per_row = np.zeros(batch.num_rows, np.int64)
            per_row[tokens.rows] = np.bincount(text[rare], minlength=here)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(per_row)).astype(np.int32), pa.StructArray.from_arrays(
                [pa.array(codes[rare], pa.int64()), pa.array(times, pa.int64())], fields=list(rest.value_type)))
            yield arrow_rows(schema, batch.column("_id"), batch.column("_hash"), row + np.arange(batch.num_rows), *found, shas, lists)
            row += batch.num_rows

    full = stage(docs.select("_id", "_hash", "_text").mapInArrow(
        run, "_id bigint, _hash binary, _row bigint, " + "".join(f"{n} bigint, " for n in numbers)
        + "groups_sha256 string, rest array<struct<code: bigint, times: bigint>>"), "aligned")
    rare = full.select("_row", F.explode("rest").alias("r")).select("_row", "r.*").join(counts, "code")
    rare = rare.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    return full.join(rare, "_row", "left").select(
        "_id", "_hash", *numbers[:4], (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
