"""Lines that repeat an earlier line up to one edited word go, by deletion neighbourhoods.

A line is its words in lower case. Two lines are near if one word is replaced, put in or
taken out, provided that both are long enough. A line's neighbourhood is the line with any
one word deleted: two lines differ by a replaced word exactly if they meet in a variant with
the word missing at the same place, and by an added word exactly if a variant of one is the
other. Variants are emitted as hashed keys and joined; then the words themselves are compared.

Before that, lines without a partner are found by halves: one edit leaves the first or the
last half of the shorter line unchanged, so only lines that share such a half with another
line can be near it, and only they emit variants. A bit table of fixed size, filled from the shared
halves, picks these lines in a second scan, so that no text is shuffled for them; lines that
it lets through by chance cost work and change no result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness.llm.common import arrow_rows, small_slices, stage
from chainwitness.llm.words import Words, mixed, powers, span_names
from chainwitness.session import release

WORDS_PER_EDIT = 10
BITS = 27  # of a half key that pick a bit: a table of 16 MB
_PLACE = ["_id", "_hash", "_line"]


def _lines(words):
    """Text, line number and first and last word (end exclusive) of every line that has words."""
    breaks = np.cumsum(words.data == 10)
    text = words.text_of()
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    before = np.concatenate(([0], breaks))[words.offsets[:-1]]
    line = breaks[words.starts] - before[text]
    opens = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1])))
    return text[opens], line[opens], opens, np.append(opens[1:], len(text))


def _half_keys(words, first, last):
    """Keys of both halves of each line, as it is and with a word more; a row for each line."""
    n, keys = last - first, []
    for shorter in (n, n - 1):
        half, salt = shorter // 2, mixed(shorter.astype(np.uint64))
        keys.append(span_names(words.names, first, first + half) ^ salt)
        keys.append(mixed(span_names(words.names, last - half, last) ^ salt))
    return np.stack(keys, axis=1)


def _all_lines(docs, words_per_edit):
    """Place, name (two words) and half keys of every line with words; short lines have no half keys."""
    schema = pa.schema([
        ("_id", pa.int64()), ("_hash", pa.binary()), ("_line", pa.int32()),
        ("name", pa.int64()), ("check", pa.int64()), ("halves", pa.list_(pa.int64())),
    ])

    def run(batches):
        for batch in small_slices(batches):
            words = Words(batch.column("_text"), lower=True)
            text, line, first, last = _lines(words)
            long = last - first >= words_per_edit
            offsets = np.concatenate(([0], np.cumsum(4 * long))).astype(np.int32)
            halves = pa.ListArray.from_arrays(offsets, _half_keys(words, first[long], last[long]).ravel().view(np.int64))
            rows = pa.array(text)
            yield arrow_rows(
                schema, batch.column("_id").take(rows), batch.column("_hash").take(rows), line.astype(np.int32),
                pa.array(span_names(words.names, first, last).view(np.int64)),
                pa.array(span_names(mixed(words.names), first, last).view(np.int64)), halves,
            )

    return docs.mapInArrow(
        run, "_id bigint, _hash binary, _line int, name bigint, check bigint, halves array<bigint>"
    )


def _bit_table(keys):
    """Two bits for each key, by its first and its last bits: a table of fixed size, whatever the number of keys."""
    places = F.array(F.shiftrightunsigned("half", 64 - BITS), F.col("half").bitwiseAND((1 << BITS) - 1))
    places = keys.select(F.explode(places).alias("place"))
    cells = places.groupBy(F.shiftright("place", 6).alias("cell")).agg(F.bit_or(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(1 << BITS - 6, np.int64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return table.view(np.uint64)


def _has_bits(table, keys):
    first, last = keys >> np.uint64(64 - BITS), keys & np.uint64((1 << BITS) - 1)
    bit = lambda place: table[place >> np.uint64(6)] >> (place & np.uint64(63))
    return (bit(first) & bit(last) & np.uint64(1)).astype(bool)


def _line_texts(docs, shared, words_per_edit):
    """First occurrences of the lines with a half in ``shared``: place and words, in lower case, joined by single spaces."""
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(shared))
    schema = pa.schema([
        ("_id", pa.int64()), ("_hash", pa.binary()), ("_line", pa.int32()), ("name", pa.int64()), ("check", pa.int64()), ("words", pa.binary())
    ])

    def run(batches):
        for batch in small_slices(batches):
            words = Words(batch.column("_text"), lower=True)
            text, line, first, last = _lines(words)
            long = np.flatnonzero(last - first >= words_per_edit)
            at = long[_has_bits(table.value, _half_keys(words, first[long], last[long])).any(axis=1)]
            first, last, rows = first[at], last[at], pa.array(text[at])
            spelt = [words.data[a:b].tobytes().lower().split() for a, b in zip(words.starts[first], words.ends[last - 1])]
            yield arrow_rows(
                schema, batch.column("_id").take(rows), batch.column("_hash").take(rows), line[at].astype(np.int32),
                pa.array(span_names(words.names, first, last).view(np.int64)),
                pa.array(span_names(mixed(words.names), first, last).view(np.int64)), [b" ".join(x) for x in spelt],
            )

    found = docs.mapInArrow(run, "_id bigint, _hash binary, _line int, name bigint, check bigint, words binary")
    return found.groupBy("name", "check").agg(F.min(F.struct(*_PLACE, "words")).alias("first")).select("first.*")


def _variants(lines):
    """Keys of each line: itself, and itself without each of its words, told apart by ``kind``.

    Kind 0: the word at a place is missing, the place is part of the key. Kind 1: a word is
    missing anywhere. Kind 2: the whole line, with a key that kind 1 rows of longer lines share.
    """
    schema = pa.schema([("number", pa.int64()), ("kind", pa.int8()), ("key", pa.int64())])

    def run(batches):
        for batch in small_slices(batches, "words"):
            words = Words(batch.column("words").cast(pa.large_binary()))
            first, last = words.first[:-1], words.first[1:]
            n = last - first
            row = words.text_of()
            at = np.arange(len(row))
            up, down = powers(len(at) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.names * up[: len(at)])))
            head = (sums[at] - sums[first[row]]) * down[first[row]]
            tail = (sums[last[row]] - sums[at + 1]) * down[first[row]] * down[np.ones(len(at), np.int64)]
            length = (n[row] - 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            missing = mixed(head + tail + length)  # what span_names gives for the words left
            placed = mixed(missing + mixed((at - first[row]).astype(np.uint64) + np.uint64(1)))
            whole = span_names(words.names, first, last)
            keys = np.concatenate((placed, missing, whole))
            kinds = np.concatenate((np.zeros(len(at), np.int8), np.ones(len(at), np.int8), np.full(len(n), 2, np.int8)))
            rows = pa.array(np.concatenate((row, row, np.arange(len(n)))))
            yield arrow_rows(schema, batch.column("number").take(rows), pa.array(kinds), pa.array(keys.view(np.int64)))

    return lines.select("number", "words").mapInArrow(run, "number bigint, kind tinyint, key bigint")


def one_edit(a, b):
    """Whether two lists of words differ by at most one replaced, added or missing word."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    if len(a) == len(b):
        return a[same + 1:] == b[same + 1:]
    return a[same + (len(a) > len(b)):] == b[same + (len(b) > len(a)):]


def _verified(pairs):
    """Places of lines whose words are within one edit of those of the earlier line."""
    schema = pa.schema([("_id", pa.int64()), ("_hash", pa.binary()), ("_line", pa.int32())])

    def run(batches):
        for batch in batches:
            good = [one_edit(a.split(), b.split()) for a, b in zip(
                batch.column("words").to_pylist(), batch.column("earlier").to_pylist())]
            yield arrow_rows(schema, *(batch.column(c).filter(pa.array(good, pa.bool_())) for c in _PLACE))

    return pairs.mapInArrow(run, "_id bigint, _hash binary, _line int")


def _near(first, docs, words_per_edit):
    """Places of first occurrences that are near an earlier line."""
    halves = first.select("name", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").select("half")
    found = stage(_line_texts(docs, shared, words_per_edit), "lines")
    # numbers in the order of places stand for them in all that follows
    lines = stage(found.orderBy(*_PLACE).withColumn("number", F.monotonically_increasing_id()), "numbered")
    variants = stage(_variants(lines), "variants")
    met = variants.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 0, F.col("number"))).alias("replaced"),
        F.min(F.when(F.col("kind") == 1, F.col("number"))).alias("longer"),
        F.min(F.when(F.col("kind") == 2, F.col("number"))).alias("shorter"),
        F.count(F.lit(1)).alias("n"), F.max("kind").alias("most"), F.min("kind").alias("least"),
    ).where("n > 1 and (most = 0 or (most = 2 and least = 1))")
    met = stage(met.select("key", "replaced", "longer", "shorter"), "met")
    earlier = F.when(F.col("kind") == 0, F.col("replaced")).when(F.col("kind") == 1, F.col("shorter")).otherwise(F.col("longer"))
    pairs = variants.join(met, "key").withColumn("before", earlier).where("before < number").select("number", "before").distinct()
    other = lines.select(F.col("number").alias("before"), F.col("words").alias("earlier"))
    near = stage(_verified(pairs.join(other, "before").join(lines, "number").select(*_PLACE, "words", "earlier")).distinct(), "near")
    release(found, lines, variants, met)
    return near


def _joined(left, right, how):
    """Join per-document columns to documents by their two key columns."""
    names = [c for c in right.columns if c not in ("_id", "_hash")]
    right = right.select(F.col("_id").alias("i"), F.col("_hash").alias("h"), *names)
    return left.join(right, left["_id"].eqNullSafe(right["i"]) & (left["_hash"] == right["h"]), how).drop("i", "h")


def _rewritten(docs):
    """The texts with only those lines that have no words or are listed in ``_lines``."""
    schema = pa.schema([
        ("_id", pa.int64()), ("_hash", pa.binary()), ("_n_lines", pa.int64()), ("_n_removed", pa.int64()), ("_kept", pa.string())
    ])

    def run(batches):
        for batch in small_slices(batches):
            lines_of, removed, texts = [], [], []
            for text, kept in zip(batch.column("_text").to_pylist(), batch.column("_lines").to_pylist()):
                if text is None:
                    lines_of.append(0)
                    removed.append(0)
                    texts.append(None)
                    continue
                lines, kept = text.split("\n"), set(kept or ())
                left = [x for i, x in enumerate(lines) if i in kept or not x.encode().split()]
                lines_of.append(len(lines))
                removed.append(len(lines) - len(left))
                texts.append("\n".join(left) if removed[-1] else text)
            found = arrow_rows(schema, batch.column("_id"), batch.column("_hash"), lines_of, removed, texts)
            yield found.append_column("_row", batch.column("_row")) if carried else found

    carried = f", _row {docs.schema['_row'].dataType.simpleString()}" if "_row" in docs.columns else ""
    return docs.mapInArrow(run, "_id bigint, _hash binary, _n_lines bigint, _n_removed bigint, _kept string" + carried)


def remove_lines(docs: DataFrame, words_per_edit=WORDS_PER_EDIT) -> DataFrame:
    """Remove every line that equals, or is within one edited word of, an earlier line.

    ``docs`` comes from ``common.identified``. Lines end at a line feed and are compared by their
    words in lower case (A-Z); lines of fewer than ``words_per_edit`` words must be equal. Earlier
    is by (id, text hash, line number), null ids first; an earlier line counts even if it goes
    itself. Lines without words always stay. Result, one row per input row: ``_id``, ``_hash``,
    ``_n_lines``, ``_n_removed``, ``_kept`` (the text that is left; null stays null), and ``_row`` if carried. Rows that
    repeat both id and text are one document and get the same result. Ties cannot arise
    otherwise, as places are unique. Nothing is gathered but line numbers of one document;
    equal lines, halves and variants meet in aggregates that combine before the shuffle.
    """
    whole, docs = docs, docs.select("_id", "_hash", "_text")
    lines = _all_lines(docs.where("_text is not null"), words_per_edit)
    first = lines.groupBy("name", "check").agg(
        F.min(F.struct(*_PLACE)).alias("place"), F.first("halves").alias("halves")
    ).select("place.*", "name", "halves")
    first = stage(first, "first")
    near = _near(first, docs.where("_text is not null"), words_per_edit)
    place = [F.col(c).eqNullSafe(F.col(c + "2")) for c in _PLACE]
    kept = first.select(*_PLACE).join(near.select(*(F.col(c).alias(c + "2") for c in _PLACE)), place, "left_anti")
    kept = kept.groupBy("_id", "_hash").agg(F.collect_list("_line").alias("_lines"))
    return _rewritten(_joined(whole, kept, "left"))
