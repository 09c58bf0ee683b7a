"""Repeated passages by recompression: words that a repeated run of words covers are removed.

Every text is rewritten in rounds. First, runs of one word become one symbol; then, round by
round, symbols are dealt by a hash into left and right ones, and each left symbol followed by
a right one merges with it. A symbol's name is a hash of what it was made of, so all tasks
name equal runs and pairs alike, and a round needs no exchange. Along with each symbol goes
the span of words that its making looked at. Inside a repeated passage every symbol whose
span lies in the passage turns up in each copy: so a window of words with an interior symbol
that occurs only once in the whole table is not repeated. What is left are windows made of
repeated symbols only; they are few, and their names are counted to verify them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness.llm.common import arrow_rows, small_slices, stage
from chainwitness.llm.words import Words, mixed, span_names
from chainwitness.session import release

WINDOW = 35
ROUNDS = 6
_KEY = ["_id", "_hash"]


def symbols(names, text_of, rounds=ROUNDS):
    """Name, first and last looked-at word (end exclusive) of the symbols of the last round.

    What a symbol looks at beyond the ends of its text is counted as a word there, so that such
    a symbol lies in no window.
    """
    n = len(names)
    change = np.ones(n + 1, bool)
    if n:
        change[1:n] = (names[1:] != names[:-1]) | (text_of[1:] != text_of[:-1])
    begin = np.flatnonzero(change[:n])
    end = np.append(begin[1:], n) if n else begin
    names, text = mixed(names[begin] + mixed((end - begin).astype(np.uint64))), text_of[begin]
    low, high = begin - 1, end + 1  # a run ends where another word stands
    for turn in range(rounds):
        n = len(names)
        if not n:
            break
        left = (mixed(names ^ np.uint64(0x1D8E4E27C47D124F * (turn + 1) % (1 << 64))) & np.uint64(1)).astype(bool)
        same = np.append(text[1:] == text[:-1], False)  # a neighbour follows in the same text
        pair = same & left & ~np.append(left[1:], True)
        second = np.append(False, pair[:-1])
        # a lone left symbol has looked at the next one, a lone right symbol at the one before
        after = np.where(left, np.arange(n) + same, np.arange(n) - np.append(False, same[:-1]))
        edge = after == np.arange(n)
        new_low = np.minimum(low, low[after]) - (edge & ~left)
        new_high = np.maximum(high, high[after]) + (edge & left)
        joined = names.copy()
        at = np.flatnonzero(pair)
        joined[at] = mixed(mixed(names[at]) + np.uint64(0x9FB21C651E98DF25) * names[at + 1])
        keep = ~second
        names, text, low, high = joined[keep], text[keep], new_low[keep], new_high[keep]
    return names, text, low, high


def _named_symbols(docs, window, rounds):
    """The symbols that fit into a window, of all texts."""
    schema = pa.schema([
        ("_id", pa.int64()), ("_hash", pa.binary()), ("name", pa.int64()), ("low", pa.int32()), ("high", pa.int32())
    ])

    def run(batches):
        for batch in small_slices(batches):
            words = Words(batch.column("_text"))
            names, text, low, high = symbols(words.names, words.text_of(), rounds)
            # spans that reach beyond a text fit into no window of it
            fits = (high - low <= window) & (low >= words.first[text]) & (high <= words.first[text + 1])
            names, text, low, high = names[fits], text[fits], low[fits], high[fits]
            rows, base = pa.array(text), words.first[text]
            yield arrow_rows(
                schema, batch.column("_id").take(rows), batch.column("_hash").take(rows),
                pa.array(names.view(np.int64)), (low - base).astype(np.int32), (high - base).astype(np.int32),
            )

    return docs.mapInArrow(run, "_id bigint, _hash binary, name bigint, low int, high int")


def _only_once(rows, key, *place):
    """Rows whose ``key`` no other row has, by an aggregate that combines before the shuffle."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in place))
    return counted.where("n = 1").select(*place)


def _starts(n_words, window, lows, highs):
    """Which windows of a text hold none of the spans [low, high), as a mask over their starts."""
    n = max(0, n_words - window + 1)
    marks = np.zeros(n + 1, np.int64)
    first, last = np.maximum(highs - window, 0), np.minimum(lows, n - 1)
    good = first <= last
    np.add.at(marks, first[good], 1)
    np.add.at(marks, last[good] + 1, -1)
    return np.cumsum(marks)[:n] == 0


def _spans(column, row):
    """Two arrays from a row of a list<struct<low, high>> column; null is none."""
    value = column[row]
    if not value.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (value.values.field(i).to_numpy().astype(np.int64) for i in range(2))


def _candidates(docs, window):
    """Name (96 bits) and place of each window that no symbol of its own rules out."""
    schema = pa.schema([
        ("_id", pa.int64()), ("_hash", pa.binary()), ("name", pa.int64()), ("check", pa.int32()), ("low", pa.int32())
    ])

    def run(batches):
        for batch in small_slices(batches):
            words = Words(batch.column("_text"))
            spans, found = batch.column("_once"), []
            for row, (first, n) in enumerate(zip(words.first.tolist(), words.counts().tolist())):
                if n >= window:
                    found.append(np.flatnonzero(_starts(n, window, *_spans(spans, row))) + first)
            at = np.concatenate(found) if found else np.zeros(0, np.int64)
            text = np.searchsorted(words.first, at, side="right") - 1
            rows = pa.array(text)
            yield arrow_rows(
                schema, batch.column("_id").take(rows), batch.column("_hash").take(rows),
                pa.array(span_names(words.names, at, at + window).view(np.int64)),
                (span_names(mixed(words.names), at, at + window) >> np.uint64(32)).astype(np.uint32).view(np.int32),
                (at - words.first[text]).astype(np.int32),
            )

    return docs.mapInArrow(run, "_id bigint, _hash binary, name bigint, check int, low int")


def _kept(docs, window):
    """The texts without the words of repeated windows."""
    schema = pa.schema([
        ("_id", pa.int64()), ("_hash", pa.binary()), ("_n_words", pa.int64()), ("_n_removed", pa.int64()), ("_kept", pa.string())
    ])

    def run(batches):
        for batch in small_slices(batches):
            counts, removed, texts = [], [], []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                words = (text or "").encode().split()
                n = len(words)
                gone = np.zeros(n, bool)
                if n >= window:
                    repeated = _starts(n, window, *_spans(batch.column("_once"), row))
                    alone = batch.column("_alone")[row]
                    if alone.is_valid:
                        repeated[alone.values.to_numpy()] = False
                    marks = np.zeros(n + 1, np.int64)
                    marks[: len(repeated)] += repeated
                    marks[window:window + len(repeated)] -= repeated
                    gone = np.cumsum(marks)[:n] > 0
                counts.append(n)
                removed.append(int(gone.sum()))
                if removed[-1]:
                    words = [words[i] for i in np.flatnonzero(~gone)]
                texts.append(b" ".join(words).decode())
            yield arrow_rows(schema, batch.column("_id"), batch.column("_hash"), counts, removed, texts)

    return docs.mapInArrow(run, "_id bigint, _hash binary, _n_words bigint, _n_removed bigint, _kept string")


def remove_repeats(docs: DataFrame, window=WINDOW, rounds=ROUNDS) -> DataFrame:
    """Remove every word that a window of ``window`` words covers which also starts elsewhere.

    ``docs`` comes from ``common.identified``. Result, one row per input row: ``_id``, ``_hash``,
    ``_n_words``, ``_n_removed`` and ``_kept``, the words left, joined by single spaces. All copies
    of a repeated window go, the first too; repeated rows count as texts of their own. Texts
    without ``window`` words, empty and null texts stay (null gives no words and an empty
    ``_kept``). Ties cannot arise. Long texts are handled row by row; only the spans found in one
    text are ever collected. No exchange holds the places of one passage together: the counts
    combine before the shuffle, and only what occurs once returns to its text.
    """
    docs = docs.select("_id", "_hash", "_text")
    once = _only_once(_named_symbols(docs, window, rounds), "name", *_KEY, "low", "high")
    spans = once.groupBy(_KEY).agg(F.collect_list(F.struct("low", "high")).alias("_once"))
    spans = stage(spans, "spans")

    def with_spans(left, right):
        names = [c for c in right.columns if c not in _KEY]
        right = right.select(F.col("_id").alias("i"), F.col("_hash").alias("h"), *names)
        return left.join(right, left["_id"].eqNullSafe(right["i"]) & (left["_hash"] == right["h"]), "left").drop("i", "h")

    # kept with their spans, so that no shuffle of whole texts is on disk beside that of the windows
    docs = stage(with_spans(docs, spans), "texts")
    release(spans)
    windows = _candidates(docs, window)
    single = _only_once(windows.withColumn("key", F.struct("name", "check")), "key", *_KEY, "low")
    alone = stage(single.groupBy(_KEY).agg(F.collect_list("low").alias("_alone")), "windows")
    return _kept(with_spans(docs, alone), window)
