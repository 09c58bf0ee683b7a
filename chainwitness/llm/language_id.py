"""Language of texts by cross-parsing: the language whose sample explains a text in fewest phrases.

Each language has a suffix automaton of a sample of its texts, which accepts exactly the
substrings of the sample. A text is cut greedily into the longest phrases that occur there; few
long phrases mean a near language. With all missing transitions led back to the start, a
phrase is a step of one table, and numpy moves thousands of pieces of text through it together.
Texts are parsed in blocks of BLOCK letters, across which no phrase goes; every letter counts.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainwitness.llm.common import arrow_rows, small_slices, sole

SAMPLE_ROWS = 64  # rows of a language that a sample is taken from
SAMPLE_LETTERS = 24_000  # letters and gaps of a language that its automaton is built of
PIECES = 4  # of a text that is longer than its share of a sample
FOLDS, HELD_OUT = 4, 2
BLOCK = 512
LANES = 8192
LETTERS, OTHERS = 64, 32  # classes: the gap and the commonest letters, and hash classes of all others
_WIDTH = LETTERS + OTHERS + 1  # one more for what is behind the end of a block
UNKNOWN = "und"


def held_out(id_col):
    """Whether a document takes no part in training; null for documents without id."""
    return F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT


def _share(sizes, letters):
    """The largest size up to which texts of these sizes can be taken so that all together have at most ``letters``."""
    left = letters
    for n, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - n) > left:
            return left // (len(sizes) - n)
        left -= size
    return letters


def _spread_pieces(text, share):
    """The whole text, or pieces of it at even distances, ``share`` letters and gaps together."""
    if len(text) > share:
        text = " ".join("".join(c if c.isalpha() else " " for c in text).split())
    if len(text) <= share:
        return [text]
    size = max(share // PIECES, 1)
    n = min(PIECES, share)
    return [text[at:at + size] for at in ((len(text) - size) * k // max(n - 1, 1) for k in range(n))]


def sample(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", rows=SAMPLE_ROWS, letters=SAMPLE_LETTERS) -> dict[str, list[str]]:
    """Pieces of up to ``rows`` texts of each language, picked by a hash of the id; ``letters`` characters a language.

    Texts with a letter are picked whatever their length. If all of them together are longer than
    ``letters``, those above an equal share give pieces at even distances, of letters and gaps
    alone. The driver gets at most ``rows`` times ``letters`` characters of a language.
    """
    found = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")
    ).where(~held_out(F.col("_id")) & F.col("_lang").isNotNull() & F.col("_text").rlike("\\p{L}"))
    ranked = found.select("_lang", "_id", F.xxhash64("_id", "_text").alias("_key")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_key", "_id"))
    )
    picked = ranked.where(F.col("rank") <= rows).select(
        F.col("_lang").alias("lang"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    squeezed = F.trim(F.regexp_replace("_text", "[^\\p{L}]+", " "))
    size = max(letters // PIECES, 1)
    at = lambda k: F.floor((F.length("_squeezed") - size) * k / (PIECES - 1)).cast("int") + 1
    pieces = F.concat(*(F.substring("_squeezed", at(k), F.lit(size)) for k in range(PIECES)))
    taken = found.join(
        F.broadcast(picked), (F.col("_lang") == F.col("lang")) & (F.col("_id") == F.col("id"))
        & (F.xxhash64("_id", "_text") == F.col("key"))
    ).withColumn("_squeezed", F.when(F.length("_text") > letters, squeezed)).select(
        "_lang", "key", F.when(F.length("_text") <= letters, F.col("_text"))
        .when(F.length("_squeezed") <= letters, F.col("_squeezed")).otherwise(pieces).alias("_text")
    ).distinct().toArrow()
    texts = {}
    for lang, _, text in sorted(zip(*(taken.column(i).to_pylist() for i in range(3)))):
        texts.setdefault(lang, []).append(text)
    shares = {lang: _share([len(t) for t in all_], letters) for lang, all_ in texts.items()}
    return {lang: [p for t in all_ for p in _spread_pieces(t, shares[lang])] for lang, all_ in texts.items()}


@lru_cache(maxsize=1)
def _letter_of():
    """The lower-case letter of each code point, 0 for what is no letter."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def _points(texts):
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


class Model:
    """Letter classes and one automaton table per language."""

    def __init__(self, texts):
        self.languages = sorted(texts)
        letters = _letter_of()
        used = [_points(texts[lang]) for lang in self.languages]
        used = np.concatenate(used) if used else np.zeros(0, np.uint32)
        values, counts = np.unique(letters[used], return_counts=True)
        counts = counts[values > 0]
        values = values[values > 0]
        common = values[np.argsort(-counts, kind="stable")][: LETTERS - 1]
        classes = (letters % OTHERS + LETTERS).astype(np.uint8)
        classes[letters == 0] = 0
        rank = np.zeros(0x110000, np.uint8)
        rank[common] = np.arange(1, len(common) + 1)
        self.classes = np.where(rank[letters] > 0, rank[letters], classes)
        self.tables, self.scale = [], []
        for lang in self.languages:
            codes = self.codes(texts[lang])[0]
            self.tables.append(automaton(codes.tolist()))
            self.scale.append(np.log2(len(codes) + 1))

    def codes(self, texts):
        """Classes of all texts, runs of other characters as one gap, and where each text begins."""
        sizes = np.array([len(t) for t in texts], np.int64)
        code = self.classes[_points(texts)]
        begins = np.concatenate(([0], np.cumsum(sizes)))
        after_gap = np.append(True, code[:-1] == 0)[: len(code)]
        after_gap[begins[:-1][sizes > 0]] = True  # no gap at the start of a text
        keep = (code != 0) | ~after_gap
        return code[keep], np.concatenate(([0], np.cumsum(keep)))[begins]

    def phrases(self, texts):
        """Phrases of each text under each language, and its number of letters and gaps."""
        codes, begins = self.codes(texts)
        lengths = np.diff(begins)
        blocks = -(-lengths // BLOCK)
        text = np.repeat(np.arange(len(texts)), blocks)
        number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = begins[text] + number * BLOCK
        size = np.minimum(BLOCK, begins[text + 1] - start)
        counts = np.zeros((len(self.languages), len(texts)))
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), LANES):
            lanes = order[at:at + LANES]
            steps = np.arange(size[lanes].max())[:, None]
            inside = steps < size[lanes]
            grid = np.where(inside, codes[np.minimum(start[lanes] + steps, len(codes) - 1)], _WIDTH - 1)
            for k, table in enumerate(self.tables):
                place, found = np.zeros(len(lanes), np.int32), np.ones(len(lanes), np.int32)
                for row in grid:
                    place = table[place + row]
                    found += place & 1
                    place >>= 1
                counts[k] += np.bincount(text[lanes], found, len(texts))
        return counts, lengths


def automaton(codes):
    """Step table of the suffix automaton of a sequence of classes.

    Entry ``[state * _WIDTH + class]`` is twice the place of the next state's row, plus one if a
    new phrase begins: the class does not go on from the state and is looked for from the start.
    """
    steps, link, longest, last = [{}], [-1], [0], 0
    for code in codes:
        new = len(steps)
        steps.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and code not in steps[state]:
            steps[state][code] = new
            state = link[state]
        if state >= 0:
            target = steps[state][code]
            if longest[state] + 1 == longest[target]:
                link[new] = target
            else:
                copy = len(steps)
                steps.append(dict(steps[target]))
                longest.append(longest[state] + 1)
                link.append(link[target])
                while state >= 0 and steps[state].get(code) == target:
                    steps[state][code] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    lone = len(steps)  # the state behind a class that the sample does not have
    table = np.full((lone + 1, _WIDTH), 2 * lone * _WIDTH + 1, np.int32)
    for code, target in steps[0].items():
        table[:, code] = 2 * target * _WIDTH + 1
    table[0] -= 1  # the first phrase is there already
    for state, own in enumerate(steps):
        for code, target in own.items():
            table[state, code] = 2 * target * _WIDTH
    table[:, -1] = 2 * _WIDTH * np.arange(lone + 1)
    return table.ravel()


@sole
def _model(key):
    return Model({lang: list(texts) for lang, texts in key})


def predict(docs: DataFrame, texts: dict[str, list[str]]) -> DataFrame:
    """Language of every whole text by the samples ``texts``; nothing but the text is looked at.

    ``docs`` comes from ``common.identified``. Result, one row per input row: ``_id``, ``_hash``,
    ``lang_pred`` (fewest normalised phrases: phrases times the logarithm of the sample's size; the
    first in alphabet on a tie), ``score`` (second / (best + second) of those, 0.5 to 1; 1 with one
    language; 0 if unknown) and ``bits``, the entropy per letter. Texts that are null or have no
    letter, and all texts when there is no sample, are ``und``. Repeated rows get the same result.
    All of ``texts`` is used. Memory: about 10 MB a language of SAMPLE_LETTERS, and a few numbers per letter of a batch or of one text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple((k, tuple(v)) for k, v in sorted(texts.items())))
    schema = pa.schema([
        ("_id", pa.int64()), ("_hash", pa.binary()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())
    ])

    def run(batches):
        model = _model(shared.value)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in small_slices(batches):
            values = [t or "" for t in batch.column("_text").to_pylist()]
            counts, lengths = model.phrases(values)
            if model.languages:
                cost = counts * np.array(model.scale)[:, None]
                best = cost.argmin(axis=0)
                least = cost.min(axis=0)
                second = np.partition(cost, 1, axis=0)[1] if len(cost) > 1 else np.full(len(values), np.inf)
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.where(np.isinf(second), 1.0, second / (least + second))
                    bits = least / lengths
                none = lengths == 0
            else:
                best, score, bits, none = np.zeros(len(values), int), *np.zeros((2, len(values))), np.ones(len(values), bool)
            best, score, bits = np.where(none, len(names) - 1, best), np.where(none, 0.0, score), np.where(none, 0.0, bits)
            yield arrow_rows(schema, batch.column("_id"), batch.column("_hash"), names[best].tolist(), score, bits)

    return docs.select("_id", "_hash", "_text").mapInArrow(
        run, "_id bigint, _hash binary, lang_pred string, score double, bits double"
    )
