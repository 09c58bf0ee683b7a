"""Words of many texts at once: places and 64-bit names of words and of word runs, with numpy.

A word is a run of bytes other than space and 0x09-0x0D. Its name is a polynomial over
random byte values modulo 2**64, taken from running sums, so that the name of any span
costs two look-ups. Names depend on nothing but the bytes: every task gives the same
word the same name.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240521)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = {}


def powers(n):
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x):
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_names(values, starts, ends):
    """Names of the spans [start, end) over ``values`` (uint64); equal spans get equal names."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def buffers(column):
    """Offsets (int64) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def byte_names(data, starts, ends, lower=False):
    """Names of the spans [start, end) of bytes, in order and without overlap, about CHUNK bytes at a time."""
    values, names, done = _LOWERED if lower else _VALUES, np.empty(len(starts), np.uint64), 0
    while done < len(starts):
        begin = starts[done]
        last = max(done + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
        piece = values[data[begin:ends[last - 1]]]
        names[done:last] = span_names(piece, starts[done:last] - begin, ends[done:last] - begin)
        done = last
    return names


class Words:
    """Words of a column of texts.

    ``names`` of all words in order; ``first[d]:first[d + 1]`` are those of text ``d``;
    ``starts`` and ``ends`` are byte places in ``data``.
    """

    def __init__(self, column, lower=False, named=True):
        self.offsets, self.data = buffers(column)
        data, n = self.data, len(self.data)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)  # a text begins or ends here
        edge[self.offsets] = True
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1] | edge[1:n]
            closes[:-1] &= ~inside[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        if named:
            self.names = byte_names(data, self.starts, self.ends, lower)

    def counts(self):
        return np.diff(self.first)

    def text_of(self):
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def grams(self, n):
        """Names of all runs of ``n`` words inside one text, and the word at which each starts."""
        if len(self.names) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.arange(len(self.names) - n + 1)
        text = self.text_of()
        at = at[text[at] == text[at + n - 1]]
        return span_names(self.names, at, at + n), at
