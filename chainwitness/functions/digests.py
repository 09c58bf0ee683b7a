"""Fuzzy digests of bytes and their comparison.

Both digests are simplified relatives of known schemes and not interoperable with them.
"""

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwitness import fixed_values as V

FUZZY = T.StructType(
    [
        T.StructField("block_size", T.LongType()),
        T.StructField("h1", T.StringType()),
        T.StructField("h2", T.StringType()),
    ]
)
LOCALITY = T.StructType(
    [
        T.StructField("checksum", T.IntegerType()),
        T.StructField("length_bucket", T.IntegerType()),
        T.StructField("body", T.BinaryType()),
    ]
)
_LETTERS = np.array(list(V.FUZZY_ALPHABET))
SIDE_BY_SIDE = 128  # fewer contents than this go one after the other
GROUP_BYTES = 16_000_000


def _products(contents):
    """For each content r = (r * factor + byte) mod 2^32 after each of its bytes, from r = 0.

    Each step needs the one before, so contents go side by side, one step for a byte of all of them, in
    order of length; what the last few longer ones have left goes byte by byte. The product exceeds
    2^53: it is rounded to a double before it wraps.
    """
    factor, wrap = float(V.FUZZY_MULTIPLIER), 4294967296.0
    order = sorted(range(len(contents)), key=lambda i: -len(contents[i]))
    sizes = np.array([len(contents[i]) for i in order], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    flat = np.concatenate([contents[i] for i in order])
    out, r, step = np.empty(len(flat), np.uint32), np.zeros(len(order)), 0
    longest = int(sizes[0])
    at_step = np.searchsorted(-sizes, -np.arange(longest), side="left")  # contents that have a byte at each step
    while step < longest and at_step[step] >= SIDE_BY_SIDE:
        at = starts[: at_step[step]] + step
        product = r[: len(at)] * factor + flat[at]
        r[: len(at)] = product - np.floor(product / wrap) * wrap
        out[at] = r[: len(at)]
        step += 1
    for i in range(at_step[step] if step < longest else 0):
        rest = flat[starts[i] + step:starts[i] + sizes[i]].tolist()
        values = accumulate(rest, lambda r, v: (r * factor + v) % wrap, initial=float(r[i]))
        out[starts[i] + step:starts[i] + sizes[i]] = np.fromiter(values, np.float64, len(rest) + 1)[1:]
    values = {i: out[a:a + n] for i, a, n in zip(order, starts, sizes)}
    return [values[i] for i in range(len(contents))]


def _trigger_values(data, products):
    """The rolling value at each byte that decides where pieces end."""
    b = data.astype(np.int64)
    step = b.copy()
    step[V.FUZZY_WINDOW:] -= b[: -V.FUZZY_WINDOW]
    window = np.zeros(len(b), np.int64)
    for j in range(min(V.FUZZY_WINDOW, len(b))):  # older terms are multiples of 2^32
        window[j:] += step[: len(b) - j] << (5 * j)
    return (window + np.bitwise_xor.accumulate(b) + products.astype(np.int64)) & 0xFFFFFFFF


def _piece_letters(data, ends):
    """Letter of each piece; ``ends`` are the last positions, the rest is the tail.

    A piece hash is s = (s * 33) ^ byte from a seed. Only its low six bits select the
    letter, and there s * 33 flips bit 5 when s is odd, so prefix XORs give all pieces.
    """
    n = len(data)
    x = np.zeros(n + 2, np.int64)  # x[i + 2] = xor of data[..i]
    x[2:] = np.bitwise_xor.accumulate(data.astype(np.int64)) if n else 0
    odd = np.bitwise_xor.accumulate(x & 1)
    start = np.concatenate(([0], ends + 1)).astype(np.int64)
    last = np.concatenate((ends, [n - 1])).astype(np.int64)
    seed = V.FUZZY_SEED & 63
    body = seed ^ x[last + 2] ^ x[start + 1]
    length = last - start + 1
    flips = (length & 1) * ((seed ^ x[start + 1]) & 1) ^ odd[last + 1] ^ odd[start]
    return "".join(_LETTERS[(body ^ (flips << 5)) & 63])


def _fuzzy(data, products):
    size = V.FUZZY_MIN_BLOCK
    while size * V.FUZZY_BLOCKS < len(data):
        size *= 2
    if not len(data):
        letter = V.FUZZY_ALPHABET[V.FUZZY_SEED & 63]
        return size, letter, letter
    rolling = _trigger_values(data, products)
    parts = [_piece_letters(data, np.flatnonzero(rolling % k == k - 1)) for k in (size, 2 * size)]
    return (size, *parts)


def _groups(contents):
    """Contents in groups of about GROUP_BYTES, those of like length together."""
    group, total = [], 0
    for content in sorted(contents, key=len):
        if group and total + len(content) > GROUP_BYTES:
            yield group
            group, total = [], 0
        group.append(content)
        total += len(content)
    if group:
        yield group


@F.pandas_udf(FUZZY)
def fuzzy_digest(content: pd.Series) -> pd.DataFrame:
    """Context-triggered piecewise digest of each content; equal contents of a batch are digested once."""
    digests = {None: (None, None, None)}
    for group in _groups({bytes(c) for c in content if c is not None}):
        arrays = [np.frombuffer(c, np.uint8) for c in group]
        digests.update((c, _fuzzy(a, p)) for c, a, p in zip(group, arrays, _products(arrays)))
    return pd.DataFrame([digests[None if c is None else bytes(c)] for c in content], columns=FUZZY.names)


def fuzzy_similarity(a, b):
    """Score 0..100 of two fuzzy digests; 0 unless block sizes are equal or double."""
    size_a, size_b = a["block_size"], b["block_size"]
    comparable = (size_a == size_b) | (size_a * 2 == size_b) | (size_b * 2 == size_a)

    def alike(s, t):
        return 1 - F.levenshtein(s, t) / F.greatest(F.length(s), F.length(t))

    best = F.greatest(alike(a["h1"], b["h1"]), alike(a["h2"], b["h2"]))
    return F.when(comparable, F.floor(best * 100 + F.lit(0.5))).otherwise(0).cast("int")


def _locality(data):
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    counts = np.zeros(256, np.int64)
    if n >= V.LOCALITY_WINDOW:
        h = np.zeros(n - V.LOCALITY_WINDOW + 1, np.uint8)
        for back in range(V.LOCALITY_WINDOW):  # newest byte first
            stop = n - back
            h = h * np.uint8(V.LOCALITY_FACTOR) + b[V.LOCALITY_WINDOW - 1 - back : stop]
        counts = np.bincount(h, minlength=256)
    ordered = np.sort(counts)
    q1, q2 = ordered[64], ordered[128]
    first = counts[:128]
    codes = np.where(first < q1, 0, np.where(first < q2, 1, np.where(first < q2 * 2, 2, 3)))
    body = (codes.reshape(32, 4) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    bucket = min(255, int(np.floor(np.log2(max(n, 1)) * 10)))
    return int(b.sum(dtype=np.int64) & 255), bucket, body.tobytes()


@F.pandas_udf(LOCALITY)
def locality_digest(content: pd.Series) -> pd.DataFrame:
    """Checksum, length class and 32 bytes of bucket codes of each content."""
    rows = [(None, None, None) if c is None else _locality(c) for c in content]
    return pd.DataFrame(rows, columns=LOCALITY.names)


def locality_distance(a, b):
    """12 per length class, 1 for another checksum, and the code differences."""

    def byte(col, i):
        return F.conv(F.hex(F.substring(col, i, F.lit(1))), 16, 10).cast("int")

    def codes_apart(both):
        x, y = both["x"], both["y"]
        return sum(
            (F.abs(F.shiftright(x, s).bitwiseAND(3) - F.shiftright(y, s).bitwiseAND(3)) for s in (2, 4, 6)),
            F.abs(x.bitwiseAND(3) - y.bitwiseAND(3)),
        )

    pairs = F.transform(
        F.sequence(F.lit(1), F.lit(32)),
        lambda i: F.struct(byte(a["body"], i).alias("x"), byte(b["body"], i).alias("y")),
    )
    body = F.aggregate(pairs, F.lit(0), lambda acc, both: acc + codes_apart(both))
    return (
        F.abs(a["length_bucket"] - b["length_bucket"]) * 12
        + F.when(a["checksum"] != b["checksum"], 1).otherwise(0)
        + body
    )
