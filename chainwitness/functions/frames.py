"""Greyscale frames: resampling, perceptual hashes and perturbations.

A frame is ``ARRAY<INT>`` of greys 0..255, row by row, with a width and a height. Long frames
are better kept packed, as ``BINARY`` with one byte per grey: hashes and the feature vector take them too.
Hashes are 64-bit integers, first bit highest; the DCT hash uses only 63 bits.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwitness.fixed_values import GREY_WEIGHTS

DCT_BITS = 63
HASH_BITS = 64
SIDE_BY_SIDE = 128  # frames that are hashed at once
SLICE_BYTES = 2_000_000


def _slices(contents):
    """Parts of a series of bytes of about SLICE_BYTES; longer contents are a part of their own."""
    start = total = 0
    for row, content in enumerate(contents):
        size = 0 if content is None else len(content)
        if total and total + size > SLICE_BYTES:
            yield contents.iloc[start:row]
            start, total = row, 0
        total += size
    yield contents.iloc[start:]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def to_grey(rgba: pd.Series) -> pd.Series:
    """Greys of RGBA bytes; alpha is ignored, a cut last pixel is dropped."""
    red, green, blue = GREY_WEIGHTS

    def one(data):
        px = np.frombuffer(data, np.uint8)
        px = px[: len(px) // 4 * 4].reshape(-1, 4).astype(np.float64)
        return np.floor(red * px[:, 0] + green * px[:, 1] + blue * px[:, 2] + 0.5).astype(np.int32)

    return rgba.map(one, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def bytes_to_grey(data: pd.Series) -> pd.Series:
    """One grey per byte."""
    return data.map(lambda d: np.frombuffer(d, np.uint8).astype(np.int32), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def grey_to_bytes(grey: pd.Series) -> pd.Series:
    """One byte per grey."""
    return grey.map(lambda g: np.asarray(g, np.uint8).tobytes(), na_action="ignore")


def bound(value, use):
    """``use(value)`` with the value computed once.

    A Spark lambda re-evaluates an outer expression for every element it visits; as
    an element of a one-item array the value becomes a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _column(number):
    return F.lit(number) if isinstance(number, int) else number


def _byte(packed, place):
    return F.conv(F.hex(F.substring(packed, place, F.lit(1))), 16, 10).cast("int")


def resize(grey, width, height, to_width, to_height, packed=False):
    """Nearest-neighbour samples of a frame, as Spark expressions."""
    w, h = _column(width), _column(height)
    pick = _byte if packed else F.element_at

    def samples(g):
        def sample(i):
            x = F.least(F.floor((i % to_width) * (w / F.lit(to_width))), w - 1)
            y = F.least(F.floor(F.floor(i / to_width) * (h / F.lit(to_height))), h - 1)
            return pick(g, (y * w + x + 1).cast("int"))

        return F.transform(F.sequence(F.lit(0), F.lit(to_width * to_height - 1)), sample)

    return bound(grey, samples)


def pack_bits(bits):
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        bits, zero, lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint"))
    )


def _at_least_mean(values, n):
    def bits(v):
        total = F.aggregate(v, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        return bound(total, lambda t: F.transform(v, lambda x: F.when(x * n >= t, 1).otherwise(0)))

    return bound(values, bits)


def average_hash(grey, width, height, packed=False):
    return pack_bits(_at_least_mean(resize(grey, width, height, 8, 8, packed), 64))


def difference_hash(grey, width, height, packed=False):
    def bits(small):
        def bit(i):
            at = (F.floor(i / 8) * 9 + i % 8).cast("int")
            return F.when(F.element_at(small, at + 1) > F.element_at(small, at + 2), 1).otherwise(0)

        return F.transform(F.sequence(F.lit(0), F.lit(63)), bit)

    return pack_bits(bound(resize(grey, width, height, 9, 8, packed), bits))


def _nearest(grey, width, height, n):
    xs = np.minimum(np.floor(np.arange(n) * (width / n)).astype(int), width - 1)
    ys = np.minimum(np.floor(np.arange(n) * (height / n)).astype(int), height - 1)
    grey = np.frombuffer(grey, np.uint8) if isinstance(grey, (bytes, bytearray, memoryview)) else np.asarray(grey)
    return grey[ys[:, None] * width + xs[None, :]].astype(np.float64)


def _packed(rows):
    """Each row of bits as a signed 64-bit integer, the first bit highest."""
    bits = np.zeros((len(rows), 64), bool)
    bits[:, 64 - rows.shape[1]:] = rows
    return np.packbits(bits, axis=1).view(">i8").ravel()


def _hashed_frames(grey, width, height, samples, bits_of):
    """Hashes of all frames of a batch, some at once; null where a frame is missing or empty."""
    usable = [g is not None and len(g) > 0 and w > 0 and h > 0 for g, w, h in zip(grey, width, height)]
    out = pd.Series(pd.NA, index=grey.index, dtype="Int64")
    at = np.flatnonzero(usable)
    hashes = np.empty(len(at), np.int64)
    for start in range(0, len(at), SIDE_BY_SIDE):
        some = at[start:start + SIDE_BY_SIDE]
        images = np.stack([_nearest(grey.iloc[i], int(width.iloc[i]), int(height.iloc[i]), samples) for i in some])
        hashes[start:start + len(some)] = _packed(bits_of(images))
    out.iloc[at] = hashes
    return out


_DCT = np.cos(np.pi / 32 * (np.arange(32)[None, :] + 0.5) * np.arange(8)[:, None])


@F.pandas_udf(T.LongType())
def dct_hash(grey: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """63 bits: the 8x8 lowest DCT-II terms but the constant one, against their mean."""

    def bits(images):
        terms = (_DCT @ images @ _DCT.T).reshape(len(images), -1)[:, 1:]
        return terms >= terms.sum(axis=1, keepdims=True) / DCT_BITS

    return _hashed_frames(grey, width, height, 32, bits)


@F.pandas_udf(T.LongType())
def wavelet_hash(grey: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """64 bits: 64x64 samples halved three times by rounded 2x2 means, against the mean."""

    def bits(images):
        for n in (32, 16, 8):
            images = np.floor(images.reshape(-1, n, 2, n, 2).sum(axis=(2, 4)) / 4 + 0.5)
        flat = images.reshape(len(images), -1)
        return flat >= flat.sum(axis=1, keepdims=True) / HASH_BITS

    return _hashed_frames(grey, width, height, 64, bits)


def hash_hex(bits, n_bits=HASH_BITS):
    """16 hex digits; bits missing from a shorter hash are zeros at the end."""
    return F.lower(F.lpad(F.hex(F.shiftleft(bits, HASH_BITS - n_bits)), 16, "0"))


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def hamming_similarity(a, b, n_bits=HASH_BITS):
    return 1 - hamming(a, b) / F.lit(n_bits)


def feature_vector(grey, width, height, packed=False):
    """64 values in [0, 1]: nearest samples over their maximum."""

    def scaled(small):
        top = F.greatest(F.array_max(small), F.lit(1))
        return bound(top, lambda t: F.transform(small, lambda v: v / t))

    return bound(resize(grey, width, height, 8, 8, packed), scaled)


# -- perturbations --------------------------------------------------------------------


def _clamp(v):
    return F.least(F.lit(255), F.greatest(F.lit(0), v)).cast("int")


def brightness(grey, delta):
    return F.transform(grey, lambda v: _clamp(v + delta))


def contrast(grey, factor):
    return F.transform(
        grey, lambda v: _clamp(F.floor(128 + (v - 128) * F.lit(float(factor)) + F.lit(0.5)))
    )


def _uniform(seed, salt, i):
    """A uniform number in [0, 1) that depends only on the row's seed and the pixel."""
    return F.pmod(F.xxhash64(seed, F.lit(salt), i), F.lit(2**53)) / F.lit(float(2**53))


def salt_and_pepper(grey, share, seed):
    def noisy(v, i):
        u = _uniform(seed, 0, i)
        return F.when(u < share / 2, 0).when(u < share, 255).otherwise(v)

    return F.transform(grey, noisy)


def gaussian_like(grey, sigma, seed):
    """Six uniforms per pixel, centred and scaled; the true deviation is about sigma / 2."""

    def noisy(v, i):
        draw = sum((_uniform(seed, k, i) for k in range(1, 6)), _uniform(seed, 6, i))
        return _clamp(F.floor(v + (draw - 3) * F.lit(sigma * 0.707) + F.lit(0.5)))

    return F.transform(grey, noisy)


def dropout(grey, share, seed):
    return F.transform(grey, lambda v, i: F.when(_uniform(seed, 7, i) < share, 0).otherwise(v))


def watermark(grey, width, height, value=200, size=16):
    def marked(v, i):
        x, y = i % width, F.floor(i / width)
        return F.when((x < size) & (y < size), value).otherwise(v)

    return F.transform(grey, marked)


def crop(grey, width, height, share=0.75):
    """Zero what lies right of or below the kept share."""
    keep_x, keep_y = F.floor(width * F.lit(share)), F.floor(height * F.lit(share))

    def kept(v, i):
        return F.when((i % width >= keep_x) | (F.floor(i / width) >= keep_y), 0).otherwise(v)

    return F.transform(grey, kept)


def splice(grey, other):
    """First half of one frame, then the start of another."""

    def spliced(g):
        half = F.floor(F.size(g) / 2).cast("int")
        donor = bound(
            other,
            lambda o: F.transform(
                F.sequence(F.lit(1), F.size(g) - half), lambda i: F.coalesce(F.get(o, i - 1), F.lit(0))
            ),
        )
        return F.concat(F.slice(g, 1, half), donor)

    return bound(grey, spliced)


# -- perturbations of packed frames -----------------------------------------------------


def brighter(delta):
    table = np.clip(np.arange(256) + delta, 0, 255).astype(np.uint8)
    return lambda px, width: table[px]


def marked(value=200, size=16):
    def change(px, width):
        px, head = px.copy(), np.arange(min(len(px), size * width))
        px[head[head % width < size]] = value
        return px

    return change


def turned(px, width):
    return px[::-1]


def altered(packed, width, changes):
    """An array of copies of a packed frame, one for each change; batches go out in small parts."""

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def copies(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for frames, widths in batches:
            for part in _slices(frames):
                yield pd.Series([
                    None if f is None else [change(np.frombuffer(f, np.uint8), w).tobytes() for change in changes]
                    for f, w in zip(part, widths[part.index])
                ], index=part.index, dtype=object)

    return copies(packed, width)
