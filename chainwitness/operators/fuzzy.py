"""Classes of near-equal fuzzy digests, exactly, without a row for each pair.

Two digests link if ``digests.fuzzy_similarity`` reaches a threshold: one block size is the other or its
double, and the first or the second signatures are few edits apart for the length of the longer one. Cut the
longer signature into one segment more than edits are allowed, and one of them stands unchanged in the
shorter, about as far from the middle: by half of the edits at most. So each signature is dealt out under its segments
and, as the shorter one, under its substrings, both with where they stand; signatures that meet under a key are packed into blocks
of like size and place, blocks that rule each other out are not joined, and the pairs of all blocks of a batch are
compared side by side. A pair counts only under its first segment in common. Where so many edits are allowed that segments would be single
letters, the block size is the key, and lengths and letter counts rule pairs out. Keys are 64-bit hashes; digests
that meet by one hash of two segments are told apart by their edits.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.operators.components import components
from chainwitness.session import let_go, release, ship_package, stage

BLOCK = 128
PAIRS = 20_000  # whose edit distances are computed side by side
MEETINGS = 500_000  # pairs of rows under keys that are looked at side by side
ROWS = 1_000  # pairs of blocks in a batch
SHORTS = 16  # blocks of short signatures that a task compares with all long ones of their key
WORD = 64
ANYWHERE = 1 << 30
_ENTRY = (("node", pa.int64(), "bigint"), ("size", pa.int64(), "bigint"), ("h1", pa.string(), "string"), ("h2", pa.string(), "string"), ("n", pa.int64(), "bigint"))
_PLACE = tuple((n, pa.int32(), "int") for n in ("least", "width", "low", "high"))  # widths and places of what it may link with
_ITEM = _ENTRY + _PLACE
_SIGNATURES = ("h1", "h2", "n")
_HEAD = (("key", pa.int64(), "bigint"), ("kind", pa.int32(), "int"), ("long", pa.bool_(), "boolean"))
_RANGES = tuple((f"{n}_{end}", t, k) for n, t, k in (("size", pa.int64(), "bigint"), ("wide", pa.int32(), "int"), ("at", pa.int32(), "int")) for end in ("from", "to"))
_FOUND = "node bigint, root bigint, n bigint"
_BASE = 0x9E3779B97F4A7C15
_powers = {}


def _sql(fields, kind="{}"):
    return ", ".join(f"{n} {kind.format(t)}" for n, _, t in fields)


def _power_tables(n):
    """Powers of the base of hashes and of its inverse, from 0 to ``n`` at least."""
    if not _powers or len(_powers["up"]) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n + 2, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class _Letters:
    """Texts one after the other, and polynomial hashes of all their stretches."""

    def __init__(self, texts):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.cumsum(self.sizes) - self.sizes
        up, self._down = _power_tables(len(points))
        self._sums = np.append(np.uint64(0), np.cumsum((points + np.uint64(1)) * up[:len(points)], dtype=np.uint64))

    def hashes(self, at, size):
        """Of the stretches of ``size`` letters from ``at``, counted over all texts."""
        return (self._sums[at + size] - self._sums[at]) * self._down[at]


def _key(hashes, size, kind):
    """Keys as signed numbers, spread evenly."""
    salt = np.uint64((4 * size + kind) * 0x94D049BB133111EB % (1 << 64))
    z = hashes * np.uint64(0xBF58476D1CE4E5B9) + salt
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (z ^ (z >> np.uint64(32))).view(np.int64)


class _Rule:
    """Which signatures link, and the keys under which they meet."""

    def __init__(self, threshold):
        if not 1 <= threshold <= 100:
            raise ValueError("a threshold lies between 1 and 100")
        self.threshold = threshold
        self._share = 1 - (threshold - 0.5) / 100
        self._plans, self._probes = {}, {}

    def reach(self, length):
        """Edits that a longer signature of this length, or of each of these lengths, allows."""
        return np.floor(np.asarray(length) * self._share + 1e-9).astype(np.int64)

    def links(self, edits, length):
        return np.floor((1 - edits / length) * 100 + 0.5) >= self.threshold

    def plan(self, length):
        """Starts of the segments of a signature and letters that are looked at of each; None if those would be single letters."""
        if length not in self._plans:
            edits = int(self.reach(length))
            size = length // (edits + 1)
            weak = edits > 0 and size < 2
            self._plans[length] = None if weak else ([i * length // (edits + 1) for i in range(edits + 1)], size)
        return self._plans[length]

    def starts(self, length):
        """Number of segments and letters looked at of each, of signatures of these lengths."""
        parts = self.reach(length) + 1
        return parts, length // parts

    def probes(self, length):
        """Letters of the segments of all longer signatures that one of this length may link with; whether the block size is a key of some."""
        if length not in self._probes:
            sizes, weak, longer = set(), False, length
            while longer - int(self.reach(longer)) <= length:
                plan = self.plan(longer)
                weak |= plan is None
                sizes |= set() if plan is None else {plan[1]}
                longer += 1
            self._probes[length] = sorted(sizes), weak
        return self._probes[length]

    def own_keys(self, plane, sizes, letters, rows):
        """Keys of signatures of one length as the longer ones of pairs: (row, key, kind, from, to) arrays, the last two where they may stand."""
        length = int(letters.sizes[rows[0]])
        plan = self.plan(length)
        if plan is None:
            return [self._weak(plane, sizes[rows], rows)]
        starts, reach = np.array(plan[0]), int(self.reach(length))
        return [self._strong(plane, letters, rows, starts, plan[1], 2 * starts - length, reach)]

    def other_keys(self, plane, sizes, letters, rows):
        """Keys of all longer signatures that those of one length may link with."""
        length = int(letters.sizes[rows[0]])
        probed, weak = self.probes(length)
        made = []
        for q in probed:
            if q <= length:
                starts = np.arange(length - q + 1)
                made.append(self._strong(plane, letters, rows, starts, q, 2 * starts - length, 0))
        if weak:
            own = sizes[rows]
            halved = rows[own % 2 == 0]
            made += [self._weak(plane, own, rows), self._weak(plane, 2 * own, rows), self._weak(plane, sizes[halved] // 2, halved)]
        return made

    @staticmethod
    def _strong(plane, letters, rows, starts, size, at, reach):
        keys = _key(letters.hashes(letters.begins[rows][:, None] + starts, size), size, plane)
        at = np.broadcast_to(at, keys.shape).ravel()
        return np.repeat(rows, len(starts)), keys.ravel(), np.full(keys.size, plane), at - reach, at + reach

    @staticmethod
    def _weak(plane, sizes, rows):
        far = np.full(len(rows), ANYWHERE)
        return rows, _key(sizes.astype(np.uint64), 0, plane + 2), np.full(len(rows), plane + 2), -far, far


def _codes(texts):
    """Letters of all texts as numbers from 0, where each text begins, and how many letters there are."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    letters, codes = np.unique(points, return_inverse=True)
    return codes, np.cumsum([0, *map(len, texts)]), len(letters)


def edit_distances(first, second):
    """Edit distance of each text of ``first`` from its partner in ``second``, all pairs side by side.

    A column of the table of distances is a pair of bit vectors, so a step handles one letter of every
    second text. First texts beyond 64 letters take Python's long integers in place of machine words.
    """
    if not len(first):
        return np.zeros(0, np.int64)
    texts = list(dict.fromkeys([*first, *second]))
    place = {t: i for i, t in enumerate(texts)}
    a, b = (np.array([place[t] for t in side]) for side in (first, second))
    codes, begins, n_letters = _codes(texts)
    sizes = np.diff(begins)
    m, steps = sizes[a], sizes[b]
    word = np.uint64 if m.max() <= WORD else object
    one = np.uint64(1) if word is np.uint64 else 1
    patterns, row = np.unique(a, return_inverse=True)
    seen = np.zeros((len(patterns), n_letters + 1), word)
    own = np.repeat(np.arange(len(patterns)), sizes[patterns])  # bit i of a letter: it is the letter at i
    place = np.arange(len(own)) - np.repeat(np.cumsum(sizes[patterns]) - sizes[patterns], sizes[patterns])
    np.add.at(seen, (own, codes[begins[patterns][own] + place]), np.left_shift(one, place.astype(word)))
    last = np.maximum(m - 1, 0).astype(word)
    up, down = np.full(len(m), ~(one ^ one), word), np.zeros(len(m), word)
    found = m.astype(np.int64)
    letters = np.append(codes, n_letters)
    for step in range(int(steps.max())):
        on = step < steps
        equal = seen[row, letters[np.where(on, begins[b] + step, len(codes))]]
        across = equal | down
        flat = (((equal & up) + up) ^ up) | equal
        more, less = down | ~(flat | up), up & flat
        change = ((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64)
        found += np.where(on, change, 0)
        more, less = (more << one) | one, less << one
        up, down = less | ~(across | more), more & across
    return np.where(m == 0, steps, found)


def _keyed(texts, rule, whole=True):
    """A row for each key of a signature and role in a pair, with the range of places, from the middle and doubled, where it stands or may stand.

    The signatures themselves are left out unless ``whole``.
    """
    entry = tuple(f for f in _ENTRY if whole or f[0] not in _SIGNATURES)
    schema = pa.schema([f[:2] for f in _HEAD + entry + _PLACE])

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 2000) for at in range(0, batch.num_rows, 2000)):
                sizes, made, widths = part.column("size").to_numpy(zero_copy_only=False), [], []
                for plane, column in enumerate(("h1", "h2")):
                    letters = _Letters(part.column(column).to_pylist())
                    widths.append(letters.sizes)
                    order = np.argsort(letters.sizes, kind="stable")
                    for rows in np.split(order, np.flatnonzero(np.diff(letters.sizes[order])) + 1):
                        for role, keys in ((True, rule.own_keys), (False, rule.other_keys)):
                            made += [(*m, np.full(len(m[0]), role)) for m in keys(plane, sizes, letters, rows)]
                row, key, kind, low, high, role = (np.concatenate(x) for x in zip(*made))
                order = np.lexsort((key, 2 * row + role))
                row, key, kind, low, high, role = (x[order] for x in (row, key, kind, low, high, role))
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (role[1:] != role[:-1]) | (key[1:] != key[:-1])))
                low, high = np.minimum.reduceat(low, new), np.maximum.reduceat(high, new)
                row, key, kind, role = (x[new] for x in (row, key, kind, role))
                taken = part.take(pa.array(row))
                width = np.where(kind % 2 == 0, widths[0][row], widths[1][row])
                places = (width - np.where(role, rule.reach(width), 0), width, low, high)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, (_, t, _) in zip((key, kind, role), _HEAD)] + [taken.column(name) for name, _, _ in entry]
                    + [pa.array(x.astype(np.int32)) for x in places], schema=schema)

    return texts.select(*(name for name, _, _ in _ENTRY)).mapInArrow(run, _sql(_HEAD + entry + _PLACE))


def _fitting(batch):
    """Rows of a batch, which holds the rows of a key one after the other, that may link with a row of the other role of their key.

    What becomes of a key can be told inside a batch only; those at either end of a batch always stay whole.
    """
    keys, longer, size, least, width, low, high, node = (
        batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "long", "size", "least", "width", "low", "high", "node"))
    new_key = np.append(True, keys[1:] != keys[:-1])
    begins, of = np.flatnonzero(new_key), np.cumsum(new_key) - 1
    ends = (of == 0) | (of == len(begins) - 1)
    fits = np.ones(len(keys), bool)
    sizes, rank = np.unique(size, return_inverse=True)
    cells, cell = np.unique(of * len(sizes) + rank, return_inverse=True)  # of one key and size
    for side in (~longer, longer):
        other = np.flatnonzero(~side & fits)
        down, up = ([np.full(len(cells) + 1, far) for _ in range(3)] for far in (1 << 62, -(1 << 62)))  # the last cell holds nothing
        for k, (lower, upper) in enumerate(((low, high), (least, width), (node, node))):
            np.minimum.at(down[k], cell[other], lower[other])
            np.maximum.at(up[k], cell[other], upper[other])
        may = ends.copy()
        for near, known in ((size, True), (2 * size, True), (size // 2, size % 2 == 0)):
            at = np.minimum(np.searchsorted(sizes, near), len(sizes) - 1)
            met = of * len(sizes) + at
            at = np.where(known & (sizes[at] == near), np.minimum(np.searchsorted(cells, met), len(cells) - 1), len(cells))
            at[cells[np.minimum(at, len(cells) - 1)] != met] = len(cells)
            apart = (down[2][at] != node) | (up[2][at] != node)
            may |= apart & (low <= up[0][at]) & (high >= down[0][at]) & (least <= up[1][at]) & (width >= down[1][at])
        fits &= ~side | may
    wanted = np.logical_or.reduceat(fits & longer, begins) & np.logical_or.reduceat(fits & ~longer, begins)
    wanted &= np.minimum.reduceat(np.where(fits, node, 1 << 62), begins) != np.maximum.reduceat(np.where(fits, node, -(1 << 62)), begins)
    wanted[[0, -1]] = True
    return np.flatnonzero(fits & wanted[of])


def _meeting(keyed):
    """The rows without those that no row of the other role of their key can link with, and keys that show a single digest or role.

    Ranges of keys and digests are dealt out, so a key that a third of all digests have is many tasks.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.take(pa.array(_fitting(batch)))

    return keyed.repartitionByRange("key", "node").sortWithinPartitions("key").mapInArrow(run, keyed.schema)


def _packed(keyed, block):
    """Blocks of at most ``block`` rows of one key and role, of like sizes and places, of the rows that may link with some other."""
    order = ("key", "long", "size", "low", "width", "node")
    schema = pa.schema([f[:2] for f in _HEAD + _RANGES] + [(name, pa.list_(kind)) for name, kind, _ in _ITEM])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            taken = batch.take(pa.array(_fitting(batch)))
            keys, longer, size, least, width, low, high = (
                taken.column(c).to_numpy(zero_copy_only=False) for c in ("key", "long", "size", "least", "width", "low", "high"))
            place = np.arange(len(keys))
            new_run = np.append(True, (keys[1:] != keys[:-1]) | (longer[1:] != longer[:-1]))
            firsts = np.flatnonzero((place - np.maximum.accumulate(np.where(new_run, place, 0))) % block == 0)
            stops = np.append(firsts, len(keys)).astype(np.int32)
            ranges = [f.reduceat(x, firsts) for both in ((size, size), (least, width), (low, high)) for f, x in zip((np.minimum, np.maximum), both)]
            yield pa.RecordBatch.from_arrays(
                [taken.column(name).take(pa.array(firsts)) for name, _, _ in _HEAD] + [pa.array(x, t) for x, (_, t, _) in zip(ranges, _RANGES)]
                + [pa.ListArray.from_arrays(stops, taken.column(name)) for name, _, _ in _ITEM], schema=schema)

    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _sql(_HEAD + _RANGES) + ", " + _sql(_ITEM, "array<{}>"))


def _shared_out(blocks, shorts):
    """Short and long blocks with a share: the short blocks of a key in shares of about ``shorts``, each with all long ones of the key."""
    many = blocks.where("not long").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / shorts).cast("int").alias("shares")).where("shares > 1")
    dealt = blocks.join(stage(many, "fuzzy-shares"), "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    short = dealt.where("not long").withColumn("share", F.pmod(F.xxhash64(F.col("node")[0], "size_from", "at_from"), F.col("shares")).cast("int"))
    long = dealt.where("long").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return short.drop("shares"), long.drop("shares")


def _letter_counts(texts):
    codes, begins, n_letters = _codes(texts)
    cells = np.repeat(np.arange(len(texts)), np.diff(begins)) * max(n_letters, 1) + codes
    return np.bincount(cells, minlength=len(texts) * max(n_letters, 1)).reshape(len(texts), -1).astype(np.int32)


class _Side:
    """Items of the short or of the long blocks of a batch."""

    def __init__(self, batch, mark):
        first = batch.column(mark + "node")
        self.stops = first.offsets.to_numpy()
        self.items = {name: batch.column(mark + name).values for name, _, _ in _ITEM}
        self.node, self.size, self.n, self.least, self.width, self.low, self.high = (
            self.items[c].to_numpy().astype(np.int64) for c in ("node", "size", "n", "least", "width", "low", "high"))

    def texts(self, places, planes):
        """Signatures of the items at ``places``, of their planes."""
        both = [self.items[h].take(pa.array(places)) for h in ("h1", "h2")]
        return pc.if_else(pa.array(planes == 0), *both).to_pylist()


def _met(short, long, begin, end):
    """Block pair and places in ``short`` and in ``long`` of the pairs of items of some block pairs that may link by size, width and place."""
    across, down = np.diff(long.stops)[begin:end].astype(np.int64), np.diff(short.stops)[begin:end].astype(np.int64)
    met = across * down
    row = np.repeat(np.arange(begin, end), met)
    within = np.arange(len(row)) - np.repeat(np.cumsum(met) - met, met)
    one, other = np.divmod(within, across[row - begin])
    i, j = short.stops[row] + one, long.stops[row] + other
    size_x, size_y, wide_x, wide_y = short.size[i], long.size[j], short.width[i], long.width[j]
    may = (size_x == size_y) | (2 * size_x == size_y) | (size_x == 2 * size_y)
    may &= (wide_x < wide_y) | ((wide_x == wide_y) & (short.node[i] < long.node[j]))
    may &= wide_x >= long.least[j]
    may &= (short.low[i] <= long.high[j]) & (short.high[i] >= long.low[j])
    may = np.flatnonzero(may)
    return row[may], i[may], j[may]


class _Aligned:
    """Pairs of a short and a long signature, and where segments of the long one stand in the short one."""

    def __init__(self, letters, x, y, rule):
        self.letters, self.x, self.y = letters, letters.begins[x], letters.begins[y]
        self.short, self.long = letters.sizes[x], letters.sizes[y]
        self.parts, self.size = rule.starts(self.long)
        self.reach, self.more = self.parts - 1, self.long - self.short

    def start(self, pair, segment):
        return segment * self.long[pair] // self.parts[pair]

    def stands(self, pair, segment, shift):
        """Whether a segment stands in the short signature, moved to the left by ``shift`` letters that the edits allow."""
        at, size = self.start(pair, segment), self.size[pair]
        to = at - shift
        sound = (np.abs(2 * shift - self.more[pair]) <= self.reach[pair]) & (to >= 0) & (to + size <= self.short[pair])
        here = self.letters.hashes(self.y[pair] + at, size)
        there = self.letters.hashes(self.x[pair] + np.where(sound, to, 0), np.where(sound, size, 0))
        return sound & (here == there)

    def unless_earlier(self, pairs, segment, shift):
        """The pairs of which no segment before ``segment`` stands ``shift`` letters to the left."""
        alive = np.ones(len(pairs), bool)
        for back in range(1, int(segment.max(initial=0)) + 1):
            left = np.flatnonzero(alive & (segment >= back))
            alive[left[self.stands(pairs[left], segment[left] - back, shift[left])]] = False
        return alive

    def first(self, pairs):
        """The first segment of each pair that stands somewhere in the short signature; -1 if none does."""
        found, open_, segment = np.full(len(pairs), -1), np.arange(len(pairs)), 0
        while len(open_):
            open_ = open_[segment < self.parts[pairs[open_]]]
            for some in (open_[k:k + 20_000] for k in range(0, len(open_), 20_000)):
                pair = pairs[some]
                least = -((self.reach[pair] - self.more[pair]) // 2)
                for step in range(int(self.reach[pair].max()) + 1):
                    left = np.flatnonzero(found[some] < 0)
                    hit = left[self.stands(pair[left], segment, least[left] + step)]
                    found[some[hit]] = segment
            open_, segment = open_[found[open_] < 0], segment + 1
        return found


def _candidates(row, i, j, short, long, kinds, rule):
    """Which of these pairs count under the key that they meet under, and may link by their letters."""
    planes = kinds[row] % 2
    (xs, x), (ys, y) = (np.unique(p, return_inverse=True) for p in (i, j))
    plane_x, plane_y = np.zeros(len(xs), np.int64), np.zeros(len(ys), np.int64)
    plane_x[x], plane_y[y] = planes, planes
    texts, y = [*short.texts(xs, plane_x), *long.texts(ys, plane_y)], y + len(xs)
    aligned = _Aligned(_Letters(texts), x, y, rule)
    strong = np.flatnonzero(kinds[row] < 2)
    at = (long.low[j[strong]] + aligned.reach[strong] + aligned.long[strong]) // 2  # where the key first stands in the long one
    segment = -(-at * aligned.parts[strong] // aligned.long[strong])
    shift = at - (short.low[i[strong]] + aligned.short[strong]) // 2
    keep, own = np.ones(len(i), bool), np.zeros(len(i), np.int64)
    keep[strong], own[strong] = aligned.unless_earlier(strong, segment, shift), at
    kept = np.flatnonzero(keep)
    if len(kept) > 200:
        counts = _letter_counts(texts)
        shared = np.concatenate([np.minimum(counts[x[k]], counts[y[k]]).sum(axis=1) for k in (kept[b:b + 20_000] for b in range(0, len(kept), 20_000))])
        kept = kept[aligned.long[kept] - shared <= aligned.reach[kept]]  # each letter without a partner takes an edit
    strong = kinds[row[kept]] < 2
    pairs = kept[strong]
    first = aligned.first(pairs)
    hashes = [aligned.letters.hashes(aligned.y[pairs] + p, aligned.size[pairs]) for p in (aligned.start(pairs, np.maximum(first, 0)), own[pairs])]
    keep = np.ones(len(kept), bool)
    keep[strong] = (first >= 0) & (hashes[0] == hashes[1])
    return kept[keep]


def _compared(blocks, rule):
    """For each digest its linked rows in a group of compared pairs, and a digest that it is connected with there."""
    names = [f[0] for f in _RANGES + _ITEM]
    short, long = _shared_out(blocks, SHORTS)
    short = short.select("key", "share", *(F.col(c).alias("s_" + c) for c in names))
    size, wide, at = ((F.col(f"s_{n}_from"), F.col(f"s_{n}_to"), F.col(f"{n}_from"), F.col(f"{n}_to")) for n in ("size", "wide", "at"))
    pairs = short.join(long, ["key", "share"]).where(
        (size[0] <= 2 * size[3]) & (2 * size[1] >= size[2]) & (wide[0] <= wide[3]) & (wide[1] >= wide[2]) & (at[0] <= at[3]) & (at[1] >= at[2])
    ).select("kind", *("s_" + f[0] for f in _ITEM), *(f[0] for f in _ITEM))
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])

    def linked(planes, first, second, x, y):
        """Which pairs link by the signature of their plane; what the first signatures link does not count for the second."""
        wide = lambda s, t: np.maximum([len(v) for v in s], [len(v) for v in t])
        own = [(s[p], t[p]) for p, s, t in zip(planes.tolist(), x, y)]
        found = rule.links(edit_distances(*zip(*own)), wide(*zip(*own)))
        again = np.flatnonzero(found & (planes == 1))
        if len(again):
            s, t = [x[k][0] for k in again], [y[k][0] for k in again]
            found[again] = ~rule.links(edit_distances(s, t), wide(s, t))
        return found

    def summed(a, b, count_a, count_b):
        nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b = places[:len(a)], places[len(a):]
        n, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        np.add.at(n, a, count_b)
        np.add.at(n, b, count_a)
        while True:
            before, least = root.copy(), np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
            if (root == before).all():
                break
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root]), pa.array(n)], schema=schema)

    def run(batches):
        held, total = [], 0

        def flushed():
            planes, a, b, count_a, count_b = (np.concatenate([h[k] for h in held]) for k in range(5))
            x, y = ([v for h in held for v in h[k]] for k in (5, 6))
            found = linked(planes, a, b, x, y)
            return summed(a[found], b[found], count_a[found], count_b[found])

        for batch in batches:
            short, long, kinds = _Side(batch, "s_"), _Side(batch, ""), batch.column("kind").to_numpy().astype(np.int64)
            met = np.cumsum(np.diff(short.stops).astype(np.int64) * np.diff(long.stops))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(met, (met[begin - 1] if begin else 0) + MEETINGS, side="right")))
                row, i, j = _met(short, long, begin, end)
                begin = end
                if not len(row):
                    continue
                kept = _candidates(row, i, j, short, long, kinds, rule)
                row, i, j = row[kept], i[kept], j[kept]
                for at in range(0, len(i), PAIRS):
                    x, y = i[at:at + PAIRS], j[at:at + PAIRS]
                    signatures = (list(zip(*(side.items[h].take(pa.array(z)).to_pylist() for h in ("h1", "h2")))) for side, z in ((short, x), (long, y)))
                    held.append((kinds[row[at:at + PAIRS]] % 2, short.node[x], long.node[y], short.n[x], long.n[y], *signatures))
                    total += len(x)
                    if total >= PAIRS:
                        yield flushed()
                        held, total = [], 0
        if held:
            yield flushed()

    return pairs.mapInArrow(run, _FOUND)


def fuzzy_classes(rows: DataFrame, threshold=V.MIN_FUZZY_SCORE, id_col="id", digest_col="digest", block=BLOCK) -> DataFrame:
    """Class and number of links of every row, exactly, by the score of its fuzzy digest.

    Result, one row per input row: ``id``, ``n_links`` (other rows whose score with it is at least ``threshold``;
    rows of one digest score 100) and ``class_id``, the smallest id that links lead to, its own included. A
    digest that is null or lacks a part, or has an empty signature, links with nothing. Null ids take part
    but are never a class unless all ids of the class are null. Repeated rows count as rows. Further columns may bear any name.

    Work: with a threshold of about 75 or more, digests meet on segments of three and more letters, and it nears the
    number of digests while they share few. The smaller the threshold the shorter the segments; at
    50, half of the letters may differ, nothing short of comparing the digests of like block size decides, and work grows
    with the square of their number, in blocks. Rows found are at most two a digest and group of compared pairs.
    """
    rule = _Rule(threshold)
    ship_package(rows.sparkSession)
    digest = F.col(digest_col)
    parts = rows.select(F.col(id_col).alias("id"), digest["block_size"].cast("bigint").alias("size"), digest["h1"].alias("h1"), digest["h2"].alias("h2"))
    sound = (F.length("h1") > 0) & (F.length("h2") > 0) & F.col("size").isNotNull()
    parts = stage(parts, "fuzzy-digests")
    texts = parts.where(sound).groupBy("size", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    texts = stage(texts.withColumn("node", F.monotonically_increasing_id()), "fuzzy-texts")  # stored, so numbers stay
    spark = rows.sparkSession
    let_go(spark)
    met = stage(_meeting(_keyed(texts, rule, whole=False)), "fuzzy-met")  # without signatures, which would take most of the disk
    let_go(spark)
    blocks = stage(_packed(met.join(texts.select("node", *_SIGNATURES), "node"), block), "fuzzy-blocks")
    release(met)
    let_go(spark)
    conf, records = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = conf.get(records)
    conf.set(records, ROWS)  # a row holds two blocks
    try:
        found = stage(_compared(blocks, rule), "fuzzy-links")
    finally:
        conf.set(records, kept)
    release(blocks)
    let_go(spark)
    links = found.groupBy("node").agg(F.sum("n").alias("links"))
    stars = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = texts.join(links, "node", "left").join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("class_id"))
    known = placed.join(least, "component").select(
        F.col("size").alias("s"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "class_id",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = parts.join(known, (F.col("size") == F.col("s")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("class_id", "id").alias("class_id"))
