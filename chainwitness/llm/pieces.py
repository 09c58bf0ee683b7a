"""Byte-level BPE of whole texts through the distinct pieces they consist of.

No token spans the place where a word ends and white space begins, nor most places where letters,
digits and marks of ASCII meet, so texts may be cut there and the pieces encoded apart. Pieces
repeat, and ``ChunkTable`` encodes each distinct one once, as long as it is known.
"""

import numpy as np
import regex

from chainwitness.llm.chunks import ChunkTable, spans, taken
from chainwitness.llm.words import Words

# Fixed value: the pattern by which byte-level BPE cuts texts into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space beyond ASCII.
WIDE_SPACES = "\u0085                 　"
KEPT_TOKENS = 150_000
ENCODE_BYTES = 2_000_000  # texts encoded at once

_SPACES = np.array([32, *range(9, 14)], np.uint8)
_PRE_TOKENS = regex.compile(PATTERN)
_ENDINGS = ".,;:!?|)]}"
_WIDE = {len(c.encode()): np.array([int.from_bytes(w.encode(), "big") for w in WIDE_SPACES if len(w.encode()) == len(c.encode())])
         for c in WIDE_SPACES}


def is_latin(segment):
    """Whether all characters lie where every Unicode version has the same letters and digits."""
    return segment.isascii() or max(segment) < "ɐ"


def pre_tokens(segment):
    """Pre-tokens of a segment of Latin script; most are one word, perhaps with marks after it."""
    word = segment.rstrip(_ENDINGS)
    if word[:1] == "\n" and word[1:].isalpha():
        return ["\n", word[1:]] if len(word) == len(segment) else ["\n", word[1:], segment[len(word):]]
    if (word[1:] if word[:1] == " " else word).isalpha():
        return [word] if len(word) == len(segment) else [word, segment[len(word):]]
    return _PRE_TOKENS.findall(segment)


def _kinds():
    """The kind of each byte (0: not told, 1: letter, 2: digit, 3: white space, 4: mark, 5: apostrophe), and by
    kinds whether a pre-token ends between two bytes."""
    kind = np.zeros(256, np.uint8)
    kind[:0x1C] = kind[0x21:0x80] = 4
    kind[[*range(65, 91), *range(97, 123)]] = 1
    kind[48:58] = 2
    kind[[32, *range(9, 14)]] = 3
    kind[39] = 5
    ends = np.zeros((6, 6), bool)
    ends[1, 2:] = ends[2, [1, 3, 4, 5]] = ends[4, 1:3] = True
    return kind, ends


_KIND, _ENDS = _kinds()


def piece_cuts(words, uncut=()):
    """Places where texts may be cut: all begins and ends of texts, word ends not behind white space beyond
    ASCII, and changes of the kind of letter; none inside one of the ``uncut`` strings."""
    data, ends = words.data, words.ends
    far = np.flatnonzero(data[ends - 1] >= 128)
    if len(far):
        at, wide = ends[far], np.zeros(len(far), bool)
        for size, known in _WIDE.items():
            whole = at >= size
            code = np.zeros(int(whole.sum()), np.int64)
            for k in range(size, 0, -1):
                code = code << 8 | data[at[whole] - k]
            wide[whole] |= np.isin(code, known)
        ends = np.delete(ends, far[wide])
    marks, kinds = np.zeros(len(data) + 1, bool), _KIND[data]
    if len(data):
        marks[1:-1] = _ENDS.ravel()[kinds[:-1] * np.uint8(6) + kinds[1:]]
    marks[ends] = True
    whole = data.tobytes() if uncut else b""
    for content in uncut:
        at = whole.find(content)
        while at >= 0:
            marks[at + 1:at + len(content)] = False
            at = whole.find(content, at + len(content))
    marks[words.offsets] = True
    return np.flatnonzero(marks)


class PieceEncoder:
    """Encodes texts; ``encode_new`` as in ``ChunkTable``. ``uncut`` are special tokens."""

    def __init__(self, encode_new, uncut=()):
        self.table, self.uncut = ChunkTable(encode_new), [s.encode() for s in uncut]

    def encode(self, column):
        """Ids of all texts of a string column in one array, and the number of ids of each text."""
        words = Words(column, named=False)
        cuts = piece_cuts(words, self.uncut)
        ids, counts = self.table.encode(words.data, cuts[:-1], cuts[1:])
        text = np.searchsorted(words.offsets, cuts[:-1], side="right") - 1
        return ids, np.bincount(text, counts, len(words.offsets) - 1).astype(np.int64)


class Parts:
    """Encodes pieces by their distinct parts; ``encode_many`` encodes a list of distinct parts.

    A part may be an ``int``, which is an id. Ids are little-endian 32-bit integers in ``bytes``.
    """

    def __init__(self, parts, encode_many, kept=KEPT_TOKENS):
        self.parts, self.encode_many, self.kept, self.tokens = parts, encode_many, kept, {}

    def __call__(self, data, begins, ends):
        pieces = taken(data, begins, ends)
        if len(self.tokens) > self.kept:
            self.tokens.clear()
        tokens, cut_up = self.tokens, [self.parts(p.decode()) for p in pieces]
        new = {t for parts in cut_up for t in parts if t not in tokens}
        for token in [t for t in new if isinstance(t, int)]:
            tokens[token] = np.array([token], "<i4").tobytes()
            new.discard(token)
        new = sorted(new)
        tokens.update(zip(new, self.encode_many(new)))
        found = [b"".join([tokens[t] for t in parts]) for parts in cut_up]
        for token in new:
            if len(token) > 64:
                del tokens[token]
        return np.frombuffer(b"".join(found), "<i4"), [len(x) // 4 for x in found]


def library_encoder(source, plain_specials=False):
    """A ``PieceEncoder`` by the tokenizers library: many pieces in one call, parted again by the bytes of their ids.

    ``source`` is a tokenizer file. Pieces that do not begin with white space follow a line feed, whose id is
    dropped. Pieces that end with white space, or hold a special token, are encoded alone. With
    ``plain_specials`` special tokens written in a text are ordinary text.
    """
    from tokenizers import Tokenizer

    from chainwitness.llm.bpe import bytes_of_ids

    library = Tokenizer.from_str(source)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = plain_specials
    names = [] if plain_specials else [t.content for t in library.get_added_tokens_decoder().values()]
    special = [s.encode() for s in names]
    sizes = np.zeros(max(bytes_of_ids(source)) + 1, np.int64)
    for number, content in bytes_of_ids(source).items():
        sizes[number] = len(content)

    def alone(text):
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def apart_from(data, begins, ends, joined):
        first, last = data[begins], data[ends - 1]
        apart = np.isin(last, _SPACES)
        for k in np.flatnonzero((first >= 128) | (last >= 128)):
            text = data[begins[k]:ends[k]].tobytes().decode()
            apart[k] |= text[0] in WIDE_SPACES or text[-1] in WIDE_SPACES
        if any(s in joined for s in special):
            apart |= [any(s in piece for s in special) for piece in taken(data, begins, ends)]
        return apart

    def with_feeds(data, begins, ends, headed):
        """All pieces in one, each of ``headed`` behind a line feed; and where each ends."""
        sizes = ends - begins
        stops = np.cumsum(sizes + headed)
        whole = np.full(int(stops[-1]) if len(stops) else 0, 10, np.uint8)
        whole[spans(stops - sizes, sizes)] = data[spans(begins, sizes)]
        return whole.tobytes(), stops

    def encode_new(data, begins, ends):
        headed = ~np.isin(data[begins], _SPACES)
        joined, stops = with_feeds(data, begins, ends, headed)
        apart = apart_from(data, begins, ends, joined)
        if apart.any():
            headed = headed[~apart]
            joined, stops = with_feeds(data, begins[~apart], ends[~apart], headed)
        ids, places_of = alone(joined.decode()), stops
        places = np.cumsum(sizes[ids])
        stops = np.searchsorted(places, places_of) + 1
        if len(stops) and not (stops[-1] <= len(places) and np.array_equal(places[stops - 1], places_of)):
            apart[:], counts, ids = True, np.zeros(0, np.int64), ids[:0]  # no such place is known
        else:
            starts = np.append(0, stops[:-1])[: len(stops)]
            ids, counts = np.delete(ids, starts[headed]), stops - starts - headed
        if not apart.any():
            return ids, counts
        own = {int(k): alone(data[begins[k]:ends[k]].tobytes().decode()) for k in np.flatnonzero(apart)}
        totals = np.zeros(len(begins), np.int64)
        totals[~apart] = counts
        totals[list(own)] = [len(x) for x in own.values()]
        found, places = np.empty(int(totals.sum()), np.int32), np.cumsum(totals) - totals
        found[spans(places[~apart], counts)] = ids
        for k, x in own.items():
            found[places[k]:places[k] + len(x)] = x
        return found, totals

    return PieceEncoder(encode_new, names)
