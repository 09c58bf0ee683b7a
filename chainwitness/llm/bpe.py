"""Byte-level BPE encoding and decoding; words share the work on their common prefixes.

The encoding of a prefix is fixed by its last token alone: the one token that ends the
prefix and may follow the last token of what stands before it. The sorted distinct words of
a batch are their trie in depth-first order, so a stack of last tokens, cut back to the
prefix shared with the word before, gives every trie node its state exactly once.
"""

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwitness.llm.common import arrow_rows, small_slices, sole
from chainwitness.llm.pieces import ENCODE_BYTES, Parts, PieceEncoder, is_latin, pre_tokens

FOLLOWS = 300_000  # pairs of tokens that one process keeps
ENCODED = "_id bigint, _hash binary, _ids array<int>"
DECODED = "_id bigint, _hash binary, _ids array<int>, _decoded string"
_ENCODED = pa.schema([("_id", pa.int64()), ("_hash", pa.binary()), ("_ids", pa.list_(pa.int32()))])
_DECODED = _ENCODED.append(pa.field("_decoded", pa.string()))


def byte_letters():
    """The letter that stands for each byte: printable bytes themselves, others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


def token_bytes(spec):
    """The bytes of every ordinary token of a tokenizer file."""
    to_byte = {letter: byte for byte, letter in byte_letters().items()}
    return {t: bytes(map(to_byte.__getitem__, t)) for t in spec["model"]["vocab"] if all(c in to_byte for c in t)}


@lru_cache(maxsize=1)
def bytes_of_ids(source):
    """The bytes of every id, special tokens included."""
    spec = json.loads(source)
    found = {spec["model"]["vocab"][t]: b for t, b in token_bytes(spec).items()}
    found.update({a["id"]: a["content"].encode() for a in spec.get("added_tokens", ())})
    return found


class Vocabulary:
    """Tokens and merges of a tokenizer file, and which token may follow which."""

    def __init__(self, source):
        spec = json.loads(source)
        model, as_bytes = spec["model"], token_bytes(spec)
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", ())}
        if any(c.isspace() for content in self.special for c in content):
            raise ValueError("special tokens with white space are not supported")
        self.id_of = {as_bytes[t]: i for t, i in model["vocab"].items() if t in as_bytes and t not in self.special}
        self.longest = max(map(len, self.id_of))
        self.rank, self.made_of = {}, {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = self.id_of[as_bytes[left]], self.id_of[as_bytes[right]]
            self.rank[pair] = rank
            self.made_of[self.id_of[as_bytes[left] + as_bytes[right]]] = rank, pair
        self._edges = {}, {}
        self._follows = {}

    def _edge(self, token, side):
        """Tokens that stand at one edge of ``token`` while it is built, with the rank at which each goes."""
        known = self._edges[side].get(token)
        if known is None:
            known, inside, gone = [(token, len(self.rank))], token, None
            while inside in self.made_of:
                gone, pair = self.made_of[inside]
                inside = pair[side]
                known.append((inside, gone))
            self._edges[side][token] = known
        return known

    def may_follow(self, left, right):
        """Whether no merge crosses the border of two tokens before both are complete.

        Of two merges with one rank the left one comes first, so a crossing merge loses a tie
        against the left token's own merge and wins it against the right one's.
        """
        key = left << 32 | right
        known = self._follows.get(key)
        if known is None:
            known, rank = True, self.rank
            for a, a_gone in self._edge(left, 1):
                for b, b_gone in self._edge(right, 0):
                    crossing = rank.get((a, b))
                    if crossing is not None and crossing < a_gone and crossing <= b_gone:
                        known = False
            if len(self._follows) > FOLLOWS:
                self._follows.clear()
            self._follows[key] = known
        return known

    def encode_sorted(self, words):
        """Ids of every word of a sorted list of byte strings, as bytes."""
        ids, longest, may_follow = self.id_of.get, self.longest, self.may_follow
        out, before = [], b""
        last, start = [-1], [0]  # for each prefix length: its last token, and where that begins
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1:], start[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    token = ids(word[begin:end])
                    if token is not None and (begin == 0 or may_follow(last[begin], token)):
                        last.append(token)
                        start.append(begin)
                        break
                else:
                    raise ValueError("a byte has no token")
            tokens, end = [], len(word)
            while end:
                tokens.append(last[end])
                end = start[end]
            out.append(np.array(tokens[::-1], "<i4").tobytes())
            before = word
        return out

    def parts(self, piece):
        """Pre-tokens of a piece as bytes; special tokens as ids."""
        for content, number in self.special.items():
            if content in piece:
                head, _, tail = piece.partition(content)
                return [*(self.parts(head) if head else ()), number, *(self.parts(tail) if tail else ())]
        if is_latin(piece):
            return [t.encode() for t in pre_tokens(piece)]
        from tokenizers.pre_tokenizers import ByteLevel  # knows the letters of all scripts as the tokenizer does

        data, out, end = piece.encode(), [], 0
        for token, _ in ByteLevel(add_prefix_space=False).pre_tokenize_str(piece):
            out.append(data[end:end + len(token)])  # one letter a byte
            end += len(token)
        return out


@sole
def _encoder(source):
    vocabulary = Vocabulary(source)
    return PieceEncoder(Parts(vocabulary.parts, vocabulary.encode_sorted), vocabulary.special)


def _source(spark, tokenizer_file):
    """The tokenizer file, of a fixed size of a few MB, for the executors."""
    with open(tokenizer_file, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, tokenizer_file) -> DataFrame:
    """Token ids of every whole text.

    ``docs`` comes from ``common.identified``. Result: ``_id``, ``_hash``, ``_ids``, one row per
    input row, repeated rows included. A null or empty text has no ids. Truncation and
    padding are not applied; a special token written in a text becomes its own id. Texts
    may be of any length: work is linear in it, and memory holds one text and its ids.
    """
    source = _source(docs.sparkSession, tokenizer_file)

    def run(batches):
        encoder = _encoder(source.value)
        for batch in small_slices(batches, max_bytes=ENCODE_BYTES):
            ids, counts = encoder.encode(batch.column("_text"))
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.array(ids))
            yield arrow_rows(_ENCODED, batch.column("_id"), batch.column("_hash"), lists)

    return docs.select("_id", "_hash", "_text").mapInArrow(run, ENCODED)


def _text(look, ids):
    return b"".join(map(look, ids.tolist())).decode("utf-8", "replace")


def decode(encoded: DataFrame, tokenizer_file) -> DataFrame:
    """Adds ``_decoded``, the text that the ids stand for, special tokens included.

    Bytes that are not UTF-8, as cut id sequences may give, become U+FFFD. Null ids give "".
    """
    source, none = _source(encoded.sparkSession, tokenizer_file), np.zeros(0, np.int32)

    def run(batches):
        look = bytes_of_ids(source.value).__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [_text(look, x.values.to_numpy() if x.is_valid else none) for x in batch.column("_ids")]
                yield arrow_rows(_DECODED, *(batch.column(c) for c in ("_id", "_hash", "_ids")), texts)

    return encoded.select("_id", "_hash", "_ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, tokenizer_file) -> DataFrame:
    """``encode`` and ``decode`` in one pass of one process: ``_id``, ``_hash``, ``_ids``, ``_decoded``."""
    source = _source(docs.sparkSession, tokenizer_file)

    def run(batches):
        encoder, look = _encoder(source.value), bytes_of_ids(source.value).__getitem__
        for batch in small_slices(batches, max_bytes=ENCODE_BYTES):
            ids, counts = encoder.encode(batch.column("_text"))
            stops = np.cumsum(counts)
            texts = [_text(look, ids[stop - n:stop]) for stop, n in zip(stops.tolist(), counts.tolist())]
            lists = pa.ListArray.from_arrays(np.append(0, stops).astype(np.int32), pa.array(ids))
            yield arrow_rows(_DECODED, batch.column("_id"), batch.column("_hash"), lists, texts)

    return docs.select("_id", "_hash", "_text").mapInArrow(run, DECODED)


def digests(decoded: DataFrame) -> DataFrame:
    """Number of ids and hashes of ids and decoded text of each document."""
    return decoded.select(
        F.col("_id").alias("doc_id"),
        F.size("_ids").cast(T.LongType()).alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded"), 256).alias("decoded_sha256"),
    )
