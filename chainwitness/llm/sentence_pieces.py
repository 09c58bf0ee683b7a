"""SentencePiece encoding and decoding through a table of distinct marked words.

In the model a mark stands for each space, and pieces have marks at their front only, so no
merge crosses the place before a mark that follows something else: a text is its marked words,
each segmented apart, and their ids joined back by position. Letters that are in no piece (line feeds
and tabs in most models) become bytes of their own and end a chunk too. ``ChunkTable`` holds the
distinct chunks; each is segmented once by the library, as long as it is known.
"""

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness.llm.chunks import ChunkTable, spans, taken
from chainwitness.llm.common import arrow_rows, small_slices, sole
from chainwitness.llm.pieces import ENCODE_BYTES
from chainwitness.llm.words import buffers

MARK = "▁"  # fixed value: what stands for a space
ENCODED = "_id bigint, _hash binary, _ids array<int>"
DECODED = "_id bigint, _hash binary, _ids array<int>, _decoded string"
_ENCODED = pa.schema([("_id", pa.int64()), ("_hash", pa.binary()), ("_ids", pa.list_(pa.int32()))])
_DECODED = _ENCODED.append(pa.field("_decoded", pa.string()))


def spaced(column):
    """Offsets and bytes of the texts with a space before each that is not empty; marks in texts become spaces."""
    if pc.any(pc.match_substring(column, MARK)).as_py():
        column = pc.replace_substring(column, MARK, " ")
    offsets, data = buffers(column)
    full = np.diff(offsets) > 0
    return offsets + np.append(0, np.cumsum(full)), np.insert(data, offsets[:-1][full], 32)


class Model:
    """A model with identity normalisation, a mark before each text, and byte pieces."""

    def __init__(self, proto):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_proto=proto)
        probe = "ｆ  x "
        if library.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models without normalisation and with a mark before the text are supported")
        n = library.vocab_size()
        plain = [not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i)) for i in range(n)]
        pieces = [library.id_to_piece(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p, use in zip(pieces, plain) if use):
            raise ValueError("pieces that go across marks are not supported")
        used = set("".join(p for p, use in zip(pieces, plain) if use))
        self.bars = [c for c in range(128) if chr(c) not in used and c != 32] if library.piece_to_id("<0x0A>") != library.unk_id() else []
        self.mark, self.end, self.unknown = library.piece_to_id(MARK), library.eos_id(), library.unk_id()
        self.content = [p.replace(MARK, " ").encode() if use else bytes([int(p[3:5], 16)]) if library.is_byte(i) else b""
                        for i, (p, use) in enumerate(zip(pieces, plain))]
        self.heads = np.array([use and p[0] == MARK for p, use in zip(pieces, plain)])  # begin with a mark
        self.sizes = np.array([len(c) for c in self.content], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.content), np.uint8)
        self.table = ChunkTable(self.segment)

    def segment(self, data, begins, ends):
        """Ids of distinct chunks. The library puts a mark before a text, which takes the place of a chunk's first
        space; what begins otherwise follows a bar, whose two ids are dropped."""
        chunks, bar = taken(data, begins, ends), chr(self.bars[-1]) if self.bars else ""
        found = self.library.encode([c[1:].decode() if c[0] == 32 else bar + c.decode() for c in chunks], num_threads=1)
        ids = [([self.mark] if c == b" " else x) if c[0] == 32 else x[2:] for c, x in zip(chunks, found)]
        return np.fromiter(chain.from_iterable(ids), np.int32), list(map(len, ids))

    def cuts(self, offsets, data):
        """All places between which chunks lie: ends of texts, the places before marks that follow something else, bars."""
        marks = np.zeros(len(data) + 1, bool)
        space = data == 32
        if len(data):
            marks[1:-1] = space[1:] & ~space[:-1]
        for code in self.bars:
            at = np.flatnonzero(data == code)
            marks[at] = marks[at + 1] = True
        marks[offsets] = True
        return np.flatnonzero(marks)

    def encode(self, offsets, data, cuts=None):
        """Ids of all ``spaced`` texts in one array, and the number of ids of each text."""
        cuts = self.cuts(offsets, data) if cuts is None else cuts
        ids, counts = self.table.encode(data, cuts[:-1], cuts[1:])
        text = np.searchsorted(offsets, cuts[:-1], side="right") - 1
        return ids, np.bincount(text, counts, len(offsets) - 1).astype(np.int64)

    def decode(self, ids, counts):
        """Texts of id sequences that follow each other in ``ids``, as the library's decode gives them."""
        sizes, stops = self.sizes[ids], np.cumsum(counts)
        whole = self.bytes[spans(self.places[ids], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, stops)]
        odd = (ids == self.unknown) | (sizes == 0)
        last = stops[counts > 0] - 1
        odd[last[ids[last] == self.end]] = False
        odd = np.append(0, np.cumsum(odd))[np.append(0, stops)]
        texts = []
        for k, (begin, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            first = stops[k] - counts[k]
            try:
                text = whole[begin:end].decode() if odd[k] == odd[k + 1] else None
            except UnicodeDecodeError:
                text = None
            if text is None:  # ids that no text has: unknown or control ids inside, or cut bytes
                text = self.library.decode(ids[first:stops[k]].tolist())
            elif counts[k] and self.heads[ids[first]]:
                text = text[1:]
            texts.append(text)
        return texts


@sole
def model(proto):
    return Model(proto)


def shared_model(spark, model_file):
    """The model file, of a fixed size below a MB, for the executors."""
    with open(model_file, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _ended(ids, counts, end_id):
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def _lists(ids, counts):
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.array(ids))


def encode(docs: DataFrame, model_file, end=True) -> DataFrame:
    """Piece ids of every whole text, with the model's end id behind them if ``end``.

    ``docs`` comes from ``common.identified``. Result: ``_id``, ``_hash``, ``_ids``, one row per input
    row, repeated rows included. A null or empty text has the end id alone. No sampling. Control pieces
    written in a text are ordinary text. Texts may be of any length; memory holds one text and its ids.
    """
    proto = shared_model(docs.sparkSession, model_file)

    def run(batches):
        own = model(proto.value)
        for batch in small_slices(batches, max_bytes=ENCODE_BYTES):
            ids, counts = own.encode(*spaced(batch.column("_text")))
            if end:
                ids, counts = _ended(ids, counts, own.end)
            yield arrow_rows(_ENCODED, batch.column("_id"), batch.column("_hash"), _lists(ids, counts))

    return docs.select("_id", "_hash", "_text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_file) -> DataFrame:
    """Adds ``_decoded``, the text that the ids stand for; null ids give "".

    The first mark is no space of the text. Control ids give nothing, bytes that are not UTF-8 U+FFFD.
    """
    proto, none = shared_model(encoded.sparkSession, model_file), pa.array([], pa.int32())

    def run(batches):
        own = model(proto.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [x.values if x.is_valid else none for x in batch.column("_ids")]
                ids = np.concatenate([x.to_numpy() for x in rows])
                texts = own.decode(ids, np.array([len(x) for x in rows], np.int64))
                yield arrow_rows(_DECODED, *(batch.column(c) for c in ("_id", "_hash", "_ids")), texts)

    return encoded.select("_id", "_hash", "_ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, model_file) -> DataFrame:
    """``encode`` and ``decode`` in one pass of one process: ``_id``, ``_hash``, ``_ids``, ``_decoded``."""
    proto = shared_model(docs.sparkSession, model_file)

    def run(batches):
        own = model(proto.value)
        for batch in small_slices(batches, max_bytes=ENCODE_BYTES):
            ids, counts = _ended(*own.encode(*spaced(batch.column("_text"))), own.end)
            yield arrow_rows(_DECODED, batch.column("_id"), batch.column("_hash"), _lists(ids, counts), own.decode(ids, counts))

    return docs.select("_id", "_hash", "_text").mapInArrow(run, DECODED)


def digests(decoded: DataFrame) -> DataFrame:
    """Number of ids and hashes of ids and decoded text of each document."""
    return decoded.select(
        F.col("_id").alias("doc_id"),
        F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded"), 256).alias("decoded_sha256"),
    )
