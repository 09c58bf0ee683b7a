"""Token ids as Arrow files of equal-length sequences, written in document order and read back.

Each range of documents makes one pair of files in Arrow's file format, the stream format
with a footer: ``ids-*.arrow`` has record batches with two fixed-size-list columns, the ids
and a mask that is true where an id is real; ``docs-*.arrow`` says where in that file each
document's ids begin. A record is found by its number through the footer, and as lists have
one length and files are not compressed, a mapped file hands out its ids without a copy.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainwitness.llm.common import arrow_rows, small_slices, sole, stage
from chainwitness.llm.pieces import ENCODE_BYTES, library_encoder
from chainwitness.session import new_dir

SEQUENCE = 2048
ROWS_PER_BATCH = 256
SHARD_ROWS = 4_096


@sole
def _encoder(source):
    return library_encoder(source)


def _id_type(source, end_id):
    """16 bits where all ids fit."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_str(source).get_vocab(with_added_tokens=True)
    return pa.uint16() if max(end_id, *vocabulary.values()) < 1 << 16 else pa.uint32()


def _schemas(sequence, id_type):
    ids = pa.schema([("ids", pa.list_(id_type, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
    docs = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    return ids, docs


class _Writer:
    """Both files of one shard; they get their names when complete, so a lost attempt leaves none."""

    def __init__(self, folder, shard, attempt, sequence, id_type):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path)
        self.sequence, self.schemas, self.total = sequence, _schemas(sequence, id_type), 0
        self.kind = id_type.to_pandas_dtype()
        self.names = [(f"{path}/.{kind}-{shard}-{attempt}", f"{path}/{kind}-{shard}.arrow") for kind in ("ids", "docs")]
        self.files = [self.system.open_output_stream(own) for own, _ in self.names]
        self.out = [pa.ipc.new_file(f, s) for f, s in zip(self.files, self.schemas)]
        self.rest = np.zeros(0, self.kind)

    def add(self, doc_ids, ids, counts):
        starts = self.total + np.concatenate(([0], np.cumsum(counts)))
        self.out[1].write(arrow_rows(self.schemas[1], doc_ids, starts[:-1], counts))
        self.total = int(starts[-1])
        ids = np.concatenate((self.rest, ids.astype(self.kind)))
        step = self.sequence * ROWS_PER_BATCH
        full = len(ids) // step * step
        for at in range(0, full, step):
            self._sequences(ids[at:at + step], step)
        self.rest = ids[full:].copy()

    def _sequences(self, ids, real):
        lists = [pa.FixedSizeListArray.from_arrays(x, self.sequence) for x in (
            pa.array(ids), pa.array(np.arange(len(ids)) < real)
        )]
        self.out[0].write(pa.RecordBatch.from_arrays(lists, schema=self.schemas[0]))

    def close(self):
        if len(self.rest):
            padded = np.zeros(-(-len(self.rest) // self.sequence) * self.sequence, self.kind)
            padded[: len(self.rest)] = self.rest
            self._sequences(padded, len(self.rest))
        for out, file, (own, name) in zip(self.out, self.files, self.names):
            out.close()
            file.close()
            self.system.move(own, name)


def write(docs: DataFrame, tokenizer_file, end_id, folder=None, sequence=SEQUENCE) -> tuple[str, DataFrame]:
    """Write the ids of all texts in ascending id order; returns the folder and its list of shards.

    ``docs`` comes from ``common.identified``. Null ids stand first; rows with one id stand in order
    of their text's hash. A null or empty text has only its end id. The shards are ranges of about
    ``SHARD_ROWS`` documents, found from a sample of the ids alone, so neither a long text nor a
    large table makes one task hold more than a batch. An empty table makes an empty list.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    with open(tokenizer_file, encoding="utf-8") as file:
        text = file.read()
    source, id_type = spark.sparkContext.broadcast(text), _id_type(text, end_id)
    shards = max(spark.sparkContext.defaultParallelism, docs.count() // SHARD_ROWS + 1)
    ordered = docs.repartitionByRange(shards, "_id", "_hash").sortWithinPartitions("_id", "_hash")

    def run(batches):
        context, encoder, writer, first = TaskContext.get(), _encoder(source.value), None, None
        shard = f"{context.partitionId():06d}"
        for batch in small_slices(batches, max_bytes=ENCODE_BYTES):
            if writer is None:
                writer = _Writer(folder, shard, context.taskAttemptId(), sequence, id_type)
                first = batch.column("_id")[0].as_py()
            ids, counts = encoder.encode(batch.column("_text"))
            stops = np.cumsum(counts)
            ids = np.insert(ids, stops, end_id)
            writer.add(batch.column("_id"), ids, counts + 1)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_tokens": [writer.total]})

    shards = stage(ordered.mapInArrow(run, "shard string, n_tokens bigint"), "shards")
    return folder, shards


class Shard:
    """Random access to the ids of one shard; a local file is mapped, not read."""

    def __init__(self, folder, shard):
        system, path = fs.FileSystem.from_uri(folder)
        local = isinstance(system, fs.LocalFileSystem)
        opened = [pa.memory_map(name) if local else system.open_input_file(name)
                  for name in (f"{path}/ids-{shard}.arrow", f"{path}/docs-{shard}.arrow")]
        self.sequences, self.docs = map(pa.ipc.open_file, opened)
        self.sequence = self.sequences.schema.field("ids").type.list_size

    def ids(self, start, n):
        """The ``n`` ids from place ``start`` on, as arrays that view the file."""
        step = self.sequence * ROWS_PER_BATCH
        while n > 0:
            at = start % step
            part = self.sequences.get_batch(start // step).column("ids").flatten().to_numpy()[at:at + n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self):
        """Record batches of doc_id, start in this shard, n_tokens."""
        for number in range(self.docs.num_record_batches):
            yield self.docs.get_batch(number)


def read(folder, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of every document, from the files alone.

    ``start`` counts the ids of all documents before it. Only one number per shard is summed
    up in order; files are read by as many tasks as there are shards.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for name, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(folder, name)
                for docs in shard.documents():
                    starts, counts = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    sums = []
                    for start, n in zip(starts.tolist(), counts.tolist()):
                        total = 0
                        for part in shard.ids(start, n):
                            total = zlib.crc32(part.astype("<u4"), total)
                        sums.append(total)
                    yield arrow_rows(schema, docs.column("doc_id"), starts + base, counts, sums)

    files = max(1, shards.count())  # named, so that Spark does not put these few short rows into one task
    return placed.repartition(files, "shard").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
