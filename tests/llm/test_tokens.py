import hashlib
import zlib

import numpy as np
import pytest
from brute import mixed_texts

from chainwitness.llm import bpe, token_files
from chainwitness.llm.common import identified

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(FILE)
    tokenizer.no_truncation()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_codec_equals_the_library(documents, library):
    texts = mixed_texts() + [(7, "a repeated id"), (None, "no id")]
    docs = identified(documents(texts))
    found = bpe.digests(bpe.decode(bpe.encode(docs, FILE), FILE)).collect()
    assert sorted(map(str, found)) == sorted(map(str, bpe.digests(bpe.round_trip(docs, FILE)).collect()))
    expected = sorted((str(i), len(ids := library(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                       hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r[0]), *r[1:]) for r in found) == expected


def test_cut_ids_decode_to_replacement_characters(spark, documents):
    ids = spark.createDataFrame([(1, b"", [447])], "_id bigint, _hash binary, _ids array<int>")  # first bytes of a quote mark
    assert "�" in bpe.decode(ids, FILE).first()["_decoded"]


def test_a_crossing_merge_is_seen():
    with open(FILE, encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    the, h, e = (vocabulary.id_of[x] for x in (b"t", b"h", b"e"))
    assert not vocabulary.may_follow(the, h)
    assert not vocabulary.may_follow(h, e)


@pytest.mark.parametrize("sequence", [8, 2048])
def test_files_give_back_all_ids_in_order(documents, library, tmp_path, sequence):
    texts = mixed_texts() + [(None, "first")]
    docs = identified(documents(texts[::-1]))
    folder, shards = token_files.write(docs, FILE, 2, folder=str(tmp_path / "ids"), sequence=sequence)
    found, start = {r["doc_id"]: r for r in token_files.read(folder, shards).collect()}, 0
    for i, text in sorted(texts, key=lambda x: -1 if x[0] is None else x[0]):
        ids = [*library(text), 2]
        row = found[i]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    name = shards.orderBy("shard").first()["shard"]
    shard = token_files.Shard(folder, name)
    batch = shard.sequences.get_batch(shard.sequences.num_record_batches - 1)
    real = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
    assert batch.column("ids").type.list_size == sequence and (np.diff(real.astype(int)) <= 0).all()
    assert batch.column("ids").flatten().to_numpy(zero_copy_only=True) is not None


def test_empty_tables(documents):
    docs = identified(documents([]))
    folder, shards = token_files.write(docs, FILE, 2)
    assert token_files.read(folder, shards).count() == 0
    assert bpe.decode(bpe.encode(docs, FILE), FILE).count() == 0
