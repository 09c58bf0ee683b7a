import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import mixed_texts

from chainwitness.llm import alignment, chunks, pieces, sentence_pieces
from chainwitness.llm.common import identified

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = [*"ab'st 12#.\n\t\r\x0b\x1c\x85\xa0é　 ñ字😀▁\x00", "<s>", "</s>", "<unk>", "<0x0A>", "'ll", " don't", "<|endoftext|>", "  "]


def odd_texts(n=1500):
    rng = random.Random(8)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 25))) for _ in range(n)] + ["字" * 3000, "x y " * 9000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=B_FILE)


@pytest.fixture(scope="module")
def plain_a():
    tokenizer = tokenizers.Tokenizer.from_file(A_FILE)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_codec_equals_the_library(documents, library):
    texts = mixed_texts() + [(7, "a repeated id"), (7, "a repeated id"), (None, "no id")] + [(100 + i, t) for i, t in enumerate(odd_texts())]
    docs = identified(documents(texts).selectExpr("*", "1 as _ids", "2 as _decoded"))
    found = sentence_pieces.digests(sentence_pieces.decode(sentence_pieces.encode(docs, B_FILE), B_FILE)).collect()
    assert sorted(map(str, found)) == sorted(map(str, sentence_pieces.digests(sentence_pieces.round_trip(docs, B_FILE)).collect()))
    expected = []
    for i, text in texts:
        ids = library.encode(text or "", add_eos=True)
        expected.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(expected)


def test_any_ids_decode_as_the_library_does(library):
    rng, model = random.Random(3), sentence_pieces.Model(library.serialized_model_proto())
    rows = [[rng.randrange(0, rng.choice([5, 300, 32000])) for _ in range(rng.randrange(0, 8))] for _ in range(5000)]
    ids = np.array([i for r in rows for i in r], np.int32)
    assert model.decode(ids, np.array(list(map(len, rows)))) == [library.decode(r) for r in rows]


def test_pieces_equal_the_tokenizers_library():
    for plain in (False, True):
        with open(A_FILE, encoding="utf-8") as file:
            encoder = pieces.library_encoder(file.read(), plain)
        tokenizer, texts = tokenizers.Tokenizer.from_file(A_FILE), odd_texts()
        tokenizer.encode_special_tokens = plain
        ids, counts = encoder.encode(pa.array([*texts, None]))
        found = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_a_full_table_begins_again():
    def encode_new(data, begins, ends):
        return np.concatenate([data[b:e] for b, e in zip(begins, ends)]).astype(np.int32), ends - begins

    table, rng = chunks.ChunkTable(encode_new, slots=16, pool=60), np.random.Generator(np.random.PCG64(2))
    for _ in range(300):
        data, cuts = rng.integers(97, 101, 80, dtype=np.uint8), np.unique(np.append(rng.integers(0, 80, 30), [0, 80]))
        ids, counts = table.encode(data, cuts[:-1], cuts[1:])
        assert np.array_equal(ids, data) and np.array_equal(counts, np.diff(cuts))


def plain_links(text, plain_a, library, contents):
    """Ids of both sides, links and groups by comparing all byte ranges."""
    if not text:
        return None
    a, b = plain_a.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
    spelt = [[contents[side][i] for i in ids] for side, ids in enumerate((a, b))]
    if any(b"".join(s) != (" " + text).encode() for s in spelt):
        return None
    ranges = []
    for s in spelt:
        ends = np.cumsum(list(map(len, s))).tolist()
        ranges.append(list(zip([0, *ends[:-1]], ends)))
    links, j0 = [], 0
    for i, (start, end) in enumerate(ranges[0]):
        while ranges[1][j0][1] <= start:
            j0 += 1
        j = j0
        while j < len(b) and ranges[1][j][0] < end:
            links.append((i, j))
            j += 1
    both, groups, at = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]}), [], 0
    places = [dict((e, k + 1) for k, (_, e) in enumerate(r)) for r in ranges]
    i0 = j0 = 0
    for end in both:
        i1, j1 = places[0][end], places[1][end]
        groups.append(",".join(map(str, a[i0:i1])) + "|" + ",".join(map(str, b[j0:j1])))
        i0, j0 = i1, j1
    return a, b, links, groups


@pytest.fixture(scope="module")
def contents(library):
    from chainwitness.llm.bpe import bytes_of_ids

    with open(A_FILE, encoding="utf-8") as file:
        of_a = bytes_of_ids(file.read())
    return of_a, sentence_pieces.Model(library.serialized_model_proto()).content


@pytest.mark.parametrize("head", [1 << 19, 200, 0])
def test_summaries_equal_all_byte_ranges(spark, documents, plain_a, library, contents, head):
    texts = [(i, t) for i, t in mixed_texts() if t is None or len(t) < 9000]
    texts += [(7, "a repeated id"), (7, "a repeated id"), (None, "no id")] + [(100 + i, t) for i, t in enumerate(odd_texts(400))]
    linked = [(i, plain_links(t, plain_a, library, contents)) for i, t in texts]
    counts = {}
    for _, found in linked:
        for i, j in found[2] if found else ():
            key = found[0][i], found[1][j]
            counts[key] = counts.get(key, 0) + 1
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    expected = []
    for i, found in linked:
        if found is None:
            expected.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = found
        n = [counts[a[x], b[y]] for x, y in links]
        expected.append((i, len(a), len(b), len(groups), len(links), sum(c == most[b[y]] for c, (_, y) in zip(n, links)), sum(n),
                         hashlib.sha256(";".join(groups).encode()).hexdigest()))
    docs = identified(documents(texts).selectExpr("*", "1 as rest", "2 as code", "3 as n"))
    got = alignment.summaries(docs, A_FILE, B_FILE, head=head).drop("_hash").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    if head == 200:
        rows = alignment.align(docs, A_FILE, B_FILE).collect()
        expected = [(i, *((a, b, [x for x, _ in links], [y for _, y in links], ";".join(groups)) if found else ([], [], [], [], "")))
                    for i, found in linked for a, b, links, groups in [found or (0, 0, 0, 0)]]
        assert sorted(str((r[0], *r[2:])) for r in rows) == sorted(map(str, expected))


def test_empty_tables(documents):
    docs = identified(documents([]))
    assert sentence_pieces.decode(sentence_pieces.encode(docs, B_FILE), B_FILE).count() == 0
    assert alignment.summaries(docs, A_FILE, B_FILE).count() == 0
    assert alignment.align(docs, A_FILE, B_FILE).count() == 0
    none = identified(documents([(1, None), (2, "")]))
    assert alignment.summaries(none, A_FILE, B_FILE).where("n_a + n_b + n_links + count_sum > 0 or groups_sha256 <> ''").count() == 0
