import pytest
from brute import edited, prose, rooted, words
from test_dedup import _kept_lines, _links
from test_text import LANGUAGES, _shared

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows():
    item = prose(900, 30)
    rows = [(i, f"{prose(i, 40)}\n{prose(100 + i, 25)}\n{LANGUAGES['aa']}{i}") for i in range(12)]
    rows += [(20, None), (21, "12 34"), (22, rows[0][1]), (23, edited(rows[1][1].replace("\n", " "), 3, 0.01)), (24, rows[1][1].replace("\n", " ")),
             (25, f"{prose(300, 15)} {item} {prose(301, 15)}"), (26, rows[2][1] + "\n" + prose(303, 30)), (27, f"{prose(305, 20)}\n\n{prose(305, 20)}")]
    return rows, [(1, item), (2, prose(901, 20))]


def test_stages_equal_their_plain_versions(spark, documents, tmp_path):
    rows, items = _rows()
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    sf_dir, texts = f"{tmp_path}/in", dict(rows)

    def step(number, docs):
        out = f"{tmp_path}/{number}"
        corpus_pipeline.STAGES[number][1](spark, docs, sf_dir).write.parquet(out)
        return spark.read.parquet(out)

    def held(frame):
        assert frame.columns == COLUMNS
        return {r["doc_id"]: r["text"] for r in frame.collect()}

    first = step(0, docs)
    texts = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert held(first) == texts
    second = step(1, first)
    kept = _kept_lines(list(texts.items()))
    texts = {i: kept[i] for i in texts if words(kept[i]) or kept[i] == texts[i]}
    assert held(second) == texts and 22 not in texts
    assert all(r["n_chars"] == len(r["text"]) for r in second.collect())
    third = step(2, second)
    sets, links = _links(list(texts.items()))
    roots = rooted(sets, links)
    texts = {i: t for i, t in texts.items() if roots[i] == i}
    assert held(third) == texts and 24 not in texts
    fourth = step(3, third)
    texts = {i: t for i, t in texts.items() if not any(_shared(t, b) for _, b in items)}
    assert held(fourth) == texts and 25 not in texts
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: (r["ids"], r["round_trip"]) for r in step(4, fourth).collect()}
    assert found == {i: (library.encode(t, add_special_tokens=False).ids, True) for i, t in texts.items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(texts)


def test_missing_labels_become_learned_languages(spark, documents, tmp_path):
    names = sorted(LANGUAGES)
    rows = [(i, LANGUAGES[names[i % 3]] * 5) for i in range(60)] + [(None, LANGUAGES["cc"]), (61, "12")]
    langs = {i: None if i % 5 == 0 else names[i % 3] for i in range(60)} | {7: "bb", 8: "aa", None: None, 61: None}
    found = corpus_pipeline.identify_language(spark, documents(rows + rows[:1], langs), str(tmp_path)).collect()
    assert len(found) == 62 and all(r["lang"] == (langs[r["doc_id"]] or names[(r["doc_id"] or 0) % 3] if r["doc_id"] is not None else "cc") for r in found)


def test_stages_take_an_empty_table(spark, documents, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents([])
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_rows_that_repeat_an_id_leave_one_document(spark, documents, tmp_path):
    rows = [(1, prose(1, 30)), (1, prose(1, 30)), (None, prose(1, 30)), (2, "")]
    left = corpus_pipeline.keep_one_of_near_copies(spark, documents(rows), str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in left) == [1, 2]
