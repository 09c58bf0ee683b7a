import re
from collections import Counter
from fractions import Fraction
from math import floor

import pytest
from brute import prose

from chainwitness.llm import phrases


def plain(rows, least, longest=5):
    """(lang, phrase) -> (a, cut, l, r, n, score), by the definition."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    often = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = {(lang, w[i:j]) for (lang, w), a in often.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1)
              if j - i < len(w) and 100 * a >= 100 * f[lang, w[i:j]]}
    found = {}
    for (lang, w), a in often.items():
        if (lang, w) not in inside:
            cuts = [(floor(Fraction(1000 * a * n[lang], f[lang, w[:k]] * f[lang, w[k:]])), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang, " ".join(w)] = (a, k, f[lang, w[:k]], f[lang, w[k:]], n[lang], score)
    return found


TEXTS = [(prose(i, 300, 25), lang) for i, lang in enumerate(["en", "de", None, "und", "en", "en"])]
TEXTS += [("New York, new  york\tNEW YORK. new york city new york city" * 3, "en")] * 7  # equal rows
TEXTS += [("", "en"), (None, "en"), (None, None), (" \t\n..", "xx"), ("en de " * 60, "de"), ("de en " * 60, "en"), ("a b " * 4000, "long"), ("é ä é ä ÀB àb ñ" * 9, "de"), ("one", "fr")]


@pytest.mark.parametrize("least", [3, 40])
def test_equals_the_definition(spark, least):
    docs = spark.createDataFrame([(i, t, lang, 1, 2, "x") for i, (t, lang) in enumerate(TEXTS)],
                                 "doc_id bigint, text string, lang string, f int, name int, _text string")
    found = {(r["lang"], r["phrase"]): tuple(r[c] for c in ("a", "cut", "l", "r", "n", "score"))
             for r in phrases.mine(docs, least=least).collect()}
    assert found == plain(TEXTS, least) and len(found) > 5


def test_ranks_and_ties(spark):
    rows = [("en", f"p{i}", i % 3, i % 2) for i in range(300)] + [("de", "É", 5, 5), ("de", "Z", 5, 5), ("de", "a", 5, 5)]
    made = spark.createDataFrame(rows, "lang string, phrase string, score bigint, a bigint")
    found = phrases.best(made, 40).collect()
    for lang in ("en", "de"):
        expected = sorted((-s, -a, p.encode()) for la, p, s, a in rows if la == lang)[:40]
        got = sorted((r["rank"], (-r["score"], -r["a"], r["phrase"].encode())) for r in found if r["lang"] == lang)
        assert [g[1] for g in got] == expected and [g[0] for g in got] == list(range(1, len(expected) + 1))


def test_products_beyond_64_bits(spark):
    big = 2**40
    made = spark.createDataFrame([(big, 3 * big + 7, [big + 1], [big + 3])], "f bigint, n bigint, lefts array<bigint>, rights array<bigint>")
    score = made.selectExpr("(cast(f as decimal(38,0)) * 1000 * n) div (cast(lefts[0] as decimal(38,0)) * rights[0]) as s").first()["s"]
    assert score == 1000 * big * (3 * big + 7) // ((big + 1) * (big + 3))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert phrases.best(phrases.mine(docs)).count() == 0


def test_the_bit_table_holds_all_names(spark):
    import numpy as np

    names = np.random.Generator(np.random.PCG64(1)).integers(-(2**63), 2**63, 500, dtype=np.int64)
    table = phrases._bit_table(spark.createDataFrame([(int(n),) for n in names], "name bigint"))
    assert phrases._has_bit(table, names.view(np.uint64)).all()
    assert sum(int(c).bit_count() for c in table) <= 500
