import collections
import math
import zlib

import numpy as np
import pytest
from brute import edited, mixed_texts, prose, words
from pyspark.sql import functions as F

from chainwitness.llm import decontamination, language_id, license_rules, lm_scoring
from chainwitness.llm.common import identified

ITEMS = "item_id bigint, text string"


def _licences(documents, rows):
    found = license_rules.scan(identified(documents(rows).withColumn("license", F.lit(0)))).collect()
    return sorted((r["_id"], r["license"], r["n_found"]) for r in found)


def test_licence_rules_match_sequences_in_order(documents):
    sentence = dict(reversed(license_rules.SENTENCES))
    full = "\n".join(sentence[n] for n in ("mit_grant", "mit_notice", "as_is"))
    rows = [
        (1, full), (2, full.upper().replace(" ", "\n  ", 40) + "\n" + full.upper().replace(" ", " - ")), (3, "Text before. " + sentence["bsd_grant"] + "\n" + sentence["bsd_source"]
                                                              + "\n" + sentence["bsd_binary"] + "\nmore text"),
        (4, sentence["bsd_grant"] + "\nanother sentence\n" + sentence["bsd_source"]), (5, "RELEASED under the  MIT license!! All rights reserved"),
        (6, "Released under the MIT License.\nReleased under the MIT License. x"), (7, None), (8, ""), (9, "All rights. Reserved."),
        (10, sentence["gpl3_grant"] + " " + sentence["gpl_hope"] + " " + sentence["gpl_see"]), (6, None),
    ]
    assert _licences(documents, rows + rows[:1]) == [
        (1, "MIT", 1), (2, "MIT", 1), (3, "BSD-2-Clause", 1), (4, "BSD", 1), (5, "All-Rights-Reserved", 1), (5, "MIT", 1),
        (6, "MIT", 2), (10, "GPL-3.0-or-later", 1),
    ]
    assert _licences(documents, []) == []


def test_every_rule_matches_its_own_sentences(documents):
    sentence = dict(reversed(license_rules.SENTENCES))
    rows = [(n, "\n".join(sentence[x] for x in names)) for n, (_, names) in enumerate(license_rules.RULES)]
    assert _licences(documents, rows) == [(n, name, 1) for n, (name, _) in enumerate(license_rules.RULES)]


def test_wrapped_licence_texts(documents):
    mit = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    names = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details.
"""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v.\n2.0. If a copy of the MPL was not distributed with" \
          " this file, You can\nobtain one at\nhttp://mozilla.org/MPL/2.0/."
    marked = lambda text, mark: "".join(f"{mark}{line}".rstrip() + "\n" for line in text.split("\n"))
    sentence = dict(reversed(license_rules.SENTENCES))
    rows = [
        (1, mit), (2, bsd), (3, bsd + names), (4, apache), (5, gpl), (6, mpl), (7, "/*\n" + marked(apache, " * ") + " */"), (8, marked(bsd + names, "# ")),
        (9, marked(mit, "// ").replace("\n", "\r\n")), (10, bsd.replace("1. ", "(a) ").replace("2. ", "b) ")), (11, "Licensed under the MIT License\nand so on"),
        (12, "All rights.\nReserved. All rights\n\nreserved."), (13, sentence["bsd_grant"] + "\n\nanother sentence\n\n" + sentence["bsd_source"]),
        (14, mit + bsd + mit), (15, None), (16, ""), (17, "Licensed under the GNU General Public License, version\n2."), (18, "\n" * 50_000 + mit + " \n" * 50_000),
    ]
    found = license_rules.scan(identified(documents(rows + rows[:1])), wrapped=True).collect()
    assert sorted((r["_id"], r["license"], r["n_found"]) for r in found) == [
        (1, "MIT", 1), (2, "BSD-2-Clause", 1), (3, "BSD-3-Clause", 1), (4, "Apache-2.0", 1), (5, "GPL-3.0-or-later", 1), (6, "MPL-2.0", 1),
        (7, "Apache-2.0", 1), (8, "BSD-3-Clause", 1), (9, "MIT", 1), (10, "BSD-2-Clause", 1), (11, "MIT", 1), (13, "BSD", 1),
        (14, "BSD-2-Clause", 1), (14, "MIT", 2), (17, "GPL-2.0", 1), (18, "MIT", 1),
    ]
    each = [(n, "\n".join(sentence[x] for x in names)) for n, (_, names) in enumerate(license_rules.RULES)]
    found = license_rules.scan(identified(documents(each)), wrapped=True).collect()
    assert sorted((r["_id"], r["license"], r["n_found"]) for r in found) == [(n, name, 1) for n, (name, _) in enumerate(license_rules.RULES)]


def _shared(document, item, window=13, substitutions=2):
    d, b = [(t or "").lower().split() for t in (document, item)]
    length, found = min(window, len(b)), 0
    needed = length if len(b) < window else length - substitutions
    if len(b) < 8 or len(d) < 8:
        return False
    for shift in range(-len(b), len(d)):
        same = [0 <= j + shift < len(d) and d[j + shift] == b[j] for j in range(len(b))]
        found = max([found, *(sum(same[k:k + length]) for k in range(len(b) - length + 1))])
    return found >= needed


def test_decontamination_equals_all_alignments(spark, documents):
    items = [(i, prose(700 + i, 12 + 6 * i)) for i in range(6)] + [(7, None), (8, "two words"), (9, prose(800, 9)), (0, prose(700, 12))]
    rows = [(i, prose(i, 50)) for i in range(3)]
    for n, (_, t) in enumerate(items[:7]):
        for share in (0, 1, 2):
            rows.append((100 + 10 * n + share, f"{prose(n, 20)} {edited(t or 'x', n + share, 0.08 * share)} {prose(n + 9, 9)}"))
    rows += [(200, items[8][1].upper()), (201, items[3][1]), (202, None), (203, ""), (204, " ".join(items[4][1].split()[5:18])), (201, items[3][1])]
    benchmark = spark.createDataFrame(items, ITEMS)
    pairs = decontamination.overlaps(identified(documents(rows).withColumn("item_id", F.lit(1))), identified(benchmark, "item_id"))
    found = sorted((r["_id"], r["item_id"]) for r in pairs.collect())
    assert found == sorted({(i, j) for i, t in rows for j, b in items if _shared(t, b)}) and len(found) > 15
    assert decontamination.overlaps(identified(documents([])), identified(benchmark, "item_id")).count() == 0
    assert decontamination.overlaps(identified(documents(rows)), identified(benchmark.limit(0), "item_id")).count() == 0


def test_short_items_are_found(spark, documents):
    items = [(n, " ".join(f"q{n}{k}" for k in range(n))) for n in range(1, 15)] + [(20, ""), (21, None), (22, "q30 q31 q32")]
    rows = [(100 + n, f"{prose(n, 9)} {t.upper()} {prose(n + 1, 9)} {t}") for n, t in items[:14]] + [(n, t) for n, t in items[:14]]
    for n, t in items[:14]:
        for k in range(n):
            one = [*t.split()[:k], "x", *t.split()[k + 1:]]
            rows.append((1000 * n + k, f"{prose(n, 4)} {' '.join(one)} y"))
            rows.append((1000 * n + 100 + k, f"{prose(n, 4)} {' '.join([*one[:(k + 3) % n], 'z', *one[(k + 3) % n + 1:]])} y"))
        rows += [(1000 * n + 200, " ".join(t.split()[1:])), (1000 * n + 201, " ".join(t.split()[:-1]))]
    rows += [(1, None), (2, "")]

    def shares(text, item):
        d, b = (text or "").lower().split(), (item or "").lower().split()
        if not b or len(b) > 12:
            return _shared(text, item)
        needed = len(b) - (1 if len(b) >= 8 else 0)
        return any(sum(0 <= j + s < len(d) and d[j + s] == w for j, w in enumerate(b)) >= needed for s in range(-len(b), len(d)))

    benchmark = identified(spark.createDataFrame(items, ITEMS), "item_id")
    found = decontamination.overlaps(identified(documents(rows)), benchmark, short=True).collect()
    expected = {(i, j) for i, t in rows for j, b in items if shares(t, b)}
    assert sorted((r["_id"], r["item_id"]) for r in found) == sorted(expected) and {j for _, j in expected} == {*range(1, 15), 22}


def test_seeds_are_made_by_several_tasks(spark, documents, monkeypatch):
    parts, stage = {}, decontamination.stage

    def noted(df, name):
        parts[name] = df.rdd.getNumPartitions()
        return stage(df, name)

    monkeypatch.setattr(decontamination, "stage", noted)
    items = spark.createDataFrame([(i, prose(i, 20)) for i in range(400)], ITEMS).repartition(4)
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        decontamination.overlaps(identified(documents([(1, prose(1, 30))])), identified(items, "item_id"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts["seeds"] > 1


def test_masks_leave_no_passage_out():
    for a in range(13):
        for b in range(a):
            assert any(
                not {a, b} & {start + i for i in mask} for mask in decontamination.MASKS for start in range(13 - mask[-1])
            )


LANGUAGES = {"aa": "the cat sat on the mat and ran to the old barn with a hen ", "bb": "el perro come en la casa y corre por el campo verde ",
             "cc": "der hund geht nach haus und läuft über die große wiese "}


def _language_rows():
    rng = np.random.default_rng(0)
    rows, langs = [], {}
    for i in range(60):
        lang = sorted(LANGUAGES)[i % 3]
        rows.append((i, " ".join(rng.permutation(LANGUAGES[lang].split() * 6).tolist())))
        langs[i] = lang
    rows += [(60, None), (61, "123 !!"), (62, ""), (63, "a"), (64, "漢字 かな"), (65, "The CAT sat, on THE mat. " * 300), (None, "der hund")]
    return rows, langs | {60: None, 61: None, 62: None, 63: None, 64: None, 65: None, None: None}


def test_phrases_equal_naive_cross_parsing(documents):
    rows, langs = _language_rows()
    texts = language_id.sample(documents(rows, langs))
    assert sorted(texts) == sorted(LANGUAGES)
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i, t in rows for x in texts.values() if t in x and t)
    model = language_id.Model(texts)
    values = [t or "" for _, t in rows]
    counts, lengths = model.phrases(values)
    codes, begins = model.codes(values)
    for k, lang in enumerate(model.languages):
        known = model.codes(texts[lang])[0][:language_id.SAMPLE_LETTERS].tobytes()
        for i in range(len(values)):
            whole, phrases = codes[begins[i]:begins[i + 1]].tobytes(), 0
            for at in range(0, len(whole), language_id.BLOCK):
                block, place = whole[at:at + language_id.BLOCK], 0
                while place < len(block):
                    n = 1
                    while place + n < len(block) and block[place:place + n + 1] in known:
                        n += 1
                    place, phrases = place + n, phrases + 1
            assert counts[k][i] == phrases


def test_languages_of_held_out_and_odd_texts(documents):
    rows, langs = _language_rows()
    docs = documents(rows, langs)
    found = {r["_id"]: r for r in language_id.predict(identified(docs), language_id.sample(docs)).collect()}
    assert all(found[i]["lang_pred"] == langs[i] for i in range(60))
    assert [found[i]["lang_pred"] for i in (60, 61, 62)] == ["und"] * 3 and found[65]["lang_pred"] == "aa"
    assert found[None]["lang_pred"] == "cc" and found[64]["lang_pred"] in LANGUAGES
    assert all(0 <= r["score"] <= 1 for r in found.values())
    none = language_id.predict(identified(docs), {}).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    assert language_id.predict(identified(documents([])), {"aa": ["the"]}).count() == 0


def test_samples_are_spread_over_all_texts(documents):
    names = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(40)]
    rows = [(i, f"{names[i]}zz " * 9_000) for i in range(40)] + [(100 + i, "ωρα καλη " * 3_000 + "1 " * 60_000) for i in range(8)] + [(200, "12 " * 99), (201, "12")]
    langs = {i: "xx" for i, _ in rows} | {100 + i: "el" for i in range(8)} | {200: "no", 201: "no"}
    docs = documents(rows + [(300, "ωρα"), (301, "abzz adzz")], langs | {300: None, 301: None})
    texts = language_id.sample(docs)
    assert sorted(texts) == ["el", "xx"] and all(0 < sum(map(len, t)) <= language_id.SAMPLE_LETTERS for t in texts.values())
    used = [n for i, n in enumerate(names) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert all(any(f"{n}zz" in x for x in texts["xx"]) for n in used) and sum(map(len, texts["xx"])) > 0.9 * language_id.SAMPLE_LETTERS
    found = {r["_id"]: r["lang_pred"] for r in language_id.predict(identified(docs), texts).collect()}
    assert found[300] == "el" and found[301] == "xx"
    less = language_id.sample(docs, letters=1_000, rows=5)
    assert all(0 < sum(map(len, t)) <= 1_000 for t in less.values())


def test_language_model_scores(documents):
    rows = mixed_texts() + [(None, "one two"), (500, "one")] + [(600 + i, prose(i, 80)) for i in range(20)]
    tokens = [[*words(t, lower=True), None] for _, t in rows]
    learned = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    counts = collections.Counter(x for w, use in zip(tokens, learned) if use for x in w)
    total, distinct = sum(counts.values()), len(counts)
    found = {r["_id"]: r for r in lm_scoring.score(identified(documents(rows).withColumn("c", F.lit(1)))).collect()}
    for (i, _), w, use in zip(rows, tokens, learned):
        r = found[i]
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not use, len(w), sum(counts[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert lm_scoring.score(identified(documents([]))).count() == 0
    twice = lm_scoring.score(identified(documents([(2, "a b"), (2, "a b")]))).collect()
    assert [r["n_tokens"] for r in twice] == [3, 3]


def test_class_probabilities_sum_to_one_and_training_helps(spark):
    contexts = np.arange(0, lm_scoring.CLASSES ** 3, 97)
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(lm_scoring.FEATURE_ROWS, lm_scoring.CLASSES))
    assert np.allclose(np.exp(lm_scoring._log_probabilities(weights, contexts)).sum(axis=1), 1)
    follow = [(int(c) * lm_scoring.CLASSES + int(c) % 7, 50) for c in contexts] + [(5, 3)]
    runs = spark.createDataFrame(follow, "key bigint, n bigint")
    totals = np.bincount([k % lm_scoring.CLASSES for k, _ in follow], [n for _, n in follow], lm_scoring.CLASSES)
    first, last = (lm_scoring.train(runs, totals, updates=n) for n in (0, 8))
    gain = [sum(n * lm_scoring._log_probabilities(w, np.array([k // lm_scoring.CLASSES]))[0, k % lm_scoring.CLASSES] for k, n in follow)
            for w in (first, last)]
    assert gain[1] > gain[0]


def test_expected_sums_are_those_of_a_plain_softmax():
    rng = np.random.default_rng(2)
    names = np.sort(lm_scoring.mixed(np.arange(1, 3_000, dtype=np.uint64)))
    vocabulary = lm_scoring._Vocabulary(names, rng.integers(1, 60, len(names)), 70_000)
    tokens = lm_scoring.mixed((rng.zipf(1.3, 20_000) % 4_000).astype(np.uint64))
    classes, code, place, common = vocabulary.find(tokens)
    assert (common == np.isin(tokens, names)).all() and (names[place[common]] == tokens[common]).all()
    assert not lm_scoring._Vocabulary(names[:0], np.zeros(0, np.int64), 0).find(tokens)[3].any()
    per_leaf = np.zeros(lm_scoring.CLASSES * lm_scoring._LEAVES)
    np.add.at(per_leaf, classes * lm_scoring._LEAVES + code, 1)
    model = lm_scoring._Model(vocabulary, vocabulary.masses(per_leaf), rng.normal(size=(lm_scoring.FEATURE_ROWS, lm_scoring.CLASSES)))
    for wide in (1, 30):  # the products of the latter do not fit 32 bits
        model.weights = [(rng.normal(size=w.shape) * wide).astype(np.float32) for w in model.weights]
        keys = [lm_scoring.mixed(tokens + np.uint64(k)) for k in range(5)]
        start, target = rng.integers(0, lm_scoring.CLASSES ** 3, len(tokens)), rng.integers(0, lm_scoring.CLASSES, len(tokens))
        sums, model.fitted = [np.zeros((1, *w.shape), np.float32) for w in model.weights], True  # expected alone
        with np.errstate(all="ignore"):
            found = model._softmax(model.bases[0], start, 0, np.exp(model.weights[0]), keys, target, sums)
        rows = [(lm_scoring.mixed(key) % np.uint64(len(model.weights[0]))).astype(np.int64) for key in keys]
        scores = np.log(np.maximum(model.bases[0][start], 1e-26)) + sum(model.weights[0][row].astype(float) for row in rows)
        scores -= scores.max(axis=1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        expected = np.zeros(model.weights[0].shape)
        for row in rows:
            np.add.at(expected, row, np.exp(scores))
        assert np.allclose(found, scores[np.arange(len(target)), target], atol=1e-3) and np.allclose(sums[0][0], expected, rtol=1e-3, atol=1e-3)


def test_features_see_words_and_probabilities_sum_to_one(spark, documents):
    rng = np.random.default_rng(1)
    names = np.sort(lm_scoring.mixed(np.arange(1, 400, dtype=np.uint64)))
    vocabulary = lm_scoring._Vocabulary(names, rng.integers(1, 60, len(names)), 900)
    per_leaf = np.zeros(lm_scoring.CLASSES * lm_scoring._LEAVES)
    classes, code, _, _ = vocabulary.find(names)
    np.add.at(per_leaf, classes * lm_scoring._LEAVES + code, vocabulary.counts + 1)
    model = lm_scoring._Model(vocabulary, vocabulary.masses(per_leaf), rng.normal(size=(lm_scoring.FEATURE_ROWS, lm_scoring.CLASSES)))
    model.weights = [rng.normal(size=w.shape).astype(np.float32) for w in model.weights]
    leaves = np.flatnonzero(model.mass.ravel())
    n = len(leaves)  # each leaf after the same three words
    tokens = np.concatenate([np.tile(names[:3, None], n), np.zeros((1, n), np.uint64)]).T.ravel()
    texts = np.repeat(np.arange(n), 4)
    c, k, _, _ = vocabulary.find(tokens)
    c[3::4], k[3::4] = leaves // lm_scoring._LEAVES, leaves % lm_scoring._LEAVES
    assert np.exp(model.log_probabilities(tokens, texts, c, k)[3::4]).sum() == pytest.approx(1, abs=1e-4)

    # words with one and the same last letters: only the words themselves tell which one follows
    pairs = [(f"{a}xx", f"{b}xx") for a, b in zip("abcdefgh", "pqrstuvw")]
    rows = [(i, " ".join(" ".join(pairs[(i * 7 + k * k) % 8]) for k in range(30))) for i in range(200)]
    outside = [i for i in range(1_000, 1_500) if zlib.crc32(str(i).encode()) % 7 == 2]
    mixed_up = [(outside[n], " ".join(pairs[k][0] + " " + pairs[(k + s) % 8][1] for k in range(8))) for n, s in enumerate((0, 3))]
    found = {r["_id"]: r for r in lm_scoring.score(identified(documents([*rows, *mixed_up]))).collect()}
    like, unlike = (found[i] for i, _ in mixed_up)
    assert like["held_out"] and like["base_score"] == pytest.approx(unlike["base_score"]) and like["score"] > unlike["score"] + 2
