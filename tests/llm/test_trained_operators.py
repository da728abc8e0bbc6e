"""Trained operators: held-out accuracy, exact parts against plain versions, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import words

from twinlens.llm import licences, pitman_yor, quality_knn, toxicity
from twinlens.llm.features import labelled_sample

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    found = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    return np.array(found)


def test_quality_votes(corpus):
    docs, labels = corpus
    found = held_out(quality_knn.score(docs, labels).collect(), labels, "quality")
    assert (found[:, 0] == found[:, 1]).mean() > 0.93
    good = found[found[:, 1] == 1]
    assert good[:, 0].mean() > 0.98


def test_votes_are_the_exact_nearest(corpus):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(50, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = quality_knn.LatentModel(None, None, vectors, (np.arange(50) % 3 == 0).astype(float), np.ones(50))
    asked = vectors[:7]
    for v, got in zip(asked, quality_knn.vote(asked, model), strict=True):
        near = vectors @ v
        best = np.argsort(-near)[: quality_knn.NEIGHBOURS]
        weight = np.maximum(near[best], 1e-6) ** quality_knn.SHARPNESS
        assert got == pytest.approx((weight * model.labels[best]).sum() / weight.sum(), rel=1e-5)


def test_a_bound_on_the_labels_keeps_the_scores(spark, corpus, monkeypatch):
    alike = spark.range(300).selectExpr("id AS doc_id", "'one text for all of them' AS text")
    labels = alike.selectExpr("doc_id", "int(doc_id % 7 > 0) AS quality")
    monkeypatch.setattr(quality_knn, "LABELLED_PER_CLASS", 10)
    known = [r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    scores = {r.score for r in quality_knn.score(alike, labels).collect()}
    assert min(scores) == pytest.approx(sum(known) / len(known)) and max(scores) == pytest.approx(min(scores))
    docs, labels = corpus
    monkeypatch.setattr(quality_knn, "LABELLED_PER_CLASS", 2000)
    whole = {r.doc_id: r.score for r in quality_knn.score(docs, labels).collect()}
    monkeypatch.setattr(quality_knn, "LABELLED_PER_CLASS", 47)
    cut = {r.doc_id: r.score for r in quality_knn.score(docs, labels).collect()}
    assert np.mean(list(cut.values())) == pytest.approx(np.mean(list(whole.values())), abs=0.05)
    assert np.mean([(cut[i] >= 0.3) == (whole[i] >= 0.3) for i in whole]) > 0.97


def test_quality_without_labels_and_odd_rows(corpus, odd_docs, no_docs):
    _, labels = corpus
    assert {r.score for r in quality_knn.score(odd_docs, labels.where("false")).collect()} == {0.5}
    assert quality_knn.score(odd_docs, labels).count() == odd_docs.count()
    assert quality_knn.score(no_docs, labels).count() == 0
    kept = quality_knn.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns


def test_toxicity(corpus):
    docs, labels = corpus
    found = held_out(toxicity.score(docs, labels).collect(), labels, "toxic")
    assert (found[:, 0] == found[:, 1]).mean() > 0.9


def test_toxicity_odd_rows(corpus, odd_docs, no_docs):
    _, labels = corpus
    one = labels.where("toxic = 0")
    assert {(r.score, r.predicted) for r in toxicity.score(odd_docs, one).collect()} <= {(0.0, 0), (0.5, 1)}
    assert toxicity.score(no_docs, labels).count() == 0


def test_obfuscation_and_pronouns_are_features():
    import pyarrow as pa

    known = [toxicity._hash_text(("stupid",)), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    rows = toxicity.dense_features(pa.array(["you are so stupid!!", "st0p1d th1ng", "A stupid thing, far away from any of them you", "", None]), known)
    at = {n: k for k, n in enumerate(toxicity.FEATURES)}
    assert rows[0, at["words"]] == 0.25 and rows[0, at["near_you"]] == 0.25 and rows[0, at["shouts"]] > 0
    assert rows[1, at["obfuscated"]] == 1 and rows[1, at["words"]] == 0
    assert rows[2, at["words"]] > 0 and rows[2, at["near_you"]] == 0 and rows[2, at["capitals"]] > 0
    assert not rows[3:].any()


def test_sample_leaves_out_held_out_rows(corpus):
    docs, labels = corpus
    rows = labelled_sample(docs, labels, "toxic", 20).collect()
    assert max(Counter(r.y for r in rows).values()) <= 20
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_language_model(corpus, odd_docs):
    docs = corpus[0].select("doc_id", "text").union(odd_docs.selectExpr("doc_id + 5000", "text"))
    texts = {r.doc_id: words(r.text) + ["\n"] for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    repeated = Counter(r.doc_id for r in docs.select("doc_id").collect())
    c = Counter()
    for d, w in texts.items():
        if not held[d]:
            for x in w:
                c[x] += repeated[d]
    total = sum(c.values())
    rows = pitman_yor.score(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        w = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in c for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in w), rel=1e-9)
        assert r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_predictive_probabilities_sum_to_one(spark):
    """Over all words and the unknown one, in every context of a tiny corpus."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("a b c d e f g".split()) for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    types, totals = pitman_yor.train(docs.select("text"), 1)
    row = types.first().asDict()
    word, context, count = pitman_yor._row_arrays(row)
    known = (word, context, count, *pitman_yor._predictive(row["bucket"], word, context, count, totals))
    names = np.unique(word)
    assert totals.words == len(names) == 8 and totals.tokens == 60 * 31
    for one in np.unique(context):
        asked = np.append(names, np.uint64(12345))
        chance = 10 ** pitman_yor.lookup(asked, np.full(len(asked), one), known, totals)[1]
        assert chance.sum() == pytest.approx(1.0, abs=1e-9)


def test_words_before_are_contexts(spark):
    """The word before, and the one before that, decide; both pairs end in the same letters and words."""
    kept = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2]
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    lines = ["red cat sleeps", "big cat runs", "xxab north", "yyab south"]
    rows = [(i, lines[n % 4]) for n, i in enumerate(kept)]
    rows += list(zip(out, ["red cat sleeps", "red cat runs", "xxab north", "xxab south"], strict=True))
    score = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert score[out[0]] > score[out[1]] + 1 and score[out[2]] > score[out[3]] + 1


def test_spread_words_before(spark):
    """Words before that are spread over buckets: probabilities sum to 1 there, scores are near those of one bucket."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("a a a b c d e f g".split()) for _ in range(30))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    types, totals = pitman_yor.train(docs.select("text"), 3)
    assert len(totals.spread) >= 1 and totals.words == 8 and totals.tokens == 120 * 31
    whole = 0
    for row in types.collect():
        word, context, held = pitman_yor._row_arrays(row.asDict())
        known = (word, context, held, *pitman_yor._predictive(row.bucket, word, context, held, totals))
        if len(held.words) < 8:
            continue
        full = np.flatnonzero(np.bincount(held.pair_v) == 8)  # a bucket asks the root for its own pairs alone
        for one in np.unique(context[np.isin(held.v, full)]):
            asked = np.append(held.words, np.uint64(12345))
            chance = 10 ** pitman_yor.lookup(asked, np.full(len(asked), one), known, totals)[1]
            assert chance.sum() == pytest.approx(1.0, abs=1e-9)
            whole += 1
    assert whole
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({r.doc_id: r.score for r in pitman_yor.score(docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys()
    assert all(found[1][i] == pytest.approx(x, rel=0.05) for i, x in found[0].items())


def test_language_model_without_training_rows(spark, no_docs):
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = pitman_yor.score(spark.createDataFrame([(i, "x y") for i in only_held], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(3, 0, 0, 0.0)] * 3
    assert all(r.score == pytest.approx(0.0, abs=1e-9) for r in rows)
    assert pitman_yor.score(no_docs).count() == 0


def test_seating_counts():
    rng = np.random.default_rng(0)
    customers = np.array([0, 1, 2, 50, 5000])
    made = pitman_yor.seat(customers, np.full(5, 0.5), 5.0, np.full(5, 100.0), np.full(5, 0.01), rng)
    assert made[0] == 0 and made[1] == 1 and 1 <= made[2] <= 2 and (made <= customers).all()
    assert made[4] > made[3] >= 1


def test_licences(corpus, odd_docs, no_docs):
    rows = {r.doc_id: r for r in licences.scan(corpus[0]).collect()}
    planted = {f: t[0] for f, t in licences.TEMPLATES.items()}
    for r in corpus[0].select("doc_id", "text").collect():
        for family, notice in planted.items():
            if notice in r.text:
                assert family in rows[r.doc_id].families.split(",")
    clean = [r for r in rows.values() if r.families and not any(f in r.families for f in ("apache", "mit", "gpl", "cc-by-nc"))]
    assert not clean
    found = licences.scan(odd_docs).collect()
    assert len(found) == odd_docs.count() and not any(r.families for r in found)
    assert licences.scan(no_docs).count() == 0


def test_licences_in_their_standard_wording(spark, corpus):
    """Headers and body paragraphs, wrapped over lines, behind comment marks, amid other text."""
    gnu = (
        "{0} is free software: you can redistribute it and/or modify\nit under the terms of the GNU {1} as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
    )
    notices = {
        "gpl": gnu.format("This program", "General Public License"),
        "agpl": gnu.format("This program", "Affero General Public License"),
        "lgpl": gnu.format("Foo", "Lesser General Public License"),
        "mit": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "bsd": "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n",
        "apache": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance\n'
        "# with the License. You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n",
        "mpl": " * This Source Code Form is subject to the\n * terms of the Mozilla Public\n * License, v. 2.0.",
        "isc": "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided "
        "that the above\ncopyright notice and this permission notice appear in all copies.",
        "unlicense": "This is free and unencumbered software\nreleased into the public domain.",
        "cc-by-sa": "This work is licensed under a Creative\nCommons Attribution-ShareAlike 4.0\nInternational License.",
    }
    other = " ".join(f"word{i % 17} of text{i % 5}" for i in range(100))
    rows = [(10**6 + i, text) for i, text in enumerate(notices.values())]
    rows += [(2 * 10**6 + i, f"{other}\n{text}\n{other}") for i, text in enumerate(notices.values())]
    rows += [(3 * 10**6 + i, f"{other} {' '.join(text.split())} {other}") for i, text in enumerate(notices.values())]
    docs = corpus[0].select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r.families for r in licences.scan(docs).collect()}
    missed = [(i // 10**6, f) for i, f in ((i, list(notices)[i % 10**6]) for i, _ in rows) if found[i] != f]
    assert not missed
