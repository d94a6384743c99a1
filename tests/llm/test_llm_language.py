"""Languages of texts and spans: held-out accuracy, and the path against trying all labels."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairflow.llm import language
from pairflow.llm import queries as llm

SYLLABLES = {
    "aa": ["ka", "to", "mi", "ru", "se", "no"],
    "bb": ["str", "ung", "ach", "ein", "heit", "ver"],
    "cc": ["да", "не", "ро", "ст", "ов", "ли"],
}


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, words(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choices(sorted(SYLLABLES), k=240))]


def labelled(spark, rows, held=lambda c: c % 4 == 2, **settings):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return {r["doc_id"]: r for r in language.label_texts(df, "doc_id", "text", "lang", held(F.col("doc_id")), **settings).collect()}


def test_held_out_texts_and_mixed_spans(spark, corpus):
    rng = random.Random(6)
    first, second, third = words(rng, "aa", 30), words(rng, "bb", 30), words(rng, "cc", 25)
    mixed = f"{first}. {second}! {third}"
    rows = [*corpus, (1002, mixed, None)]
    got = labelled(spark, rows)
    held = [(i, lang) for i, _, lang in corpus if i % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.99 * len(held)
    r = got[1002]
    spans = [(s["lang"], s["start"], s["end"]) for s in r["spans"]]
    a, b = len(first), len(first) + 2 + len(second)
    assert spans == [("aa", 0, a), ("bb", a + 2, b), ("cc", b + 2, len(mixed))]
    by_lang = {lang: sum(c.isalpha() for c in mixed[s:e]) for lang, s, e in spans}
    assert r["lang_pred"] == max(by_lang, key=by_lang.get)
    assert r["score"] == pytest.approx(max(by_lang.values()) / sum(by_lang.values()))


def test_labels_of_held_out_rows_are_not_used(spark, corpus):
    wrong = [(i, t, "zz" if i % 4 == 2 else lang) for i, t, lang in corpus]
    a, b = labelled(spark, corpus), labelled(spark, wrong)
    assert all(a[i]["lang_pred"] == b[i]["lang_pred"] and a[i]["score"] == b[i]["score"] for i, _, _ in corpus)


def test_edge_rows(spark, corpus):
    rng = random.Random(7)
    long = words(rng, "bb", 60_000)
    odd = [
        (2002, None, "aa"), (2003, "", "bb"), (2006, "12 34 -- \n\t", None), (2007, "x", None), (2010, long, None),
        (2011, "ñ" * 30_000, None), (2014, "日本語 テキスト", None), (2015, "\U0001d4d0\x00é", None),
    ]
    got = labelled(spark, [*corpus, *odd])
    for i in (2002, 2003, 2006):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["spans"], got[i]["n_words"]) == ("und", 0.0, [], 0)
    assert got[2010]["lang_pred"] == "bb" and got[2010]["n_words"] == 60_000 and got[2010]["score"] == 1.0
    for i in (2007, 2011, 2014, 2015):
        assert got[i]["lang_pred"] in SYLLABLES and 0 < got[i]["score"] <= 1


def test_scripts_narrow_the_languages(spark, corpus):
    """A word of a script that one language alone writes is that language's, whatever stands around it."""
    rng = random.Random(8)
    text = f"{words(rng, 'aa', 40)} дв {words(rng, 'aa', 40)}"
    got = labelled(spark, [*corpus, (3002, text, None)])[3002]
    assert [s["lang"] for s in got["spans"]] == ["aa", "cc", "aa"]


def test_empty_unlabelled_repeated_and_clashing(spark, corpus):
    assert labelled(spark, []) == {}
    none = labelled(spark, [(1, "some text", None), (2, "held", "aa")])
    assert {i: (r["lang_pred"], r["score"]) for i, r in none.items()} == {1: ("und", 0.0), 2: ("und", 0.0)}
    rows = [(None, t, lang, "x", 1) for _, t, lang in corpus[:40]] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, spans string, lang string, score string, `key` int")
    got = language.label_texts(df, "doc_id", "spans", "lang", F.lit(None).cast("boolean")).collect()
    assert len(got) == 80 and {r["doc_id"] for r in got} == {None} and not any(r["held_out"] for r in got)
    assert len({(r["lang_pred"], r["score"], r["n_words"]) for r in got}) <= 40


def test_path_equals_trying_all(corpus):
    rng = np.random.default_rng(2)
    sizes = np.array([6, 0, 1, 5, 3])
    scores = np.round(rng.standard_normal((sizes.sum(), 3)) * 2, 3).astype(np.float32)
    got, at = language.paths(scores, sizes, penalty=1.5), 0
    for n in sizes:
        own = scores[at : at + n].astype(np.float64)
        value = lambda p: sum(own[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(map(value, product(range(3), repeat=int(n))), default=0)
        assert value(got[at : at + n].tolist()) == pytest.approx(best, abs=1e-4)
        at += n


def test_slices_do_not_change_scores(monkeypatch, corpus):
    model = language.Model(["a", "b"], np.random.default_rng(0).standard_normal((language.BUCKETS, 2)).astype(np.float32), np.ones((len(language.NAMES) + 1, 2), bool))
    some = language.Words.of([t for _, t, _ in corpus[:20]] + ["", "!"])
    whole = model.scores(some)
    monkeypatch.setattr(language, "SLICE", 60)
    np.testing.assert_allclose(model.scores(some), whole, rtol=1e-5)
    alone = np.concatenate([model.scores(language.Words.of([t])) for _, t, _ in corpus[:20]])
    np.testing.assert_allclose(alone, whole, rtol=1e-5)


def test_the_query_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    got = llm.QUERIES["op12_languages"](spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert got.count() == docs.count()
    held = got.where("held_out").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    assert got.where("score < 0 or score > 1 or lang_pred is null").count() == 0
