"""The pipeline against a plain version of its stages."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from plain import base_spans, classes, rejected, simhash, words

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def hidden(text):
    out, at, end = [], 0, -1
    for a, _, b in base_spans(text):
        if a > end:
            out.append(text[at:a])
        end = max(end, b)
        at = end
    return "[REDACTED]".join([*out, text[at:]])


def test_run_equals_the_plain_stages(spark, documents):
    rows = [r for r in documents.collect() if not rejected(r["text"])]
    groups = classes([simhash(r["text"]) for r in rows])
    rows = [min((rows[i] for i in g), key=lambda r: r["doc_id"]) for g in groups]
    texts = {r["doc_id"]: hidden(r["text"]) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}

    got = corpus_pipeline.run(spark, SF).collect()
    times = Counter(r["doc_id"] for r in got)
    assert set(times) <= set(texts)
    assert all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["restored"] for r in got)
    assert all(r["n_pieces"] == len(r["ids"]) for r in got)

    sizes = {i: len(words(t)) for i, t in texts.items()}
    by_source = Counter()
    taken = Counter()
    for i in texts:
        by_source[source[i]] += sizes[i]
        taken[source[i]] += sizes[i] * times[i]
    from test_llm_mixing import plain_targets

    for s, target in plain_targets(by_source).items():
        largest = max(sizes[i] for i in texts if source[i] == s)
        assert abs(taken[s] - target) <= 2 * largest
    assert max(times.values()) <= 2


def test_stages_return_the_columns_of_documents(spark, documents):
    docs = documents.limit(40).unionByName(documents.limit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns, name
    assert len(corpus_pipeline.STAGES) == 5


def test_odd_tables(spark, docs):
    odd = docs([None, "", "x", " ".join(f"w{i}" for i in range(90)), None], ids=[None, 2, 2, 3, None])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), SF).count() == 0, name
        stage(spark, odd, SF).count()
