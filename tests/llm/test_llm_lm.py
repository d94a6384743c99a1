from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairflow.llm import lm

SF = "/root/testdata/sf0.001"


def plain_likelihood(model, symbols):
    """Sum over all state paths."""
    total = 0.0
    for path in product(range(len(model.first)), repeat=len(symbols)):
        p = model.first[path[0]] * model.emit[symbols[0], path[0]]
        for a, b, s in zip(path, path[1:], symbols[1:]):
            p *= model.step[a, b] * model.emit[s, b]
        total += p
    return math.log10(total)


def small_model(states=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)
    shares = rng.random(symbols)
    return lm.Model.initial(shares / shares.sum(), states, seed)


def test_forward_is_the_sum_over_all_paths():
    model = small_model()
    sequences = [np.array(s, np.uint16) for s in ([0], [1, 2, 3], [4, 4, 0, 1, 2, 2], [3], [2, 0])]
    got = lm.log10_likelihoods(model, sequences)
    assert got == pytest.approx([plain_likelihood(model, s) for s in sequences])


def test_counts_are_the_expected_ones_and_rounds_raise_the_likelihood():
    rng = np.random.default_rng(3)
    model = small_model()
    sequences = [rng.integers(0, 5, rng.integers(1, 7)).astype(np.uint16) for _ in range(6)]
    want = lm.Counts.zero(5, 3)
    for s in sequences:
        paths = []
        for path in product(range(3), repeat=len(s)):
            p = model.first[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.step[a, b] * model.emit[x, b]
            paths.append((path, p))
        total = sum(p for _, p in paths)
        for path, p in paths:
            want.first[path[0]] += p / total
            for k, x in zip(path, s):
                want.emit[x, k] += p / total
            for a, b in zip(path, path[1:]):
                want.step[a, b] += p / total
    for length in (1, 2, 3, 100):  # whole texts, however they are cut for the work
        counts = lm.Counts.zero(5, 3)
        counts.add(model, sequences, length)
        for name in ("first", "step", "emit"):
            assert getattr(counts, name) == pytest.approx(getattr(want, name), abs=1e-4)
    assert lm.segments(np.arange(5), 2)[2].tolist() == [4]


def test_classes_and_words_share_all_probability(spark):
    """Over all words of a tiny vocabulary and one unknown per class, the parts sum to one."""
    shares = (np.array([3.0, 5.0, 2.0]) + 0.5) / 11.5
    model = lm.improved(lm.Counts.zero(3, 2), shares)
    assert model.emit.sum(0) == pytest.approx([1, 1]) and model.step.sum(1) == pytest.approx([1, 1])


def rows_of(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


def test_query_base_columns_and_held_out_gain(spark, documents):
    rows = rows_of(documents)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.op9_lm_scores(spark, SF).collect()}
    assert set(got) == set(held)
    base = full = 0.0
    for i, r in got.items():
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
        base, full = base + held[i] * r["base_score"], full + held[i] * r["score"]
    assert full > base


def test_odd_rows(spark, docs):
    texts = [None, "", "A b a", "a b a", " \n", "x " * 70_000, "a b a"]
    frame = docs(texts, ids=[1, 2, 3, 4, None, 6, 3]).withColumns({"score": F.lit("mine"), "block": F.lit(1)})
    got = lm.score_texts(frame, "doc_id", "text", F.col("doc_id") == 4, states=2, classes=16, rounds=2).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "3", "4", "6", "None"]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_tokens"], round(r["base_score"], 9), round(r["score"], 9)))
    assert by[3][0] == by[3][1] == by[4][0] and by[1] == by[2] == by[None] and by[6][0][0] == 70_001
    assert all(math.isfinite(r["score"]) for r in got)
    only = lm.score_texts(frame, "doc_id", "text", F.lit(True), states=2, classes=16, rounds=1).collect()
    assert {r["train_tokens"] for r in only} == {0} and {r["n_known"] for r in only} == {0}
    assert lm.score_texts(frame.where("false"), "doc_id", "text", F.lit(False), rounds=1).count() == 0


def test_frequent_words_are_emitted_by_themselves_however_blocks_are_cut(spark, docs):
    """All words share one class: what tells the two subjects apart is the words themselves."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 20, 30)) + f" rare{i}" for i in range(120)]
    frame = docs(texts)
    got = [
        {r["doc_id"]: r for r in lm.score_texts(frame.repartition(n), "doc_id", "text", F.col("doc_id") % 5 == 0, states=4, classes=1, rounds=6).collect()}
        for n in (1, 5)
    ]
    for i, r in got[0].items():
        assert got[1][i]["score"] == pytest.approx(r["score"], abs=1e-3) and got[1][i]["base_score"] == pytest.approx(r["base_score"])
    held = [r for r in got[0].values() if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in held) > 0.1 * sum(r["n_tokens"] for r in held)


def test_one_very_long_text_among_short_ones_takes_bounded_memory():
    rng = np.random.default_rng(4)
    model = small_model(4, 50)
    texts = [rng.integers(0, 50, k).astype(np.int32) for k in [500_000, *rng.integers(1, 300, 5_000)]]
    tracemalloc.start()
    got = lm.log10_likelihoods(model, texts)
    counts = lm.Counts.zero(50, 4)
    counts.add(model, texts)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert got[7] == pytest.approx(lm.log10_likelihoods(model, [texts[7]])[0])
    assert counts.emit.sum() == pytest.approx(sum(map(len, texts)), rel=1e-5)
    assert counts.step.sum() == pytest.approx(sum(map(len, texts)) - len(texts), rel=1e-5)
    assert counts.first.sum() == pytest.approx(len(texts), rel=1e-5)


def test_query_is_the_plain_model_on_whole_texts(spark, docs):
    """Words of their own only: initial numbers, rounds and scores worked out text by text, without parts or blocks."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 12, rng.integers(3, 40))) for _ in range(40)]
    frame = docs(texts)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(frame, "doc_id", "text", F.lit(False), states=3, classes=2, rounds=3, often=1).collect()}
    c = Counter(w for t in texts for w in t.split())
    words = sorted(c)
    n, n_own = sum(c.values()) + len(texts), len(words)
    total = n + 0.5 * (3 + n_own)
    shares = (np.array([0.0, 0.0, len(texts)]) + 0.5) / total
    digest = np.array([zlib.crc32(w.encode()) | zlib.crc32(w.encode(), lm.SEED) << 32 for w in words], np.uint64)
    own_shares = np.array([(c[w] + 0.5) / total for w in words])
    gamma = np.random.default_rng(lm.SEED).gamma(0.5, 2.0, (3, 3))
    emit = np.concatenate([shares[:, None] * (gamma + 1e-3), own_shares[:, None] * (lm.chance(digest, 3) + 1e-3)])
    first, step = np.full(3, 1 / 3), (np.full((3, 3), 0.025) + np.eye(3) * 0.95) / 1.025
    emit /= emit.sum(0)
    number = {w: 3 + i for i, w in enumerate(words)}
    symbols = {r["doc_id"]: [*(number[w] for w in r["text"].split()), 2] for r in frame.collect()}

    def walk(x):
        a, b = np.zeros((len(x), 3)), np.ones((len(x), 3))
        a[0] = first * emit[x[0]]
        for t in range(1, len(x)):
            a[t] = a[t - 1] @ step * emit[x[t]]
        for t in range(len(x) - 2, -1, -1):
            b[t] = step @ (emit[x[t + 1]] * b[t + 1])
        return a, b, a[-1].sum()

    for _ in range(3):
        f, s, e = np.ones(3), np.ones((3, 3)), lm.PRIOR * (3 + n_own) * np.concatenate([shares, own_shares])[:, None] * np.ones(3)
        for x in symbols.values():
            a, b, p = walk(x)
            f += a[0] * b[0] / p
            np.add.at(e, x, a * b / p)
            for t in range(len(x) - 1):
                s += a[t][:, None] * step * (emit[x[t + 1]] * b[t + 1]) / p
        first, step, emit = f / f.sum(), s / s.sum(1, keepdims=True), e / e.sum(0)
    for i, x in symbols.items():
        assert got[i] == pytest.approx(math.log10(walk(x)[2]), rel=1e-5)


def test_a_block_spans_batches_up_to_its_bytes(spark, docs):
    """Messages of a round are as many as (block, word) pairs: batches of one task share a block until it is full."""
    frame = docs([f"same words in all texts and own{i}" for i in range(60)]).repartition(1)
    rows = frame.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5 == 1).alias("held_out"), "text")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        texts, words = lm.tokenised(rows, 4)
        few = [(r["block"], w, c) for r in words.collect() for w, c in zip(r["words"], r["counts"])]
        cut, of_cut = lm.tokenised(rows, 4, 700)  # a batch of ten holds about 330 bytes, so two fit
        many = [(r["block"], w, c) for r in of_cut.collect() for w, c in zip(r["words"], r["counts"])]
    finally:
        spark.conf.set(key, before)
    assert texts.count() == cut.count() == 60
    assert len({b for b, _, _ in few}) == 1 and len(few) == 6 + 60
    assert len({b for b, _, _ in many}) > 1
    summed = Counter()
    for _, w, c in many:
        summed[bytes(w)] += c
    assert summed == Counter({bytes(w): c for _, w, c in few}) and summed[b"same"] == 48


def test_counts_of_wide_groups_are_those_of_texts_alone():
    """Texts of unlike length walked side by side, long ones in segments, give the sum of what each gives alone."""
    rng = np.random.default_rng(9)
    model = small_model(4, 30)
    texts = [rng.integers(0, 30, k).astype(np.int32) for k in [*rng.integers(1, 60, 300), 1, 1, 257, 400]]
    together, alone = lm.Counts.zero(30, 4), lm.Counts.zero(30, 4)
    together.add(model, texts, 100)
    for x in texts:
        alone.add(model, [x], 1000)
    for name in ("first", "step", "emit"):
        assert getattr(together, name) == pytest.approx(getattr(alone, name), rel=1e-4)
