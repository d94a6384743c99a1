"""Phrases against a plain count, and the summaries against their guarantee."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pairflow.llm import phrases
from pairflow.llm import queries as llm

SETTINGS = {"longest": 4, "least": 5, "share": 80, "top": 15}


def plain(rows, longest=4, least=5, share=80, top=15):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for n in range(1, longest + 1):
                own.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    held[p[i : i + n]] = max(held[p[i : i + n]], a)
        listed = []
        for p, a in found.items():
            if held[p] and 100 * held[p] >= share * a:
                continue
            score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            listed.append((" ".join(p), a, left, right, sizes[lang], score))
        listed.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(listed[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "the", "The", "É", "é", "x\x00y", "日本", "of", "z w"] + [f"w{i}" for i in range(40)]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ! "]
    return ["".join(rng.choice(words) + rng.choices(gaps, [12, 1, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 300, 10**6])
def test_equals_a_plain_count(spark, block):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "en", "fr", "und", None]), t) for t in texts(1, 150)]
    rows += [("en", "new york city hall is in new york"), ("en", None), (None, ""), ("fr", " \t\n ")] + [("en", "only this one phrase here")] * 7
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert rows_of(phrases.find_phrases(df, "text", "lang", block_bytes=block, **SETTINGS)) == plain(rows)


def test_names_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert rows_of(phrases.find_phrases(empty, "text", "lang")) == []
    nothing = spark.createDataFrame([(None, None), ("en", None), ("en", "...")], "lang string, text string")
    assert rows_of(phrases.find_phrases(nothing, "text", "lang")) == []
    # Columns named like the operator's own.
    rows = [("en", "p q r", 1, "x")] * 6
    clash = spark.createDataFrame(rows, "`la.ng` string, n string, block int, phrase string")
    got = rows_of(phrases.find_phrases(clash, "n", "la.ng", **SETTINGS))
    assert got == plain([("en", "p q r")] * 6)


def test_one_long_text_and_one_common_word(spark):
    rows = [("en", "go " * 200_000), ("en", "stop go " * 50)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(phrases.find_phrases(df, "text", "lang", **SETTINGS)) == plain(rows)


def test_scores_past_64_bits(spark):
    """A score's product passes 64 bits long before its parts do."""
    big = 9_000_000_000_000
    counts = spark.createDataFrame(
        [("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + 1)], "lang string, phrase string, words int, a bigint"
    )
    got = phrases._cut(counts.where("words > 1"), counts, 4).first()
    assert (got["l"], got["r"], got["score"]) == (big, big + 1, 2_000_000 * big // (2 * big + 1))


@pytest.mark.parametrize("seed", range(5))
def test_a_summary_keeps_every_frequent_key(seed):
    rng = np.random.default_rng(seed)
    least, parts = 30, []
    for _ in range(20):
        keys = np.concatenate([rng.integers(0, 50_000, 3000), rng.zipf(1.5, 500) % 1000])
        parts.append(np.unique(keys, return_counts=True))
    truth = Counter()
    for k, c in parts:
        truth.update(dict(zip(k.tolist(), c.tolist())))
    mass = sum(truth.values())
    summary = phrases.MisraGries(mass // least + 1, buffer=1000)
    for k, c in parts:
        summary.add(k.astype(np.int64), c.astype(np.int64))
    kept = set(summary.at_least(least).tolist())
    assert {k for k, n in truth.items() if n >= least} <= kept
    assert summary.error <= mass / (summary.capacity + 1)
    assert len(summary.keys) <= summary.capacity
    for k, c in zip(summary.keys.tolist(), summary.counts.tolist()):
        assert c <= truth[k] <= c + summary.error


def test_packed_keys_come_back():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 32, 5000))
    counts = rng.integers(1, 1 << 31, len(keys))
    for k, c in ((keys, counts), (keys[:0], counts[:0]), (np.array([0, (1 << 32) - 1]), np.array([1, 2]))):
        got = phrases.unpack(phrases.pack(k, c))
        assert got[0].tolist() == k.tolist() and got[1].tolist() == c.tolist()
        assert phrases.unpack(phrases.pack(k), counted=False)[0].tolist() == k.tolist()


def test_the_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({llm.ORACLE['op11_phrases']})").fetchall())
    assert rows_of(llm.QUERIES["op11_phrases"](spark, path)) == want
