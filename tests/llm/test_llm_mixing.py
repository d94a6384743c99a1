from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from check_queries import connect, difference
from pyspark.sql import functions as F

from pairflow.llm import common, mixing

SF = "/root/testdata/sf0.001"


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            out |= {s: weight[s] * level for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize(
    "sizes",
    [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 1, None: 50}, {"z": 0, "é": 5}, {"a": 0}, {"x": 7},
     {f"s{i}": (i * 37) % 101 for i in range(40)}],
)
def test_targets_equal_the_plain_ones(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_taken_words_come_near_the_targets_and_reruns_agree(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, 1 + (i * 7919) % 400) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = mixing.copies(frame, "doc_id", "size", "source").collect()
    again = mixing.copies(frame.repartition(5), "doc_id", "size", "source").collect()
    assert sorted((r["doc_id"], r["n_copies"]) for r in got) == sorted((r["doc_id"], r["n_copies"]) for r in again)
    taken, target, rate = Counter(), {}, defaultdict(set)
    for r in got:
        taken[r["source"]] += r["n_copies"] * r["size"]
        target[r["source"]] = r["target"]
        rate[r["source"]].add(r["n_copies"])
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.02)
        assert max(rate[s]) - min(rate[s]) <= 1 and max(rate[s]) <= 2


def test_query_equals_sql(spark):
    want = connect(SF).execute(mixing.OP8_SQL).df()
    assert difference(mixing.op8_mixing(spark, SF).toPandas(), want) is None


def test_stage_repeats_rows(spark, docs):
    texts = ["a b c", None, "", "w " * 30, "w " * 30, "x y"] * 5
    frame = docs(texts, ids=[i // 2 for i in range(len(texts))]).withColumn("n_copies", F.lit("mine")).withColumn("_n", F.lit(2))
    mixed = mixing.mix(spark, frame, "")
    assert mixed.columns == frame.columns
    seen, have = Counter((r["doc_id"], r["text"]) for r in mixed.collect()), Counter((r["doc_id"], r["text"]) for r in frame.collect())
    assert set(seen) <= set(have) and all(n <= 2 * have[k] for k, n in seen.items())
    assert sum(len((t or "").split()) * n for (_, t), n in seen.items()) == pytest.approx(1.5 * sum(len((t or "").split()) for t in texts), rel=0.1)
    assert mixing.mix(spark, frame.where("false"), "").count() == 0
    assert mixing.mix(spark, docs([None, ""]), "").count() == 0


def test_rows_of_one_id_are_mixed_alike_in_each_run(spark):
    """Forty rows without id and of one size: which texts stand twice depends on the texts alone."""
    rows = [(None, f"word{i:02d}", None, "s", 6) for i in range(40)] + [(None, None, "word00", "s", 6)]
    runs = []
    for k, order in enumerate((rows, rows[::-1], rows[20:] + rows[:20])):
        df = spark.createDataFrame(order, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(k + 1)
        runs.append(sorted((r.text or "", r.lang or "") for r in mixing.mix(spark, df, "").collect()))
    assert runs[0] == runs[1] == runs[2]
    assert len(set(runs[0])) < len(runs[0])


def test_a_digest_tells_rows_apart(spark):
    rows = [("a", None), (None, "a"), ("a", "a"), (None, None), ("", None), ("aa", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(common.row_digest(df).alias("d")).distinct().count() == len(rows)
    assert {len(r.d) for r in df.select(common.row_digest(df).alias("d")).collect()} == {32}
