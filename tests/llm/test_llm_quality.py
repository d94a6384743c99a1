from __future__ import annotations

from plain import quality as plain_quality
from plain import rejected
from pyspark.sql import functions as F

from pairflow.llm import quality

ODD = [
    None, "", " \n\t", "one", "a b c a b c", "x\x1fy z", "你好 " * 60, "a b\na b\n\n a b\nc", "# * $ | <p>",
    "w " * 5000, " ".join(f"w{i % 700}" for i in range(9000)), "no " + "yes!! " * 70, "a b a b a b a",
]


def test_measurements_equal_the_plain_ones(docs, documents):
    for frame in (docs(ODD), documents):
        got = quality.ledger(frame).collect()
        for r in got:
            want = plain_quality(r["text"])
            assert {k: r[k] for k in want} == want
            assert (r["failure_bits"] != 0) == rejected(r["text"])


def test_policies_and_ablations(docs):
    texts = ["word " * 3, "some words " + " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}#" for i in range(60)), "# # #"]
    book = quality.ledger(docs(texts))
    assert [r["kept"] for r in quality.apply_policy(book, "base-1").orderBy("doc_id").collect()] == [False, True, True, False]
    assert [r["kept"] for r in quality.apply_policy(book, "web-2").orderBy("doc_id").collect()] == [False, True, False, False]
    rows = {(r["policy"], r["rule"]): r for r in quality.ablations(book).collect()}
    few = rows["web-2", "few_words"]
    assert (few["n_rows"], few["rejected"], few["by_rule"], few["by_rule_alone"], few["with_rule"]) == (4, 3, 2, 1, 5)
    assert rows["web-2", "symbols"]["by_rule_alone"] == 1
    assert ("base-1", "symbols") not in rows


def test_empty_repeated_and_clashing(spark, docs):
    assert quality.ledger(docs(["x"]).where("false")).count() == 0
    frame = docs(["a b", "a b"], ids=[1, 1]).withColumn("n_words", F.lit("mine")).withColumn("_measured", F.lit(1))
    got = quality.ledger(frame).collect()
    assert [r["n_words"] for r in got] == [2, 2] and [r["_measured"] for r in got] == [1, 1]


def test_stage_keeps_columns_and_clean_rows(spark, docs):
    good = " ".join(f"word{i}" for i in range(80))
    frame = docs([good, None, "x", good]).withColumn("_rejected", F.lit(7))
    kept = quality.keep_good(spark, frame, "")
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


def test_ablations_of_all_documents_are_the_ones_counted_by_the_rules(spark, documents):
    """Each verdict worked out anew without the rule, over plain measurements, instead of from bits."""
    tests = {r.name: {row["text"]: row["failure_bits"] >> r.bit & 1 for row in quality.ledger(documents).collect()} for r in quality.RULES}
    texts = [r["text"] for r in documents.collect()]
    got = {(r["policy"], r["rule"]): r for r in quality.quality_ablations(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {(p, name) for p, names in quality.POLICIES.items() for name in names}
    for (policy, rule), r in got.items():
        names = quality.POLICIES[policy]
        rejected_by = [{n for n in names if tests[n][t]} for t in texts]
        assert (r["n_rows"], r["rejected"]) == (len(texts), sum(bool(x) for x in rejected_by))
        assert (r["by_rule"], r["by_rule_alone"]) == (sum(rule in x for x in rejected_by), sum(x == {rule} for x in rejected_by))
