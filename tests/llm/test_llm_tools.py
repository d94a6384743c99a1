from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pairflow.llm import tools

SCHEMAS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


def call(conv, turn, id_, args='{"x":1}', needs=(), name="add", idx=0):
    return (conv, turn, idx, id_, name, args, list(needs))


def linked(spark, calls, results=()):
    got = tools.link(spark.createDataFrame(calls, tools.CALL), spark.createDataFrame(list(results), tools.RESULT), SCHEMAS)
    return {(r["conv"], r["id"]): r for r in got.collect()}


def test_results_validation_and_canonical_json(spark):
    got = linked(
        spark,
        [call(1, 0, "a", '{ "x" : 2.0 }'), call(1, 2, "b", '{"y":1}'), call(1, 4, "c", "{"), call(1, 6, "d", name="other"), call(2, 0, "a", '{"x":-1}')],
        [(1, 1, 0, "a", "é"), (1, 3, 0, "a", "late"), (2, 1, 0, "a", None), (1, 7, 0, "d", "x")],
    )
    assert got[1, "a"]["valid"] and got[1, "a"]["n_results"] == 2
    assert got[1, "a"]["json"] == '{"arguments":{"x":2},"id":"a","name":"add","result":"é"}'
    assert got[1, "b"]["error"] == "no result; $: no x"
    assert "not JSON" in got[1, "c"]["error"] and got[1, "c"]["json"] is None
    assert got[1, "d"]["error"] == "no such tool"
    assert got[2, "a"]["error"] == "$.x: out of range" and json.loads(got[2, "a"]["json"])["result"] is None


def check_order(got, calls):
    place = {k: r["position"] for k, r in got.items()}
    for conv in {c[0] for c in calls}:
        assert sorted(p for (c, _), p in place.items() if c == conv) == list(range(sum(c == conv for c, _ in place)))
    for c in calls:
        for need in c[6]:
            r = got[c[0], c[3]]
            if "itself" not in (r["error"] or "") and "itself" not in (got[c[0], need]["error"] or ""):
                assert place[c[0], need] < place[c[0], c[3]]


def test_order_keeps_calls_behind_their_needs(spark):
    calls = [
        call(1, 0, "a", needs=["d"]), call(1, 1, "b", needs=["a"]), call(1, 2, "c"), call(1, 5, "d", needs=["e"]), call(1, 5, "e", idx=1), call(1, 9, "f", needs=["b"]),
        *[call(3, i, str(i), needs=[str(i + 1)] if i < 12 else []) for i in range(13)],
    ]
    got = linked(spark, calls)
    check_order(got, calls)
    assert [got[1, x]["position"] for x in "cedabf"] == list(range(6))
    assert [got[3, str(i)]["position"] for i in range(13)] == list(range(12, -1, -1))


def test_circles_and_missing_needs_are_told(spark):
    calls = [call(1, 0, "a", needs=["b"]), call(1, 1, "b", needs=["a"]), call(1, 2, "c", needs=["nowhere"]), call(1, 3, "d", needs=["c"]), call(2, 0, "s", needs=["s"])]
    got = linked(spark, calls)
    assert "itself" in got[1, "a"]["error"] and "itself" in got[1, "b"]["error"] and "itself" in got[2, "s"]["error"]
    assert "not there: nowhere" in got[1, "c"]["error"] and got[1, "d"]["position"] > got[1, "c"]["position"]


def test_repeated_null_and_clashing_rows(spark):
    calls = [call(1, 0, "a"), call(1, 0, "a"), call(1, 3, "b"), call(1, 4, "b"), call(None, 0, "a"), call(1, 0, None), (1, None, None, "n", None, None, None)]
    frame = spark.createDataFrame(calls, tools.CALL).withColumns({"position": F.lit(1), "error": F.lit("x")})
    got = {r["id"]: r for r in tools.link(frame, spark.createDataFrame([], tools.RESULT), SCHEMAS).collect()}
    assert set(got) == {"a", "b", "n"} and got["a"]["error"] == "no result"
    assert got["b"]["turn"] == 3 and "several" in got["b"]["error"] and "no such tool" in got["n"]["error"]
    assert tools.link(frame.where("false"), spark.createDataFrame([], tools.RESULT), SCHEMAS).count() == 0


@pytest.mark.parametrize(
    "value,schema,ok",
    [(1, {"type": "integer"}, True), (1.0, {"type": "integer"}, True), (True, {"type": "integer"}, False), (None, {"type": ["string", "null"]}, True),
     ("b", {"enum": ["a"]}, False), ([1, "x"], {"items": {"type": "number"}}, False), ("ab", {"pattern": "^b"}, False), ({"a": {"b": 1}}, {"properties": {"a": {"required": ["c"]}}}, False)],
)
def test_schema_keywords(value, schema, ok):
    assert (tools.fault(value, schema) is None) == ok


def test_tagged_messages(spark):
    text = '<tool_call>{"id":"a","name":"add","arguments":"{\\"x\\":1}"}</tool_call> and <tool_call>bad</tool_call>'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, "tool", '{"id":"a","content":"2"}'), (1, 3, "assistant", None)]
    calls, results = tools.from_tags(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = tools.link(calls, results, SCHEMAS).collect()
    assert len(got) == 1 and got[0]["valid"] and got[0]["json"] == '{"arguments":{"x":1},"id":"a","name":"add","result":"2"}'


def test_query_equals_plain(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    users = {(r["conv_id"], r["turn"]): r["text"] for r in rows if r["role"] == "user"}
    replies = {(r["conv_id"], r["turn"] - 1): r["text"] for r in rows if r["role"] == "assistant"}
    every = tools.op5_tool_calls(spark, sf).collect()
    got = {(r["conv_id"], r["turn"]): r for r in every if r["kind"] == "call"}
    assert set(got) == set(users)
    left = sorted((r["kind"], r["conv_id"], r["turn"]) for r in every if r["kind"] != "call")
    lone = [("lone result", c, t + 1) for c, t in replies if (c, t) not in users]
    assert left == sorted(lone + [("other turn", r["conv_id"], r["turn"]) for r in rows if r["role"] not in ("user", "assistant")])
    for k, r in got.items():
        assert r["n_results"] == (k in replies) and r["position"] == sum(c == k[0] and t < k[1] for c, t in users)
        args = {"conversation": k[0], "prompt": users[k], "turn": k[1]}
        assert r["json"] == tools.canonical({"id": str(k[1]), "name": "reply", "arguments": args, "result": replies.get(k)})


def test_every_call_result_and_turn_has_a_row(spark):
    tagged = '<tool_call>{"id":"c","name":"add","arguments":"{\\"x\\":1}","needs":["d"]}</tool_call><tool_call>{"id":"d","name":"add","arguments":"{\\"x\\":2}"}</tool_call>'
    again = '<tool_call>{"id":"d","name":"add","arguments":"{\\"x\\":9}"}</tool_call>'
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", tagged), (1, 2, "tool", '{"id":"c","content":"3"}'), (1, 3, "tool", '{"id":"c","content":"4"}'),
        (1, 4, "tool", '{"id":"zz","content":"5"}'), (1, 5, "assistant", again), (1, 6, "system", "be brief"), (1, 7, None, None),
        (None, 0, "user", "lost"), (1, None, "assistant", "lost"), (2, 3, "assistant", None), (2, 3, "assistant", None),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("kind", F.lit("mine"))
    got = tools.conversation_calls(turns, {"reply": tools.REPLY, **SCHEMAS}).collect()
    told = sorted((r["kind"], str(r["conv_id"]), str(r["turn"]), str(r["call_id"]), str(r["error"])) for r in got)
    assert told == sorted([
        ("call", "1", "0", "0", "None"), ("call", "1", "1", "c", "None"), ("call", "1", "1", "d", "several calls have this id; no result"),
        ("repeated call", "1", "5", "d", "another call of this id is first"), ("repeated result", "1", "3", "c", "another result of this id is first"),
        ("lone result", "1", "4", "zz", "no call"), ("lone result", "1", "5", "4", "no call"), ("lone result", "2", "3", "2", "no call"),
        ("other turn", "1", "6", "None", "None"), ("other turn", "1", "7", "None", "None"), ("other turn", "None", "0", "None", "None"), ("other turn", "1", "None", "None", "None"),
    ])
    by = {(r["kind"], r["call_id"]): r for r in got}
    assert by["call", "d"]["position"] < by["call", "c"]["position"]  # moved behind what it needs
    assert by["repeated call", "d"]["json"] == '{"arguments":{"x":9},"id":"d","name":"add","result":null}'
    assert by["repeated result", "c"]["json"] == '{"id":"c","result":"4"}'
    assert tools.conversation_calls(turns.where("false"), SCHEMAS).count() == 0
