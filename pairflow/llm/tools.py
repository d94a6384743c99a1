"""Tool calls of conversations: linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet by a hash join on (conversation, identifier). A call may need the results of
others; the order keeps every call behind what it needs. Arguments are checked against the JSON
schema of their tool. All steps are joins and sums over calls, so that a conversation of any length
is spread like any other rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairflow.llm.common import stored, table
from pairflow.operators.ordering import row_index

CALL = "conv bigint, turn bigint, idx int, id string, name string, arguments string, needs array<string>"
RESULT = "conv bigint, turn bigint, idx int, id string, content string"
STRETCH = 256
"""Turns of a conversation that one sorting task holds."""


# --- JSON helpers ----------------------------------------------------------------------------


def canonical(value: object) -> str:
    """JSON with sorted keys, no white space and one form for each number; non-finite numbers are an error."""

    def plain(v: object) -> object:
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("a number is not finite")
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int,
}


def fault(value: object, schema: dict, path: str = "$") -> str | None:
    """What is wrong with ``value`` under ``schema``; the common keywords of JSON Schema, others are ignored."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        whole = isinstance(value, float) and value.is_integer()
        fits = any(
            isinstance(value, _KINDS[k]) and (not isinstance(value, bool) or k == "boolean") or k == "integer" and whole
            for k in kinds
        )
        if not fits:
            return f"{path}: not {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not one of the allowed values"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{path}: out of range"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"{path}: length out of range"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{path}: does not match the pattern"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{path}: number of items out of range"
        if "items" in schema:
            return next((x for i, v in enumerate(value) if (x := fault(v, schema["items"], f"{path}[{i}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}: no {name}"
        for name, v in value.items():
            if name in known:
                if x := fault(v, known[name], f"{path}.{name}"):
                    return x
            elif schema.get("additionalProperties", True) is False:
                return f"{path}: {name} is not allowed"
    return None


def _json(name: str | None, call_id: str, arguments: str | None, result: str | None, linked: bool, schemas: dict) -> tuple[str | None, str | None]:
    """(error, canonical JSON of call and result). Broken arguments give an error and no JSON."""
    try:
        args = json.loads(arguments if arguments is not None else "null")
        whole = canonical({"id": call_id, "name": name, "arguments": args, "result": result if linked else None})
    except (ValueError, RecursionError) as wrong:
        return f"arguments are not JSON: {str(wrong)[:80]}", None
    if name not in schemas:
        return "no such tool", whole
    return fault(args, schemas[name]), whole


# --- linking ---------------------------------------------------------------------------------


def _order(calls: DataFrame) -> DataFrame:
    """(conv, id, late_turn, late_idx, depth, cyclic) of the calls that stand before something they need.

    A call takes the place of the latest thing it needs, one step deeper; all others keep their own
    place. Rounds go on only from calls whose place has just changed, and end with them. Places in
    a circle, and behind one, never settle: a depth beyond the number of calls moved in the conversation
    tells them, and twice that number is where pushing them on ends.
    """
    place = F.struct(F.col("turn").alias("turn"), F.col("idx").alias("idx"), F.lit(0).alias("depth"))
    nodes = stored(calls.select("conv", "id", place.alias("place")))
    edges = stored(calls.select("conv", "id", F.explode(F.array_distinct("needs")).alias("need")).where("need is not null"))
    moved, frontier = None, nodes.select("conv", F.col("id").alias("need"), F.col("place").alias("behind"))
    while True:
        now = nodes if moved is None else nodes.join(moved, ["conv", "id"], "left").select(
            "conv", "id", F.coalesce("late", "place").alias("place")
        )
        behind = F.struct(F.col("behind.turn"), F.col("behind.idx"), (F.col("behind.depth") + 1).alias("depth"))
        pushed = edges.join(frontier, ["conv", "need"]).groupBy("conv", "id").agg(F.max(behind).alias("late"))
        news = stored(pushed.join(now, ["conv", "id"]).where(F.col("late") > F.col("place")).select("conv", "id", "late"))
        if news.isEmpty():
            break
        both = news if moved is None else moved.join(news.select("conv", "id"), ["conv", "id"], "left_anti").unionByName(news)
        moved = stored(both)
        most = moved.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
        frontier = (
            news.join(most, "conv").where(F.col("late.depth") <= 2 * F.col("n"))
            .select("conv", F.col("id").alias("need"), F.col("late").alias("behind"))
        )
    if moved is None:
        return nodes.where(F.lit(False)).select("conv", "id", F.col("place.turn").alias("late_turn"), F.col("place.idx").alias("late_idx"), F.col("place.depth").alias("depth"), F.lit(False).alias("cyclic"))
    most = moved.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    return moved.join(most, "conv").select(
        "conv", "id", F.col("late.turn").alias("late_turn"), F.col("late.idx").alias("late_idx"), F.col("late.depth").alias("depth"),
        (F.col("late.depth") > F.col("n")).alias("cyclic"),
    )


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv, id, turn, name, n_results, position, valid, error, json): one row per distinct call.

    ``calls`` and ``results`` have the columns of ``CALL`` and ``RESULT``; others are ignored. Rows
    with a null conversation or id take no part. Of several calls with one id the first (turn, idx,
    name, arguments) counts and is marked; repeated equal rows are one call. Of several results the
    first counts and all are counted. ``position`` numbers a conversation's calls from 0 so that
    each stands behind what it needs; what needs itself (or waits for what does) or something missing
    is marked. ``valid`` is false where ``error`` tells anything. Empty tables give no rows.
    """
    own = (
        calls.select("conv", "turn", "idx", "id", "name", "arguments", "needs")
        .where("conv is not null and id is not null").distinct()
        .groupBy("conv", "id")
        .agg(F.min(F.struct("turn", "idx", "name", "arguments", "needs")).alias("c"), F.count(F.lit(1)).alias("same"))
        .select("conv", "id", F.coalesce("c.turn", F.lit(0)).alias("turn"), F.coalesce("c.idx", F.lit(0)).alias("idx"), "c.name", "c.arguments",
                F.coalesce("c.needs", F.array().cast("array<string>")).alias("needs"), "same")
    )
    own = stored(own)
    first = (
        results.select("conv", "turn", "idx", "id", "content").where("conv is not null and id is not null").distinct()
        .groupBy("conv", "id")
        .agg(F.min(F.struct("turn", "idx", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    )
    known = own.select("conv", F.col("id").alias("need"))
    missing = (
        own.select("conv", "id", F.explode("needs").alias("need")).join(known, ["conv", "need"], "left_anti")
        .groupBy("conv", "id").agg(F.min("need").alias("missing"))
    )
    order = _order(own)
    linked = (
        own.join(first.hint("shuffle_hash"), ["conv", "id"], "left").join(missing, ["conv", "id"], "left").join(order, ["conv", "id"], "left")
        .withColumn("place", F.struct(
            F.coalesce("late_turn", "turn").alias("a"), F.coalesce("late_idx", "idx").alias("b"), F.coalesce("depth", F.lit(0)).alias("c"),
            F.col("turn").alias("d"), F.col("idx").alias("e"), F.col("id").alias("f")))
    )
    placed = row_index(linked, ["conv"], [F.col("place")], F.floor(F.col("place.a") / STRETCH), name="position")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_json(*row, schemas) for row in zip(b["name"], b["id"], b["arguments"], b["content"], b["n_results"] > 0)]
            b["error"], b["json"] = zip(*made) if made else ((), ())
            yield b

    rows = placed.select(
        "conv", "id", "turn", "name", F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"), "position",
        "arguments", F.col("r.content").alias("content"), "same", "missing", F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("error", T.StringType()), T.StructField("json", T.StringType())])
    error: Column = F.concat_ws(
        "; ",
        F.when(F.col("same") > 1, F.lit("several calls have this id")),
        F.when(F.col("cyclic"), F.lit("it needs itself")),
        F.concat(F.lit("it needs a call that is not there: "), "missing"),
        F.when(F.col("n_results") == 0, F.lit("no result")),
        F.col("error"),
    )
    return rows.mapInPandas(finish, schema).select(
        "conv", "id", "turn", "name", "n_results", "position", (error == "").alias("valid"), F.nullif(error, F.lit("")).alias("error"), "json"
    )


def unlinked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv, id, turn, name, kind, error, json): what ``link`` gives no row of its own.

    ``kind`` is ``repeated call`` for each other distinct call of an id, ``repeated result`` for each distinct
    result of an id behind the first, and ``lone result`` for the first result of an id that no call
    of the conversation has. Rows with a null conversation or id take no part; equal rows are one. Empty tables give
    no rows.
    """
    kept = "conv is not null and id is not null"
    called = calls.select("conv", "id", F.struct("turn", "idx", "name", "arguments", "needs").alias("c")).where(kept).distinct()
    heard = results.select("conv", "id", F.struct("turn", "idx", "content").alias("r")).where(kept).distinct()
    first_call = called.groupBy("conv", "id").agg(F.min("c").alias("first"), F.count(F.lit(1)).alias("n"))
    first_result = heard.groupBy("conv", "id").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    again = (
        called.join(first_call.where("n > 1"), ["conv", "id"]).where(~F.col("c").eqNullSafe(F.col("first")))
        .select("conv", "id", "c.turn", "c.name", F.lit("repeated call").alias("kind"), "c.arguments", none.alias("content"))
    )
    late = (
        heard.join(first_result.where("n > 1"), ["conv", "id"]).where(~F.col("r").eqNullSafe(F.col("first")))
        .select("conv", "id", "r.turn", none.alias("name"), F.lit("repeated result").alias("kind"), none.alias("arguments"), "r.content")
    )
    lone = (
        first_result.join(first_call.select("conv", "id").hint("shuffle_hash"), ["conv", "id"], "left_anti")
        .select("conv", "id", "first.turn", none.alias("name"), F.lit("lone result").alias("kind"), none.alias("arguments"), "first.content")
    )
    rows = again.unionByName(late).unionByName(lone)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [
                _json(name, id_, arguments, None, False, {name: {}}) if kind == "repeated call" else (None, canonical({"id": id_, "result": content}))
                for kind, name, id_, arguments, content in zip(b["kind"], b["name"], b["id"], b["arguments"], b["content"])
            ]
            b["error"], b["json"] = zip(*made) if made else ((), ())
            yield b

    schema = T.StructType([*rows.schema.fields, T.StructField("error", T.StringType()), T.StructField("json", T.StringType())])
    told = {"repeated call": "another call of this id is first", "repeated result": "another result of this id is first", "lone result": "no call"}
    why = F.coalesce(*[F.when(F.col("kind") == k, F.lit(x)) for k, x in told.items()])
    return rows.mapInPandas(finish, schema).select("conv", "id", "turn", "name", "kind", F.concat_ws("; ", why, "error").alias("error"), "json")


# --- where calls come from -------------------------------------------------------------------

_TAGGED = r"(?s)<tool_call>(.*?)</tool_call>"
_BODY = "id string, name string, arguments string, needs array<string>"


def from_tags(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) that carry them as tagged JSON.

    Assistant texts hold ``<tool_call>{"id", "name", "arguments", "needs"}</tool_call>``, texts of the role
    tool are ``{"id", "content"}``. A body that is not such JSON has no id, and so takes no part.
    """
    calls = (
        turns.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(_TAGGED), 1)).alias("idx", "body"))
        .withColumn("c", F.from_json("body", _BODY))
        .select(F.col("conv_id").alias("conv"), "turn", "idx", "c.id", "c.name", "c.arguments", "c.needs")
    )
    results = (
        turns.where("role = 'tool'").withColumn("r", F.from_json("text", "id string, content string"))
        .select(F.col("conv_id").alias("conv"), "turn", F.lit(0).alias("idx"), "r.id", "r.content")
    )
    return calls, results


REPLY = {
    "type": "object",
    "required": ["conversation", "prompt", "turn"],
    "properties": {
        "conversation": {"type": "integer"},
        "turn": {"type": "integer", "minimum": 0},
        "prompt": {"type": "string", "minLength": 1},
    },
    "additionalProperties": False,
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls of a tool ``reply``: a user's turn asks, the assistant's next turn is the result.

    The identifier is the turn asked in; each question needs the one two turns before, if there is one.
    """
    key = F.col("turn").cast("string")
    asked = turns.where("role = 'user'")
    arguments = F.to_json(F.struct(F.col("conv_id").alias("conversation"), "turn", F.coalesce("text", F.lit("")).alias("prompt")))
    before = asked.select("conv_id", (F.col("turn") + 2).alias("turn"), (F.col("turn")).cast("string").alias("before")).distinct()
    calls = asked.join(before, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("conv"), "turn", F.lit(0).alias("idx"), key.alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"),
        F.when(F.col("before").isNotNull(), F.array("before")).otherwise(F.array()).cast("array<string>").alias("needs"),
    )
    results = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("conv"), "turn", F.lit(0).alias("idx"), (F.col("turn") - 1).cast("string").alias("id"), F.col("text").alias("content")
    )
    return calls, results


ROLES = ("user", "assistant", "tool")


def conversation_calls(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, call_id, n_results, position, valid, error, json, kind) of ``turns`` (conv_id, turn, role, text).

    Tagged calls and plain turns are linked together; a tagged call whose identifier is the number of a user's turn
    shares that identifier with it, and both are told. ``kind`` is ``call``, one of those of ``unlinked``, or
    ``other turn`` for a turn of any other role (or none), which has its place and nothing else. Turns without a
    conversation or a number ask nothing, and are ``other turn`` too. Empty tables give no rows.
    """
    takes = F.coalesce(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.lit(False))
    own = turns.select("conv_id", "turn", "role", "text")
    part = own.where(takes)
    calls, results = (a.unionByName(b) for a, b in zip(from_turns(part), from_tags(part)))
    rest = unlinked(calls, results).select(
        F.col("conv").alias("conv_id"), "turn", F.col("id").alias("call_id"), F.lit(None).cast("bigint").alias("n_results"),
        F.lit(None).cast("bigint").alias("position"), F.lit(False).alias("valid"), "error", "json", "kind",
    )
    other = own.where(~takes).select("conv_id", "turn", F.lit("other turn").alias("kind"))
    linked = link(calls, results, schemas).select(
        F.col("conv").alias("conv_id"), "turn", F.col("id").alias("call_id"), "n_results", "position", "valid", "error", "json", F.lit("call").alias("kind")
    )
    return linked.unionByName(rest).unionByName(other, allowMissingColumns=True)


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call, tagged or plain, of every conversation, linked to its result, in order and as canonical JSON; and what is left."""
    return conversation_calls(table(spark, sf_dir, "conversations"), {"reply": REPLY})
