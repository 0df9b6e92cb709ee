"""Chat formatting: tool calls linked with their results, ordered, validated and serialised.

Calls and results meet in a hash join on (conversation, call id). Within a conversation the
calls are put in an order in which each comes after the calls it depends on; arguments are
checked against the schema of their tool; every call becomes one canonical JSON record.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import ranked_within
from ..session import spool

MAX_TOOLS = 100_000


@dataclass(frozen=True)
class Arguments:
    canonical: str | None
    error: str | None


_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def _plain(value):
    """Whole numbers as integers, however they were written, as far as a double is exact."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _same(a, b) -> bool:
    """Equality of JSON values: true is not 1."""
    return canonical(_plain(a)) == canonical(_plain(b))


def canonical(value) -> str:
    """Keys in order, no spaces, characters unescaped where JSON allows; no NaN or infinity."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violation(value, schema: dict, place: str = "$") -> str | None:
    """The first breach of ``schema`` in ``value``, as "place: rule"; None if it holds."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_TYPES[k](value) for k in kinds):
            return f"{place}: type"
    if "enum" in schema and not any(_same(value, allowed) for allowed in schema["enum"]):
        return f"{place}: enum"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return f"{place}: length"
    if _TYPES["number"](value) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return f"{place}: range"
    if isinstance(value, list):
        for i, item in enumerate(value):
            if found := violation(item, schema.get("items", {}), f"{place}[{i}]"):
                return found
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(schema.get("required", [])):
            if name not in value:
                return f"{place}.{name}: required"
        for name in sorted(value):
            if name in known:
                if found := violation(value[name], known[name], f"{place}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{place}.{name}: unknown"
    return None


def check_arguments(text: str | None, schema: dict | None) -> Arguments:
    try:
        value = _plain(json.loads(text if text is not None else "null"))
        plain = canonical(value)
        plain.encode("utf-8")  # an escape may name half of a pair, which no text can hold
    except (ValueError, RecursionError):
        return Arguments(None, "$: not JSON")
    if schema is None:
        return Arguments(plain, "unknown tool")
    return Arguments(plain, violation(value, schema))


def _levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of each call: 0 where turns already respect every dependency, else its depth.

    Only conversations with a dependency on a later turn need it; they are peeled call by call,
    level by level, all conversations at once. What never becomes free lies on a cycle or
    behind one and gets a null level.
    """
    backward = edges.filter("dep_turn >= turn").select("conv_id").distinct()
    backward = spool(backward)
    left = spool(edges.join(backward, "conv_id", "left_semi").select("conv_id", "call_id", "dep_id"))
    rest = spool(calls.join(backward, "conv_id", "left_semi").select("conv_id", "call_id"))
    done, level = None, 0
    while not rest.isEmpty():
        free = spool(rest.join(left.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti"))
        if free.isEmpty():
            break
        ranked = free.withColumn("level", F.lit(level))
        done = ranked if done is None else done.union(ranked)
        rest = spool(rest.join(free, ["conv_id", "call_id"], "left_anti"))
        freed = free.select("conv_id", F.col("call_id").alias("dep_id"))
        left = spool(left.join(freed, ["conv_id", "dep_id"], "left_anti"))
        level += 1
    placed = calls.join(backward.withColumn("peeled", F.lit(True)), "conv_id", "left")
    if done is None:
        return placed.withColumn("level", F.when(F.col("peeled"), F.lit(None).cast("int")).otherwise(0)).drop("peeled")
    return placed.join(done, ["conv_id", "call_id"], "left").withColumn(
        "level", F.when(F.col("peeled"), F.col("level")).otherwise(F.lit(0))
    ).drop("peeled")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call id and per result without a call: conv_id, call_id, turn, position,
    name, n_calls, n_results, status, error, arguments, record.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON text) and depends_on (array of
    call ids of the conversation), ``results`` conv_id, turn, call_id and content; other columns
    are ignored. Of several calls or results under one id the first by turn (then by text)
    counts; n_calls and n_results tell how many there were. position numbers the calls of a
    conversation so that each comes after those it depends on, else by turn and id; calls on or
    behind a cycle come last. Dependencies on ids that don't occur are ignored. status is the
    first that fits of: orphan_result (no call), cycle, unknown_tool, invalid_arguments,
    missing_result, linked. record is canonical JSON. Rows with a null conv_id or call_id can't
    be linked and are left to the caller: they are not returned. Empty tables give no rows.
    """
    if len(schemas) > MAX_TOOLS:
        raise ValueError(f"{len(schemas)} tools exceed the broadcast bound of {MAX_TOOLS}")
    named = "conv_id is not null and call_id is not null"
    first = calls.filter(named).groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), F.count(F.lit(1)).alias("n_calls")
    )
    calls = spool(first.select("conv_id", "call_id", "c.*", "n_calls"))
    answers = results.filter(named).groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")
    ).select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    wanted = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("depends_on")).alias("dep_id"))
    known = calls.select("conv_id", F.col("call_id").alias("dep_id"), F.col("turn").alias("dep_turn"))
    edges = spool(wanted.join(known, ["conv_id", "dep_id"]))
    leveled = _levels(calls.select("conv_id", "call_id", "turn"), edges)
    order = leveled.select("conv_id", "call_id", "turn", "level").withColumn(
        "late", F.coalesce("level", F.lit(2**31 - 1))
    )
    places = ranked_within(order, ["conv_id"], ["late", "turn", "call_id"], into="position", size="calls_in_conv").select(
        "conv_id", "call_id", "level", "position"
    )
    linked = calls.join(places, ["conv_id", "call_id"]).join(answers, ["conv_id", "call_id"], "full_outer")
    shared = calls.sparkSession.sparkContext.broadcast(schemas)

    @F.pandas_udf("status string, error string, arguments string, record string")
    def serialise(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.to_dict("records"):
            number = lambda name, row=row: None if pd.isna(row[name]) else int(row[name])
            called = not pd.isna(row["n_calls"])
            found = check_arguments(row["arguments"], shared.value.get(row["name"])) if called else Arguments(None, None)
            status = (
                "orphan_result" if not called
                else "cycle" if pd.isna(row["level"])
                else "unknown_tool" if found.error == "unknown tool"
                else "invalid_arguments" if found.error
                else "missing_result" if pd.isna(row["n_results"])
                else "linked"
            )
            record = canonical({
                "arguments": json.loads(found.canonical) if found.canonical else None,
                "call_id": row["call_id"], "content": row["content"], "conv_id": int(row["conv_id"]),
                "name": row["name"], "position": number("position"), "status": status,
            })
            out.append((status, found.error, found.canonical, record))
        return pd.DataFrame(out, columns=["status", "error", "arguments", "record"])

    fields = ["conv_id", "call_id", "name", "arguments", "content", "position", "level", "n_calls", "n_results"]
    return linked.withColumn("out", serialise(F.struct(*fields))).select(
        "conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "position", "name",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "out.status", "out.error", "out.arguments", "out.record",
    )


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in plain chats: a user turn asks a tool, the assistant turn after it
    answers under the same id; each request depends on the one two turns before.

    ``turns`` has conv_id, turn, role and text. Roles other than these two give nothing.
    """
    call_id = lambda turn: F.concat(F.lit("call-"), F.format_string("%05d", turn))
    size = F.length(F.coalesce("text", F.lit("")))
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", call_id(F.col("turn")).alias("call_id"),
        F.when(size % 7 == 0, F.lit("unlisted")).otherwise(F.lit("lookup")).alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), (size % 60).alias("limit"))).alias("arguments"),
        F.array(call_id(F.col("turn") - 2)).alias("depends_on"),
    )
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return asked, answered


#: the tools that the registered query knows
CHAT_TOOLS = {
    "lookup": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "minLength": 1},
            "limit": {"type": "integer", "minimum": 1, "maximum": 50},
        },
        "required": ["query", "limit"],
        "additionalProperties": False,
    }
}
