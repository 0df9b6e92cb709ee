import json

import pytest

from slipstone.llm import toolcalls
from slipstone.llm.toolcalls import check_arguments, violation

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, record string"
TOOL = {"sum": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}}, "required": ["n"], "additionalProperties": False}}


def linked(spark, calls, results):
    frame = toolcalls.link_calls(
        spark.createDataFrame([(*c, None) for c in calls], CALLS), spark.createDataFrame([(*r, None) for r in results], RESULTS), TOOL
    )
    return {(r.conv_id, r.call_id): r for r in frame.collect()}


def test_links_orders_and_validates(spark):
    calls = [
        (1, 0, "a", "sum", '{"n": 2}', []), (1, 2, "b", "sum", '{"n":0}', ["a"]), (1, 4, "c", "other", "{}", ["a", "gone"]),
        (1, 6, "d", "sum", "not json", None), (1, 8, "e", "sum", '{"n":1,"n":5}', ["a"]), (1, 9, "e", "sum", '{"n":9}', []),
        (2, 0, "x", "sum", '{"n":1}', ["y"]), (2, 2, "y", "sum", '{"n":1}', ["z"]), (2, 4, "z", "sum", '{"n":1}', []),
        (3, 0, "p", "sum", '{"n":1}', ["q"]), (3, 2, "q", "sum", '{"n":1}', ["p"]), (3, 4, "r", "sum", '{"n":1}', []),
        (None, 0, "n", "sum", "{}", []), (4, 0, None, "sum", "{}", []), (5, None, "t", None, None, None),
    ]
    results = [(1, 1, "a", "é\n\"q\""), (1, 7, "a", "late"), (1, 3, "b", "r"), (1, 5, "o", "orphan"), (2, 1, "x", None), (None, 1, "n", "r")]
    got = linked(spark, calls, results)
    status = {k: r.status for k, r in got.items()}
    assert status == {
        (1, "a"): "linked", (1, "b"): "invalid_arguments", (1, "c"): "unknown_tool", (1, "d"): "invalid_arguments",
        (1, "e"): "missing_result", (1, "o"): "orphan_result", (2, "x"): "linked", (2, "y"): "missing_result",
        (2, "z"): "missing_result", (3, "p"): "cycle", (3, "q"): "cycle", (3, "r"): "missing_result", (5, "t"): "unknown_tool",
    }
    position = {k: r.position for k, r in got.items()}
    assert [position[1, c] for c in "abcde"] == [1, 2, 3, 4, 5]
    assert [position[2, c] for c in "zyx"] == [1, 2, 3]
    assert position[3, "r"] == 1 and {position[3, "p"], position[3, "q"]} == {2, 3}
    assert (got[1, "a"].n_results, got[1, "e"].n_calls, got[1, "e"].arguments) == (2, 2, '{"n":5}')
    assert got[1, "a"].record == (
        '{"arguments":{"n":2},"call_id":"a","content":"é\\n\\"q\\"","conv_id":1,"name":"sum","position":1,"status":"linked"}'
    )
    assert all(json.loads(r.record)["call_id"] == k[1] for k, r in got.items())


def test_empty_tables(spark):
    assert linked(spark, [], []) == {}


def test_hot_conversation_and_long_text(spark):
    calls = [(7, 2 * i, f"c{i:04d}", "sum", '{"n":1}', [f"c{i - 1:04d}"] if i else []) for i in range(300)]
    got = linked(spark, calls, [(7, 1, "c0000", "x" * 200_000)])
    assert [got[7, f"c{i:04d}"].position for i in range(300)] == list(range(1, 301))
    assert len(got[7, "c0000"].record) > 200_000


@pytest.mark.parametrize(("value", "schema", "found"), [
    (True, {"type": "integer"}, "$: type"), (3.0, {"type": "integer"}, None), ("x", {"enum": ["y"]}, "$: enum"),
    ([1, "a"], {"items": {"type": "number"}}, "$[1]: type"), ({"a": {}}, {"properties": {"a": {"required": ["b"]}}}, "$.a.b: required"),
    ("abc", {"maxLength": 2}, "$: length"), (None, {"type": ["null", "string"]}, None), ({"z": 1}, {"additionalProperties": False}, "$.z: unknown"),
])
def test_schema_rules(value, schema, found):
    assert violation(value, schema) == found


def test_canonical_arguments():
    assert check_arguments('{"b": [1, 2.50], "a": "\\u00e9/"}', {}).canonical == '{"a":"é/","b":[1,2.5]}'
    assert check_arguments("[NaN]", {}).error == "$: not JSON"


def test_halves_of_pairs_and_whole_numbers(spark):
    half = '{"s":"\\ud800"}'
    assert check_arguments(half, {}).error == "$: not JSON"
    assert check_arguments('{"s":"\\ud83d\\ude00"}', {}).canonical == '{"s":"\U0001f600"}'
    assert check_arguments('{"n":[1.0,2.5,-0.0,1e300,1e3]}', {}).canonical == '{"n":[1,2.5,0,1e+300,1000]}'
    assert violation(True, {"enum": [1]}) == "$: enum" and violation(1.0, {"enum": [1]}) is None
    assert violation([True], {"enum": [[1]]}) == "$: enum" and violation({"a": 1.0}, {"enum": [{"a": 1}]}) is None
    got = linked(spark, [(1, 0, "a", "sum", half, []), (1, 2, "b", "sum", '{"n":3.0}', [])], [(1, 1, "a", "r"), (1, 3, "b", "r")])
    assert got[1, "a"].status == "invalid_arguments" and got[1, "a"].arguments is None
    assert (got[1, "b"].status, got[1, "b"].arguments) == ("linked", '{"n":3}')
