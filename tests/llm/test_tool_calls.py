"""Tool calls that no producer should write, and schemas."""

import json
from collections import Counter

import pytest

from seriesloom.llm.tool_calls import canonical, check_schema, format_chat, problems, too_deep

SCHEMA = "conv_id long, turn int, role string, text string, call_id string, nth int, level string"
TOOL = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "exclusiveMaximum": 10}}}


def call(**fields):
    return f"<tool_call>{json.dumps(fields)}</tool_call>"


def nested(depth):
    return "[" * depth + "]" * depth


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, 0, "assistant", '<tool_call>{"id":"a","name":"t","arguments":{"x":1,"note":"\\ud800"}}</tool_call>'),
        (1, 1, "assistant", call(id="b", name=["t"], arguments={"x": 2})),
        (1, 2, "assistant", f'<tool_call>{{"id":"c","name":"t","arguments":{{"x":{nested(300)}}}}}</tool_call>'),
        (1, 3, "assistant", f'<tool_call>{{"id":"d","name":"t","arguments":{nested(200_000)}}}</tool_call>'),
        (1, 4, "assistant", call(id=7, name="t", arguments={"x": 2.0})),
        (1, 5, "assistant", call(id="e", name="t", arguments={"x": 10})),
        (1, 6, "tool", json.dumps({"tool_call_id": 7, "content": "\ud800"})),
        (1, 7, "tool", f'{{"tool_call_id":"a","content":{nested(300)}}}'),
        (1, 8, "tool", "no json"),
        (2, 0, "assistant", "<tool_call>broken</tool_call>" * 50),
        (3, None, "user", "w " * 300_000),
        (None, None, None, None), (None, None, None, None), (4, 0, "user", ""),
    ]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def test_odd_calls_are_records_and_not_crashes(odd):
    got = format_chat(odd, {"t": TOOL}).collect()
    for r in got:
        assert canonical(json.loads(r.json)) == r.json
    calls = {json.loads(r.json)["id"]: r for r in got if r.conv_id == 1 and r.kind == "call" and '"id":null' not in r.json}
    assert {k: r.status for k, r in calls.items()} == {"a": "ok", "b": "invalid", "c": "invalid", "7": "ok", "e": "invalid"}
    assert json.loads(calls["b"].json)["problems"] == ["unknown tool"] and json.loads(calls["b"].json)["name"] == '["t"]'
    deep = json.loads(calls["c"].json)
    assert "nested too deeply" in deep["problems"] and nested(300) in deep["arguments"]
    assert json.loads(calls["a"].json)["result"].endswith("}") and json.loads(calls["7"].json)["result"] == "\ud800"
    assert json.loads(calls["e"].json)["problems"] == ["$.x: above the maximum"]
    assert Counter((r.kind, r.status) for r in got if r.conv_id == 1)["result", "orphan"] == 1
    assert sum(r.conv_id == 2 and r.status == "invalid" for r in got) == 50
    assert sum(r.conv_id is None for r in got) == 1
    for conv in (1, 2, 3):
        mine = sorted(r.position for r in got if r.conv_id == conv)
        assert mine == list(range(len(mine)))


def test_schemas_say_what_they_cannot_check():
    for bad in ({"type": "strin"}, {"format": "date"}, {"properties": {"a": {"oneOf": []}}}, {"items": {"$ref": "#/x"}}, {"additionalProperties": {}}):
        with pytest.raises(ValueError):
            check_schema(bad)
    check_schema({"title": "t", "type": ["object", "null"], "anyOf": [{"const": 1}], "properties": {"a": {"items": {}}}})


@pytest.mark.parametrize(
    ("value", "schema", "fine"),
    [
        (2.0, {"type": "integer"}, True), (2.5, {"type": "integer"}, False), (True, {"type": "integer"}, False), (True, {"enum": [1]}, False),
        (1.0, {"const": 1}, True), ("abc", {"pattern": "^b"}, False), ("abc", {"pattern": "b"}, True), ([1, 1.0], {"uniqueItems": True}, False),
        ([1], {"minItems": 2}, False), (3, {"exclusiveMinimum": 3}, False), (3, {"minimum": 3}, True), ("x", {"anyOf": [{"type": "integer"}, {"minLength": 1}]}, True),
        (None, {"anyOf": [{"type": "integer"}, {"type": "string"}]}, False), ({"$ref": "a"}, {"type": "integer"}, True),
    ],
)
def test_schema_keywords(value, schema, fine):
    assert (problems(value, schema) == []) == fine


def test_depth():
    assert not too_deep(json.loads(nested(200))) and too_deep(json.loads(nested(201)))
