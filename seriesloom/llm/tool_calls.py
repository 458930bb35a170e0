"""Chat formatting with linked tool calls.

Assistant messages may hold calls, ``<tool_call>{"id", "name", "arguments"}</tool_call>``;
a message of role ``tool`` is a result, ``{"tool_call_id", "content"}``. Arguments may
point to other calls' results with ``{"$ref": "<call id>"}``. Results are hash-joined
to calls by conversation and id, calls are put after the calls they refer to, arguments
are validated against the schema of their tool, and every record is written as
canonical JSON (sorted keys, no blanks). The unit of work is the message, so a
conversation of any length is spread over many tasks.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
DEPTH = 200
_SURROGATE = re.compile("[\ud800-\udfff]")
TURNS_PER_BUCKET = 512


def canonical(value: Any) -> str:
    """JSON text that equal values share: sorted keys, no blanks, whole floats as integers.

    Halves of surrogate pairs, which UTF-8 cannot hold, are written as escapes.
    """
    return escaped(json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def escaped(text: str) -> str:
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _named(value: Any) -> str | None:
    """An id or a name as text, whatever JSON value it is."""
    return None if value is None else escaped(value) if isinstance(value, str) else canonical(value)


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return None
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    return value


def too_deep(value: Any) -> bool:
    """Whether lists and objects are nested more than ``DEPTH`` times."""
    stack = [(value, 1)]
    while stack:
        item, depth = stack.pop()
        if isinstance(item, (dict, list)):
            if depth > DEPTH:
                return True
            stack += [(v, depth + 1) for v in (item.values() if isinstance(item, dict) else item)]
    return False


_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float),
}
_CHECKED = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength",
    "pattern", "items", "minItems", "maxItems", "uniqueItems", "properties", "required", "additionalProperties", "anyOf",
}
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}


def check_schema(schema: Mapping[str, Any], at: str = "$") -> None:
    """Raises if a schema asks for something that ``problems`` does not check."""
    if not isinstance(schema, Mapping):
        raise ValueError(f"{at}: a schema has to be an object")
    if unknown := sorted(set(schema) - _CHECKED - _NOTES):
        raise ValueError(f"{at}: unsupported in a schema: {', '.join(unknown)}")
    names = schema.get("type", [])
    if wrong := [n for n in ([names] if isinstance(names, str) else names) if n not in _TYPES]:
        raise ValueError(f"{at}: unknown type {wrong[0]!r}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties has to be true or false")
    if "pattern" in schema:
        re.compile(schema["pattern"])
    for name, inner in schema.get("properties", {}).items():
        check_schema(inner, f"{at}.{name}")
    for i, inner in enumerate(schema.get("anyOf", [])):
        check_schema(inner, f"{at}.anyOf[{i}]")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def _is(value: Any, name: str) -> bool:
    if isinstance(value, bool):
        return name == "boolean"
    if name == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _TYPES[name])


def problems(value: Any, schema: Mapping[str, Any], at: str = "$") -> list[str]:
    """Ways in which a value breaks a schema of the keywords that ``check_schema`` lets pass.

    A reference to another call's result stands for any value. Whole floats are integers.
    """
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    found = []
    names = schema.get("type")
    if names is not None:
        names = [names] if isinstance(names, str) else names
        if not any(_is(value, n) for n in names):
            return [f"{at}: not {'/'.join(names)}"]
    if "enum" in schema and canonical(value) not in [canonical(v) for v in schema["enum"]]:
        found.append(f"{at}: not one of the allowed values")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        found.append(f"{at}: not the required value")
    if "anyOf" in schema and all(problems(value, s, at) for s in schema["anyOf"]):
        found.append(f"{at}: fits none of the alternatives")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value <= schema.get("exclusiveMinimum", value - 1):
            found.append(f"{at}: below the minimum")
        if value > schema.get("maximum", value) or value >= schema.get("exclusiveMaximum", value + 1):
            found.append(f"{at}: above the maximum")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            found.append(f"{at}: length out of range")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: does not match the pattern")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            found.append(f"{at}: number of items out of range")
        if schema.get("uniqueItems") and len({canonical(v) for v in value}) < len(value):
            found.append(f"{at}: repeated items")
        for i, v in enumerate(value if "items" in schema else []):
            found += problems(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                found += problems(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    return [escaped(f) for f in found]


def _refs(value: Any) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"}:
            return [_named(value["$ref"]) or ""]
        return [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def _load(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def parse_calls(messages: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """(conv_id, turn, place, call_id, name, arguments, refs, problems): a row per call."""
    found = messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("place", "raw")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(3).to_pylist():
                call = _load(raw)
                call = call if isinstance(call, dict) else {}
                wrong = [] if call.get("id") is not None else ["no id"]
                if too_deep(call):  # kept as it was written
                    wrong.append("nested too deeply")
                    call = {k: v for k, v in call.items() if k in ("id", "name") and isinstance(v, (str, int, float))}
                    call["arguments"] = raw
                    refs: list[str] = []
                else:
                    refs = sorted(set(_refs(call.get("arguments"))))
                name, arguments = call.get("name"), call.get("arguments")
                if not isinstance(name, str) or name not in schemas:
                    wrong.append("unknown tool")
                else:
                    wrong += problems(arguments, schemas[name])
                out.append((_named(call.get("id")), _named(name), canonical(arguments), refs, sorted(wrong)))
            text, many = pa.string(), pa.list_(pa.string())
            yield pa.record_batch(
                [*batch.columns[:3], *[pa.array([r[i] for r in out], k) for i, k in enumerate((text, text, text, many, many))]],
                names=["conv_id", "turn", "place", "call_id", "name", "arguments", "refs", "problems"],
            )

    kinds = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    return found.mapInArrow(
        read, f"{kinds}, place int, call_id string, name string, arguments string, refs array<string>, problems array<string>"
    )


def parse_results(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, content): a row per message of role tool."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents = [], []
            for raw in batch.column(2).to_pylist():
                result = _load(raw)
                linked = isinstance(result, dict) and result.get("tool_call_id") is not None
                if linked and too_deep(result):  # linked, but kept as it was written
                    linked = isinstance(result["tool_call_id"], (str, int, float))
                    result["content"] = raw
                ids.append(_named(result["tool_call_id"]) if linked else None)
                contents.append(canonical(result.get("content")) if linked else canonical(raw))
            yield pa.record_batch(
                [*batch.columns[:2], pa.array(ids, pa.string()), pa.array(contents, pa.string())],
                names=["conv_id", "turn", "call_id", "content"],
            )

    kinds = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    tools = messages.where(F.col("role") == "tool").select("conv_id", "turn", "text")
    return tools.mapInArrow(read, f"{kinds}, call_id string, content string")


def order_calls(calls: DataFrame) -> DataFrame:
    """Add ``level`` and ``at``: calls without references are level 0, others one more than
    the highest call they refer to, and no call comes ``at`` an earlier turn than those.

    References to ids that are no call of the conversation are ignored. Calls on a
    circle of references never become free; they get level -1. One join per level.
    """
    keyed = calls.select("conv_id", "call_id", F.col("turn").alias("at"), F.array_distinct("refs").alias("refs"))
    edges = keyed.select("conv_id", "call_id", F.explode("refs").alias("ref"))
    real = keyed.select("conv_id", F.col("call_id").alias("ref"))
    edges = materialise(edges.join(real, ["conv_id", "ref"], "left_semi"))
    waiting = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("open"))
    state = materialise(
        keyed.select("conv_id", "call_id", "at")
        .join(waiting, ["conv_id", "call_id"], "left")
        .withColumn("level", F.when(F.col("open").isNull(), 0))
    )
    level = 0
    while True:
        done = state.where(F.col("level").isNotNull()).select("conv_id", F.col("call_id").alias("ref"), F.col("at").alias("before"))
        ready = edges.join(done, ["conv_id", "ref"]).groupBy("conv_id", "call_id").agg(
            F.count(F.lit(1)).alias("met"), F.max("before").alias("before")
        )
        level += 1
        free = F.col("level").isNull() & (F.col("met") == F.col("open"))
        moved = materialise(
            state.join(ready, ["conv_id", "call_id"], "left").select(
                "conv_id", "call_id",
                F.when(free, F.greatest("at", "before")).otherwise(F.col("at")).alias("at"), "open",
                F.when(free, level).otherwise(F.col("level")).alias("level"),
            )
        )
        # Levels are given in order, so a round that frees nothing ends the search.
        if moved.where(F.col("level") == level).isEmpty():
            break
        state = moved
    return state.select("conv_id", "call_id", F.coalesce("level", F.lit(-1)).alias("level"), "at")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows of an id in a conversation as ``nth``; rows without an id, of which there may be many, are all first."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy(*order))
    named = rows.where(F.col("call_id").isNotNull()).withColumn("nth", nth)
    return named.unionByName(rows.where(F.col("call_id").isNull()).withColumn("nth", F.lit(1)))


def format_chat(messages: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Records of all conversations: conv_id, position, kind, status, level, json.

    Kinds: ``message`` (role and text, calls cut out; left out if nothing else was in
    it), ``call`` (id, name, arguments and the linked result) and ``result`` (one that
    no call claims). Status of a call: ``ok``, ``invalid`` (see the JSON's problems),
    ``no_result``, ``cycle``; of a result: ``orphan``, or ``extra`` for the second and
    further results of a call; of a message ``ok``. The first call of an id in a
    conversation owns it; later ones are ``invalid``. ``position`` counts the records
    of a conversation from 0 without gaps.

    Null conversation ids form one conversation; null turns come first; null roles and
    texts are written as null. Calls and results nested more than ``DEPTH`` times are kept
    as text, the calls as ``invalid``; JSON that cannot be read is a call without id. Schemas
    with keywords or types that are not checked are an error. Exactly repeated messages are one message; different
    messages of one turn are ordered by role and text. Further columns are ignored;
    an empty table gives an empty result.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    # A joined null would match nothing, so the key of conversations is never null.
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-"))
    plain = materialise(
        messages.select(key.alias("conv_id"), F.col("conv_id").alias("__conv"), F.coalesce("turn", F.lit(-1)).alias("turn"), "role", "text")
        .distinct()
    )
    parsed = materialise(parse_calls(plain, schemas))
    numbered = _numbered(parsed, ["turn", "place", "name", "arguments"])
    owners = numbered.where("nth = 1 and call_id is not null")
    levels = order_calls(owners)
    results = _numbered(materialise(parse_results(plain)), ["turn", "content"])
    first = results.where("nth = 1 and call_id is not null").select("conv_id", "call_id", "content")
    linked = (
        owners.join(first, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"])
        .unionByName(
            numbered.where("nth > 1 or call_id is null").withColumn("problems", F.concat("problems", F.when(F.col("nth") > 1, F.array(F.lit("id used before"))).otherwise(F.array().cast("array<string>"))))
            .withColumns({"content": F.lit(None).cast("string"), "level": F.lit(0), "at": F.col("turn")})
        )
    )
    status = (
        F.when(F.size("problems") > 0, "invalid").when(F.col("level") < 0, "cycle")
        .when(F.col("content").isNull(), "no_result").otherwise("ok")
    )

    def quoted(c):
        return F.when(F.col(c).isNull(), F.lit("null")).otherwise(_json_string(F.col(c)))

    call_json = F.concat(
        F.lit('{"arguments":'), F.col("arguments"), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"),
        F.when(F.size("problems") > 0, F.concat(F.lit(',"problems":['), F.array_join(F.transform("problems", _json_string), ","), F.lit("]"))).otherwise(F.lit("")),
        F.lit(',"result":'), F.coalesce("content", F.lit("null")), F.lit("}"),
    )
    calls = linked.select(
        "conv_id", F.col("at").alias("turn"), F.lit(1).alias("order"), F.greatest("level", F.lit(0)).alias("rank"), "place",
        F.lit("call").alias("kind"), status.alias("status"), "level", call_json.alias("json"),
    )
    text = F.when(F.col("role") == "assistant", F.trim(F.regexp_replace("text", CALL, ""))).otherwise(F.col("text"))
    said = plain.where(~F.col("role").eqNullSafe("tool")).withColumn("said", text)
    said = said.where(~(F.col("role").eqNullSafe("assistant") & (F.col("said") == "") & F.col("text").contains("<tool_call>")))
    message_json = F.concat(F.lit('{"role":'), quoted("role"), F.lit(',"text":'), quoted("said"), F.lit("}"))
    talk = said.select(
        "conv_id", "turn", F.lit(0).alias("order"), F.lit(0).alias("rank"), F.lit(0).alias("place"),
        F.lit("message").alias("kind"), F.lit("ok").alias("status"), F.lit(0).alias("level"), message_json.alias("json"),
    )
    claimed = owners.select("conv_id", "call_id", F.lit(True).alias("claimed"))
    stray = results.join(claimed, ["conv_id", "call_id"], "left").where("claimed is null or nth > 1")
    left_over = stray.select(
        "conv_id", "turn", F.lit(2).alias("order"), F.lit(0).alias("rank"), F.lit(0).alias("place"), F.lit("result").alias("kind"),
        F.when(F.col("claimed"), "extra").otherwise("orphan").alias("status"), F.lit(0).alias("level"),
        F.concat(F.lit('{"content":'), F.col("content"), F.lit(',"id":'), quoted("call_id"), F.lit("}")).alias("json"),
    )
    records = materialise(talk.unionByName(calls).unionByName(left_over))
    return _positions(records).join(
        plain.select(F.col("conv_id").alias("__key"), "__conv").distinct(), F.col("conv_id") == F.col("__key")
    ).select(F.col("__conv").alias("conv_id"), "position", "kind", "status", "level", "json")


def _json_string(c):
    """A JSON string literal; control characters are escaped as the JSON standard asks."""
    made = F.to_json(F.struct(c.alias("v")))
    return made.substr(F.lit(6), F.length(made) - 6)  # without {"v": and }


def _positions(records: DataFrame) -> DataFrame:
    """0-based place in the conversation, counted over buckets of turns."""
    bucket = F.floor(F.col("turn") / TURNS_PER_BUCKET)
    tagged = records.withColumn("__bucket", bucket)
    sizes = tagged.groupBy("conv_id", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    inner = Window.partitionBy("conv_id", "__bucket").orderBy("turn", "order", "rank", "place", "kind", "json")
    return (
        tagged.withColumn("__row", F.row_number().over(inner) - 1)
        .join(offsets, ["conv_id", "__bucket"])
        .withColumn("position", F.col("__from") + F.col("__row"))
        .drop("__bucket", "__row", "__from")
    )
