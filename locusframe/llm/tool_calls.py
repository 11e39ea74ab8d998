"""Tool calls of conversations: link calls with their results, order them, validate arguments, serialise canonical JSON.

Calls and results meet in a hash join by conversation and identifier: both sides are dealt by them, and each task builds a hash table of its
share of the results. A call may name another one whose result it needs; these
references form a forest, whose depths are found by pointer doubling: every round joins each open reference with the reference of
its target, so chains of any length take a logarithmic number of rounds, and whatever is still open when a round settles nothing lies on a
cycle. Depth, then turn, is a topological order; positions are counted per run of turns, so a conversation may hold any share of all rows.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from locusframe.functions.ranking import with_row_index
from locusframe.llm.common import materialise

_MESSAGE = ("struct<tool_calls: array<struct<id: string, after: string, function: struct<name: string, arguments: string>>>, "
            "tool_call_id: string, content: string>")
TURN_RUN = 4096


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages ``conv_id, turn, text`` whose text is a JSON message.

    A message with ``tool_calls`` makes calls (``id``, ``after``: the call whose result it needs, ``function.name`` and ``function.arguments``, a JSON
    text); one with ``tool_call_id`` is a result with ``content``. Other texts make neither.
    """
    parsed = messages.select("conv_id", "turn", F.from_json("text", _MESSAGE).alias("m"))
    calls = parsed.select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).where("c is not null").select(
        "conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name"),
        F.col("c.function.arguments").alias("arguments"), F.col("c.after").alias("after"))
    results = parsed.where("m.tool_call_id is not null").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"),
                                                                F.col("m.content").alias("content"))
    return calls, results


def _utf16(key: str) -> bytes:
    return key.encode("utf-16-be", "surrogatepass")


def canonical(value) -> str:
    """JSON with keys sorted by UTF-16 units, no blanks, whole floats as integers, and lone surrogates replaced."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=_utf16)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        value = int(value)
    if isinstance(value, str):
        value = value.encode("utf-8", "replace").decode() if any(0xD800 <= ord(c) < 0xE000 for c in value) else value
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer") and isinstance(value, bool):
        return False
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _KINDS[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema: types, enumerations, bounds, required and unknown properties, items."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    if "enum" in schema and not any(value == e and isinstance(value, bool) == isinstance(e, bool) for e in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: out of bounds")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        out.append(f"{at}: length")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: number of items")
        for i, item in enumerate(value if "items" in schema else ()):
            out += violations(item, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} missing" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}: {k} unknown")
    return out


def _no_constant(name: str):
    raise ValueError(name)


def _check(schemas: dict[str, dict]):
    """A function of one call's fields to ``valid, errors, json``."""

    @arrow_udf("valid boolean, errors string, json string")
    def check(ids: pa.Array, names: pa.Array, arguments: pa.Array, after: pa.Array, content: pa.Array) -> pa.Array:
        valid, errors, texts = [], [], []
        for i, name, text, up, result in zip(*(c.to_pylist() for c in (ids, names, arguments, after, content))):
            try:
                value = json.loads(text if text is not None else "", parse_constant=_no_constant)
                found = violations(value, schemas[name]) if name in schemas else [f"no schema for {name}"]
                canonical(value)
            except (ValueError, RecursionError):  # no JSON, or nested beyond what Python follows
                value, found = text, ["arguments aren't JSON"]
            valid.append(not found)
            errors.append("; ".join(found))
            texts.append(canonical({"id": i, "name": name, "arguments": value, "after": up, "result": result}))
        return pa.StructArray.from_arrays([pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(texts, pa.string())],
                                          ["valid", "errors", "json"])

    return check


def depths(calls: DataFrame) -> DataFrame:
    """``key, depth`` for calls ``key, up`` (the key of the call that it needs, or null): steps to the start of its chain.

    A reference to a key that isn't there counts as none. Calls on a cycle, or that need one on a cycle, have a null depth.
    """
    known = calls.select(F.col("key").alias("up"))
    jumps = materialise(calls.join(known.withColumn("_there", F.lit(1)).hint("shuffle_hash"), "up", "left").select(
        "key", F.when(F.col("_there") == 1, F.col("up")).alias("up"), F.coalesce("_there", F.lit(0)).cast("long").alias("depth")))
    still = None
    while (now := jumps.where("up is not null").count()) and now != still:
        still = now
        done = jumps.where("up is null")
        target = jumps.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = jumps.where("up is not null").join(target.hint("shuffle_hash"), "up").select("key", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        jumps = materialise(done.unionByName(moved))
    return jumps.select("key", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _key(call: str) -> Column:
    """Conversation and identifier as one text; a null identifier has no key."""
    return F.when(F.col(call).isNotNull(), F.to_json(F.struct(F.col("conv_id").alias("c"), F.col(call).alias("i"))))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per identifier of a conversation, from ``calls`` and ``results`` as ``extract`` makes them.

    Columns: ``conv_id, call_id, turn, name, depth, position, status, valid, errors, n_calls, n_results, json``. ``position`` (from 0) counts a
    conversation's rows in the order of depth, turn and identifier. Status: ``linked``; ``unanswered`` (no result); ``orphan`` (a result
    without a call: no name, never valid); ``cyclic`` (needs itself by its references: depth null, placed last). Of calls or
    results that share an identifier the earliest stands (ties: the smallest fields), and ``n_calls``, ``n_results`` tell how many there
    were. Calls without identifier can't be told apart and are one row with a null ``call_id``; results without one likewise. ``json`` holds
    ``after, arguments, id, name, result``; arguments that aren't JSON stay a string there and aren't valid.
    """
    call_rows = calls.select("conv_id", "call_id", F.struct("turn", "name", "arguments", "after").alias("_c"))
    one = call_rows.groupBy("conv_id", "call_id").agg(F.min("_c").alias("_c"), F.count(F.lit(1)).alias("n_calls"))
    got = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("_r"), F.count(F.lit(1)).alias("n_results"))
    got = got.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), "_r", "n_results")
    # without an identifier nothing is linked, so the equality of identifiers leaves nulls apart on both sides
    same = F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri"))
    both = one.join(got.hint("shuffle_hash"), same, "full_outer").select(
        F.when(F.col("n_calls").isNull(), F.col("rc")).otherwise(F.col("conv_id")).alias("conv_id"), F.coalesce("call_id", "ri").alias("call_id"),
        "_c.name", "_c.arguments", "_c.after", F.coalesce("_c.turn", "_r.turn").alias("turn"), F.col("_r.content").alias("content"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"))
    both = materialise(both.withColumn("key", _key("call_id")).withColumn("up", F.when(F.col("after") != "", _key("after"))))
    levels = depths(both.where("key is not null and n_calls > 0").select("key", "up"))
    levels = levels.select(F.col("key").alias("_k"), F.col("depth").alias("_d"))
    placed = both.join(levels.hint("shuffle_hash"), F.col("key") == F.col("_k"), "left").withColumn(
        "depth", F.when(F.col("_k").isNull(), F.lit(0).cast("long")).otherwise(F.col("_d"))).drop("_k", "_d")
    status = F.when(F.col("n_calls") == 0, "orphan").when(F.col("depth").isNull(), "cyclic").when(F.col("n_results") == 0, "unanswered").otherwise("linked")
    checked = placed.withColumn("status", status).withColumn(
        "_v", _check(schemas)("call_id", "name", "arguments", "after", "content")).select(
        "conv_id", "call_id", "turn", "name", "depth", "status", (F.col("_v.valid") & (F.col("n_calls") > 0)).alias("valid"),
        F.when(F.col("n_calls") > 0, F.col("_v.errors")).otherwise("no call").alias("errors"), "n_calls", "n_results", F.col("_v.json").alias("json"))
    ordered = materialise(checked).withColumns({"_conv": F.to_json(F.struct("conv_id")), "_depth": F.coalesce("depth", F.lit((1 << 31) - 1)),
                                                "_turn": F.coalesce("turn", F.lit(-1)).cast("long")})
    run = F.col("_depth") * (1 << 31) + F.floor(F.col("_turn") / TURN_RUN)
    return with_row_index(ordered, ["_depth", "_turn", "call_id", "n_calls"], run, by=("_conv",), name="position").drop("_conv", "_depth", "_turn")
