import json

import duckdb
import pytest

from llm_cases import records  # noqa: F401
from locusframe.llm import queries
from locusframe.llm.tool_calls import canonical, extract, link, violations

SCHEMA = {"t": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}}


def message(conv, turn, text, **extra):
    return (conv, turn, text if isinstance(text, str) or text is None else json.dumps(text), "clash", 1)


def call(i, name="t", arguments='{"a": 1}', after=None):
    return {"tool_calls": [{"id": i, "after": after, "function": {"name": name, "arguments": arguments}}]}


def linked(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string, key string, depth int").repartition(3)
    return {(r.conv_id, r.call_id): r for r in link(*extract(frame), SCHEMA).collect()}


def test_cases(spark):
    got = linked(spark, [
        message(1, 5, {"tool_call_id": "b", "content": "result b"}), message(1, 1, call("a")), message(1, 2, call("b", after="a")),
        message(1, 3, {"tool_call_id": "a", "content": "first"}), message(1, 4, {"tool_call_id": "a", "content": "second"}),
        message(1, 6, call("c", after="nowhere", arguments="{bad")), message(1, 7, {"tool_call_id": "zz", "content": None}),
        message(1, 0, call("late", after="b")), message(2, 0, call("x", after="y")), message(2, 1, call("y", after="x")),
        message(2, 2, call("w", after="x")), message(2, 3, call("self", after="self")), message(2, 4, "plain text"), message(2, 5, None),
        message(None, 1, call("a", arguments='{"a": "no"}')), message(3, 1, call("a")), message(3, 2, call("a", name="other")),
        message(3, 3, call(None)), message(3, 4, {"tool_calls": []}), message(3, 5, call("deep", arguments="[" * 5000 + "]" * 5000)),
    ])
    def seen(c, i):
        r = got[c, i]
        return r.status, r.depth, r.position, r.valid, r.n_calls, r.n_results
    assert seen(1, "a") == ("linked", 0, 0, True, 1, 2) and json.loads(got[1, "a"].json)["result"] == "first"
    assert seen(1, "b")[:4] == ("linked", 1, 3, True) and seen(1, "late")[:3] == ("unanswered", 2, 4)
    assert seen(1, "c")[:4] == ("unanswered", 0, 1, False) and seen(1, "zz") == ("orphan", 0, 2, False, 0, 1)
    assert [got[2, k].status for k in ("x", "y", "w", "self")] == ["cyclic"] * 4 and got[2, "x"].depth is None
    assert got[None, "a"].valid is False and seen(3, "a") == ("unanswered", 0, 0, True, 2, 0)
    assert seen(3, None)[0] == "unanswered" and got[3, "deep"].valid is False
    assert got[1, "a"].json == '{"after":null,"arguments":{"a":1},"id":"a","name":"t","result":"first"}'


def test_long_chain_in_one_conversation(spark):
    rows = [message(1, k, call(f"c{k}", after=f"c{k - 1}")) for k in range(300)]
    got = linked(spark, rows)
    assert all(got[1, f"c{k}"].depth == got[1, f"c{k}"].position == k for k in range(300))


def test_empty_and_nulls(spark):
    assert linked(spark, []) == {}
    none = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert link(*extract(queries.tool_messages(none)), queries.TOOL_SCHEMAS).count() == 0


def test_odd_conversations_equal_the_sql(spark, tmp_path):
    texts = ["", "short", 'quotes " and \\ and \n lines\t', "é\U0001f642   \x7f \x01", "x" * 100_000, None]
    rows = [(c, t, ("system", "user", "assistant")[0 if t == 0 and c % 2 else 1 + (t + c) % 2], texts[(c + t) % 6]) for c in range(6) for t in range(12)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op5_tool_calls"])
    names = [d[0] for d in want.description]
    got = link(*extract(queries.tool_messages(frame)), queries.TOOL_SCHEMAS).select(*names)
    assert records(got) == sorted((tuple("null" if v is None else v for v in r) for r in want.fetchall()), key=repr)


def test_canonical_json():
    assert canonical({"b": 1.0, "a": [True, None, "é\n"], "\U0001f642": 1, "～": 0.5}) == '{"a":[true,null,"é\\n"],"b":1,"\U0001f642":1,"～":0.5}'
    assert canonical("\ud800x") == '"?x"'


@pytest.mark.parametrize("value, schema, bad", [
    (True, {"type": "integer"}, 1), (2.0, {"type": "integer"}, 0), ("ab", {"minLength": 3}, 1), ([1, "x"], {"items": {"type": "number"}}, 1),
    ({"a": 1, "z": 2}, {"properties": {"a": {"maximum": 0}}, "additionalProperties": False}, 2), (None, {"type": ["null", "string"]}, 0),
    (1, {"enum": [True]}, 1), ([1, 2], {"maxItems": 1}, 1)])
def test_violations(value, schema, bad):
    assert len(violations(value, schema)) == bad
