import json

from lodestar.llm import tool_calls as t

TOOLS = {
    "add": t.Tool({"a": t.Parameter("integer", True, least=0), "b": t.Parameter("number", True, most=9.5)}),
    "say": t.Tool({"text": t.Parameter("string", True, least=2, most=5), "tone": t.Parameter("string", choices=("low", "high")), "tags": t.Parameter("array"), "more": t.Parameter("object"), "now": t.Parameter("boolean")}, closed=False),
}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "function": {"name": n, "arguments": a if isinstance(a, str) else json.dumps(a)}} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def link(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return t.link(t.from_messages(df), TOOLS).orderBy("conv_id", "position").collect()


def test_results_follow_their_calls(spark):
    rows = [
        (1, 0, "user", "please"), (1, 1, "assistant", call(("x", "add", {"b": 2.5, "a": 1}), ("y", "say", {"text": "hey"}))),
        (1, 2, "tool", result("y", "said")), (1, 3, "user", "well"), (1, 4, "tool", result("x", "3.5")), (1, 5, "tool", result("z", "?")),
        (2, 0, "assistant", call(("x", "add", {"a": 1, "b": 1}))), (2, 1, "assistant", call(("x", "add", {"a": 2, "b": 1}))), (2, 2, "tool", result("x", None)),
    ]
    out = link(spark, rows)
    assert [(r["conv_id"], r["kind"], r["call_id"], r["state"], r["position"]) for r in out] == [
        (1, "message", None, "ok", 0), (1, "call", "x", "ok", 1), (1, "result", "x", "ok", 2), (1, "call", "y", "ok", 3), (1, "result", "y", "ok", 4),
        (1, "message", None, "ok", 5), (1, "result", "z", "orphan", 6), (2, "call", "x", "ok", 0), (2, "result", "x", "ok", 1), (2, "call", "x", "duplicate", 2),
    ]
    assert out[1]["json"] == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","role":"assistant"}'
    assert json.loads(out[2]["json"]) == {"content": "3.5", "id": "x", "role": "tool"}
    assert out[8]["json"] == '{"content":"","id":"x","role":"tool"}'


def test_arguments_are_checked(spark):
    cases = [
        ({"a": 1, "b": 2}, []), ({"a": -1, "b": 2}, ["a is below 0"]), ({"a": 1.5, "b": 10}, ["a is no integer", "b is above 9.5"]),
        ({"a": None}, ["a is missing", "b is missing"]), ({"a": 1, "b": 1, "c": 0, "B": 1}, ["unknown: B, c"]), ("[1]", ["arguments are no JSON object"]), ("{", ["arguments are no JSON object"]),
    ]
    rows = [(1, k, "assistant", call((f"i{k}", "add", a))) for k, (a, _) in enumerate(cases)]
    assert [list(r["errors"]) for r in link(spark, rows)] == [e for _, e in cases]
    rows = [(1, 0, "assistant", call(("p", "say", {"text": "x", "tone": "mid", "tags": {}, "more": [], "now": 1, "else": 2}), ("q", "none", {}), ("r", "say", {"text": "okay", "tone": "low", "tags": [], "more": {}, "now": True})))]
    got = link(spark, rows)
    assert list(got[0]["errors"]) == ["more is no object", "now is no boolean", "tags is no array", "text is below 2", "tone is none of the choices"]
    assert list(got[1]["errors"]) == ["no schema for none"] and list(got[2]["errors"]) == []
    assert all(r["state"] == "unanswered" for r in got)


def test_odd_messages(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, 2, "user", "{not json"), (1, 3, "user", '{"a": 1}'), (1, 4, "user", 'q"\\\n é🙂'), (1, 4, "user", 'q"\\\n é🙂'), (None, 0, "user", "x"), (1, None, "user", "y"), (1, 9, "user", "z" * 100_000)]
    out = link(spark, rows)
    assert len(out) == len(rows) and all(r["kind"] == "message" and r["state"] == "ok" for r in out)
    texts = sorted(json.loads(r["json"])["content"] for r in out)
    assert texts == sorted((r[3] or "") for r in rows)
    assert link(spark, []) == []


def test_long_conversations_are_numbered_throughout(spark):
    rows = [(1, k, "user", str(k)) for k in range(2000)]
    assert [(r["position"], json.loads(r["json"])["content"]) for r in link(spark, rows)] == [(k, str(k)) for k in range(2000)]
    extra = spark.createDataFrame([(*rows[0], "a", "b")], "conv_id long, turn long, role string, text string, state string, n long" .replace("n long", "n string"))
    assert t.link(t.from_messages(extra), TOOLS).count() == 1


def test_calls_and_results_meet_in_a_hash_join(spark, data):
    from lodestar.llm.registry import op6_link_tool_calls

    text = op6_link_tool_calls(spark, f"{data}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "Join [" in line and "call_id" in line]
    assert joins and all("ShuffledHashJoin" in line for line in joins)
