import json

from gristmill.llm import chat

KIND = ("conv_id long, turn long, role string, text string, tool_calls array<struct<id:string,name:string,"
        "arguments:string,needs:array<string>>>, tool_call_id string, position int, status string")
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False), "tags": ("array", False)}, "ping": {}}


def call(i, name="add", arguments='{"a": 1}', needs=()):
    return (i, name, arguments, list(needs))


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], KIND)
    return [r.asDict() for r in chat.format_chats(df, SCHEMAS).orderBy("conv_id", "position").collect()]


def test_links_order_and_json(spark):
    rows = [
        (1, 0, "user", "say \"hi\"\n", None, None),
        (1, 1, "tool", "late", None, "c2"),
        (1, 2, "assistant", None, [call("c1", arguments='{ "b": 2.50, "a" : 7 }'), call("c2", "ping", "{}")], None),
        (1, 3, "tool", "3", None, "c1"),
        (1, 4, "tool", "?", None, "nowhere"),
        (1, 5, "assistant", "open", [call("c9", "ping", "{}")], None),
    ]
    found = run(spark, rows)
    assert [(r["turn"], r["position"], r["status"]) for r in found] == [
        (0, 0, "plain"), (2, 1, "answered"), (1, 2, "linked"), (3, 3, "linked"), (4, 4, "orphan"), (5, 5, "open")]
    assert found[0]["message"] == '{"content":"say \\"hi\\"\\n","role":"user"}'
    told = json.loads(found[1]["message"])
    assert list(told) == sorted(told) == ["content", "role", "tool_calls"]
    assert [c["arguments"] for c in told["tool_calls"]] == ['{"a":7,"b":2.5}', "{}"]
    assert found[2]["message"] == '{"content":"late","role":"tool","tool_call_id":"c2"}'


def test_arguments(spark):
    cases = {
        '{"a": 1}': "", '{"a": "1"}': "x: a is no integer", '{"b": 1.5}': "x: a is missing", "[1]": "x: no object",
        "{": "x: no JSON", '{"a": 1, "z": 2}': "x: z is not known", '{"a": 1, "b": true, "tags": []}': "x: b is no number",
        '{"a": 2, "b": 3, "tags": ["u"]}': "", '{"a": null}': "x: a is no integer", None: "x: no JSON"}
    rows = [(i, 0, "assistant", "", [call("x", arguments=a)], None) for i, a in enumerate(cases)]
    assert [r["errors"] for r in run(spark, rows)] == list(cases.values())
    assert run(spark, [(1, 0, "assistant", "", [call("x", "fly")], None)])[0]["errors"] == "x: unknown tool"


def test_needs_and_cycles(spark):
    rows = [
        (1, 0, "assistant", "first", [call("a", needs=["b"])], None),
        (1, 1, "assistant", "second", [call("b", needs=["c", "missing"])], None),
        (1, 2, "assistant", "third", [call("c")], None),
        (2, 0, "assistant", "p", [call("p", needs=["q"])], None),
        (2, 1, "assistant", "q", [call("q", needs=["p"])], None),
    ]
    found = run(spark, rows)
    assert [json.loads(r["message"])["content"] for r in found] == ["third", "second", "first", "p", "q"]
    assert {r["status"] for r in found[3:]} == {"unordered"}


def test_odd_inputs(spark):
    rows = [
        (None, None, None, None, None, None), (None, 3, "user", "", [], None), (1, 0, "tool", "r", None, "x"),
        (1, 0, "tool", "r", None, "x"), (1, 0, "assistant", "", [call("x"), call("x"), call(None)], None),
        (1, 5000, "user", "z" * 10000, None, None), (1, None, "user", "early", None, None)]
    found = run(spark, rows)
    assert len(found) == len(rows)
    for conv in (None, 1):
        own = [r for r in found if r["conv_id"] == conv]
        assert [r["position"] for r in own] == list(range(len(own)))
    assert [r["turn"] for r in found if r["conv_id"] == 1] == [None, 0, 0, 0, 5000]
    assert run(spark, []) == []


def test_query_rows(spark, small):
    from gristmill.llm import queries

    rows = queries.REGISTRY["op6_chat_formatting"](spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/conversations.parquet").count()
    assert {r["status"] for r in rows} >= {"linked", "answered", "plain"}
    for r in rows:
        message = json.loads(r["message"])
        assert json.dumps(message, separators=(",", ":"), sort_keys=True, ensure_ascii=False) == r["message"]
        if r["turn"] == 5 and r["role"] == "assistant":
            assert "length is no integer" in r["errors"]
