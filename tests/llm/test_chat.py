import json

import pytest
from pyspark.sql import functions as F

from undula.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = {"add": {"type": "object", "properties": {"x": {"type": "number", "minimum": 0}, "y": {"type": ["number", "null"]}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 3}, "maxItems": 2}}, "required": ["x", "y"], "additionalProperties": False}}


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows, schemas=None):
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA), schemas).collect()
    return sorted(out, key=lambda r: (r.conv_id is not None, r.conv_id, r.place))


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", result("a", {"k": [1.50, True]})),  # comes before its call
        (1, 2, "assistant", call({"id": "a", "name": "add", "arguments": {"y": 2.0, "x": 1}})),
        (1, 3, "assistant", call({"id": "b", "function": {"name": "add", "arguments": '{"x": -1, "tags": ["long", "b", "c"], "z": 0}'}, "after": ["c"]})),
        (1, 4, "assistant", call({"id": "c", "name": "add", "arguments": {"x": 1, "y": None}})),
        (1, 5, "tool", result("c", "3")),
        (2, 0, "tool", result("zz", "nobody asked")),
        (2, 1, "assistant", call({"id": "q", "name": "other", "arguments": {}}, {"id": "q", "name": "add", "arguments": {"x": 1, "y": 1}})),
    ]
    got = run(spark, rows, TOOLS)
    assert [(r.conv_id, r.turn) for r in got] == [(1, 0), (1, 2), (1, 1), (1, 4), (1, 5), (1, 3), (2, 0), (2, 1)]
    assert [r.place for r in got] == [0, 1, 2, 3, 4, 5, 0, 1]
    assert got[1].message == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"x":1,"y":2},"id":"a","name":"add"}]}' and got[1].valid
    assert got[2].message == '{"content":"{\\"k\\":[1.5,true]}","role":"tool","tool_call_id":"a"}'
    assert set(got[5].problems) == {"b: $.y: missing", "b: $.tags: maxItems is 2", "b: $.tags[0]: maxLength is 3", "b: $.x: minimum is 0", "b: $.z: not allowed", "b: a call without a result"}
    assert got[6].problems == ["zz: a result without a call"]
    assert "q: no schema for other" in got[7].problems


def test_cycles_are_reported(spark):
    rows = [(1, 0, "assistant", call({"id": "a", "name": "f", "arguments": {}, "after": ["b"]})), (1, 1, "assistant", call({"id": "b", "name": "f", "arguments": {}, "after": ["a"]})), (1, 2, "tool", result("a", "")), (1, 3, "tool", result("b", ""))]
    assert all("calls that wait for each other" in r.problems for r in run(spark, rows))


@pytest.mark.parametrize("block", [4096, 7])
def test_long_chains_are_no_cycles(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    n = 70
    turns = list(range(2 * n))[::-1]  # every message comes before what it waits for
    rows = []
    for i in range(n):
        rows += [(1, turns[2 * i], "assistant", call({"id": str(i), "name": "f", "arguments": {}, "after": [str(i - 1)] if i else []})), (1, turns[2 * i + 1], "tool", result(str(i), ""))]
    # a cycle, a call that waits for it, and one that the cycle waits for
    for i, after in (("p", []), ("a", ["b", "p"]), ("b", ["a"]), ("z", ["b"])):
        rows += [(2, len(rows), "assistant", call({"id": i, "name": "f", "arguments": {}, "after": after})), (2, len(rows) + 1, "tool", result(i, ""))]
    got = run(spark, rows)
    chain = [r for r in got if r.conv_id == 1]
    assert [r.turn for r in chain] == turns and all(r.valid for r in chain)
    assert [r.valid for r in got if r.conv_id == 2] == [True] * 2 + [False] * 6


def test_no_content_is_dropped(spark):
    odd = [{"name": "no id", "arguments": {"x": 1.0}}, {"id": "n"}, "text", {"id": "e", "name": "f", "arguments": {}, "after": ["a", 5], "note": {"b": 1, "a": 2}}]
    nested = {"id": "g", "type": "function", "index": 0, "function": {"name": "f", "arguments": "{}", "strict": True}}
    rows = [
        (1, 0, "assistant", json.dumps({"content": "c", "reasoning": "why", "name": "x", "role": "assistant", "tool_calls": odd})),
        (1, 1, "tool", json.dumps({"tool_call_id": "e", "content": "r", "is_error": True, "metadata": {"t": [1, 2.0]}, "name": "f"})),
        (1, 2, "assistant", json.dumps({"tool_calls": [nested], "score": float("nan")})),
        (1, 3, "tool", json.dumps({"tool_call_id": "g", "content": "", "role": "user"})),
        (1, 4, "assistant", json.dumps({"content": None, "tool_calls": [{"id": "h", "name": "f", "function": {"name": "g"}}]})),
        (1, 5, "assistant", json.dumps({"content": "d", "tool_calls": [], "refusal": None})),
    ]
    got = run(spark, rows)
    messages = [json.loads(r.message) for r in got]
    assert messages[0] == {"role": "assistant", "content": "c", "reasoning": "why", "name": "x", "tool_calls": odd}
    assert got[0].problems == ["a call without an id or a name"]
    assert messages[1] == {"role": "tool", "tool_call_id": "e", "content": "r", "is_error": True, "metadata": {"t": [1, 2]}, "name": "f"} and got[1].valid
    assert messages[2] == {"role": "assistant", "content": None, "score": "nan", "tool_calls": [{"id": "g", "type": "function", "index": 0, "name": "f", "arguments": {}, "strict": True}]} and got[2].valid
    assert messages[3]["role"] == "tool" and messages[3]["role_in_text"] == "user" and got[3].problems == ["another role in the text"]
    assert messages[4]["tool_calls"] == [{"id": "h", "name": "f", "function": {"name": "g"}}] and "a call that gives a key twice" in got[4].problems
    assert messages[5] == {"role": "assistant", "content": "d", "tool_calls": [], "refusal": None} and got[5].valid


def test_the_query_validates_against_declared_tools(spark, tmp_path):
    from undula.llm import queries

    def tools(*given):
        return json.dumps({"content": "be helpful", "tools": list(given)})

    f = {"type": "object", "properties": {"x": {"type": "number"}}, "required": ["x"]}
    rows = [
        (1, 0, "system", tools({"type": "function", "function": {"name": "f", "parameters": {"type": "string"}}}, {"name": "bad", "parameters": {"type": 5}})),
        (1, 1, "developer", tools({"name": "f", "parameters": f})),  # the last one counts
        (2, 0, "user", tools({"name": "f", "parameters": f})),  # users declare nothing
    ]
    given = [("f", {"x": 1}), ("f", {}), ("f", {"x": "1"}), ("g", {"x": 1}), ("bad", 1)]
    for i, (name, arguments) in enumerate(given):
        for conv in (1, 2):
            rows += [(conv, 10 + 2 * i, "assistant", call({"id": str(i), "name": name, "arguments": arguments})), (conv, 11 + 2 * i, "tool", result(str(i), ""))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r.valid for r in queries.op10_chat(spark, str(tmp_path)).collect()}
    assert [got[1, 10 + 2 * i] for i in range(5)] == [True, False, False, False, False]
    assert all(valid for (conv, turn), valid in got.items() if conv == 2 or turn < 2 or turn % 2)
    problems = {r.turn: r.problems for r in run(spark, rows, {"g": {"required": ["y"]}}) if r.conv_id == 1}
    assert problems[12] == ["1: $.x: missing"] and problems[14] == ["2: $.x: not of type number"] and problems[16] == ["3: $.y: missing"] and problems[18] == ["4: a schema that can't be read"]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (3, 0, "tool", "garbage"), (3, 1, "assistant", "{not json"), (3, 2, "assistant", '{"tool_calls": 5}'), (3, 2, "assistant", '{"tool_calls": 5}'), (3, None, "user", ""), (3, 4, "user", "x" * 100_000), (3, 5, "assistant", call({"id": 1, "name": "f"}))]
    got = run(spark, rows)
    assert len(got) == len(rows) and got[0].message == '{"content":null,"role":null}'
    assert [r.place for r in got[1:]] == list(range(7)) and got[1].turn is None
    assert [r.valid for r in got if r.turn in (0, 5)] == [False, False]
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversations_are_placed_by_blocks(spark):
    rows = [(1, t, "user", str(t)) for t in range(1500)]
    assert [json.loads(r.message)["content"] for r in run(spark, rows)] == [str(t) for t in range(1500)]


def test_canonical_json():
    assert chat.canonical({"b": 1.0, "a": [None, True, "é"]}) == '{"a":[null,true,"é"],"b":1}'
    assert chat.canonical(json.loads('{"a":1e2}')) == chat.canonical({"a": 100})
    with pytest.raises(ValueError):
        chat.canonical(float("nan"))
    assert chat.violations({"a": 1}, {"properties": {"a": {"enum": [1.0, 2]}}}) == []
    assert chat.violations(True, {"type": "integer"}) and not chat.violations(3.0, {"type": "integer"}) and chat.violations("x", {"const": "y"})


def test_many_messages_of_one_turn(spark, monkeypatch):
    """Repeated and null turns: places have no gaps and follow the order of small blocks."""
    rows = [(1, None, "user", f"n{i}") for i in range(40)] + [(1, 7, "user", f"s{i}") for i in range(50)] + [(2, i, "user", "x") for i in range(30)] + [(None, 3, "user", "y")] * 25
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("row", "block", "first", "sort", "place")})
    df.cache().count()
    want = sorted((str(r.conv_id), r.place, str(r.turn)) for r in chat.format_chats(df).collect())
    monkeypatch.setattr(chat, "LARGE_BLOCK", 20)
    got = chat.format_chats(df).collect()
    assert sorted((str(r.conv_id), r.place, str(r.turn)) for r in got) == want and len(got) == len(rows)
    for key, n in ((1, 90), (2, 30), (None, 25)):
        assert sorted(r.place for r in got if r.conv_id == key) == list(range(n))


def test_plain_tables_and_generated_traces(spark, rng):
    """Generated tool traces against an order made by hand: repeatedly the earliest message that waits for nothing."""
    rows, want = [], {}
    for conv in range(6):
        n = rng.randint(3, 40)
        calls = [{"id": str(i), "name": "f", "arguments": {}, "after": [str(j) for j in range(i) if rng.random() < 2 / (i + 1)]} for i in range(n)]
        turns = list(range(2 * n))
        rng.shuffle(turns)
        edges = {}
        for i, c in enumerate(calls):
            edges[turns[2 * i]] = {turns[2 * int(j) + 1] for j in c["after"]}
            edges[turns[2 * i + 1]] = {turns[2 * i]}
            rows += [(conv, turns[2 * i], "assistant", call(c)), (conv, turns[2 * i + 1], "tool", result(str(i), "r"))]
        late, deep = {}, {}

        def settle(t, edges=edges, late=late, deep=deep):
            if t not in late:
                late[t], deep[t] = t, 0
                for e in edges[t]:
                    settle(e, edges, late, deep)
                    late[t], deep[t] = max(late[t], late[e]), max(deep[t], deep[e] + 1)
            return late[t], deep[t], t

        want[conv] = sorted(turns, key=settle)
    got = run(spark, rows)
    for conv in want:
        own = [r for r in got if r.conv_id == conv]
        assert [r.turn for r in own] == want[conv] and all(r.valid for r in own)
        for r in own:
            assert r.message == chat.canonical(json.loads(r.message))
