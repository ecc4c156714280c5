import json

from quirework.llm import chat_tools as C

SCHEMAS = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("find", "q", "string", True), ("find", "tags", "array", False), ("find", "where", "object", None), ("find", "deep", "boolean", False)]


def call(i, name, args):
    return {"id": i, "name": name, "arguments": args}


def said(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 0, "user", 'Add "one"\n é'),
    (1, 1, "assistant", said(call("c1", "add", {"b": 2.5, "a": 1}), call("c2", "find", json.dumps({"q": "x", "tags": [1, 2], "where": {"z": 1, "a": None}, "deep": True})), content="so")),
    (1, 2, "tool", result("c2", "found")),
    (1, 3, "tool", result("c1", "3.5")),
    (1, 4, "assistant", said(call("c3", "find", {"q": "$call:c1 and $call:c2"}))),
    (1, 5, "tool", result("c3", "late")),
    (2, 0, "tool", result("early", "before its call")),
    (2, 1, "assistant", said(call("early", "add", {"a": 1, "b": 1}))),
    (2, 2, "assistant", said(call("early", "add", {"a": 1, "b": 1}), call("x1", "add", {"a": "1", "b": 1}), call("x2", "add", {"b": 1}), call("x3", "add", {"a": 1, "b": 1, "k": 1}), call("x4", "nope", {}), call("x5", "add", "[1]"), call("x6", "add", "{broken"), call(None, "add", {"a": 1, "b": 1}))),
    (2, 3, "tool", result("early", "again")),
    (2, 4, "tool", result("ghost", "nobody asked")),
    (3, 0, "assistant", said(call("p", "find", {"q": "$call:q"}), call("q", "find", {"q": "$call:p"}), call("d", "find", {"q": "$call:zzz"}), call("u", "find", {"q": "y"}))),
    (3, 1, "tool", result("p", "1")),
    (3, 2, "tool", result("q", "2")),
    (3, 3, "tool", result("d", "3")),
    (4, 0, "assistant", said(call("k3", "find", {"q": "$call:k2"}), call("k2", "find", {"q": "$call:k1"}), call("k1", "find", {"q": "z"}))),
    (4, 1, "tool", result("k3", "a")),
    (4, 1, "tool", result("k2", "b")),
    (4, 1, "tool", result("k1", "c")),
    (5, 0, None, None),
    (5, 1, "user", "{not json"),
    (5, 2, "tool", "plain tool text"),
    (None, 0, "assistant", said(call("n", "find", {"q": "y"}))),
    (None, 1, "tool", result("n", "y")),
]


def run(spark):
    rows = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, status int").repartition(4)
    return C.events(rows, spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean"))


def test_links_orders_and_validates(spark):
    found = run(spark).collect()
    status = {(r.conv_id, r.kind, r.call_id, r.turn): r.status for r in found}
    of = lambda conv, kind, i, turn: status[conv, kind, i, turn]
    assert [of(1, "call", i, 1) for i in ("c1", "c2")] == ["ok", "ok"] and of(1, "call", "c3", 4) == "ok"
    assert of(2, "call", "early", 1) == "ok" and of(2, "call", "early", 2) == "duplicate"
    assert [of(2, "call", f"x{k}", 2) for k in range(1, 7)] == ["wrong_type", "missing_parameter", "unknown_parameter", "unknown_tool", "malformed", "malformed"]
    assert of(2, "call", None, 2) == "malformed"
    assert of(2, "result", "early", 0) == "ok" and of(2, "result", "early", 3) == "duplicate" and of(2, "result", "ghost", 4) == "orphan"
    assert [of(3, "call", i, 0) for i in "pqdu"] == ["cyclic", "cyclic", "dangling", "unanswered"]
    assert of(None, "call", "n", 0) == "unanswered" and of(None, "result", "n", 1) == "orphan"
    # a message for each row but the results, and no other row
    assert sum(r.kind == "message" and r.status == "plain" for r in found) == sum(not (role == "tool" and (text or "").startswith("{")) for _, _, role, text in ROWS)
    assert sum(r.kind == "result" for r in found) == sum(role == "tool" and (text or "").startswith("{") for _, _, role, text in ROWS)
    assert sum(r.kind == "call" for r in found) == sum(len(json.loads(text)["tool_calls"]) for _, _, role, text in ROWS if role == "assistant")
    place = lambda r: (r.order_turn, r.order_depth, r.turn, r.part, r.kind)
    for conv in (1, 2, 3, 4):
        calls = {r.call_id: place(r) for r in found if r.conv_id == conv and r.kind == "call" and r.status != "duplicate"}
        for r in found:
            if r.conv_id == conv and r.kind == "result" and r.call_id in calls:
                assert place(r) > calls[r.call_id]
    mine = {(r.kind, r.call_id): place(r) for r in found if r.conv_id == 4}
    assert mine["call", "k1"] < mine["result", "k1"] < mine["call", "k2"] < mine["result", "k2"] < mine["call", "k3"] < mine["result", "k3"]


def test_json_is_canonical(spark):
    found = run(spark).collect()
    for r in found:
        value = json.loads(r.json)
        assert r.json == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    texts = {(r.conv_id, r.turn): json.loads(r.json)["content"] for r in found if r.kind == "message"}
    assert texts[1, 0] == 'Add "one"\n é' and texts[1, 1] == "so" and texts[5, 0] is None and texts[5, 1] == "{not json" and texts[5, 2] == "plain tool text"
    lines = {r.conv_id: r.lines.split("\n") for r in C.conversation_lines(run(spark)).collect()}
    assert len(lines[1]) == 9 and json.loads(lines[1][0])["role"] == "user"


def test_numbers_have_one_form(spark):
    forms = {"1e2": "100", "100": "100", "100.0": "100", "-0.0": "0", "-0": "0", "2.50": "2.5", "0.1": "0.1", "1E10": "10000000000", "12345678901234567890123": "12345678901234567890123", "1e300": "1.0E300", "1.5e-3": "0.0015", "1e-9": "1.0E-9", "0.000000001": "1.0E-9", '"1e2 \\" 3.0"': '"1e2 \\" 3.0"', "[1.0,{}]": "[1,{}]"}
    rows = [(k, 0, "assistant", '{"tool_calls":[{"id":"a","name":"t","arguments":{"y":%s,"e":true}}]}' % raw) for k, raw in enumerate(forms)]
    found = C.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    assert {list(forms)[r.conv_id]: r.json for r in found} == {raw: '{"arguments":{"e":true,"y":%s},"id":"a","name":"t"}' % one for raw, one in forms.items()}


def test_repeated_messages_and_schemas(spark):
    rows = [(1, 0, "assistant", said(call("a", "add", {"a": 1}), call("b", "none", {}))), (1, 1, "tool", result("a", "x")), (1, 2, "tool", result("b", "y"))] * 2
    schemas = [("add", "a", "integer", None), ("add", "a", "string", True), ("add", "a", "integer", True), (None, "a", "integer", True), ("add", None, None, None), ("none", None, None, None)]
    found = C.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame(schemas, "tool string, param string, type string, required boolean")).collect()
    assert len(found) == 2 * (1 + 2 + 2)
    assert {(r.kind, r.call_id, r.status) for r in found} == {("message", None, "plain"), ("call", "a", "ok"), ("call", "b", "ok"), ("result", "a", "ok"), ("result", "b", "ok")}


def test_long_chains_and_texts(spark):
    n = 12
    rows = [(1, 0, "assistant", said(*(call(f"c{k}", "find", {"q": f"$call:c{k + 1}" if k + 1 < n else "end " * 100_000}) for k in range(n)))), (1, 1, "user", "long " * 200_000)]
    found = C.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean")).collect()
    depth = {r.call_id: r.order_depth for r in found if r.kind == "call"}
    assert [depth[f"c{k}"] for k in range(n)] == list(range(n - 1, -1, -1))
    assert max(len(r.json) for r in found) > 900_000


def test_no_python_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = C.events(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert C.events(rows).count() == 1 and C.events(rows.limit(0)).count() == 0


def test_query_takes_schemas_from_system_messages(spark, tmp_path):
    from quirework.llm.queries import op10_chat_tools

    add = {"name": "add", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a"]}}
    now = {"type": "function", "function": {"name": "now", "parameters": {"type": "object", "properties": {}}}}
    rows = [
        (1, 0, "system", json.dumps({"tools": [add, now, {"name": "bare"}, {}]})),
        (1, 1, "assistant", said(call("a", "add", {"a": 1}), call("b", "add", {"b": 1}), call("c", "add", {"a": "1"}), call("d", "add", {"a": 1, "z": 1}), call("e", "now", {}), call("f", "nope", {}), call("g", "add", {"a": "$call:a"}), call("h", "bare", {}), call("i", "bare", {"x": 1}))),
        (1, 2, "tool", result("a", "2")),
        (1, 3, "tool", result("zz", "2")),
        (2, 0, "assistant", said(call("a", "add", {"a": 1}))),  # another conversation, which declares nothing
        (3, 0, "user", json.dumps({"tools": [add]})),  # not a system message
        (3, 1, "assistant", said(call("a", "add", {"a": 1}))),
        (4, 0, "system", '{"tools": broken'),
        (4, 1, "system", json.dumps({"tools": "add"})),
        (4, 2, "assistant", said(call("a", "add", {"a": 1}))),
        (None, 0, "system", json.dumps({"tools": [add]})),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = op10_chat_tools(spark, str(tmp_path)).collect()
    status = {(r.conv_id, r.call_id): r.status for r in found if r.kind == "call"}
    want = {"a": "ok", "b": "missing_parameter", "c": "wrong_type", "d": "unknown_parameter", "e": "unanswered", "f": "unknown_tool", "g": "wrong_type", "h": "unanswered", "i": "unknown_parameter"}
    assert status == {**{(1, k): v for k, v in want.items()}, (2, "a"): "unknown_tool", (3, "a"): "unknown_tool", (4, "a"): "unknown_tool"}
    assert {(r.call_id, r.status) for r in found if r.kind == "result"} == {("a", "ok"), ("zz", "orphan")}
    assert sum(r.kind == "message" for r in found) == len(rows) - 2
