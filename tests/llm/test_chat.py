import json

from lodestar.llm import chat as C

ROWS = [
    (1, 0, "user", 'hi "x"\n é/'), (1, 0, "tool", '{"tool_call_id":"b","content":"early"}'),
    (1, 1, "assistant", '{"content":"c","tool_calls":[{"id":"a","name":"f","arguments":{"z":1,"b":"s","a":1.50}},{"id":"b","function":{"name":"g","arguments":"{\\"q\\": [1, 2]}"}}]}'),
    (1, 2, "tool", '{"tool_call_id":"a","content":"ok"}'), (1, 3, "tool", '{"tool_call_id":"zz","content":{"k":[1]}}'),
    (2, 0, None, None), (2, 1, "assistant", "{bad"), (2, 2, "assistant", '{"tool_calls":[{"name":"f"},5]}'), (2, 3, "user", '{"tool_call_id":"a"}'),
    (3, 0, "assistant", '{"tool_calls":[{"id":"a","name":"g","arguments":{"q":null}},{"id":"a","name":"h","arguments":[1]}]}'), (3, 1, "assistant", ' {"tool_calls":[]}'),
    (4, 0, "assistant", '\n\t {"tool_calls":[{"id":"q","name":"n","arguments":{}}]}'), (4, 1, "tool", '\r\n{"tool_call_id":"q"}'), (4, 2, "assistant", '\xa0{"tool_calls":[]}'),
]
TOOLS = [("f", "z", "integer", True), ("f", "b", "integer", False), ("f", "need", "string", True), ("g", "q", "array", True), ("n", None, None, None)]


def plain(rows, tools):
    """The same, message by message in plain Python."""
    schema = {}
    for t, p, kind, need in tools:
        schema.setdefault(t, {})
        if p is not None:
            schema[t][p] = (kind, bool(need))
    kind_of = lambda v: "null" if v is None else "boolean" if v is True or v is False else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else {str: "string", list: "array", dict: "object"}[type(v)]
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    items, first, times, answers = [], {}, {}, set()
    for conv, turn, role, text in rows:
        v = None
        if role in ("assistant", "tool") and text and text.lstrip(" \t\n\r").startswith("{"):
            try:
                v = json.loads(text)
            except ValueError:
                v = None
        calls = v.get("tool_calls", []) if role == "assistant" and v else []
        rid = v.get("tool_call_id") if role == "tool" and v else None
        content = v.get("content") if calls or rid else text
        content = content if content is None or isinstance(content, str) else dump(content)
        items.append((conv, turn, 0, "result" if rid else "message", role, rid, content))
        if rid:
            answers.add((conv, rid))
        for k, c in enumerate(calls, 1):
            c = c if isinstance(c, dict) else {}
            f = c.get("function") or {}
            args = c.get("arguments", f.get("arguments"))
            args = json.loads(args) if isinstance(args, str) else args
            items.append((conv, turn, k, "call", role, c.get("id"), (c.get("name", f.get("name")), args)))
            if c.get("id") is not None:
                first[conv, c["id"]] = min(turn, first.get((conv, c["id"]), turn))
                times[conv, c["id"]] = times.get((conv, c["id"]), 0) + 1
    out = []
    for conv, turn, k, kind, role, cid, x in items:
        at, error, call_turn, order = turn, None, None, 0
        if kind == "message":
            text = dump({"content": x, "role": role})
        elif kind == "result":
            call_turn = first.get((conv, cid))
            error = "result without a call" if call_turn is None else None
            if call_turn is not None and call_turn >= turn:
                at, order = call_turn, 2
            text = dump({"content": x, "role": role, "tool_call_id": cid})
        else:
            name, args = x
            call_turn, order = first.get((conv, cid)), 1
            if cid is None:
                error = "call without an identifier"
            elif times[conv, cid] > 1:
                error = "repeated identifier"
            elif name is None:
                error = "call without a name"
            elif not isinstance(args, dict):
                error = "arguments are not an object"
            elif name not in schema:
                error = "unknown tool"
            else:
                s = schema[name]
                bad = {
                    "missing": [p for p, (_, need) in s.items() if need and p not in args],
                    "unknown": [p for p in args if p not in s],
                    "wrong type": [p for p, v in args.items() if p in s and s[p][0] != kind_of(v) and not (s[p][0] == "number" and kind_of(v) == "integer")],
                }
                error = "; ".join(f"{w}: {','.join(sorted(ps))}" for w, ps in bad.items() if ps) or None
            error = error or (None if (conv, cid) in answers else "call without a result")
            text = dump({"arguments": args, "id": cid, "name": name, "type": "tool_call"})
        out.append((conv, turn, k, kind, role, cid, call_turn, at, order, error is None, error, text))
    return sorted(out, key=repr)


def test_against_plain_python(spark):
    m = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, json int").repartition(3)
    tools = spark.createDataFrame(TOOLS, "name string, parameter string, type string, required boolean")
    assert sorted(map(tuple, C.formatted(m, tools).collect()), key=repr) == plain(ROWS, TOOLS)


def test_order_is_topological(spark):
    m = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    rows = C.formatted(m).orderBy("conv_id", "order_turn", "order_step", "turn", "item").collect()
    seen = set()
    for r in rows:
        if r.kind == "call":
            seen.add((r.conv_id, r.call_id))
        if r.kind == "result" and r.call_turn is not None:
            assert (r.conv_id, r.call_id) in seen


def test_no_python_in_the_plan(spark):
    m = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = C.formatted(m)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "ShuffledHashJoin" in plan


def test_empty_and_repeated(spark):
    m = spark.createDataFrame([(1, 1, "user", "a"), (1, 1, "user", "a"), (None, None, "user", None)], "conv_id long, turn long, role string, text string")
    assert C.formatted(m).count() == 3
    assert C.formatted(m.limit(0)).collect() == []


NESTED = [
    ("deep", "where", "object", True, None), ("deep", "where.city", "string", True, None), ("deep", "where.zip", "integer", False, None), ("deep", "tags", "array", False, None), ("deep", "tags[]", "string", False, None),
    ("deep", "rows", "array", False, None), ("deep", "rows[].n", "number", True, None), ("deep", "unit", "string", False, ['"c"', '"f"']), ("deep", "free", "object", False, None), ("deep", "any", None, False, None),
]


def test_nested_schemas(spark):
    """Objects, items of arrays and choices, in the arguments and in what they hold."""
    cases = [
        ({"where": {"city": "x"}}, None),
        ({"where": {"city": "x", "zip": 5}, "tags": ["a", "b"], "rows": [{"n": 1}, {"n": 2.5}], "unit": "c", "free": {"whatever": [1]}, "any": [None]}, None),
        ({}, "missing: where"),
        ({"where": {}}, "missing: where.city"),
        ({"where": "x"}, "wrong type: where"),
        ({"where": {"city": 5, "street": "y"}}, "unknown: where.street; wrong type: where.city"),
        ({"where": {"city": "x"}, "tags": ["a", 3, None], "unit": "k"}, "wrong type: tags[1],tags[2]; not a choice: unit"),
        ({"where": {"city": "x"}, "rows": [{}, {"n": "1"}, {"n": 1, "m": 2}], "z": 0}, "missing: rows[0].n; unknown: rows[2].m,z; wrong type: rows[1].n"),
    ]
    rows = [(k, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "deep", "arguments": c}]})) for k, (c, _) in enumerate(cases)] + [(k, 1, "tool", '{"tool_call_id":"a"}') for k in range(len(cases))]
    tools = spark.createDataFrame(NESTED, "name string, parameter string, type string, required boolean, choices array<string>")
    out = C.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).filter("kind = 'call'").orderBy("conv_id").collect()
    assert [r.error for r in out] == [e for _, e in cases]


def test_very_long_text_and_clashing_columns(spark):
    long = "x" * 3_000_000
    df = spark.createDataFrame([(1, 0, "user", long, "a", 1), (1, 1, "assistant", json.dumps({"content": long, "tool_calls": []}), "b", 2)], "conv_id long, turn long, role string, text string, item string, error int")
    assert sorted(len(r.json) for r in C.formatted(df).collect())[0] > 3_000_000
