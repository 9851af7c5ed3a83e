"""The chat query checks calls against schemas."""

import json

from lodestar.llm import queries


def test_chat_query_checks_calls(spark, tmp_path):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
    calls = [call("a", "search", {"query": "x", "place": {"turn": 1}}), call("b", "search", {"query": 5, "place": {"turn": "1"}}), call("c", "other", {})]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls}))] + [(1, k, "tool", json.dumps({"tool_call_id": i, "content": "r"})) for k, i in enumerate("abc", 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.call_id: (r.valid, r.error) for r in queries.op6_chat_formatting(spark, str(tmp_path)).filter("kind = 'call'").collect()}
    assert got == {"a": (True, None), "b": (False, "wrong type: place.turn,query"), "c": (False, "unknown tool")}
