"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

All of it is DataFrame functions. Messages are rows (conv_id, turn, role,
text). A message of the assistant whose text is a JSON object with a list
``tool_calls`` makes calls, each ``{"id", "name", "arguments"}`` (or with name and
arguments under ``function``); a message of the role ``tool`` whose text is a JSON
object with ``tool_call_id`` is the result of a call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The JSON schema type of a value by how its variant type begins.
_TYPES = (("BIGINT", "integer"), ("DECIMAL", "number"), ("DOUBLE", "number"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("ARRAY", "array"), ("OBJECT", "object"), ("VOID", "null"))


def _json(text: Column) -> Column:
    """The variant of a text that is a JSON object, else null."""
    return F.when(F.ltrim(text, F.lit(" \t\n\r")).startswith("{"), F.try_parse_json(text))


def items_of(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows (conv_id, turn, item, kind, role, content, call_id, name, arguments): a message itself, each call it makes, or the result it is."""
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    m = m.withColumn("v", F.when(F.col("role").isin("assistant", "tool"), _json(F.col("text"))))
    m = m.withColumn("calls", F.when(F.col("role") == "assistant", F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')")))
    m = m.withColumn("result_of", F.when(F.col("role") == "tool", F.expr("try_variant_get(v, '$.tool_call_id', 'string')")))
    makes = F.coalesce(F.size("calls"), F.lit(0)) > 0
    said = F.when(makes | F.col("result_of").isNotNull(), F.expr("coalesce(try_variant_get(v, '$.content', 'string'), to_json(try_variant_get(v, '$.content', 'variant')))")).otherwise(F.col("text"))
    none = F.lit(None).cast("string")
    # A call is kept as JSON text until it is a row of its own: variants stay out of shuffles and comparisons.
    own = F.struct(F.when(F.col("result_of").isNotNull(), "result").otherwise("message").alias("kind"), F.col("result_of").alias("call_id"), said.alias("content"), none.alias("call"))
    made = F.transform(F.coalesce("calls", F.expr("cast(array() as array<variant>)")), lambda c: F.struct(F.lit("call").alias("kind"), none.alias("call_id"), none.alias("content"), F.to_json(c).alias("call")))
    m = m.select("conv_id", "turn", "role", F.posexplode(F.concat(F.array(own), made)).alias("item", "x")).select("conv_id", "turn", "role", "item", "x.*")
    c = F.when(F.col("call").isNotNull(), F.try_parse_json("call"))
    m = m.withColumn("c", c)
    m = m.withColumn("call_id", F.coalesce("call_id", F.expr("try_variant_get(c, '$.id', 'string')")))
    m = m.withColumn("name", F.expr("coalesce(try_variant_get(c, '$.name', 'string'), try_variant_get(c, '$.function.name', 'string'))"))
    args = F.expr("coalesce(to_json(try_variant_get(c, '$.arguments', 'variant')), to_json(try_variant_get(c, '$.function.arguments', 'variant')))")
    m = m.withColumn("arguments", args)
    # Arguments given as a string of JSON are taken apart too.
    inner = F.expr("coalesce(try_variant_get(c, '$.arguments', 'string'), try_variant_get(c, '$.function.arguments', 'string'))")
    m = m.withColumn("arguments", F.when(F.col("arguments").startswith('"'), F.coalesce(F.to_json(F.try_parse_json(inner)), F.col("arguments"))).otherwise(F.col("arguments")))
    return m.drop("c", "call")


def _type_of(value: Column) -> Column:
    kind, out = F.schema_of_variant(value), F.lit("other")
    for start, name in reversed(_TYPES):
        out = F.when(kind.startswith(start), name).otherwise(out)
    return out


def _entry(at: Column, path: Column, up: Column, value: Column) -> Column:
    return F.struct(at.alias("at"), path.alias("path"), up.alias("up"), _type_of(value).alias("type"), F.to_json(value).alias("json"))


def _inside(e: Column, deeper: int) -> Column:
    """The values inside a value (at, path, v), and inside those, to a depth: an array of entries."""
    fields = F.coalesce(F.try_variant_get(e["v"], "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    items = F.coalesce(F.try_variant_get(e["v"], "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    dot = lambda x: F.when(x == "", "").otherwise(F.concat(x, F.lit(".")))
    below = F.concat(
        F.transform(F.map_entries(fields), lambda f: F.struct(F.concat(dot(e["at"]), f["key"]).alias("at"), F.concat(dot(e["path"]), f["key"]).alias("path"), e["at"].alias("up"), f["value"].alias("v"))),
        F.transform(items, lambda x, k: F.struct(F.concat(e["at"], F.lit("["), k.cast("string"), F.lit("]")).alias("at"), F.concat(e["path"], F.lit("[]")).alias("path"), e["at"].alias("up"), x.alias("v"))),
    )
    own = F.transform(below, lambda x: _entry(x["at"], x["path"], x["up"], x["v"]))
    return own if deeper <= 1 else F.concat(own, F.flatten(F.transform(below, lambda x: _inside(x, deeper - 1))))


def checked(calls: DataFrame, tools: DataFrame | None) -> DataFrame:
    """The calls with ``error``: what is wrong with their arguments, null if nothing.

    tools: rows (name, parameter, type, required) and, if wanted, ``choices`` (an
    array of JSON texts), a row with null parameter for a tool without any. Types
    are those of JSON schemas; ``number`` takes integers, a null type anything. A
    parameter is a path: ``a`` is an argument, ``a.b`` a property of it, ``a[]`` what
    its items are, ``a[].b`` a property of each. Required properties are asked of
    every object that is there; unknown are arguments, and properties of objects
    for which some are declared, that no row names.
    """
    if tools is None:
        whole = F.when(F.col("arguments").startswith("{"), F.lit(True))
        return calls.withColumn("error", F.when(F.col("name").isNull(), "call without a name").when(whole.isNull(), "arguments are not an object"))
    if "choices" not in tools.columns:
        tools = tools.withColumn("choices", F.lit(None).cast("array<string>"))
    # Paths of a schema say how deep arguments are looked into: a bounded number, of the schemas alone.
    depth = tools.agg(F.max(F.length("parameter") - F.length(F.regexp_replace("parameter", r"\.|\[\]", "")) - F.regexp_count("parameter", F.lit(r"\[\]")) + 1)).first()[0] or 1
    up, leaf = F.regexp_extract("parameter", r"^(.*?)(\.[^.\[\]]+|\[\])$", 1), F.regexp_extract("parameter", r"([^.\[\]]+|\[\])$", 1)
    one = F.struct(F.col("parameter").alias("path"), up.alias("up"), leaf.alias("leaf"), "type", F.coalesce("required", F.lit(False)).alias("required"), "choices")
    schemas = tools.select(F.col("name").alias("_tool"), one.alias("p")).groupBy("_tool").agg(F.filter(F.array_sort(F.collect_set("p")), lambda p: p["path"].isNotNull()).alias("_schema"))  # parameters of one tool
    root = F.struct(F.lit("").alias("at"), F.lit("").alias("path"), F.when(F.col("arguments").startswith("{"), F.try_parse_json("arguments")).alias("v"))
    calls = calls.withColumn("_root", root).withColumn("_given", F.when(F.col("_root.v").isNotNull(), _inside(F.col("_root"), int(depth)))).drop("_root")
    broken = F.when(F.col("name").isNull(), "call without a name").when(F.col("_given").isNull(), "arguments are not an object")
    calls = calls.join(schemas, F.col("name") == F.col("_tool"), "left")
    given, schema = F.col("_given"), F.col("_schema")
    none = F.expr("cast(array() as array<string>)")
    dot = lambda x: F.when(x == "", "").otherwise(F.concat(x, F.lit(".")))
    # The objects that a required property is asked of: the arguments themselves, or what is given at the path above.
    holders = lambda p: F.when(p["up"] == "", F.array(F.lit(""))).otherwise(F.transform(F.filter(given, lambda g: (g["path"] == p["up"]) & (g["type"] == "object")), lambda g: g["at"]))
    absent = lambda p: F.filter(F.transform(holders(p), lambda h: F.concat(dot(h), p["leaf"])), lambda at: ~F.exists(given, lambda g: g["at"] == at))
    lacking = F.flatten(F.transform(F.filter(schema, lambda p: p["required"] & (p["leaf"] != "[]")), absent))
    declared = lambda g: (~g["path"].endswith("[]")) & ((g["up"] == "") | F.exists(schema, lambda p: (p["leaf"] != "[]") & (p["up"] == F.regexp_replace(g["up"], r"\[[0-9]+\]", "[]"))))
    unknown = F.filter(given, lambda g: declared(g) & ~F.exists(schema, lambda p: p["path"] == g["path"]))
    misfit = lambda g, p: (g["path"] == p["path"]) & p["type"].isNotNull() & (g["type"] != p["type"]) & ~((p["type"] == "number") & (g["type"] == "integer"))
    wrong = F.filter(given, lambda g: F.exists(schema, lambda p: misfit(g, p)))
    odd = F.filter(given, lambda g: F.exists(schema, lambda p: (g["path"] == p["path"]) & p["choices"].isNotNull() & ~F.exists(p["choices"], lambda c: c == g["json"])))
    at = lambda xs: F.transform(xs, lambda x: x["at"])
    parts = F.array(*(F.when(F.size(xs) > 0, F.concat(F.lit(f"{what}: "), F.array_join(F.array_sort(xs), ","))) for what, xs in (("missing", lacking), ("unknown", at(unknown)), ("wrong type", at(wrong)), ("not a choice", at(odd)))))
    found = F.array_join(F.coalesce(parts, none), "; ")
    error = F.coalesce(broken, F.when(F.col("_tool").isNull(), "unknown tool"), F.when(found != "", found))
    return calls.withColumn("error", error).drop("_given", "_tool", "_schema")


def _canonical(**fields: Column) -> Column:
    """JSON with its keys in order, no spaces, and nulls written."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def formatted(messages: DataFrame, tools: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, item, kind, role, call_id, call_turn, order_turn, order_step, valid, error, json), one for each message, call and result.

    Sorted by (order_turn, order_step, turn, item) the rows of a conversation are
    in topological order: turns follow each other, and a result that stands
    before its call moves behind it (``order_turn`` is then the call's turn and
    ``order_step`` 2; else 0 for messages and results, 1 for calls). A result is
    linked by a hash join to the first call of its conversation with its
    identifier. ``error`` is null where ``valid``: for calls, that an identifier is
    missing or repeated, that no result answers it, or what :func:`checked` finds;
    for results, that there is no such call. Texts that are not such JSON are
    messages as they stand; null texts and roles are JSON nulls; rows with null
    conversation or turn are kept and link with nothing; repeated rows stay
    repeated (their calls repeat identifiers); an empty table gives no rows;
    other columns are not read.
    """
    items = items_of(messages, conv_col, turn_col, role_col, text_col)
    calls = checked(items.filter("kind = 'call'"), tools)
    first = calls.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"), F.count(F.lit(1)).alias("_n"))
    results = items.filter("kind = 'result'")
    answered = results.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("_answers"))
    calls = calls.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(answered.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    error = F.coalesce(F.when(F.col("call_id").isNull(), "call without an identifier"), F.when(F.col("_n") > 1, "repeated identifier"), F.col("error"), F.when(F.col("_answers").isNull(), "call without a result"))
    calls = calls.withColumn("error", error).drop("_n", "_answers")
    # JSON text inside JSON would be quoted: the arguments take part as a variant.
    call_json = _canonical(arguments=F.when(F.col("arguments").isNotNull(), F.try_parse_json("arguments")), id=F.col("call_id"), name=F.col("name"), type=F.lit("tool_call"))
    calls = calls.select("conv_id", "turn", "item", "kind", "role", "call_id", "call_turn", F.col("turn").alias("order_turn"), F.lit(1).alias("order_step"), "error", call_json.alias("json"))
    results = results.join(first.drop("_n").hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    moved = F.col("call_turn") >= F.col("turn")
    result_json = _canonical(content=F.col("content"), role=F.col("role"), tool_call_id=F.col("call_id"))
    results = results.select(
        "conv_id", "turn", "item", "kind", "role", "call_id", "call_turn", F.when(moved, F.col("call_turn")).otherwise(F.col("turn")).alias("order_turn"), F.when(moved, 2).otherwise(0).alias("order_step"),
        F.when(F.col("call_turn").isNull(), "result without a call").alias("error"), result_json.alias("json"),
    )
    plain = items.filter("kind = 'message'").select(
        "conv_id", "turn", "item", "kind", "role", "call_id", F.lit(None).cast(dict(items.dtypes)["turn"]).alias("call_turn"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"),
        F.lit(None).cast("string").alias("error"), _canonical(content=F.col("content"), role=F.col("role")).alias("json"),
    )
    out = plain.unionAll(calls).unionAll(results)
    return out.select("conv_id", "turn", "item", "kind", "role", "call_id", "call_turn", "order_turn", "order_step", F.col("error").isNull().alias("valid"), "error", "json")
