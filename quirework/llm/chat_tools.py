"""Tool-call linking and chat formatting, with DataFrame functions only.

Messages are rows (conv_id, turn, role, text). A message whose text is a JSON object with ``tool_calls`` (an array
of objects with id, name and arguments, an object or its JSON) makes calls; a message of role ``tool`` whose
text is a JSON object with ``tool_call_id`` is a result. Results are hash-joined to calls by (conv_id, id);
arguments are validated against parameter schemas (rows of tool, param, type, required, and conv_id if they hold in one
conversation only; ``declared_tools`` reads those that system messages declare); and each event gets
a place (order_turn, order_depth, turn, part) in which no result precedes its call, and no call the results
that its arguments name as ``$call:<id>``. An event is one row with canonical JSON: sorted keys, no spaces, numbers
as decimals without exponent, trailing zeros or point where these are exact (38 digits of an integer; 20 digits before and
18 after the point from 0.000001 on), else as the shortest double. So 1e2, 100.0 and 100 are all 100, and a conversation of any length stays spread over tasks; ``conversation_lines``
puts conversations together where that is wanted.

Status of a call: ok, duplicate (an earlier call has its id), malformed (arguments aren't an object), unknown_tool,
missing_parameter, unknown_parameter, wrong_type, dangling (names no call), cyclic, in this order of precedence,
or unanswered (else ok, without a result). Of a result: ok, orphan (no call), duplicate. Of a message: plain.

Defined cases: null texts are messages with content null; a null id links nothing (a call is then
``malformed``, a result an ``orphan``); null conv_ids are no conversation, so nothing of them is linked; repeated rows
are repeated events (a call that is repeated with equal turn and part is the first as well); without schemas
every tool is unknown; of schema rows that repeat a parameter the smallest type holds, and it is required if one
says so; a schema row without a parameter (null) makes its tool known, one without a tool is ignored; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
RESULT = "struct<tool_call_id:string,content:string>"
PARAMETERS = "struct<properties:map<string,struct<type:string>>,required:array<string>>"
DECLARED = f"struct<tools:array<struct<name:string,parameters:{PARAMETERS},function:struct<name:string,parameters:{PARAMETERS}>>>>"
LARGEST_BROADCAST = 10_000
TYPES = {
    "integer": r"BIGINT|DECIMAL\(\d+,0\)",
    "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "string": "STRING",
    "boolean": "BOOLEAN",
    "array": "ARRAY.*",
    "object": "OBJECT.*",
    "null": "VOID",
}
PLACE = "struct<order_turn:bigint,order_depth:int>"


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _place(turn: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.struct(turn.cast("long").alias("order_turn"), depth.cast("int").alias("order_depth"))


def _after(place: Column) -> Column:
    return _place(place["order_turn"], place["order_depth"] + 1)


def _argument_status(args: Column, known: Column) -> Column:
    """Of parsed arguments (map of variant types by name) against parameters (map of struct<type, required>)."""
    missing = F.exists(F.map_keys(known), lambda p: F.element_at(known, p)["required"] & ~F.map_contains_key(args, p))
    unknown = F.exists(F.map_keys(args), lambda p: ~F.map_contains_key(known, p))

    def fits(p: Column) -> Column:
        want, out = F.element_at(known, p)["type"], F.lit(True)
        for name, pattern in TYPES.items():
            out = F.when(want == name, F.element_at(args, p).rlike(f"^({pattern})$")).otherwise(out)
        return out

    wrong = F.exists(F.map_keys(args), lambda p: F.map_contains_key(known, p) & ~fits(p))
    return F.when(args.isNull(), "malformed").when(known.isNull(), "unknown_tool").when(missing, "missing_parameter").when(unknown, "unknown_parameter").when(wrong, "wrong_type")


def _places(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, id, place (of the call), trouble (dangling, cyclic or null) of each distinct call."""
    firsts = calls.where("conv_id is not null and id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "part", "refs")).alias("f"))
    firsts = firsts.select("conv_id", "id", F.col("f.turn").alias("turn"), F.col("f.refs").alias("refs"))
    answered = results.where("conv_id is not null and id is not null").groupBy("conv_id", "id").agg(F.min("turn").alias("answer"))
    firsts = written(firsts.join(answered, ["conv_id", "id"], "left"), "calls")

    def settled(rows: DataFrame) -> DataFrame:
        """with done: where a call goes that needs this one's result."""
        result = F.when(F.col("answer").isNotNull(), F.greatest(_place(F.col("answer"), 0), _after(F.col("place")))).otherwise(F.col("place"))
        return rows.withColumn("done", _after(result))

    own = _place(F.col("turn"), 0)
    done = settled(firsts.where(F.size("refs") == 0).withColumn("place", own)).select("conv_id", "id", "place", "done", F.lit(None).cast("string").alias("trouble"))
    waiting = firsts.where(F.size("refs") > 0)
    if not waiting.take(1):
        return done
    refs = waiting.select("conv_id", "id", F.explode("refs").alias("ref"))
    there = firsts.select("conv_id", F.col("id").alias("ref"), F.lit(True).alias("there"))
    refs = written(refs.join(there, ["conv_id", "ref"], "left"), "refs")
    dangling = refs.groupBy("conv_id", "id").agg(F.bool_or(F.col("there").isNull()).alias("dangles"), F.count("there").alias("n_refs"))
    refs, done = refs.where("there").drop("there"), written(done, "done")
    waiting = waiting.join(dangling, ["conv_id", "id"]).drop("refs")
    # calls that wait have no place yet; a round, and one table, for each link of the longest chain
    state, left = written(waiting.withColumn("place", F.lit(None).cast(PLACE)).withColumn("done", F.lit(None).cast(PLACE)), "state"), None
    while True:
        ends = done.select("conv_id", F.col("id").alias("ref"), F.col("done").alias("end")).unionByName(state.where("done is not null").select("conv_id", F.col("id").alias("ref"), F.col("done").alias("end")))
        ready = refs.join(ends, ["conv_id", "ref"]).groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("after"))
        placed = state.join(ready, ["conv_id", "id"], "left").withColumn("place", F.when(F.coalesce("n", F.lit(0)) == F.col("n_refs"), F.greatest(own, F.coalesce("after", own))))
        ended = settled(placed).withColumn("done", F.when(F.col("place").isNotNull(), F.col("done")))
        state = written(ended.select(*state.columns), "state")
        before, left = left, state.where("place is null").count()
        if not left or left == before:
            break
    trouble = F.when(F.col("place").isNull(), "cyclic").when(F.col("dangles"), "dangling")
    rest = state.select("conv_id", "id", F.coalesce("place", own).alias("place"), F.coalesce("done", _after(own)).alias("done"), trouble.alias("trouble"))
    return done.unionByName(rest)


def one_form(text: Column) -> Column:
    """JSON text whose numbers, outside strings, are in one form."""

    def number(token: Column) -> Column:
        value = token.try_cast("double")

        def exact(kind: str) -> Column:
            decimal = token.try_cast(kind)
            plain = F.regexp_replace(F.regexp_replace(decimal.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
            return F.when((decimal.cast("double") == value) & ((decimal == 0) | (F.abs(value) >= 1e-6)), plain)

        integer = F.when(token.rlike("^-?[0-9]{1,38}$"), F.when(token == "-0", "0").otherwise(token))
        return F.coalesce(integer, exact("decimal(38,18)"), exact("decimal(38,0)"), value.cast("string"), token)

    # possessive, so that matching doesn't recurse over long strings
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'), F.lit(0))
    made = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), number(t)).otherwise(t)), "")
    return F.when(text.rlike("[.eE]"), made).otherwise(text)


def declared_tools(messages: DataFrame) -> DataFrame:
    """conv_id, tool, param, type, required of the tools that a conversation's system messages declare.

    Such a message's text is a JSON object with ``tools``: an array of objects with name and parameters (a JSON schema:
    properties and required), bare or under ``function``. A tool without parameters is one row without a parameter.
    """
    text = F.col("text").cast("string")
    said = messages.where((F.col("role").cast("string") == "system") & F.ltrim(text).startswith("{") & text.contains('"tools"'))
    tools = said.select("conv_id", F.explode(F.from_json(text, DECLARED)["tools"]).alias("t"))
    tools = tools.select("conv_id", F.coalesce("t.function.name", "t.name").alias("tool"), F.coalesce("t.function.parameters", "t.parameters").alias("p"))
    rows = tools.select("conv_id", "tool", "p.required", F.explode_outer(F.map_entries("p.properties")).alias("e"))
    return rows.select("conv_id", "tool", F.col("e.key").alias("param"), F.col("e.value.type").alias("type"), F.coalesce(F.array_contains("required", F.col("e.key")), F.lit(False)).alias("required"))


def events(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, part, kind, call_id, tool, status, order_turn, order_depth, json of each message, call and result."""
    spark = messages.sparkSession
    if schemas is None:
        schemas = spark.createDataFrame([], "tool string, param string, type string, required boolean")
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    is_object = F.ltrim("text").startswith("{")
    rows = rows.withColumn("made", F.when(is_object & F.col("text").contains("tool_calls"), F.from_json("text", CALLS)))
    rows = rows.withColumn("result", F.when(is_object & (F.col("role") == "tool"), F.from_json("text", RESULT)))
    makes, answers = F.col("made.tool_calls").isNotNull(), F.col("result.tool_call_id").isNotNull()
    nothing = F.lit(None).cast("string")

    content = F.when(makes, F.col("made.content")).otherwise(F.col("text"))
    plain = rows.where(~answers | (F.coalesce("role", F.lit("")) != "tool")).select(
        "conv_id", "turn", F.lit(0).alias("part"), F.lit("message").alias("kind"), nothing.alias("call_id"), nothing.alias("tool"), F.lit("plain").alias("status"), _place(F.col("turn"), 0).alias("place"), _json(content.alias("content"), F.col("role")).alias("json")
    )

    calls = rows.where(makes).select("conv_id", "turn", F.posexplode("made.tool_calls").alias("part", "c"))
    calls = calls.select("conv_id", "turn", (F.col("part") + 1).alias("part"), F.col("c.id").alias("id"), F.col("c.name").alias("tool"), F.expr("try_parse_json(c.arguments)").alias("v"), F.col("c.arguments").alias("raw"))
    types = F.transform_values(F.from_json("raw", "map<string,variant>"), lambda _, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))
    calls = calls.withColumn("types", F.when(F.schema_of_variant("v").startswith("OBJECT"), types))
    calls = calls.withColumn("refs", F.array_distinct(F.coalesce(F.regexp_extract_all("raw", F.lit(r"\$call:([A-Za-z0-9_-]+)"), F.lit(1)), F.array().cast("array<string>"))))
    results = rows.where(answers & (F.col("role") == "tool")).select("conv_id", "turn", F.col("result.tool_call_id").alias("id"), F.col("result.content").alias("content"))

    places = written(_places(calls.select("conv_id", "turn", "part", "id", "refs"), results.select("conv_id", "turn", "id")), "places")
    first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "part")).alias("first_call")).where("conv_id is not null and id is not null")
    answer = results.groupBy("conv_id", "id").agg(F.min("turn").alias("first_answer")).where("conv_id is not null and id is not null")
    keys = ["conv_id", "tool"] if "conv_id" in schemas.columns else ["tool"]
    params = schemas.where("tool is not null").groupBy(*keys, "param").agg(F.min("type").alias("type"), F.coalesce(F.bool_or("required"), F.lit(False)).alias("required"))
    entry = F.when(F.col("param").isNotNull(), F.struct(F.col("param"), F.struct("type", "required")))
    tools = params.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("known"))
    if schemas.limit(LARGEST_BROADCAST + 1).count() <= LARGEST_BROADCAST:
        tools = F.broadcast(tools)

    linked = calls.join(first, ["conv_id", "id"], "left").join(answer, ["conv_id", "id"], "left").join(places, ["conv_id", "id"], "left").join(tools, keys, "left")
    status = (
        F.when(F.col("id").isNull(), "malformed")
        .when(F.struct("turn", "part") != F.col("first_call"), "duplicate")
        .otherwise(F.coalesce(_argument_status(F.col("types"), F.col("known")), "trouble", F.when(F.col("first_answer").isNull(), "unanswered"), F.lit("ok")))
    )
    own = _place(F.col("turn"), 0)
    call_rows = linked.select(
        "conv_id", "turn", "part", F.lit("call").alias("kind"), F.col("id").alias("call_id"), "tool", status.alias("status"), F.greatest(own, F.coalesce("place", own)).alias("place"),
        one_form(_json(F.coalesce("v", F.expr("try_variant_get(parse_json('null'), '$')")).alias("arguments"), F.col("id"), F.col("tool").alias("name"))).alias("json"),
    )
    joined = results.join(first.withColumn("called", F.lit(True)), ["conv_id", "id"], "left").join(answer, ["conv_id", "id"], "left").join(places, ["conv_id", "id"], "left")
    result_status = F.when(F.col("called").isNull(), "orphan").when(F.col("turn") != F.col("first_answer"), "duplicate").otherwise("ok")
    result_rows = joined.select(
        "conv_id", "turn", F.lit(0).alias("part"), F.lit("result").alias("kind"), F.col("id").alias("call_id"), nothing.alias("tool"), result_status.alias("status"),
        F.when(F.col("place").isNull(), own).otherwise(F.greatest(own, _after(F.col("place")))).alias("place"), _json(F.col("content"), F.col("id").alias("tool_call_id")).alias("json"),
    )
    every = plain.unionByName(call_rows).unionByName(result_rows)
    return every.select("conv_id", "turn", "part", "kind", "call_id", "tool", "status", "place.order_turn", "place.order_depth", "json")


def conversation_lines(found: DataFrame) -> DataFrame:
    """conv_id and lines: the JSON of a conversation's events in order, one on each line (a conversation must fit a task)."""
    order = ("order_turn", "order_depth", "turn", "part", "kind", "json")
    rows = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("e"))
    return rows.select("conv_id", F.array_join(F.transform("e", lambda x: x["json"]), "\n").alias("lines"))


#: For tables without tool calls; calls and results are tested against brute force.
ORACLE = """
SELECT conv_id, turn, 0 AS part, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS tool, 'plain' AS status, turn AS order_turn, 0 AS order_depth,
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
FROM conversations
"""
