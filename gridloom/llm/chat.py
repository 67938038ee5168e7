"""Chat formatting with linked tool calls.

A turn is plain text, or JSON that tells about tools:

* calls: ``{"content": ..., "tool_calls": [{"id", "name", "arguments", "after": [ids]}]}``,
  where ``after`` names calls whose results must stand before this one;
* a result: ``{"tool_call_id": ..., "content": ...}``.

Each call and each result becomes a message of its own. Calls and results are
joined by (conversation, identifier). Sorting by (turn, level, part) is a
topological order: a result that stands before its call moves to the call's
turn, and a call moves to the turn of the last result that it waits for, under a higher ``level``: the
length of the longest chain of calls before it. Whatever needn't move keeps its
turn. A call that waits for itself, over others or not, stays where it is with status ``cycle``, and so
does one that waits for such a call. Chains of any length are followed, a round of joins for each level.

Arguments are checked against the schemas: ``{tool: {parameter: (type, required)}}``,
types as in JSON Schema. Each message is written as canonical JSON: keys sorted, no
white space, absent fields left out.

One row leaves per message, with (conv_id, turn, level, part) as its place, so a
conversation of any length is never gathered into one task. ``status`` is
``ok`` for a plain turn, a valid call with a result, or the first result of a call;
otherwise ``unanswered``, ``unknown_tool``, ``invalid_arguments``, ``cycle``,
``duplicate_call`` (a later call under a used id), ``orphan_result`` or ``duplicate_result``.

A null role becomes "unknown", a null text "". Null conversations and turns are kept; their
calls link with nothing, as do null identifiers. Text that is not such JSON is
plain. Repeated rows are messages of their own; of calls (or results) that share turn, part and
content any one is the first. Empty texts are empty messages, very long ones stay whole. An empty
table gives an empty result. Other columns are not read. All steps are DataFrame expressions.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, materialize

CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>,tool_call_id:string>"
#: Rounds after which the tables of levels found so far are written as one.
ROUNDS_A_TABLE = 8
# How a variant's type tells of JSON types.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}
Schemas = dict[str, dict[str, tuple[str, bool]]]
SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "get_weather": {"city": ("string", True), "days": ("integer", False)},
}


def canonical(json: Column) -> Column:
    """Keys sorted at every depth, no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def _fits(value: Column, kind: str) -> Column:
    found = F.schema_of_variant(value)
    if kind == "number":
        return found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return found.startswith(TYPES[kind])


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """true or false; null for a tool without schema. Arguments must be an object without other parameters."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.lit(None).cast("boolean")
    for tool, parameters in sorted(schemas.items()):
        good = is_object & (F.size(F.array_except(keys, F.array(*map(F.lit, parameters)).cast("array<string>"))) == 0)
        for parameter, (kind, required) in parameters.items():
            value = F.try_variant_get(parsed, f"$.{parameter}", "variant")
            good = good & F.when(value.isNull(), F.lit(not required)).otherwise(_fits(value, kind))
        out = F.when(name == tool, F.coalesce(good, F.lit(False))).otherwise(out)
    return out


def _levels(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, id, level, at) of calls that wait for others: chain length and the turn they move to; level -1 marks a cycle.

    Rounds of joins, each written to the shared folder, until one adds no call: what is left then waits for a cycle.
    """
    first = calls.where("first_call")
    waits = materialize(first.select("conv_id", "id", F.explode("after").alias("on")).where("on is not null").distinct(), "waits")
    if waits.isEmpty():
        return waits.select("conv_id", "id", F.lit(0).alias("level"), F.lit(None).cast("long").alias("at"))
    base = materialize(first.select("conv_id", "id", "turn").join(answers.select("conv_id", "id", F.col("turn").alias("answer")), ["conv_id", "id"], "left"), "call-turns")
    open_calls = waits.select("conv_id", "id").distinct()
    done = F.greatest("turn", "answer").alias("done")
    known = materialize(base.join(open_calls, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).alias("level"), F.col("turn").alias("at"), done), "levels")
    for turn in itertools.count(1):
        state = waits.join(known.select("conv_id", F.col("id").alias("on"), F.col("level").alias("l"), "done"), ["conv_id", "on"], "left")
        # an identifier that no call has holds nobody up
        state = state.join(base.select("conv_id", F.col("id").alias("on"), F.lit(True).alias("exists")), ["conv_id", "on"], "left")
        ready = state.groupBy("conv_id", "id").agg(F.max(F.col("l").isNull() & F.col("exists").isNotNull()).alias("held"), F.coalesce(F.max("l"), F.lit(-1)).alias("l"), F.max("done").alias("d")).where("not held")
        new = ready.join(known, ["conv_id", "id"], "left_anti").join(base, ["conv_id", "id"]).withColumn("turn", F.greatest("turn", "d"))
        new = materialize(new.select("conv_id", "id", (F.col("l") + 1).alias("level"), F.col("turn").alias("at"), done), "levels")
        if new.isEmpty():
            break
        known = known.union(new)
        if turn % ROUNDS_A_TABLE == 0:  # or the plan would grow with the chain
            parts, known = known, materialize(known, "levels")
            drop_table(parts)
    stuck = open_calls.join(known, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(-1).alias("level"), F.lit(None).cast("long").alias("at"))
    return known.where("level > 0").select("conv_id", "id", "level", "at").union(stuck)


def _with_first(rows: DataFrame, linked: Column, order: list[str], name: str) -> DataFrame:
    """Written rows, with a flag on the first one of each (conv_id, id) that links.

    A least row a key, found with partial sums, is joined by the rows' own numbers, so neither a key
    that holds many rows nor the null keys land in one task.
    """
    numbered = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), name)
    least = numbered.where(linked).groupBy("conv_id", "id").agg(F.min(F.struct(*order, "uid")).alias("least"))
    found = numbered.join(least.select(F.col("least.uid").alias("uid"), F.lit(True).alias(name)), "uid", "left")
    return materialize(found.withColumn(name, F.coalesce(name, F.lit(False))).drop("uid"), name)


def format_chat(turns: DataFrame, schemas: Schemas = SCHEMAS) -> DataFrame:
    """conv_id, turn, level, part, role, call_id, status, message (canonical JSON)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), text.alias("text"))
    looks = F.col("text").rlike(r'^\s*\{') & F.col("text").rlike('"tool_call')
    rows = rows.withColumn("j", F.when(looks & F.try_parse_json("text").isNotNull(), F.from_json("text", CALLS)))
    has_calls, is_result = F.coalesce(F.size("j.tool_calls") > 0, F.lit(False)), F.col("j.tool_call_id").isNotNull()
    rows = rows.withColumn("kind", F.when(has_calls, "calls").when(is_result, "result").otherwise("text"))

    def message(**fields: Column) -> Column:
        return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))

    plain_text = F.when(F.col("kind") == "calls", F.col("j.content")).otherwise(F.col("text"))
    plain = rows.where((F.col("kind") == "text") | ((F.col("kind") == "calls") & F.col("j.content").isNotNull()))
    none = F.lit(None).cast("string")
    plain = plain.select("conv_id", "turn", F.lit(0).alias("level"), F.lit(0).alias("part"), "role", none.alias("call_id"), F.lit("ok").alias("status"), message(content=plain_text, role=F.col("role")).alias("message"))

    tools = rows.where("kind <> 'text'")
    calls = tools.where("kind = 'calls'").select("conv_id", "turn", "role", F.posexplode("j.tool_calls").alias("pos", "c"))
    calls = calls.select("conv_id", "turn", "role", (F.col("pos") + 1).alias("part"), F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"), F.col("c.after").alias("after"))
    linked = F.col("conv_id").isNotNull() & F.col("id").isNotNull()
    # the first use of an identifier in a conversation is its call, the first answer its result
    calls = _with_first(calls, linked, ["turn", "part", "name", "arguments"], "first_call")
    results = tools.where("kind = 'result'").select("conv_id", "turn", "role", F.col("j.tool_call_id").alias("id"), F.coalesce("j.content", F.lit("")).alias("content"))
    results = _with_first(results, linked, ["turn", "content"], "first_answer")

    levels = _levels(calls, results.where("first_answer"))
    answered = results.where("first_answer").select("conv_id", "id", F.lit(True).alias("answered"))
    placed = calls.join(answered, ["conv_id", "id"], "left").join(levels.withColumnRenamed("level", "depth"), ["conv_id", "id"], "left")
    depth = F.coalesce("depth", F.lit(0))
    valid = valid_arguments(F.col("name"), F.col("arguments"), schemas)
    status = (
        F.when(~F.col("first_call") & linked, "duplicate_call").when(depth < 0, "cycle").when(valid.isNull(), "unknown_tool").when(~valid, "invalid_arguments").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    )
    call_text = message(arguments=F.coalesce(canonical(F.col("arguments")), F.col("arguments")), id=F.col("id"), name=F.col("name"), role=F.col("role"), type=F.lit("tool_call"))
    call_rows = placed.select("conv_id", F.greatest("turn", "at").alias("turn"), F.greatest(depth, F.lit(0)).cast("int").alias("level"), "part", "role", F.col("id").alias("call_id"), status.alias("status"), call_text.alias("message"))

    origin = placed.where("first_call").select("conv_id", "id", F.greatest(depth, F.lit(0)).cast("int").alias("level"), F.greatest("turn", "at").alias("called"), F.col("part").alias("call_part"))
    answers = results.join(origin, ["conv_id", "id"], "left")
    status = F.when(F.col("called").isNull() & F.col("level").isNull(), "orphan_result").when(~F.col("first_answer"), "duplicate_result").otherwise("ok")
    result_text = message(content=F.col("content"), role=F.col("role"), tool_call_id=F.col("id"), type=F.lit("tool_result"))
    # a result that stands before its call moves behind it: the call's turn, after all of its calls
    turn, part = F.greatest("turn", "called"), F.when(F.col("turn") <= F.col("called"), F.col("call_part") + 1_000_000).otherwise(F.lit(0))
    result_rows = answers.select("conv_id", turn.alias("turn"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce(part, F.lit(0)).alias("part"), "role", F.col("id").alias("call_id"), status.alias("status"), result_text.alias("message"))
    return plain.union(call_rows).union(result_rows)
