"""Operator 10: tool-call linking and canonical chat records, in DataFrame functions only.

Calls and results are joined by (conversation, identifier).  Calls that use an
earlier call's result name it in ``after``; their depth comes from pointer
doubling (each round doubles the distance looked back, so a chain of a million
calls takes 20 joins), which also finds cycles.  Arguments are parsed as variants
and validated against the tool's schema row by row.  Every message, call and
result becomes one row with canonical JSON: keys sorted, no white space.

The order of a conversation is (depth, turn, kind, call_id): a call stands before
its result, and both before any call that uses it.  It is returned as sortable
columns, so a conversation of any length is never gathered in one task.

Defined cases: identifiers used by several calls belong to the smallest (turn,
name, arguments, after), which links them; the others keep a row of their own, marked
``duplicate`` at the depth of the first, and every row tells by ``n_same`` how many
other calls share its identifier; a result without a call
is kept, marked ``orphan``; a call without a result is marked ``unanswered``;
``after`` naming an unknown call is marked ``unknown_dependency`` and ignored; calls
on or behind a cycle are marked ``cycle`` and have depth null, at the end; arguments that
are null or no JSON object are marked ``invalid_json``; an unknown tool is ``unknown_tool``;
rows without conversation or identifier link to nothing; a message without text has null content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm.common import materialize

__all__ = ["TOOLS", "link_calls", "chat_records", "derived_calls"]

#: (tool, parameter, variant type, required)
TOOLS = [
    ("lookup", "limit", "BIGINT", True),
    ("lookup", "query", "STRING", True),
    ("summarise", "max_words", "BIGINT", True),
    ("summarise", "style", "STRING", False),
    ("summarise", "text", "STRING", True),
]
KEY = ["conv_id", "call_id"]


def tools_frame(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean")
    return schema_of(rows)


def schema_of(params: DataFrame) -> DataFrame:
    """(name, params) of a table of (name, param, type, required)."""
    return params.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("param", "type", "required"))).alias("params"))


def canonical(parsed: Column) -> Column:
    """Compact JSON of a variant; the keys of a variant's objects are sorted."""
    return F.to_json(parsed)


def _left(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Left join; rows with a null among ``on``, which match nothing, are not sent to one task for it."""
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    return rows.where(whole).join(known, on, "left").unionByName(rows.where(~whole), allowMissingColumns=True)


def _errors(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds ``arguments_json`` (canonical) and ``errors`` (sorted)."""
    parsed = calls.withColumn("_v", F.try_parse_json("arguments"))
    parsed = parsed.withColumn("_types", F.transform_values(
        F.try_variant_get("_v", "$", "map<string,variant>"), lambda _, v: F.schema_of_variant(v)))
    j = parsed.join(tools, "name", "left")
    none = F.array().cast("array<string>")
    params = F.coalesce("params", F.array().cast("array<struct<param:string,type:string,required:boolean>>"))
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.map_contains_key("_types", p["param"])),
                          lambda p: F.concat(F.lit("missing:"), p["param"]))
    wrong = F.transform(F.filter(params, lambda p: F.map_contains_key("_types", p["param"])
                                 & (F.col("_types")[p["param"]] != p["type"])), lambda p: F.concat(F.lit("type:"), p["param"]))
    names = F.transform(params, lambda p: p["param"])
    more = F.transform(F.array_except(F.map_keys("_types"), names), lambda k: F.concat(F.lit("unknown:"), k))
    found = (F.when(F.col("_types").isNull(), F.array(F.lit("invalid_json")))
             .when(F.col("params").isNull(), F.array(F.lit("unknown_tool")))
             .otherwise(F.concat(missing, wrong, more)))
    return (j.withColumn("errors", F.sort_array(F.coalesce(found, none)))
            .withColumn("arguments_json", canonical(F.col("_v"))).drop("_v", "_types", "params"))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, mark): number of calls behind each call; null on or behind a cycle.

    Each round replaces a call's pointer by its target's pointer and adds the target's distance.  The
    calls that still point somewhere become fewer in each round unless they stand behind a cycle.
    """
    mine = calls.select(*KEY, "after")
    target = calls.select("conv_id", F.col("call_id").alias("after"), F.col("call_id").alias("_i"))
    known = _left(mine, target, ["conv_id", "after"])
    step = materialize(known.select(
        *KEY, F.col("_i").alias("to"), F.when(F.col("_i").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        F.when(F.col("after").isNotNull() & F.col("_i").isNull(), "unknown_dependency").alias("mark")), "depths")
    left = step.where("to is not null").count()
    while left:
        up = step.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("to").alias("_to"),
                         F.col("depth").alias("_d"))
        step = materialize(
            step.where("to is not null").join(up, (F.col("conv_id") == F.col("_c")) & (F.col("to") == F.col("_i")), "left")
            .select(*KEY, F.col("_to").alias("to"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), "mark")
            .unionByName(step.where("to is null")), "depths")
        now = step.where("to is not null").count()
        if now == left:
            break
        left = now
    cyclic = F.col("to").isNotNull()
    return step.select(*KEY, F.when(~cyclic, F.col("depth")).alias("depth"), F.when(cyclic, "cycle").otherwise(F.col("mark")).alias("mark"))


def link_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, call_id, name, arguments, after) and results (conv_id, turn, call_id, content), linked.

    ``tools``: name and the array ``params``, as ``schema_of`` gives it.
    """
    results = results.select("conv_id", "turn", "call_id", "content")
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select(*KEY, "turn", "name", "arguments", "after")
    first = F.struct("turn", "name", "arguments", "after")
    alike = materialize(calls.groupBy(*KEY, "turn", "name", "arguments", "after").agg(F.count(F.lit(1)).alias("_n")), "calls")
    one = materialize(alike.where(keyed).groupBy(*KEY).agg(F.min(first).alias("_f"), (F.sum("_n") - 1).alias("n_same")), "first-calls")
    answers = results.where(keyed).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_results"))
    d = depths(one.select(*KEY, "_f.after"))
    known = one.join(answers, KEY, "left").join(d, KEY, "left")     # whole keys only
    # One row for each call: of those equal in every column, the first one alone links.
    every = (_left(_errors(alike, tools), known, KEY)
             .withColumn("_first", F.coalesce(first.eqNullSafe(F.col("_f")), F.lit(False)))
             .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))))
    same = F.coalesce("n_same", F.lit(0)).cast("bigint")
    duplicate = keyed & ~(F.col("_first") & (F.col("_copy") == 1))
    linked = every.select(
        "conv_id", "turn", "call_id", "name", "arguments_json", "errors", same.alias("n_same"),
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        F.when(duplicate, "duplicate").otherwise(
            F.coalesce("mark", F.when(F.col("n_results").isNull(), "unanswered"))).alias("mark"),
        F.when(F.col("mark").eqNullSafe("cycle"), F.lit(None)).otherwise(F.coalesce("depth", F.lit(0))).alias("depth"))
    linked = materialize(linked, "linked")
    asked = linked.where(keyed & ~F.col("mark").eqNullSafe("duplicate")).select(*KEY, F.col("depth").alias("_depth"), F.lit(True).alias("_known"))
    back = _left(results, asked, KEY).select(
        "conv_id", "turn", "call_id", "content", F.col("_depth").alias("depth"),
        F.when(F.col("_known").isNull(), "orphan").alias("mark"))
    return linked, back


def chat_records(messages: DataFrame, calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, depth, turn, kind, call_id, valid, mark, errors, json, n_same: one row per message, call and result.

    A message stands at the depth of the calls of its turn; kinds are 0 message, 1 call, 2 result, 3 call
    whose identifier belongs to another call (mark ``duplicate``); ``n_same`` is null but for calls.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    linked, back = link_calls(calls, results, tools)
    # Messages carry no call: their depth is that of the conversation so far, which the turn tells.
    no = F.lit(None)
    turns = linked.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("depth").alias("depth"))
    message = (_left(messages, turns, ["conv_id", "turn"]).select(
        "conv_id", "depth", "turn", F.lit(0).alias("kind"), no.cast("string").alias("call_id"), F.lit(True).alias("valid"),
        no.cast("string").alias("mark"), no.cast("string").alias("errors"),
        F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"), no.cast("bigint").alias("n_same")))
    call = linked.select(
        "conv_id", "depth", "turn", F.when(F.col("mark").eqNullSafe("duplicate"), 3).otherwise(1).alias("kind"), "call_id", (F.size("errors") == 0).alias("valid"), "mark",
        F.array_join("errors", ",").alias("errors"),
        F.to_json(F.struct(F.lit(None).cast("string").alias("content"), F.lit("assistant").alias("role"), F.array(F.struct(
            F.struct(F.col("arguments_json").alias("arguments"), "name").alias("function"), F.col("call_id").alias("id"),
            F.lit("function").alias("type"))).alias("tool_calls")), {"ignoreNullFields": "false"}).alias("json"), "n_same")
    result = back.select(
        "conv_id", "depth", "turn", F.lit(2).alias("kind"), "call_id", F.col("mark").isNull().alias("valid"), "mark",
        no.cast("string").alias("errors"),
        F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id")),
                  {"ignoreNullFields": "false"}).alias("json"), no.cast("bigint").alias("n_same"))
    return message.unionByName(call).unionByName(result)


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a conversation table stands for.

    Each user turn asks for a tool (even turns ``lookup``, odd turns ``summarise``) with the turn's text
    as an argument; it uses the call two turns before.  The assistant's next turn is its result.
    """
    c = conversations.select("conv_id", "turn", "role", "text")
    ident = F.concat(F.lit("call-"), F.col("turn").cast("string"))
    words = F.size(F.split(F.trim("text"), r"\s+")).cast("bigint")
    even = F.pmod("turn", F.lit(2)) == 0
    calls = c.where("role = 'user'").select(
        "conv_id", "turn", ident.alias("call_id"), F.when(even, "lookup").otherwise("summarise").alias("name"),
        F.when(even, F.to_json(F.struct(F.col("text").alias("query"), words.alias("limit"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("text"), words.alias("max_words")))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.concat(F.lit("call-"), (F.col("turn") - 2).cast("string"))).alias("after"))
    results = c.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.col("text").alias("content"))
    return calls, results


ORACLE = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text FROM conversations),
calls0 AS (SELECT conv_id, turn, 'call-' || CAST(turn AS VARCHAR) AS call_id,
    CASE WHEN turn % 2 = 0 THEN 'lookup' ELSE 'summarise' END AS name,
    len(string_split_regex(trim(text), '\s+')) AS words, text,
    CASE WHEN turn >= 2 THEN 'call-' || CAST(turn - 2 AS VARCHAR) END AS after FROM c WHERE role = 'user'),
args AS (SELECT *, CASE WHEN turn % 2 = 0
    THEN '{"limit":' || CAST(words AS VARCHAR) || CASE WHEN text IS NULL THEN '}' ELSE ',"query":' || CAST(to_json(text) AS VARCHAR) || '}' END
    ELSE '{"max_words":' || CAST(words AS VARCHAR) || CASE WHEN text IS NULL THEN '}' ELSE ',"text":' || CAST(to_json(text) AS VARCHAR) || '}' END
    END AS arguments_json FROM calls0),
calls AS (SELECT conv_id, call_id, min(turn) AS turn, min(name) AS name, min(arguments_json) AS arguments_json,
    min(after) AS after, count(*) AS n FROM args GROUP BY conv_id, call_id),
walk AS (SELECT conv_id, call_id, 0 AS depth FROM calls k WHERE after IS NULL OR NOT EXISTS
        (SELECT 1 FROM calls p WHERE p.conv_id = k.conv_id AND p.call_id = k.after)
    UNION ALL SELECT k.conv_id, k.call_id, w.depth + 1 FROM calls k JOIN walk w ON w.conv_id = k.conv_id AND w.call_id = k.after),
res AS (SELECT conv_id, turn, 'call-' || CAST(turn - 1 AS VARCHAR) AS call_id, text AS content FROM c WHERE role = 'assistant'),
linked AS (SELECT k.*, w.depth,
    CASE WHEN k.after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = k.conv_id AND p.call_id = k.after)
         THEN 'unknown_dependency'
         WHEN NOT EXISTS (SELECT 1 FROM res r WHERE r.conv_id = k.conv_id AND r.call_id = k.call_id) THEN 'unanswered' END AS mark
    FROM calls k JOIN walk w ON w.conv_id = k.conv_id AND w.call_id = k.call_id),
turns AS (SELECT conv_id, turn, min(depth) AS depth FROM linked GROUP BY conv_id, turn)
SELECT c.conv_id, CAST(t.depth AS BIGINT) AS depth, c.turn, 0 AS kind, CAST(NULL AS VARCHAR) AS call_id, true AS valid,
    CAST(NULL AS VARCHAR) AS mark, CAST(NULL AS VARCHAR) AS errors,
    '{"content":' || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(c.role) AS VARCHAR), 'null') || '}' AS json,
    CAST(NULL AS BIGINT) AS n_same
FROM c LEFT JOIN turns t ON t.conv_id = c.conv_id AND t.turn = c.turn
UNION ALL
SELECT conv_id, CAST(depth AS BIGINT), turn, 1, call_id, true, mark, '',
    '{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":' || CAST(to_json(arguments_json) AS VARCHAR)
    || ',"name":"' || name || '"},"id":"' || call_id || '","type":"function"}]}', CAST(n - 1 AS BIGINT) FROM linked
UNION ALL
SELECT r.conv_id, CAST(l.depth AS BIGINT), r.turn, 2, r.call_id, l.call_id IS NOT NULL,
    CASE WHEN l.call_id IS NULL THEN 'orphan' END, CAST(NULL AS VARCHAR),
    '{"content":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || ',"role":"tool","tool_call_id":"' || r.call_id || '"}', CAST(NULL AS BIGINT)
FROM res r LEFT JOIN linked l ON l.conv_id = r.conv_id AND l.call_id = r.call_id
"""
