"""Chat formatting in DataFrame functions only: tool calls meet their results, are ordered, checked and written as JSON.

Calls and results are hash-joined by conversation and call identifier, so a conversation of any length is spread over
all tasks. A call may name the call that it follows. Its depth, the number of calls before it on that path, is found
by pointer doubling: each round joins every call with the one its pointer shows and doubles the reach, so a chain
of a million calls takes twenty rounds. Ordered by depth, every call comes after what it follows; calls on a cycle have no
depth. Arguments are checked against the schema of their tool by expressions built from it, and serialised
canonically: keys sorted, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Types of a schema, as Spark names the kinds of JSON values.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
_KEYS = ["conv_id", "call_id"]


def _field_errors(name: str, rule: dict, value: Column) -> list[Column]:
    """A message for each way in which the field breaks its rule, null where it doesn't."""
    part = F.try_variant_get(value, f"$.{name}", "variant")
    kind = F.schema_of_variant(part)
    there = part.isNotNull()
    out = [F.when(~there, F.lit(f"missing:{name}"))] if rule.get("required") else []
    fits = kind.rlike(f"^({_KINDS[rule['type']]})$")
    out.append(F.when(there & ~fits, F.lit(f"type:{name}")))
    number = F.try_variant_get(value, f"$.{name}", "double")
    text = F.try_variant_get(value, f"$.{name}", "string")
    if "minimum" in rule:
        out.append(F.when(there & fits & (number < rule["minimum"]), F.lit(f"minimum:{name}")))
    if "maximum" in rule:
        out.append(F.when(there & fits & (number > rule["maximum"]), F.lit(f"maximum:{name}")))
    if "minLength" in rule:
        out.append(F.when(there & fits & (F.char_length(text) < rule["minLength"]), F.lit(f"minLength:{name}")))
    if "enum" in rule:
        out.append(F.when(there & fits & ~text.isin(rule["enum"]), F.lit(f"enum:{name}")))
    return out


def errors_of(tool: Column, arguments: Column, value: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """Array of messages, in the schema's order; empty if the arguments are valid."""
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    found = F.array(F.lit("unknown_tool"))
    for name, fields in sorted(schemas.items()):
        own = F.array(*[e for field, rule in sorted(fields.items()) for e in _field_errors(field, rule, value)])
        known = F.array(*[F.lit(f) for f in sorted(fields)])
        extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unexpected:"), k))
        found = F.when(tool == name, F.concat(F.filter(own, lambda e: e.isNotNull()), extra)).otherwise(found)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, found).otherwise(F.array(F.lit("not_an_object")))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): 0 for a call that follows none or one that isn't there, null on or after a cycle."""
    known = calls.select("conv_id", F.col("call_id").alias("follows")).distinct()
    rows = calls.select(*_KEYS, "follows").distinct()
    linked = rows.join(known.withColumn("there", F.lit(True)), ["conv_id", "follows"], "left")
    state = linked.select(*_KEYS, F.when(F.col("there"), F.col("follows")).alias("jump"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
    state, before = materialize(state, "calls"), None
    while True:
        left = state.where("jump is not null").count()
        if left == 0 or left == before:
            return state.select(*_KEYS, F.when(F.col("jump").isNull(), F.col("depth")).alias("depth"))
        before = left
        ahead = state.select("conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        state = state.join(ahead, ["conv_id", "jump"], "left").select(*_KEYS, F.col("next").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = materialize(state, "calls")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """One row per call: conv_id, call_id, name, depth, n_results, valid, errors, json.

    calls: (conv_id, call_id, follows, name, arguments); results: (conv_id, call_id, content). A call without conv_id or
    call_id is dropped, as nothing can refer to it. Calls that repeat an identifier are one: the smallest (name,
    arguments, follows) stands. Of several results the smallest content is taken, n_results counts all; results of
    unknown calls are left out. Null arguments are not an object. The JSON leaves out what is null. Further columns don't
    matter. Rows in the order of (depth, call_id) are in topological order within their conversation, null depths last.
    """
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(whole).groupBy(*_KEYS).agg(F.min(F.struct("name", "arguments", "follows")).alias("c")).select(*_KEYS, "c.name", "c.arguments", "c.follows")
    one = materialize(one, "unique")
    said = results.where(whole).groupBy(*_KEYS).agg(F.count("*").alias("n_results"), F.min("content").alias("content"))
    joined = one.join(said.hint("shuffle_hash"), _KEYS, "left").join(depths(one).hint("shuffle_hash"), _KEYS, "left")
    rows = joined.withColumn("value", F.try_parse_json("arguments"))
    rows = rows.withColumn("errors", errors_of(F.col("name"), F.col("arguments"), F.col("value"), schemas))
    # Fields in alphabetical order: what to_json writes is canonical.
    written = F.to_json(F.struct(F.col("value").alias("arguments"), "call_id", "depth", "follows", "name", F.col("content").alias("result"), (F.size("errors") == 0).alias("valid")))
    return rows.select("conv_id", "call_id", "name", "depth", F.coalesce("n_results", F.lit(0)).alias("n_results"), (F.size("errors") == 0).alias("valid"), F.concat_ws(";", "errors").alias("errors"), written.alias("json"))


#: Tools of the conversations table.
SCHEMAS = {
    "search": {"limit": {"type": "integer", "required": True, "minimum": 1, "maximum": 40}, "query": {"type": "string", "required": True, "minLength": 1}},
    "summarize": {"limit": {"type": "integer", "required": True, "minimum": 10}, "query": {"type": "string", "required": True}},
    "translate": {"limit": {"type": "integer"}, "query": {"type": "string", "required": True}},
}


def of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in a table of (conv_id, turn, role, text).

    Each user turn is a call: its tool by the length of the text, its arguments the text and the number of its spaces plus
    one, and it follows the user turn two before it, if there is one. Each assistant turn is the result of the
    call one turn before it. So that each kind of error occurs, a quarter of the lengths name a tool that isn't known, every
    seventh has no limit, every eleventh has it as a string and every thirteenth has a further field. Null roles
    and turns are neither call nor result; a null text is an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    length = F.char_length(text)
    name = F.element_at(F.array(*[F.lit(t) for t in ("search", "summarize", "translate", "lookup")]), (length % 4 + 1).cast("int"))
    limit = F.when(length % 7 != 0, length - F.char_length(F.translate(text, " ", "")) + 1)
    further = F.when(length % 13 == 0, F.lit("en"))
    written = lambda limit: F.to_json(F.struct(text.alias("query"), limit.alias("limit"), further.alias("lang")))
    arguments = F.when(length % 11 == 0, written(limit.cast("string"))).otherwise(written(limit))
    of = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    calls = turns.where("role = 'user' and turn is not null").select("conv_id", of(F.col("turn")).alias("call_id"), of(F.col("turn") - 2).alias("follows"), name.alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant' and turn is not null").select("conv_id", of(F.col("turn") - 1).alias("call_id"), text.alias("content"))
    return calls, results


ORACLE = """
WITH RECURSIVE u AS MATERIALIZED (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user' AND turn IS NOT NULL AND conv_id IS NOT NULL),
d(conv_id, turn, depth) AS (SELECT conv_id, turn, 0 FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, d.depth + 1 FROM d JOIN u ON u.conv_id = d.conv_id AND u.turn = d.turn + 2),
a AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, min(coalesce(text, '')) AS content FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY 1, 2),
x AS (SELECT u.conv_id, u.turn, t, depth, n_results, content, len(t) AS n, CASE WHEN len(t) % 7 <> 0 THEN len(t) - len(replace(t, ' ', '')) + 1 END AS lim,
  CASE len(t) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'summarize' WHEN 2 THEN 'translate' ELSE 'lookup' END AS name FROM u JOIN d USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn)),
e AS (SELECT *, CASE WHEN name = 'lookup' THEN 'unknown_tool' ELSE concat_ws(';',
  CASE WHEN lim IS NULL THEN CASE WHEN name <> 'translate' THEN 'missing:limit' END WHEN n % 11 = 0 THEN 'type:limit' WHEN name = 'summarize' AND lim < 10 THEN 'minimum:limit' WHEN name = 'search' AND lim > 40 THEN 'maximum:limit' END,
  CASE WHEN name = 'search' AND t = '' THEN 'minLength:query' END, CASE WHEN n % 13 = 0 THEN 'unexpected:lang' END) END AS errors FROM x)
SELECT conv_id, 'call_' || turn AS call_id, name, CAST(depth AS BIGINT) AS depth, coalesce(n_results, 0) AS n_results, errors = '' AS valid, errors,
 '{"arguments":{' || CASE WHEN n % 13 = 0 THEN '"lang":"en",' ELSE '' END || CASE WHEN lim IS NULL THEN '' WHEN n % 11 = 0 THEN '"limit":"' || lim || '",' ELSE '"limit":' || lim || ',' END || '"query":' || CAST(to_json(t) AS VARCHAR) || '},"call_id":"call_' || turn || '","depth":' || depth || ',"follows":"call_' || (turn - 2) || '","name":"' || name || '"'
 || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || CAST(to_json(content) AS VARCHAR) END || ',"valid":' || CASE WHEN errors = '' THEN 'true' ELSE 'false' END || '}' AS json
FROM e
"""
