"""Session logs of varying shape: tool calls as VARIANT, gold labels mined from them, loads and routes counted since a moment.

A log may hold a list of calls or one, with the name and the arguments at the
top or under ``function``, arguments as an object or as a string of JSON, or
something that is no JSON at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.jobs import derived
from ferrule.jobs.prompts import usable
from ferrule.sources.shared import stored

#: The call that says which item was chosen.
CHOSEN = "skill_view"

#: (conv_id, turn, role, text, calls): conversations with the calls that their assistant made.
LOGS = """
SELECT conv_id, turn, role, text, CASE WHEN role <> 'assistant' OR w = '' THEN NULL
  WHEN (conv_id + turn) % 7 = 1 THEN concat('[{"function": {"name": "search", "arguments": "{}"}}, {"function": {"name": "skill_view", "arguments": "{', chr(92), '"name', chr(92), '": ', chr(92), '"', w, chr(92), '"}"}}]')
  WHEN (conv_id + turn) % 7 = 2 THEN concat('{"function": {"name": "skill_view", "arguments": {"name": "', w, '", "depth": 2}}}')
  WHEN (conv_id + turn) % 7 = 3 THEN concat('[{"name": "skill_view", "arguments": {"name": 7}}, {"name": "skill_view", "arguments": {"name": "', w, '"}}]')
  WHEN (conv_id + turn) % 7 = 4 THEN concat('{"name": "skill_view", "arguments": "{', chr(92), '"name', chr(92), '": ', chr(92), '"', w, chr(92), '"}"}')
  WHEN (conv_id + turn) % 7 = 5 THEN concat('[{"function": {"name": "skill_view", "arguments": "{broken ', w, '"}}, 5, null]')
  WHEN (conv_id + turn) % 7 = 6 THEN concat('[{"function": {"name": "', w, '"')
  ELSE '' END AS calls
FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(regexp_extract(text, '([a-z]{6,})', 1), '') AS w FROM conversations) s"""


def called(logs: DataFrame) -> DataFrame:
    """The calls of ``logs`` (..., calls), a row each: pos from 0, name, and arguments as a VARIANT (null where they are no JSON)."""
    one = F.try_parse_json("calls")
    listed = F.when(F.startswith(F.schema_of_variant(one), F.lit("ARRAY")), one).otherwise(F.try_parse_json(F.concat(F.lit("["), "calls", F.lit("]"))))
    rows = logs.withColumn("_calls", F.when(one.isNotNull(), listed))
    rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_calls").outer()))
    value = F.col("value")
    name = F.coalesce(F.try_variant_get(value, "$.function.name", "string"), F.try_variant_get(value, "$.name", "string"))
    given = F.coalesce(F.try_variant_get(value, "$.function.arguments", "variant"), F.try_variant_get(value, "$.arguments", "variant"))
    rows = rows.where(F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))).select(*logs.columns, "pos", name.alias("name"), given.alias("_given"))
    inner = F.when(F.schema_of_variant("_given") == "STRING", F.try_parse_json(F.try_variant_get("_given", "$", "string"))).otherwise(F.col("_given"))
    return rows.select(*logs.columns, "pos", "name", inner.alias("arguments"))


def _named(arguments):
    """The name that arguments give, if it is a text."""
    value = F.try_variant_get(arguments, "$.name", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(arguments, "$.name", "string"))


def tool_calls(spark, d):
    rows = called(derived.rows(spark, d, LOGS))
    return rows.select("conv_id", "turn", F.col("pos").cast("int").alias("pos"), "name", _named(F.col("arguments")).alias("chosen"))


def gold_mined(spark, d):
    """(conv_id, turn, prompt, label): prompts with the first item that was chosen while they were answered, before the next prompt."""
    logs = stored(derived.rows(spark, d, LOGS))
    w = Window.partitionBy("conv_id").orderBy("turn")
    last = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    owned = logs.withColumn("prompt_turn", last).where("role = 'assistant' and prompt_turn is not null and calls <> ''")
    chosen = called(owned.select("conv_id", "prompt_turn", "turn", "calls")).where(F.col("name") == CHOSEN).withColumn("label", _named(F.col("arguments"))).where("label <> ''")
    first = chosen.groupBy("conv_id", "prompt_turn").agg(F.min_by("label", F.struct("turn", "pos")).alias("label"))
    prompts = logs.where("role = 'user'").select("conv_id", F.col("turn").alias("prompt_turn"), X.clean_prompt(F.col("text")).alias("prompt"))
    return prompts.where(usable(F.col("prompt"))).join(first, ["conv_id", "prompt_turn"]).select("conv_id", F.col("prompt_turn").alias("turn"), "prompt", "label")


_CALLS = f"""WITH lg AS ({LOGS}),
c0 AS (SELECT *, CASE WHEN json_valid(calls) THEN calls::JSON END AS j FROM lg WHERE calls IS NOT NULL),
c1 AS (SELECT conv_id, turn, role, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS l FROM c0 WHERE j IS NOT NULL),
c2 AS (SELECT conv_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS v FROM c1),
c3 AS (SELECT conv_id, turn, pos, coalesce(json_extract_string(v, '$.function.name'), json_extract_string(v, '$.name')) AS name, coalesce(json_extract(v, '$.function.arguments'), json_extract(v, '$.arguments')) AS a FROM c2 WHERE json_type(v) = 'OBJECT'),
c4 AS (SELECT conv_id, turn, pos, name, CASE WHEN json_type(a) <> 'VARCHAR' THEN a WHEN json_valid(json_extract_string(a, '$')) THEN json_extract_string(a, '$')::JSON END AS a FROM c3),
c5 AS (SELECT conv_id, turn, pos::INT AS pos, name, CASE WHEN json_type(a, '$.name') = 'VARCHAR' THEN json_extract_string(a, '$.name') END AS chosen FROM c4)"""
_MARKS = " OR ".join(f"contains(p, '{m}')" for m in ("<system-reminder>", "<local-command-stdout>", "<command-name>", "<task-notification>", "[SYSTEM NOTIFICATION", "This session is being continued from", "Caveat: The messages below were generated by the user while running"))

QUERIES = {
    "tool_calls": (tool_calls, _CALLS + " SELECT * FROM c5"),
    "gold_mined": (gold_mined, _CALLS + f""", ow AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prompt_turn FROM lg),
fc AS (SELECT conv_id, prompt_turn, arg_min(chosen, (turn, pos)) AS label FROM c5 JOIN ow USING (conv_id, turn) WHERE role = 'assistant' AND prompt_turn IS NOT NULL AND name = 'skill_view' AND chosen <> '' GROUP BY ALL),
cl AS (SELECT conv_id, turn AS prompt_turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '<[^>]+>', ' ', 'g'), '^[ \\t\\n\\r]*[*#]+[ \\t\\n\\r]*', ''), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS p FROM lg WHERE role = 'user'),
wd AS (SELECT *, list_filter(string_split(lower(p), ' '), lambda x: x <> '') AS w FROM cl)
SELECT conv_id, prompt_turn AS turn, p AS prompt, label FROM wd JOIN fc USING (conv_id, prompt_turn) WHERE p <> '' AND NOT regexp_matches(p, '^[*#]') AND NOT ({_MARKS})
  AND NOT (starts_with(p, '/') AND len(w) < 4) AND length(p) BETWEEN 12 AND 1500 AND len(list_distinct(w)) >= greatest(4, len(w) // 8)"""),
}
