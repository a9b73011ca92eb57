"""What a prompt asks for: intents, risks, paths, constraints, gaps, ecosystems, depth, number of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.functions import vocab as V
from ferrule.jobs import derived, sqltext


def requested(prompt: Column) -> Column:
    """The number of results that a prompt names, within 1 and 50; null where it names none."""
    found = F.coalesce(F.nullif(F.regexp_extract(prompt, V.REQUESTED, 1), F.lit("")), F.nullif(F.regexp_extract(prompt, V.REQUESTED, 2), F.lit("")))
    return F.when(found.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(50), found.cast("int"))))


def scaffold(spark, d):
    return features(derived.rows(spark, d, derived.PROMPTS))


def features(prompts: DataFrame) -> DataFrame:
    """All features of prompts (prompt_id, prompt). The pronoun gap looks for the letters, within words too.

    Paths and constraints are given with an x for each character beyond ASCII.
    """
    rows = prompts.withColumn("low", F.lower("prompt"))
    rows = rows.select(
        "prompt_id", "prompt", "low", X.flags(F.col("low"), V.INTENTS).alias("i"), X.flags(F.col("low"), V.RISKS).alias("r"), F.size(X.split_words(F.col("prompt"))).alias("words"),
        F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("prompt", F.lit("(?U)" + V.PATH), F.lit(0)))), 1, 12).alias("p"),
        F.slice(F.transform(F.regexp_extract_all("prompt", F.lit("(?U)" + V.CONSTRAINT), F.lit(0)), lambda x: F.btrim(x, F.lit(" \t\r"))), 1, 6).alias("c"),
    )
    edits = F.arrays_overlap("i", F.array(*map(F.lit, ("implement", "refactor", "debug", "test"))))
    gaps = F.array(
        F.when((F.size("p") == 0) & edits, V.GAPS[0]), F.when(F.array_contains("i", "debug") & ~F.col("low").rlike("(?U)" + V.ERROR_TEXT), V.GAPS[1]),
        F.when((F.col("words") < 8) & (F.size("i") > 0), V.GAPS[2]), F.when(F.col("low").rlike("it|that|this") & (F.col("words") < 15), V.GAPS[3]),
    )
    several = F.col("low").rlike(" (and|then|also|plus) ")
    points = sum(c.cast("int") for c in (F.size("i") >= 2, F.size("i") >= 3, F.col("words") > 25, F.size("p") >= 2, several))
    line = lambda c: F.array_join(c, "|")
    plain = lambda c: F.regexp_replace(line(c), r"[^\x00-\x7F]", "x")
    return rows.select(
        "prompt_id", line("i").alias("intents"), line("r").alias("risks"), plain("p").alias("paths"), plain("c").alias("constraints"),
        line(F.filter(gaps, lambda x: x.isNotNull())).alias("gaps"), "words", (F.concat("prompt", F.lit(" ")).rlike(r"\?\s") & (F.size("i") == 0)).alias("question"),
        F.when(points >= 3, 10).when(points >= 1, 7).otherwise(4).alias("depth"), requested(F.col("prompt")).alias("requested"),
    )


def concept_bridge(spark, d):
    rows = derived.rows(spark, d, derived.PROMPTS).select("prompt_id", X.typed_concepts(F.col("prompt")).alias("c"))
    return rows.where(F.size("c") > 0).select("prompt_id", F.array_join("c", " ").alias("concepts"))


_CONCEPT_SQL = ", ".join(f"('{k}', '{v}')" for k, v in sqltext.CONCEPTS.items())
_CONCEPTS = f"""
WITH RECURSIVE pr AS ({derived.PROMPTS}), kv(k, v) AS (VALUES {_CONCEPT_SQL}),
w AS (SELECT prompt_id, list_transform(regexp_extract_all(lower(prompt), '[a-z0-9][a-z0-9.+#-]{{1,24}}'), lambda x: trim(x, '.-+#')) AS ws FROM pr),
hot AS (SELECT * FROM w WHERE len(list_intersect(ws, (SELECT list(k) FROM kv))) > 0),
f AS (SELECT prompt_id, ws, 1 AS i, []::VARCHAR[] AS seen, []::VARCHAR[] AS emitted FROM hot UNION ALL
  SELECT prompt_id, ws, i + 1,
    CASE WHEN list_contains(seen, ws[i]) OR ws[i] = '' THEN seen ELSE list_concat(list_append(seen, ws[i]), coalesce(string_split(v, ' '), [])) END,
    CASE WHEN list_contains(seen, ws[i]) OR v IS NULL THEN emitted ELSE list_concat(emitted, list_filter(string_split(v, ' '), lambda t: NOT list_contains(list_append(seen, ws[i]), t))) END
  FROM f LEFT JOIN kv ON k = ws[i] WHERE i <= len(ws))
SELECT prompt_id, array_to_string(emitted, ' ') AS concepts FROM f WHERE i = len(ws) + 1 AND len(emitted) > 0"""

SCAFFOLD = r"""
WITH pr AS (@PROMPTS@),
i(k, name, rx) AS (VALUES
 (1, 'debug', '\b(bug\w*|broken|fail\w*|error\w*|crash\w*|traceback|regress\w*|not work\w*|why (is|does|isn))'),
 (2, 'implement', '\b(add|build|creat\w*|implement\w*|writ\w*|scaffold\w*|generat\w*|set ?up|wire)\b'),
 (3, 'refactor', '\b(refactor\w*|clean ?up|simplif\w*|renam\w*|restructur\w*|extract\w*|dedupe)\b'),
 (4, 'review', '\b(review\w*|audit\w*|critique|smell|lint\w*|check (this|my))\b'),
 (5, 'explain', '\b(explain\w*|how does|what does|walk me|understand|trace|document\w*)\b'),
 (6, 'test', '\b(test\w*|coverage|tdd|assert\w*|spec)\b'),
 (7, 'perf', '\b(slow|perf\w*|optimi[sz]\w*|latency|throughput|memory|profil\w*)\b'),
 (8, 'security', '\b(secur\w*|vuln\w*|exploit\w*|auth\w*|token\w*|secret\w*|injection|xss|csrf|permission\w*)'),
 (9, 'deploy', '\b(deploy\w*|releas\w*|ship|rollout|docker|kubernetes|k8s|ci|pipeline|publish\w*)\b'),
 (10, 'data', '\b(quer\w*|sql|schema\w*|index\w*|migrat\w*|dataset\w*|dataframe|etl)\b'),
 (11, 'design', '\b(design\w*|ui|ux|layout|css|animat\w*|figma|landing|theme|chart\w*)\b'),
 (12, 'research', '\b(research\w*|compar\w*|evaluat\w*|find out|investigat\w*|which (tool|library))\b'),
 (13, 'docs', '\b(api|sdk|library|framework|version|changelog|upgrade|latest|docs?)\b')),
r(k, name, rx) AS (VALUES
 (1, 'destructive', '(\brm -rf|\bdrop\b[^.\n]{0,20}\b(table|database|schema)|\btruncat\w*|\bdelet\w*|force ?push|reset --hard|\bprune\b|\bmkfs|\bdd if=)'),
 (2, 'secrets', '\b(api[_ -]?key|token|password|credential\w*|\.env|secret\w*)\b'),
 (3, 'outbound', '\b(publish\w*|deploy to prod\w*|send (an )?email|post to|push to (main|master)|tweet)\b'),
 (4, 'migration', '\b(migrat\w*|schema change|alter table|backfill)')),
-- a letter outside ASCII is part of a word
t AS (SELECT prompt_id, prompt, lower(prompt) AS low, regexp_replace(lower(prompt), '[^\x00-\x7F]', 'x', 'g') AS ascii, regexp_replace(prompt, '[^\x00-\x7F]', 'x', 'g') AS plain FROM pr),
fi AS (SELECT prompt_id, list(name ORDER BY k) AS i FROM t, i WHERE regexp_matches(ascii, rx) GROUP BY prompt_id),
fr AS (SELECT prompt_id, list(name ORDER BY k) AS r FROM t, r WHERE regexp_matches(ascii, rx) GROUP BY prompt_id),
f AS (SELECT t.*, coalesce(i, []) AS i, coalesce(r, []) AS r, len(list_filter(regexp_split_to_array(prompt, '[ \t\n\r]+'), lambda x: x <> '')) AS words,
  list_sort(list_distinct(regexp_extract_all(plain, '[\w.~/-]+/[\w.-]+\.\w{1,8}|\b[\w-]+\.(?:py|ts|tsx|js|jsx|ex|exs|rs|go|java|kt|rb|php|sql|md|json|ya?ml|toml|sh)\b')))[1:12] AS p,
  list_transform(regexp_extract_all(plain, '\b(?:must|should|never|only|don''?t|do not|avoid|without|keep|preserve|no)\b[^.;\n]{0,80}', 0, 'i'), lambda x: trim(x, ' ' || chr(9) || chr(13)))[1:6] AS c
  FROM t LEFT JOIN fi USING (prompt_id) LEFT JOIN fr USING (prompt_id)),
g AS (SELECT *, list_filter([
  CASE WHEN len(p) = 0 AND len(list_intersect(i, ['implement', 'refactor', 'debug', 'test'])) > 0 THEN 'no file/module named — locate the target before editing' END,
  CASE WHEN list_contains(i, 'debug') AND NOT regexp_matches(ascii, '\b(error|traceback|exception|log|output|expected)\b') THEN 'no error text or expected-vs-actual given' END,
  CASE WHEN words < 8 AND len(i) > 0 THEN 'terse request — confirm scope before large changes' END,
  CASE WHEN (contains(low, 'it') OR contains(low, 'that') OR contains(low, 'this')) AND words < 15 THEN 'pronoun reference — resolve what ''it/this'' points to' END], lambda x: x IS NOT NULL) AS g,
  (len(i) >= 2)::INT + (len(i) >= 3)::INT + (words > 25)::INT + (len(p) >= 2)::INT + regexp_matches(low, ' (and|then|also|plus) ')::INT AS points,
  regexp_extract(plain, '\btop[- ]?(\d{1,3})\b|\b(\d{1,3})\s+(?:top\s+)?(?:skills|tools|mcp|mcps|plugins|agents|commands)', ['a', 'b'], 'i') AS n FROM f)
SELECT prompt_id, array_to_string(i, '|') AS intents, array_to_string(r, '|') AS risks, array_to_string(p, '|') AS paths, array_to_string(c, '|') AS constraints, array_to_string(g, '|') AS gaps, words,
  regexp_matches(prompt || ' ', '\?\s') AND len(i) = 0 AS question, CASE WHEN points >= 3 THEN 10 WHEN points >= 1 THEN 7 ELSE 4 END AS depth,
  CASE WHEN n.a <> '' OR n.b <> '' THEN greatest(1, least(50, coalesce(TRY_CAST(n.a AS INT), TRY_CAST(n.b AS INT)))) END AS requested FROM g"""

QUERIES = {
    "prompt_scaffold": (scaffold, SCAFFOLD.replace("@PROMPTS@", derived.PROMPTS)),
    "concept_bridge": (concept_bridge, _CONCEPTS),
}
