"""Prompt jobs over conversations: features, admission, keys, intents, labels by carry-forward."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.functions import vocab as V
from ferrule.jobs import derived, sqltext
from ferrule.jobs.scaffold import SCAFFOLD
from ferrule.operators import similar
from ferrule.sources.tables import table, texts


def _turns(spark, d):
    return texts(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def skip_reason(text, source):
    p = F.btrim(text, F.lit(" \t\n\r"))
    marked = F.lit(False)
    for m in V.MACHINE_MARKERS:
        marked = marked | p.contains(m)
    return (
        F.when(source.isin(list(V.MACHINE_SOURCES)), F.concat(F.lit("source="), source)).when(p == "", "empty").when(p.rlike(r"^[*#]"), "bypass prefix")
        .when(marked, "machine-generated content").when(p.startswith("/") & (F.size(X.split_words(p)) < 4), "slash command")
    )


def usable(text, source=None):
    """Whether a prompt can be a labelled example: typed by someone, neither short nor long, and not one word over and over."""
    words = X.split_words(F.lower(text))
    varied = F.size(F.array_distinct(words)) >= F.greatest(F.lit(4), F.floor(F.size(words) / 8))
    return skip_reason(text, F.lit(None).cast("string") if source is None else source).isNull() & F.length(text).between(12, 1500) & varied


def admission(spark, d):
    rows = _turns(spark, d)
    return rows.select("conv_id", "turn", skip_reason(F.col("text"), F.col("role")).alias("reason"), usable(F.col("text"), F.col("role")).alias("usable"))


def keys(spark, d):
    rows = _turns(spark, d).withColumn("t", X.intent_tokens(F.col("text")))
    return rows.select("conv_id", "turn", X.clean_prompt(F.col("text")).alias("clean"), X.norm_key(F.col("text")).alias("key"), X.intent_key(F.col("t")).alias("intent"))


def answered(spark, d):
    """Each assistant turn with the latest user turn before it, once for each user turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    prompt = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    rows = _turns(spark, d).withColumn("prompt_turn", prompt).where("role = 'assistant' and prompt_turn is not null")
    return rows.groupBy("conv_id", "prompt_turn").agg(F.min("turn").alias("turn"))


def similar_intents(spark, d, least=0.6):
    """Prompts with another prompt of at least that token overlap: the best, the first of equals."""
    rows = derived.rows(spark, d, derived.PROMPTS).select(F.col("prompt_id").alias("id"), X.intent_tokens(F.col("prompt")).alias("t"))
    return similar.best(rows, least)


def duplicates(spark, d):
    """Documents grouped by normalised text: the first, how many, their labels."""
    docs = texts(spark, d, "documents").select("doc_id", "source", F.sha2(X.norm_key(F.col("text")), 256).alias("key"))
    marks = table(spark, d, "labels").select("doc_id", "quality")
    rows = docs.join(marks, "doc_id", "left").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("quality")).alias("q"), F.min_by("source", "doc_id").alias("source"))
    return rows.select("first_id", "n", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("labels"), "source")


def tally(spark, d):
    """How often each intent stands in the turns of each role; list values are counted one by one."""
    return _turns(spark, d).select("role", F.explode(X.flags(F.lower("text"), V.INTENTS)).alias("intent")).groupBy("role", "intent").agg(F.count(F.lit(1)).alias("n"))


_IT = f"list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{2,}}')), lambda w: w NOT IN ({', '.join(repr(w) for w in sqltext.INTENT_STOP)}))"

_INTENTS = "WITH " + SCAFFOLD[SCAFFOLD.index("i(k, name, rx)") : SCAFFOLD.index("r(k, name, rx)")].strip().rstrip(",")

QUERIES = {
    "prompt_admission": (admission, "WITH f AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM conversations), a AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS p FROM f), b AS (SELECT *, CASE WHEN role IN ('system', 'loop_wakeup', 'schedule_wakeup', 'poll_event') THEN 'source=' || role WHEN p = '' THEN 'empty' WHEN regexp_matches(p, '^[*#]') THEN 'bypass prefix' WHEN " + " OR ".join(f"contains(p, '{m}')" for m in ("<system-reminder>", "<local-command-stdout>", "<command-name>", "<task-notification>", "[SYSTEM NOTIFICATION", "This session is being continued from", "Caveat: The messages below were generated by the user while running")) + " THEN 'machine-generated content' WHEN starts_with(p, '/') AND len(w) < 4 THEN 'slash command' END AS reason FROM a) SELECT conv_id, turn, reason, reason IS NULL AND length(text) BETWEEN 12 AND 1500 AND len(list_distinct(list_transform(w, lambda x: lower(x)))) >= greatest(4, len(w) // 8) AS usable FROM b"),
    "prompt_keys": (keys, f"WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), k AS (SELECT *, list_sort({_IT}) AS s FROM t) SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '<[^>]+>', ' ', 'g'), '^[ \\t\\n\\r]*[*#]+[ \\t\\n\\r]*', ''), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS clean, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS key, CASE WHEN len(s) > 24 THEN 'intent:' || left(sha1(array_to_string(s, ' ')), 16) || ' (' || len(s) || ' tokens)' ELSE array_to_string(s, ' ') END AS intent FROM k"),
    "answered_prompts": (answered, "WITH t AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prompt_turn FROM conversations) SELECT conv_id, prompt_turn, min(turn) AS turn FROM t WHERE role = 'assistant' AND prompt_turn IS NOT NULL GROUP BY ALL"),
    "similar_intents": (similar_intents, f"WITH pr AS ({derived.PROMPTS}), u AS (SELECT prompt_id AS id, {_IT.replace('lower(text)', 'lower(prompt)')} AS t FROM pr), w AS (SELECT id, len(t) AS n, unnest(t) AS w FROM u), p AS (SELECT a.id, b.id AS other, round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 4) AS overlap FROM w a JOIN w b ON a.w = b.w AND a.id <> b.id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, other) AS k FROM p WHERE overlap >= 0.6::DOUBLE) SELECT id, other, overlap FROM r WHERE k = 1"),
    "duplicate_documents": (duplicates, "WITH k AS (SELECT doc_id, source, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' ') AS key, quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT min(doc_id) AS first_id, count(*) AS n, coalesce(string_agg(DISTINCT quality::VARCHAR, ',' ORDER BY quality::VARCHAR), '') AS labels, arg_min(source, doc_id) AS source FROM k GROUP BY key"),
    "intent_tally": (tally, _INTENTS + " SELECT role, name AS intent, count(*) AS n FROM (SELECT role, regexp_replace(lower(coalesce(text, '')), '[^\\x00-\\x7F]', 'x', 'g') AS t FROM conversations), i WHERE regexp_matches(t, rx) GROUP BY ALL"),
}
