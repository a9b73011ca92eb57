"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured, and rule failures are added up by host (here the
``source`` column). A host's failure rate under each rule is shrunk towards
the rate of all hosts by an empirical beta prior, fitted by moments to the
hosts' raw rates: small hosts stay near the common rate, large ones near their
own. A host whose shrunk rate exceeds ``LIMIT`` under some rule is rejected,
and the verdict is joined back to its documents.

Rules: ``few_words`` (under 20), ``repeats`` (over 30 % of the words lie in
eight-word windows found twice), ``symbols`` (over 10 % of the characters),
``dup_lines`` (over 30 % as many repeated lines as words).

Edge cases: null text counts as empty (no words, so it fails); a null source
is a host of its own; repeated rows count each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import SPACES, stored, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A host is rejected above this shrunk rate of failures.
LIMIT = 0.5
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def _repeated_words(pairs: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``pairs``: (hash, position), sorted."""
    again = F.filter(
        F.transform(pairs, lambda x, i: F.struct(
            x["at"].alias("at"),
            ((F.get(pairs, i - 1)["h"] == x["h"]) | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"),
        )),
        lambda x: F.coalesce(x["twice"], F.lit(False)),
    )
    starts = F.array_sort(F.transform(again, lambda x: x["at"]))
    begin = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("upto"))

    def cover(acc: Column, at: Column) -> Column:
        return F.struct((acc["covered"] + at + WINDOW - F.greatest(at, acc["upto"])).alias("covered"), (at + WINDOW).alias("upto"))

    return F.aggregate(starts, begin, cover, lambda acc: acc["covered"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host and the measures of every document."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    step = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("host"),
        words(F.col("text")).alias("w"), F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    step = step.select(
        "doc_id", "host", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    step = step.withColumn("some", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    # a column of its own: an expression used within a lambda would be computed for each element
    places = F.arrays_zip(F.col("hashes").alias("h"), F.sequence(F.lit(0), F.size("hashes") - 1).alias("at"))
    step = step.withColumn("pairs", F.when(F.col("some"), F.sort_array(places)))
    repeated = F.coalesce(_repeated_words(F.col("pairs")), F.lit(0)).cast("long")
    return step.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"))


def _failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * n,
    }


def host_verdicts(measures: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(host, n_docs, rate_<rule>..., rejected): one row per host."""
    by_host = measures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(c.cast("long")).alias(r) for r, c in _failures().items()))
    prior = by_host.agg(*(f(F.col(r) / F.col("n_docs")).alias(f"{k}_{r}") for r in RULES for k, f in (("mean", F.avg), ("var", F.var_pop))))
    both = by_host.crossJoin(F.broadcast(prior))  # the prior is one row

    def shrunk(rule: str) -> Column:
        m, v = F.col(f"mean_{rule}"), F.col(f"var_{rule}")
        weight = F.when((v > 0) & (m * (1 - m) > v), m * (1 - m) / v - 1)
        # hosts that do not differ share the mean; hosts as unlike as can be keep their own rates
        return F.when(v > 0, (F.col(rule) + m * F.coalesce(weight, F.lit(0.0))) / (F.col("n_docs") + F.coalesce(weight, F.lit(0.0)))).otherwise(m)

    rated = both.select("host", "n_docs", *(shrunk(r).alias(f"rate_{r}") for r in RULES))
    return rated.withColumn("rejected", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > limit)


def query(docs: DataFrame) -> DataFrame:
    measures = stored(measured(docs))
    verdicts = host_verdicts(measures).select("host", "rejected")
    base = _failures()["few_words"] | _failures()["repeats"]
    joined = measures.join(verdicts, "host", "left").withColumn("base_failed", base)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT row_id, unnest(range(1, len(w) - 6)) AS p0, w FROM w WHERE len(w) >= 8),
win AS (SELECT row_id, p0, array_to_string(w[p0:p0 + 7], ' ') AS s FROM pos),
again AS (SELECT row_id, p0 FROM (SELECT *, count(*) OVER (PARTITION BY row_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT row_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT row_id, unnest(range(p0, p0 + 8)) AS p FROM again) GROUP BY row_id),
m AS (SELECT w.row_id, doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
  length(array_to_string(w, '')) AS word_chars, length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (row_id)),
f AS (SELECT *, n_words < 20 AS few_words, 100 * n_repeat_words > 30 * n_words AS repeats,
  10 * n_symbols > word_chars AS symbols, 100 * n_dup_lines > 30 * n_words AS dup_lines FROM m),
h AS (SELECT host, count(*) AS n, sum(few_words::INT) AS a, sum(repeats::INT) AS b, sum(symbols::INT) AS c, sum(dup_lines::INT) AS e FROM f GROUP BY host),
r AS (SELECT host, n, unnest([a, b, c, e]) AS k, unnest([1, 2, 3, 4]) AS rule FROM h),
p AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM r GROUP BY rule),
s AS (SELECT host, CASE WHEN v > 0 THEN (k + m * g) / (n + g) ELSE m END AS rate
  FROM (SELECT r.*, m, v, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 0 END AS g FROM r JOIN p USING (rule))),
v AS (SELECT host, max(rate) > 0.5 AS rejected FROM s GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
  NOT (few_words OR repeats) AND NOT rejected AS kept FROM f JOIN v USING (host)
"""
