"""The library's functions for queries written in SQL.

``register`` adds them to a session:

* ``normalize(word)``, ``tokenize(text)``: the common form of a word, and all normalised tokens of a text;
* ``term_weight(n, df, term)``, ``term_share(tf, length, avg_length, in_name)``: the two factors of BM25;
* ``overlap(a, b)``: Jaccard similarity of two arrays;
* ``score_cliff(TABLE(t) PARTITION BY query_id ORDER BY rank)``: a table function that keeps the rows of each query
  down to the first after the largest drop of its column ``score``, with all columns that the table has.

All but the last are SQL expressions, which the optimiser puts in place of the call.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from ferrule.functions.text import plain_norm
from ferrule.functions.vocab import ENDINGS, GENERIC, STOP, VARIANTS

K1, B, NAME_BOOST, GENERIC_DAMP = 1.2, 0.6, 2.5, 0.4
#: A drop counts among the first rows, above this share, and where there are three rows or more.
CLIFF_ROWS, DROP, LEAST_ROWS = 15, 0.35, 3


def _listed(words) -> str:
    return ", ".join(repr(w) for w in words)


def _norm(w: str) -> str:
    variants = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in VARIANTS.items())
    endings = " ".join(f"WHEN length({w}) > 4 AND endswith({w}, {e!r}) THEN left({w}, length({w}) - {len(e)})" for e in ENDINGS)
    return f"CASE {w} {variants} ELSE CASE {endings} ELSE {w} END END"


_STOP = _listed(STOP)
_FUNCTIONS = {
    "normalize(word STRING) RETURNS STRING": _norm("word"),
    "tokenize(body STRING) RETURNS ARRAY<STRING>": f"""transform(flatten(transform(
      filter(transform(split(lower(coalesce(body, '')), '[^a-z0-9+#._-]+'), x -> btrim(x, '._-')), x -> length(x) >= 2 AND x NOT IN ({_STOP})),
      x -> concat(array(x), CASE WHEN contains(x, '-') OR contains(x, '.') THEN filter(split(x, '[-.]'), p -> length(p) > 2 AND p NOT IN ({_STOP})) ELSE array() END))),
      w -> {_norm('w')})""",
    "term_weight(n BIGINT, df BIGINT, term STRING) RETURNS DOUBLE": f"ln(1 + (n - df + 0.5D) / (df + 0.5D)) * CASE WHEN term IN ({_listed(sorted({plain_norm(w) for w in GENERIC}))}) THEN {GENERIC_DAMP}D ELSE 1D END",
    "term_share(tf BIGINT, length BIGINT, avg_length DOUBLE, in_name BOOLEAN) RETURNS DOUBLE": f"tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * length / avg_length)) * CASE WHEN in_name THEN {NAME_BOOST}D ELSE 1D END",
    "overlap(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
}


class ScoreCliff:
    """Rows of a partition in order; those that wait for the cliff to be known are ``CLIFF_ROWS`` at most."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "score" not in rows.dataType.names:
            raise ValueError("score_cliff takes a table with a column score")
        return AnalyzeResult(rows.dataType)

    def __init__(self) -> None:
        self.head: list[Row] | None = []
        self.edge: float | None = None

    def _known(self) -> list[tuple]:
        """The rows that waited, once the cliff is known."""
        head, self.head = self.head, None
        if len(head) >= LEAST_ROWS:
            drops = [((a["score"] - b["score"]) / a["score"], -k) for k, (a, b) in enumerate(zip(head, head[1:])) if a["score"] > 0]
            most = max(drops, default=(0.0, 0))
            if most[0] > DROP:
                self.edge = head[1 - most[1]]["score"]
        return [tuple(r) for r in head if self.edge is None or r["score"] >= self.edge]

    def eval(self, row: Row):
        if self.head is not None:
            self.head.append(row)
            if len(self.head) == CLIFF_ROWS:
                yield from self._known()
        elif self.edge is None or row["score"] >= self.edge:
            yield tuple(row)

    def terminate(self):
        if self.head:
            yield from self._known()


def register(spark: SparkSession) -> None:
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("score_cliff", udtf(ScoreCliff))
