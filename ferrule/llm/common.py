"""What the operators of this subpackage share: tables on shared storage, words, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
SPACES = "\t\n\x0b\x0c\r "
SPACES_RX = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. A temporary folder
    stands in only on one machine, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="ferrule-"))
    return _own_dir[0]


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, ``stored`` writes below one folder, which goes at the end: results must be written by then."""
    _scratch.append(f"{shared_dir(spark)}/ferrule/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        discard(spark, _scratch.pop())


def discard(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, within the scratch folder if there is one."""
    return f"{_scratch[-1] if _scratch else shared_dir(spark) + '/ferrule'}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, so that a lost executor costs a re-read and not a
    recomputation, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = own_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids that may be broadcast, about 50 MB.
BROADCAST_ROWS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """Stored ``ids`` (a long each), broadcast while they are few, so that a join with them does not shuffle texts."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


_kept: dict[object, object] = {}


def kept(key: object, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept by this process until another key is asked for: one large thing at a time."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        _kept[key] = build()
    return _kept[key]


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES_RX)
    return F.filter(parts, lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (node, root) per node with an edge.

    Each round sends every node to the least node of its neighbourhood, follows
    that pointer once more and contracts the graph. Each step is a grouping with
    map-side minima or a join, so nothing is gathered anywhere, and a star or
    chain of any size takes rounds in the logarithm of its length.
    """
    spark = edges.sparkSession
    left = stored(_canonical(edges, "a", "b"))
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        least = stored(least.select("node", F.least("node", "m").alias("parent")))
        above = least.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = stored(least.join(above, "parent").select("node", F.col("above").alias("parent")))
        steps.append(step)
        ends = left.join(step.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        ends = ends.join(step.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        left = stored(_canonical(ends, "pa", "pb"))
    if not steps:
        return spark.createDataFrame([], "node long, root long")

    def onward(found: DataFrame, step: DataFrame) -> DataFrame:
        nxt = step.select(F.col("node").alias("root"), F.col("parent").alias("next"))
        return found.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    return reduce(onward, steps[1:], steps[0].select("node", F.col("parent").alias("root")))


def _canonical(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
