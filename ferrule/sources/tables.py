"""Reading: tables, JSON lines, front matter, TOML table names, configuration maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are worked on, dealt out evenly if its files give fewer tasks than there are cores.

    A Parquet file of one row group is one task, however large. An input of many files stays as it is read.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents_in(spark: SparkSession, folder: str, pattern: str = "*.md", head: int = 8000) -> DataFrame:
    """(path, head): the beginning of every file under a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.substring("value", 1, head).alias("head"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank and broken lines are skipped."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null").drop("_broken")


def front_matter(text: Column) -> Column:
    """map of lower-case key -> value from the block between the leading ``---`` and the next.

    A value that is a fold mark takes the indented or blank lines after it, joined by spaces. Quotes around a
    value go; later keys win; comments, other indented lines and lines without a colon are skipped. Text
    without a block, or with one that does not end, has no keys.
    """
    block = F.regexp_extract(text, r"(?s)^---(.*?)\n---", 1)
    kept = F.filter(F.split(block, r"\r?\n"), lambda x: ~x.rlike(r"^[ \t]*#") & (x.rlike(r"^[ \t]*$") | x.rlike(r"^[ \t]") | x.contains(":")))
    empty = F.create_map().cast("map<string,string>")
    start = F.struct(empty.alias("m"), F.lit(None).cast("string").alias("fold"))

    def put(m: Column, key: Column, value: Column) -> Column:
        return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, value))

    def step(acc: Column, x: Column) -> Column:
        line = F.btrim(x, F.lit(" \t"))
        key = F.lower(F.btrim(F.regexp_extract(x, r"^([^:]*):", 1), F.lit(" \t")))
        value = F.btrim(F.regexp_replace(x, r"^[^:]*:", ""), F.lit(" \t"))
        folds = value.rlike(r"^[>|][+-]?$")
        bare = F.when(value.rlike(r"""(?s)^(?:"[^"]*"|'[^']*')$|^"".*"$|^".*"$|^'.*'$"""), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        held = F.coalesce(F.element_at(acc["m"], acc["fold"]), F.lit(""))
        joined = F.when(line == "", held).when(held == "", line).otherwise(F.concat(held, F.lit(" "), line))
        indented = x.rlike(r"^[ \t]") | (line == "")
        more = F.struct(put(acc["m"], acc["fold"], joined).alias("m"), acc["fold"].alias("fold"))
        entry = F.struct(put(acc["m"], key, F.when(folds, F.lit("")).otherwise(bare)).alias("m"), F.when(folds, key).alias("fold"))
        return F.when(indented & acc["fold"].isNotNull(), more).when(indented, acc).otherwise(entry)

    return F.aggregate(kept, start, step, lambda acc: acc["m"])


def toml_tables(text: Column, name: str) -> Column:
    """Names N of the sections ``[name.N]``."""
    return F.regexp_extract_all(text, F.lit(rf"(?m)^[ \t]*\[+{name}\.([^\]\n]+)\]"), F.lit(1))


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    struct = F.struct(*order, *(c for c in rows.columns if c not in order))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min(struct).alias("row")).select("row.*")
