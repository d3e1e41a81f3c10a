"""Scans and sinks: posts, dimensions, feeds, tables of results and their manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_COLUMNS = "mention_id source platform sub_source source_type keyword query category title text full_text author community published_at collected_at url".split()
NUMBER_COLUMNS = "engagement_score semantic_relevance_score tiktok_relevance_score collector_priority_score".split()
MENTIONS = ", ".join([f"{c} string" for c in TEXT_COLUMNS] + [f"{c} double" for c in NUMBER_COLUMNS] + ["business_context_label string", "metrics_json string"])


def read_mentions(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Posts from CSV with quoted line ends; only ``columns`` are parsed. Malformed rows fail."""
    rows = spark.read.schema(MENTIONS).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    return rows.select(*columns) if columns else rows


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def flat_cells(sheet: DataFrame, drop: tuple[str, ...] = ("", "nan", "brand_name")) -> DataFrame:
    """``value`` of all cells of a sheet read as strings, without blanks and headings."""
    cells = F.array(*(F.trim(F.col(f"`{c}`").cast("string")) for c in sheet.columns))
    return sheet.select(F.explode(cells).alias("value")).where(F.col("value").isNotNull() & ~F.lower("value").isin(*drop))


def read_landing(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """JSON lines that collectors leave in a folder, as a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def read_feed(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Entries of Atom or RSS files."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_config(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def epoch_bounds(day: Column, end: bool = False) -> Column:
    """Seconds of a date's first or last second, UTC."""
    start = F.unix_date(day).cast("bigint") * 86400
    return start + 86399 if end else start


def write_stage(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A stage's table, never the one being read; partitions it holds replace those before."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition) if partition else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """More files in a folder of CSV, each with its heading."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job wrote all of ``path``: a folder without the committer's mark is a broken-off one."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """A stage's table, made only if it isn't there in full or is asked for ``again``."""
    if again or not finished(spark, path):
        write_stage(make(), path)
    return spark.read.parquet(path)


def resumed(spark: SparkSession, rows: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame], steps: int = 16) -> DataFrame:
    """``make`` of all rows, in steps by the hash of their key, each a stage of its own: a rerun does the missing ones.

    ``make`` works row by row. The number of steps is part of the folder's layout and must stay the same.
    """
    own = F.pmod(F.xxhash64(key), F.lit(steps))
    parts = [f"{path}/step={i:05d}" for i in range(steps)]
    for i, part in enumerate(parts):
        if not finished(spark, part):
            write_stage(make(rows.where(own == i)), part)
    return spark.read.parquet(*parts)


def manifest(spark: SparkSession, paths: list[str], required: list[str] | None = None) -> DataFrame:
    """``path, bytes, sha256, modified`` of files; a required one that is missing fails."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))
    names = {r[0].rsplit("/", 1)[-1] for r in files.select("path").collect()} if required else set()
    if gone := sorted(set(required or []) - names):
        raise FileNotFoundError(f"missing artefacts: {gone}")
    return files
