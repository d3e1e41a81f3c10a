"""What the operators of this subpackage share: table access, Arrow mapping and cut lineage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='trendloom-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a folder of its own; any other is refused, as its executors
    would each write to their own disk.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return own_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trendloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: a later lost executor does not recompute what is above."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the files of tables that :func:`materialize` wrote, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        own = f"{shared_dir(spark)}/trendloom/".split(":", 1)[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if own in folder:
                remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch, where a row can be large: Spark and Python each hold a few batches for each task.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound Arrow batches by BATCH_BYTES meanwhile, unless they are already smaller."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = spark.conf.get(key, "64m")
    now = told.strip().lower().removesuffix("b")
    size = int(now.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if 0 < size <= BATCH_BYTES:
        yield
        return
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, told)


def map_batches(df: DataFrame, fn: Callable[..., dict], schema: str, **context) -> DataFrame:
    """Map Arrow batches: ``fn(columns as Python lists by name, **context)`` returns lists by output column.

    Spark bounds a batch by rows and by bytes, so memory doesn't depend on the partition.
    """
    spark = df.sparkSession
    target = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch.to_pydict(), **context)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], schema).schema)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the least number of parts to deal work out by."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Words are runs of anything but ASCII white space, in every operator here.
WORD = r"[^\x20\x09-\x0D]+"


def unclashed(df: DataFrame, *names: str) -> list[str]:
    """Names for added columns that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
