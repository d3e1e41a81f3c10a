"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def weekly_counts(stream: DataFrame, time: str = "published_at", late: str = "14 days") -> DataFrame:
    """Mentions of each category in weeks from Sunday (UTC), with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "7 days", "7 days", "3 days"), "category").agg(F.count("*").alias("mentions")).select("category", F.date_format("window.start", "yyyy-MM-dd").alias("week_start"), "mentions")


def first_only(stream: DataFrame, key: str, time: str = "published_at", late: str = "60 days") -> DataFrame:
    """Rows whose key wasn't seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def first_ever(stream: DataFrame, key: str) -> DataFrame:
    """Rows whose key was never seen: the keys stay in the checkpoint's state for good, so it grows with them.

    :func:`keys_on_disk` keeps that state out of the executors' heaps.
    """
    return stream.dropDuplicates([key])


@contextlib.contextmanager
def keys_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile hold their state in files with a cache in front, and commit what changed."""
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collected(result: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Run what is available, write it to ``out`` and read it.

    Complete results replace those before. Others go to a folder for each batch, so a batch that is run again after a
    failure replaces what it had written.
    """
    spark = result.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch_id={number}")

    result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def incremental(stream: DataFrame, known: Callable[[], DataFrame], key: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Each batch: rows with new keys are processed and written to the batch's own folder of ``out``.

    ``known`` reads the keys present before; keys of the batch's own folder are not among them if it is run again, as
    that folder is emptied first.
    """

    def step(batch: DataFrame, number: int) -> None:
        from ..operators.records import first_by, new_rows

        place = f"{out}/batch_id={number}"
        hadoop = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        hadoop.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        fresh = new_rows(first_by(batch, [key], F.col(key)), known(), key)
        process(fresh).write.mode("overwrite").parquet(place)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
