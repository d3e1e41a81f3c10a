"""``python -m trendloom QUERY --data FOLDER [--out FOLDER] [--master URL]``: a registered query, shown or written."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .plans.queries import QUERIES

    parser = argparse.ArgumentParser(prog="trendloom")
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("--data", required=True, help="folder of the tables")
    parser.add_argument("--out", help="Parquet folder; without it the first 20 rows are shown")
    parser.add_argument("--again", action="store_true", help="write even if the folder is there in full")
    parser.add_argument("--master", help="where to run; the environment's default otherwise")
    told = parser.parse_args(argv)
    builder = SparkSession.builder.appName(f"trendloom {told.query}").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(told.master) if told.master else builder).getOrCreate()
    if told.out:
        from .sources import stage

        stage(spark, told.out, lambda: QUERIES[told.query](spark, told.data), told.again)
    else:
        QUERIES[told.query](spark, told.data).show(20, truncate=False)


if __name__ == "__main__":
    main()
