"""Fixture generators: deterministic tables of any size from spark.range, spread over all executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, n: int) -> Column:
    """A number below n that depends on id and seed alone, in place of random()."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)).cast("int")


def join_left(spark: SparkSession, rows: int = 1_000_000) -> DataFrame:
    return spark.range(1, rows + 1).select("id", (F.col("id") % 100_000).cast("int").alias("key1"), (F.col("id") % 50_000).cast("int").alias("key2"), draw(1, 10_001).alias("val"), F.concat(F.lit("left_"), "id").alias("payload"))


def join_right(spark: SparkSession, rows: int = 500_000) -> DataFrame:
    return join_left(spark, rows).withColumn("val", draw(2, 10_001)).withColumn("payload", F.concat(F.lit("right_"), "id"))


def bench_data(spark: SparkSession, rows: int = 1_000_000) -> DataFrame:
    return spark.range(1, rows + 1).select("id", (F.col("id") % 100).cast("int").alias("grp"), *(draw(10 + k, 10_001).alias(f"val{k}") for k in range(1, 6)), F.concat(F.lit("row_"), "id").alias("txt"))


def date_data(spark: SparkSession, rows: int = 1_000_000) -> DataFrame:
    start = F.lit("2000-01-01").cast("timestamp_ntz")
    return spark.range(1, rows + 1).select("id", F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 10_000).cast("int")).alias("d"), (start + F.make_dt_interval(secs=(F.col("id") % 10_000_000).cast("decimal(18,6)"))).alias("ts"), draw(20, 1_001).alias("val"))


def wide(spark: SparkSession, columns: int, rows: int = 100_000) -> DataFrame:
    """About a tenth of the values are not null; seven types take turns."""
    kinds = ["string", "int", "string", "bigint", "string", "boolean", "decimal(12,4)"]
    return spark.range(1, rows + 1).select("id", (F.col("id") % 50).cast("int").alias("grp"), *(F.when((F.col("id") * 7919 + k) % 10 == 0, (draw(k, 1000) if kinds[k % 7] != "boolean" else draw(k, 2)).cast(kinds[k % 7])).alias(f"c{k:04d}") for k in range(1, columns + 1)))
