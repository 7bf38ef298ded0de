"""The session the engine expects: ANSI errors, UTC, adaptive execution."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; on a cluster leave master and partitions to the submitter's configuration."""
    builder = SparkSession.builder.appName("quernstone")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("QUERNSTONE_DRIVER_MEMORY", "8g")).config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def info(spark: SparkSession) -> dict[str, str]:
    """What evaluates expressions just now: the settings that stand in for a choice of code generator."""
    keys = ["spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode", "spark.sql.codegen.maxFields", "spark.sql.optimizer.inSetConversionThreshold", "spark.sql.adaptive.enabled", "spark.sql.parquet.enableVectorizedReader", "spark.sql.shuffle.partitions"]
    return {"version": spark.version, "master": spark.sparkContext.master} | {k: str(spark.conf.get(k)) for k in keys}
