"""Delimited and JSON text, with schemas declared rather than inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = "|", trailing: bool = True) -> DataFrame:
    """Pipe-delimited .tbl files and the like; a line may end with a separator. A value of the wrong type is an error."""
    found = spark.read.schema(schema).options(sep=sep, mode="FAILFAST", enforceSchema="true")
    if trailing:
        from pyspark.sql.types import StringType, StructField

        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        wide = StructType([*kind.fields, StructField("_end", StringType())])
        return found.schema(wide).csv(path).drop("_end")
    return found.csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
