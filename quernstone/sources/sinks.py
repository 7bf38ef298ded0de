"""Sinks: range-partitioned Parquet, and what stands in for row updates on immutable files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_ranges(df: DataFrame, path: str, column: str, bounds: list[int], name: str = "part") -> None:
    """One folder for each range between ascending bounds, so a filter on `name` prunes whole folders.

    Rows go to the range's writers spread by the other columns too: one large range is not one task.
    """
    at = F.lit(0)
    for k, bound in enumerate(bounds, 1):
        at = F.when(F.col(column) >= bound, k).otherwise(at)
    df.withColumn(name, at).hint("rebalance", name).write.mode("overwrite").partitionBy(name).parquet(path)


def updated(df: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """UPDATE as a projection: new values where the condition is true, types kept; the result is written elsewhere."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(where, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in changes.items()})


def updated_from(df: DataFrame, source: DataFrame, key: str, changes: dict[str, str]) -> DataFrame:
    """UPDATE .. FROM: values of a source with one row for each key; rows without one keep theirs."""
    renamed = source.select(key, *(F.col(s).alias(f"_new_{c}") for c, s in changes.items()), F.lit(True).alias("_met"))
    kinds = dict(df.dtypes)
    out = df.join(renamed, key, "left").withColumns({c: F.when(F.col("_met"), F.col(f"_new_{c}").cast(kinds[c])).otherwise(F.col(c)) for c in changes})
    return out.select(*df.columns)
