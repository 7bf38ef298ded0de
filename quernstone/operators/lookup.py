"""CASE and IN over large lists, and top rows of groups, in the form that scales.

A chain of WHEN branches is evaluated one by one and can outgrow a compiled method. Equality cases become one map
lookup, monotonic thresholds one binary search over a literal array, long lists a hash set or a join.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Members up to which a list stays a literal in the plan.
LITERALS = 5_000


def case_equal(x: Column, branches: dict[Any, Any], other: Any = None) -> Column:
    """CASE x WHEN k THEN v ..; a null x takes the ELSE value, as no branch equals it."""
    table = F.create_map(*(F.lit(v) for pair in branches.items() for v in pair))
    return F.when(x.isNull(), F.lit(other)).otherwise(F.coalesce(F.try_element_at(table, x), F.lit(other)))


def case_below(x: Column, bounds: list[Any], values: list[Any], other: Any = None) -> Column:
    """CASE WHEN x < bounds[0] THEN values[0] WHEN x < bounds[1] ..; bounds ascend. Null takes the ELSE value."""
    if sorted(bounds) != bounds or len(bounds) != len(values):
        raise ValueError("ascending bounds with a value each are needed")
    array = F.array(*(F.lit(b) for b in bounds))
    passed = F.size(F.filter(array, lambda b: x >= b))
    return F.when(x.isNull() | (passed == len(bounds)), F.lit(other)).otherwise(F.element_at(F.array(*(F.lit(v) for v in values)), F.least(passed + 1, F.lit(len(values)))))


def is_in(df: DataFrame, column: str, members: list[Any]) -> DataFrame:
    """Rows whose value is a member. Nulls in the list match nothing; a long list is joined rather than compiled."""
    known = list(dict.fromkeys(m for m in members if m is not None))
    if len(known) <= LITERALS:
        return df.filter(F.col(column).isin(known))
    kind = dict(df.dtypes)[column]
    listed = df.sparkSession.createDataFrame([(m,) for m in known], f"{column} {kind}")
    return df.join(listed, column, "left_semi")


def top_rows(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group (LATERAL .. ORDER BY .. LIMIT k). Spark limits groups before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """NOT IN (subquery): no row at all if the subquery has a null, as three-valued logic has it."""
    other.createOrReplaceTempView("_not_in_right")
    df.createOrReplaceTempView("_not_in_left")
    return df.sparkSession.sql(f"SELECT * FROM _not_in_left WHERE `{column}` NOT IN (SELECT `{other_column}` FROM _not_in_right)")
