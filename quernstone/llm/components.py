"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import settle

#: Links that one task may hold; more are worked on as tables.
ONE_TASK = 16_384


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(links: DataFrame, path: str) -> DataFrame:
    """node, component (the smallest node it reaches) for each node of links (a, b), both long and not null.

    Rounds of large stars (each node's larger neighbours move to its smallest neighbour) and small stars (its
    smaller neighbours do) end in one star for each component; each round is written below path. A node with very
    many links costs rows, not a collected list. Once few links are left, one task finishes them.
    """
    at = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{path}/links-0")
    for k in itertools.count(1):  # ends when a round changes nothing, which stars do after some log(nodes) rounds
        n = at.count()
        if n <= ONE_TASK:
            return at.coalesce(1).mapInArrow(_union, "node long, component long")
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = settle(large, f"{path}/large-{k}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
        small = settle(small, f"{path}/links-{k}")
        changed = small.exceptAll(at).limit(1).count() + at.exceptAll(small).limit(1).count()
        at = small
        if not changed:
            break
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
