"""All registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.plans import business, micro, relational, surface, tpch, typed
from quernstone.plans.suite import Query

SUITE: dict[str, Query] = {**tpch.SUITE, **micro.SUITE, **relational.SUITE, **surface.SUITE, **typed.SUITE, **business.SUITE}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(SUITE)
ORACLES: dict[str, str] = {name: q.oracle_text() for name, q in SUITE.items() if q.oracle != ""}
