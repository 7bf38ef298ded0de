"""Registered SQL queries: one text for the engine, from which the oracle's text follows.

A query names driver tables or fixtures; a fixture is a SELECT over driver tables that both sides put in front as a
common table expression, so the optimiser prunes it like any other relation. Short forms keep results comparable:
ISUM(x) is a sum as bigint, DSUM(x) a sum rounded to two places, DAVG(x) a mean rounded to four.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quernstone.sources import TABLES, read_table

#: Name -> SELECT. A fixture may use driver tables and fixtures defined before it.
FIXTURES: dict[str, str] = {}

SHORT = {"ISUM": "cast(sum({}) as bigint)", "DSUM": "round(sum({}), 2)", "DAVG": "round(avg({}), 4)"}
#: What the oracle calls by another name.
ORACLE_WORDS = [
    (r"\bget_json_object\(", "json_extract_string("),
    (r"\barray\(", "list_value("),
    (r"\bregexp_like\(", "regexp_matches("),
    (r"\bdiv\b", "//"),
    (r"\btimestamp_ntz\b", "timestamp"),
    (r"\barrays_overlap\(", "list_has_any("),
    (r"\barray_contains\(", "list_contains("),
    (r"\bexplode\(", "unnest("),
    (r"\bcollect_list\(", "list("),
    (r"\bunix_micros\(", "epoch_us("),
    (r"\bchar_length\(", "length("),
    (r"\bshiftleft\(", "pg_shl("),
]


def expand(sql: str) -> str:
    """Replaces the short forms; their parentheses may nest."""
    while m := re.search(r"\b(ISUM|DSUM|DAVG)\(", sql):
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        sql = sql[: m.start()] + SHORT[m[1]].format(sql[m.end() : at - 1]) + sql[at:]
    return sql


def names_in(sql: str, known: list[str]) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", sql))
    return [n for n in known if n in words]


def with_fixtures(sql: str, fixtures: dict[str, str] | None = None) -> str:
    """Puts the fixtures that sql needs in front of it."""
    known = FIXTURES if fixtures is None else fixtures
    needed = set(names_in(sql, list(known)))
    for name in reversed(known):
        if name in needed:
            needed |= set(names_in(known[name], [n for n in known if n != name]))
    parts = [f"{n} AS ({known[n]})" for n in known if n in needed]
    if not parts:
        return sql
    if m := re.match(r"\s*WITH\s", sql, re.I):
        return f"WITH {', '.join(parts)}, {sql[m.end() :]}"
    return f"WITH {', '.join(parts)} {sql}"


@dataclass
class Query:
    sql: str
    oracle: str | None = None
    tables: list[str] = field(default_factory=list)
    #: Values of named parameters (:name); a caller may give others.
    args: dict[str, object] = field(default_factory=dict)

    def text(self) -> str:
        return expand(with_fixtures(self.sql))

    def oracle_text(self) -> str:
        sql = expand(with_fixtures(self.sql if self.oracle is None else self.oracle))
        for pattern, word in ORACLE_WORDS:
            sql = re.sub(pattern, word, sql)
        return sql

    def __call__(self, spark: SparkSession, sf_dir: str, **args: object) -> DataFrame:
        sql = self.text()
        for name in names_in(sql, TABLES):
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(sql, args={**self.args, **args} or None)


def queries(found: dict[str, Query]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(found)


def oracles(found: dict[str, Query]) -> dict[str, str]:
    return {name: q.oracle_text() for name, q in found.items()}
