"""JSON text: validity in all its forms, containment and key tests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_first = r"^[ \t\n\r]*"


def is_json(doc: Column, kind: str = "value", unique: bool = False) -> Column:
    """IS JSON [VALUE | OBJECT | ARRAY | SCALAR] [WITH UNIQUE KEYS]; null for null. The session lets keys repeat."""
    valid = F.try_parse_json(doc).isNotNull()
    if unique:
        valid = valid & unique_keys(doc)
    starts = {"value": F.lit(True), "object": doc.rlike(_first + r"\{"), "array": doc.rlike(_first + r"\["), "scalar": ~doc.rlike(_first + r"[\[{]")}[kind]
    return F.when(doc.isNotNull(), valid & starts)


def contains(doc: Column, members: dict[str, object]) -> Column:
    """doc @> {..} for scalar members at the top level. Types count: a text is no number, but 42 is 42.0."""
    parsed = F.try_parse_json(doc)
    out = F.lit(True)
    for key, value in members.items():
        found = F.try_variant_get(parsed, f"$['{key}']", "variant")
        kind = F.schema_of_variant(found)
        if value is None:
            same = F.is_variant_null(found)
        elif isinstance(value, bool):
            same = (kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == value)
        elif isinstance(value, str):
            same = (kind == "STRING") & (F.try_variant_get(found, "$", "string") == value)
        else:
            number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
            same = number & (F.try_variant_get(found, "$", "double") == float(value))
        out = out & F.coalesce(same, F.lit(False))
    return F.when(doc.isNotNull(), out)


def unique_keys(doc: Column) -> Column:
    """Whether no object of a JSON text has a key twice, at any depth; false for what is no JSON, null for null."""

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        def pairs(items: list[tuple[str, object]]) -> dict[str, object]:
            if len({k for k, _ in items}) < len(items):
                raise ValueError("a key occurs twice")
            return dict(items)

        def one(text: str | None) -> bool | None:
            if text is None:
                return None
            try:
                json.loads(text, object_pairs_hook=pairs)
            except ValueError:
                return False
            return True

        return texts.map(one)

    return check(doc)


def has_key(doc: Column, key: str) -> Column:
    """doc ? 'key' for an object; false for anything else."""
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))
