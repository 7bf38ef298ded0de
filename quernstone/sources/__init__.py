"""Readers and writers."""

from quernstone.sources.parquet import TABLES, read_table, register

__all__ = ["TABLES", "read_table", "register"]
