"""Parquet table scans (S4).  Projection and filters are left to Catalyst, which pushes them
into the scan (``ReadSchema`` / ``PushedFilters``)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class TableSet:
    """Named tables of one build ("the database"); ``list_tables`` is S5.

    A table may be given as a DataFrame or as a zero-argument function building it; functions
    run on first use, so a check that reads two tables never plans (or materialises) the rest.
    ``stats``: what was counted while tables were written, by table and name."""

    def __init__(self, tables: dict[str, DataFrame | Callable[[], DataFrame]], stats: dict[str, dict[str, int]] | None = None):
        self._tables = dict(tables)
        self.stats = stats or {}

    def list_tables(self) -> list[str]:
        return list(self._tables)

    def table(self, name: str) -> DataFrame:
        t = self._tables[name]
        if callable(t) and not isinstance(t, DataFrame):
            t = self._tables[name] = t()
        return t

    def items(self):
        return [(name, self.table(name)) for name in self._tables]
