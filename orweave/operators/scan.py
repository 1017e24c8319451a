"""Scans: a table under an alias, its columns renamed so that no two tables' names clash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orweave.sources.catalog import Catalog


def scan(catalog: Catalog, table: str, alias: str) -> DataFrame:
    frame = catalog.table(table)
    return frame.select(*[F.col(f"`{c}`").alias(f"{alias}__{c}") for c in frame.columns])
