"""Named tables: registering data sets as SQL views and running SQL over them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from grainfold.session import cut_lineage

MAX_ROWS = 10_000
DEFAULT_ROWS = 1_000


def slug(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9]+", "_", name).strip("_").lower() or "dataset"


def free_name(name: str, used: set[str]) -> str:
    """Slug that is not taken yet; ``_1``, ``_2`` ... are tried in turn."""
    base = slug(name)
    candidate, i = base, 1
    while candidate in used:
        candidate, i = f"{base}_{i}", i + 1
    used.add(candidate)
    return candidate


def register(datasets: Iterable[tuple[str, DataFrame]]) -> dict[str, str]:
    """Create one temporary view per data set; returns view name by position-safe label."""
    used: set[str] = set()
    views = {}
    for name, df in datasets:
        view = free_name(name, used)
        df.createOrReplaceTempView(view)
        views[view] = name
    return views


def list_datasets(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Ready data sets, newest first. ``entries`` hold name, view, status, created and row counts."""
    schema = "name string, view string, status string, created long, rows long, columns int"
    from pyspark.sql import functions as F

    rows = [tuple(e.get(k) for k in ("name", "view", "status", "created", "rows", "columns")) for e in entries]
    return (
        spark.createDataFrame(rows, schema)
        .where(F.col("status") == "ready")
        .orderBy(F.desc("created"), "name")
    )


@dataclass
class SqlResult:
    """Rows of a statement, cut at the limit, and whether more would have come."""

    rows: DataFrame
    truncated: bool
    row_count: int | None


def run_sql(spark: SparkSession, text: str, limit: int = DEFAULT_ROWS, count: bool = False) -> SqlResult:
    """Run one statement; only ``limit`` rows (1 to 10 000) are handed out.

    The statement is run once for the rows and the flag: one row more than asked for is written to the shared folder.
    """
    limit = max(1, min(int(limit), MAX_ROWS))
    full = spark.sql(text)
    held = cut_lineage(full.limit(limit + 1))
    found = held.count()
    total = (found if found <= limit else full.count()) if count else None
    return SqlResult(held.limit(limit), found > limit, total)
