"""Sinks: writing a cleaned table as a new data set, exports, table definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.operators.profile import Profile

# SQL type per semantic type.
DDL_TYPES = {
    "numeric": "DOUBLE PRECISION",
    "boolean": "BOOLEAN",
    "datetime": "TIMESTAMP",
    "categorical": "VARCHAR(255)",
    "text": "TEXT",
}


def commit(df: DataFrame, path: str) -> Profile:
    """Write the table to a new folder, then profile what was written."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    profile = Profile(written)
    profile.columns.write.mode("errorifexists").parquet(f"{path}/profile_columns")
    profile.summary().write.mode("errorifexists").parquet(f"{path}/profile_summary")
    return profile


def export_csv(df: DataFrame, path: str) -> None:
    """CSV parts with header; null is the empty cell and quotes are doubled."""
    df.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', emptyValue='""')


def export_profile(profile: Profile, path: str) -> None:
    profile.columns.write.mode("errorifexists").json(path)


def table_definition(profile: Profile, table: str) -> DataFrame:
    """One row: the CREATE TABLE text for the columns of a profile."""
    kind = F.lit("TEXT")
    for semantic, sql_type in DDL_TYPES.items():
        kind = F.when(F.col("semantic_type") == semantic, sql_type).otherwise(kind)
    line = F.concat(F.lit('  "'), F.col("name"), F.lit('" '), kind)
    ordered = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    body = F.array_join(F.transform(ordered, lambda s: s["line"]), ",\n")
    return profile.columns.agg(
        F.concat(F.lit(f'CREATE TABLE "{table}" (\n'), body, F.lit("\n);")).alias("ddl")
    )
