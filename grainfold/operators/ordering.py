"""Row order at scale: positions, running totals and fills over a whole sorted table.

A window without partition keys, or with one very large partition, would pull
those rows into a single task. Here the table is range-partitioned by the sort
keys, every part is worked on by itself, and only one small row per part is
combined. The sorted rows are written out once, so part numbers stay the same
when a task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.functions.columns import ref
from grainfold.session import cut_lineage

PART, POS = "_part", "_pos"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _keys(order_by: Sequence[str | Column]) -> list[Column]:
    return [ref(k) if isinstance(k, str) else k for k in order_by]


def sort_into_parts(df: DataFrame, order_by: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Rows with ``_part`` (number of the sorted range) and ``_pos`` (order inside it).

    Equal sort keys are told apart by a running number, so a long run of ties
    is spread over several parts as well.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _keys(order_by)
    numbered = df.withColumn("_tie", F.monotonically_increasing_id())
    spread = numbered.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    marked = spread.drop("_tie").withColumn("_row", F.monotonically_increasing_id())
    return cut_lineage(
        marked.withColumn(PART, F.shiftright("_row", _ROW_BITS).cast("int"))
        .withColumn(POS, F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_row")
    )


def _offsets(sorted_df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier parts; as many rows as there are parts."""
    per_part = sorted_df.groupBy(PART).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        PART, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums]
    )


def add_position(df: DataFrame, order_by: Sequence[str | Column], name: str = "position") -> DataFrame:
    """0-based position of every row in the whole sorted table."""
    sorted_df = sort_into_parts(df, order_by)
    offsets = _offsets(sorted_df, {"_start": F.lit(1)})
    return (
        sorted_df.join(F.broadcast(offsets), PART)
        .withColumn(name, F.col("_start") + F.col(POS))
        .drop(PART, POS, "_start")
    )


def add_running(df: DataFrame, order_by: Sequence[str | Column], totals: dict[str, Column]) -> DataFrame:
    """Running totals up to and including every row of the sorted table."""
    held = df.select("*", *[c.alias(f"_in_{n}") for n, c in totals.items()])
    sorted_df = sort_into_parts(held, order_by)
    offsets = _offsets(sorted_df, {f"_off_{n}": F.col(f"_in_{n}") for n in totals})
    inside = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    out = sorted_df.join(F.broadcast(offsets), PART)
    for n in totals:
        out = out.withColumn(n, F.col(f"_off_{n}") + F.sum(f"_in_{n}").over(inside))
    return out.drop(PART, POS, *[f"_in_{n}" for n in totals], *[f"_off_{n}" for n in totals])


def carry(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    backward: bool = False,
    include_current: bool = True,
) -> DataFrame:
    """Fill nulls with the last earlier value (the next later one if ``backward``).

    With ``include_current=False`` every value is replaced by the last one before it.

    The keys are part of the sort, so a key with very many rows spans several
    parts; its last value is carried over the borders through one row per part.
    """
    order = [ref(k).desc_nulls_last() if backward else ref(k).asc_nulls_first() for k in order_by]
    held = df.withColumn("_key", F.struct(*[ref(k) for k in partition_by]) if partition_by else F.lit(1))
    sorted_df = sort_into_parts(held, [F.col("_key"), *order])

    first = sorted_df.groupBy(PART).agg(F.min_by("_key", POS).alias("_key"))
    ends = sorted_df.groupBy(PART, "_key").agg(
        *[F.max_by(ref(c), F.when(ref(c).isNotNull(), F.col(POS))).alias(f"_end_{i}") for i, c in enumerate(columns)]
    )
    # A key that goes on from an earlier part is the first key of a part, so
    # only these pairs matter: at most two per part.
    border_keys = first.select("_key").distinct()
    spans = ends.join(F.broadcast(border_keys), "_key", "left_semi")
    before = Window.partitionBy("_key").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        PART, "_key",
        *[F.last(f"_end_{i}", ignorenulls=True).over(before).alias(f"_carry_{i}") for i in range(len(columns))],
    )
    inside = Window.partitionBy(PART, "_key").orderBy(POS).rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1)
    out = sorted_df.join(F.broadcast(carried), [PART, "_key"], "left")
    filled = {
        c: F.coalesce(F.last(ref(c), ignorenulls=True).over(inside), F.col(f"_carry_{i}"))
        for i, c in enumerate(columns)
    }
    return out.select(*[filled[c].alias(c) if c in filled else ref(c) for c in df.columns])
