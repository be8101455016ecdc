"""Window frames that Spark SQL lacks: GROUPS, and EXCLUDE for all frames.

The peers of a row are the rows of its partition with the same order values.
Peers are summed up first, so a run of ties is one row. Their dense numbers come
from sorted parts (``ordering.add_position``), and a GROUPS frame is a range over
these numbers, cut into overlapping buckets: neither a partition with very many
rows nor one with very many groups of peers goes through one task. Open frames go
over the parts with one row carried from part to part.

EXCLUDE puts the result together from what stands outside the row's own peers,
the peers, and the row itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.functions.columns import ref
from grainfold.operators import ordering
from grainfold.session import cut_lineage

FRAMES = ("rows", "range", "groups")
EXCLUDES = ("no others", "current row", "group", "ties")
AGGREGATES = ("sum", "count", "avg", "min", "max")
SPANS = 16  # frame widths per bucket
_STATES = ("s", "c", "lo", "hi")  # sum, count of values, least, greatest


def _merge(name: str):
    return {"s": F.sum, "c": F.sum, "lo": F.min, "hi": F.max}[name]


def _put_together(parts: list[dict[str, Column]]) -> dict[str, Column]:
    """One state from some that share no row; a state of nothing is null, with the count null or 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    add = lambda name: reduce(lambda a, b: F.coalesce(a + b, a, b), [p[name] for p in parts])
    pick = lambda fn, name: fn(*[p[name] for p in parts], F.lit(None), F.lit(None))
    return {"s": add("s"), "c": reduce(lambda a, b: a + b, [zero(p["c"]) for p in parts]), "lo": pick(F.least, "lo"), "hi": pick(F.greatest, "hi")}


def _result(aggregate: str, state: dict[str, Column]) -> Column:
    some = F.when(state["c"] > 0, state["s"])
    return {"sum": some, "count": F.coalesce(state["c"], F.lit(0)), "avg": some / state["c"], "min": state["lo"], "max": state["hi"]}[aggregate]


def framed(
    df: DataFrame, measures: dict[str, tuple[str, str]], partition_by: Sequence[str], order_by: Sequence[str],
    frame: str = "groups", start: int | None = None, end: int | None = 0, exclude: str = "no others", descending: bool = False, nulls_first: bool = False,
) -> DataFrame:
    """``df`` with ``measures``, a name for each (aggregate, column), over a frame around every row.

    ``start`` and ``end`` are offsets (negative before the row, positive after it,
    None without end) in rows, order values or groups of peers. Aggregates are sum,
    count, avg, min and max; nulls are not counted, and a frame without a value
    gives null (count 0). The least and greatest value under an EXCLUDE are stated
    for GROUPS frames and, without the current row, for ROWS frames.
    """
    if frame not in FRAMES or exclude not in EXCLUDES:
        raise ValueError(f"frames: {', '.join(FRAMES)}; excludes: {', '.join(EXCLUDES)}")
    if start is not None and end is not None and start > end:
        raise ValueError("the frame ends before it starts")
    if any(a not in AGGREGATES for a, _ in measures.values()):
        raise ValueError(f"aggregates: {', '.join(AGGREGATES)}")
    if not order_by:
        raise ValueError("a frame needs an order")
    values = list(dict.fromkeys(c for _, c in measures.values()))
    at = {c: str(i) for i, c in enumerate(values)}
    # Working columns beside the whole row, so that no name can clash.
    rows = df.select(F.struct(*[ref(c) for c in df.columns]).alias("_row"),
                     *[ref(c).alias(f"_p{i}") for i, c in enumerate(partition_by)], *[ref(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
                     *[ref(c).alias(f"_v{at[c]}") for c in values])
    if frame == "groups":
        states = _groups(rows, len(partition_by), len(order_by), list(at.values()), start, end, exclude, descending, nulls_first)
    else:
        states = _plain(rows, len(partition_by), len(order_by), {at[c]: {a for a, x in measures.values() if x == c} for c in values}, frame, start, end, exclude, descending, nulls_first)
    out, state_of = states
    return out.select("_row.*", *[_result(a, state_of[at[c]]).alias(name) for name, (a, c) in measures.items()])


def _order(c: Column, descending: bool, nulls_first: bool) -> Column:
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def _own(i: str) -> dict[str, Column]:
    v = F.col(f"_v{i}")
    return {"s": v, "c": v.isNotNull().cast("long"), "lo": v, "hi": v}


# --- GROUPS ----------------------------------------------------------------------------------------

def _groups(rows, n_keys, n_order, values, start, end, exclude, descending, nulls_first):
    keys, order = [f"_p{i}" for i in range(n_keys)], [f"_o{i}" for i in range(n_order)]
    peers = rows.groupBy(*keys, *order).agg(*[
        agg.alias(f"_{name}{i}") for i in values for name, agg in
        (("s", F.sum(f"_v{i}")), ("c", F.count(f"_v{i}")), ("lo", F.min(f"_v{i}")), ("hi", F.max(f"_v{i}")))])
    # One numbering over all partitions: inside a partition it is dense, and that is all a frame needs.
    sort = [ref(k).asc_nulls_first() for k in keys] + [_order(F.col(o), descending, nulls_first) for o in order]
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(1)
    numbered = cut_lineage(ordering.add_position(peers, sort, "_g").withColumn("_key", key))
    inside = (start is None or start <= 0) and (end is None or end >= 0)
    spans = [(start, end)]
    if inside:  # what comes before the peers and what comes after them
        spans = [(start, -1)] * (start is None or start < 0) + [(1, end)] * (end is None or end > 0)
    found = numbered
    for k, span in enumerate(spans):
        found = _over(found, values, *span, f"_f{k}")
    if inside and exclude == "current row":  # the second least and greatest of the peers
        numbered_values = rows.select(*keys, *order, *[f"_v{i}" for i in values])
        both = _same(numbered_values, found.select(*[F.col(c).alias(f"_x{c}") for c in (*keys, *order)], *[F.col(f"_{n}{i}").alias(f"_x{n}{i}") for i in values for n in ("lo", "hi")]), [*keys, *order])
        second = both.groupBy(*keys, *order).agg(*[a for i in values for a in (
            F.min(F.when(F.col(f"_v{i}") > F.col(f"_xlo{i}"), F.col(f"_v{i}"))).alias(f"_lo_next{i}"), F.max(F.when(F.col(f"_v{i}") < F.col(f"_xhi{i}"), F.col(f"_v{i}"))).alias(f"_hi_next{i}"),
            F.count_if(F.col(f"_v{i}") == F.col(f"_xlo{i}")).alias(f"_lo_times{i}"), F.count_if(F.col(f"_v{i}") == F.col(f"_xhi{i}")).alias(f"_hi_times{i}"))])
        second = second.select(*[F.col(c).alias(f"_x{c}" if c in (*keys, *order) else c) for c in second.columns])
        found = _same(found, second, [*keys, *order]).drop(*[f"_x{c}" for c in (*keys, *order)])
    found = found.drop("_g", "_key")
    out = _same(rows, found.select(*[F.col(c).alias(f"_x{c}" if c in (*keys, *order) else c) for c in found.columns]), [*keys, *order])
    state = {}
    for i in values:
        parts = [{n: F.col(f"_f{k}{n}{i}") for n in _STATES} for k in range(len(spans))]
        own, peer = _own(i), {n: F.col(f"_{n}{i}") for n in _STATES}
        if inside:
            if exclude == "no others":
                parts.append(peer)
            elif exclude == "ties":
                parts.append(own)
            elif exclude == "current row":
                less = lambda end, v, i=i: F.when((v == F.col(f"_{end}{i}")) & (F.col(f"_{end}_times{i}") == 1), F.col(f"_{end}_next{i}")).otherwise(F.col(f"_{end}{i}"))
                v = F.col(f"_v{i}")
                c = peer["c"] - own["c"]
                parts.append({"s": F.when(c > 0, peer["s"] - F.coalesce(v, F.lit(0))), "c": c, "lo": F.when(c > 0, less("lo", v)), "hi": F.when(c > 0, less("hi", v))})
        nothing = {"s": F.lit(None).cast("double"), "c": F.lit(0).cast("long"), "lo": F.lit(None), "hi": F.lit(None)}
        state[i] = _put_together(parts or [{**nothing, "lo": F.when(F.lit(False), F.col(f"_v{i}")), "hi": F.when(F.lit(False), F.col(f"_v{i}"))}])
    return out, state


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Join on columns that are equal or both null; the right side carries them with the prefix ``_x``."""
    return left.join(right, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_x{n}")) for n in names]))


def _over(numbered: DataFrame, values: list[str], start: int | None, end: int | None, prefix: str) -> DataFrame:
    """Adds the states over the groups with numbers from g + ``start`` to g + ``end`` of the same partition."""
    if start is not None and end is not None:
        width = end - start + 1
        size = SPANS * max(width, abs(start), abs(end))
        # A group goes to every bucket in which the frame of some row can hold it.
        first, last = F.floor((F.col("_g") - end) / size), F.floor((F.col("_g") - start) / size)
        own = F.floor(F.col("_g") / size)
        to = F.array_distinct(F.array(first, own, last))
        spread = numbered.select("*", own.alias("_own"), F.explode(to).alias("_b"))
        w = Window.partitionBy("_key", "_b").orderBy("_g").rangeBetween(start, end)
        out = spread.select("*", *[_merge(n)(f"_{n}{i}").over(w).alias(f"{prefix}{n}{i}") for i in values for n in _STATES])
        return out.where("_b = _own").drop("_own", "_b")
    if start is None and end is None:
        whole = numbered.groupBy(F.col("_key").alias("_k")).agg(*[_merge(n)(f"_{n}{i}").alias(f"{prefix}{n}{i}") for i in values for n in _STATES])
        return numbered.join(whole, F.col("_key").eqNullSafe(F.col("_k"))).drop("_k")
    backward = end is None  # from an offset to the end of the partition
    offset = start if backward else end
    running = _running(numbered, values, prefix, backward)
    if offset == 0:
        return running
    # the running state of the group at the offset; beyond the partition's last group that of the last
    at = running.select(F.col("_key").alias("_k"), F.col("_g").alias("_at"), *[f"{prefix}{n}{i}" for i in values for n in _STATES])
    edge = numbered.groupBy(F.col("_key").alias("_e")).agg(F.min("_g").alias("_first"), F.max("_g").alias("_last"))
    aim = F.col("_g") + offset
    aim = F.greatest(aim, F.col("_first")) if backward else F.least(aim, F.col("_last"))
    placed = numbered.join(edge, F.col("_key").eqNullSafe(F.col("_e"))).withColumn("_aim", aim)
    return placed.join(at, (F.col("_aim") == F.col("_at")) & F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_e", "_first", "_last", "_aim", "_at", "_k")


def _running(numbered: DataFrame, values: list[str], prefix: str, backward: bool) -> DataFrame:
    """States from the first group of the partition to the row's (from the row's to the last if ``backward``), part by part."""
    names = [(n, i) for i in values for n in _STATES]
    by = F.col("_g").desc() if backward else F.col("_g").asc()
    parts = ordering.sort_into_parts(numbered, [F.col("_key"), by])
    part, pos = ordering.PART, ordering.POS
    ends = parts.groupBy(part, "_key").agg(*[_merge(n)(f"_{n}{i}").alias(f"_t{n}{i}") for n, i in names])
    # Only a key that goes on over a border has earlier parts: at most two a part.
    first = parts.groupBy(part).agg(F.min_by("_key", pos).alias("_key")).select("_key").distinct()
    earlier = Window.partitionBy("_key").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(F.broadcast(first), "_key", "left_semi").select(
        F.col(part).alias("_cp"), F.col("_key").alias("_ck"), *[_merge(n)(f"_t{n}{i}").over(earlier).alias(f"_c{n}{i}") for n, i in names])
    here = Window.partitionBy(part, "_key").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[_merge(n)(f"_{n}{i}").over(here).alias(f"_l{n}{i}") for n, i in names])
    both = local.join(F.broadcast(carried), (F.col(part) == F.col("_cp")) & F.col("_key").eqNullSafe(F.col("_ck")), "left")
    for i in values:
        whole = _put_together([{n: F.col(f"_l{n}{i}") for n in _STATES}, {n: F.col(f"_c{n}{i}") for n in _STATES}])
        both = both.withColumns({f"{prefix}{n}{i}": c for n, c in whole.items()})
    return both.drop("_cp", "_ck", part, pos, *[f"_{x}{n}{i}" for n, i in names for x in "lc"])


# --- ROWS and RANGE --------------------------------------------------------------------------------

def _plain(rows, n_keys, n_order, wanted, frame, start, end, exclude, descending, nulls_first):
    keys, order = [f"_p{i}" for i in range(n_keys)], [f"_o{i}" for i in range(n_order)]
    sort = [_order(F.col(o), descending, nulls_first) for o in order]
    if frame == "rows":  # ties keep one order in all windows
        rows, sort = rows.withColumn("_tie", F.monotonically_increasing_id()), [*sort, F.col("_tie")]
    low, high = Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end
    inside = low <= 0 <= high
    whole = Window.partitionBy(*keys).orderBy(*sort)
    peers = Window.partitionBy(*keys, *order)
    state = {}
    for i, aggregates in wanted.items():
        v = F.col(f"_v{i}")
        over = lambda w, v=v: {"s": F.sum(v).over(w), "c": F.count(v).over(w), "lo": F.min(v).over(w), "hi": F.max(v).over(w)}
        in_frame = over(whole.rowsBetween(low, high) if frame == "rows" else whole.rangeBetween(low, high))
        if exclude == "no others" or not inside and (frame == "range" or exclude == "current row"):
            state[i] = in_frame
            continue
        if frame == "rows" and exclude == "current row":
            before = [over(whole.rowsBetween(low, -1))] if low < 0 else []
            after = [over(whole.rowsBetween(1, high))] if high > 0 else []
            state[i] = _put_together([*before, *after] or [{n: F.when(F.lit(False), c) for n, c in in_frame.items()}])
            continue
        if aggregates & {"min", "max"}:
            raise ValueError(f"min and max are not stated for {frame} frames that exclude {exclude}")
        # peers that lie in the frame: all of them for values, those at these distances for rows
        gone = over(peers.orderBy(*sort).rowsBetween(low, high) if frame == "rows" else peers)
        own = _own(i)
        if exclude == "current row":
            gone = own
        kept = {"s": F.coalesce(in_frame["s"], F.lit(0)) - F.coalesce(gone["s"], F.lit(0)), "c": in_frame["c"] - gone["c"], "lo": v, "hi": v}
        if exclude == "ties" and inside:
            kept = {"s": kept["s"] + F.coalesce(v, F.lit(0)), "c": kept["c"] + own["c"], "lo": v, "hi": v}
        state[i] = kept
    named = {f"_z{n}{i}": c for i, s in state.items() for n, c in s.items()}
    out = rows.select("*", *[c.alias(k) for k, c in named.items()])
    return out, {i: {n: F.col(f"_z{n}{i}") for n in _STATES} for i in state}
