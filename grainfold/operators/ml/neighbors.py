"""Exact nearest neighbours and distance jobs, split into blocks that fit a task.

Points are assigned to the nearest of a few hundred pivots. Radii around the
pivots bound every distance (triangle inequality), so pairs of cells that
cannot matter are left out. Neighbouring cells form groups, large cells several;
a task holds one pair of groups, goes over it in small blocks, and emits only
per-point results, never the pairs. A row goes to as many tasks as there are
groups near it: few, whatever the size of a block. Small point sets, checked by
count, are broadcast instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.functions.columns import stable_order
from grainfold.session import cut_lineage

BROADCAST_POINTS, BROADCAST_BYTES = 20_000, 32 << 20
CELLS = 4_000_000  # distances that a task holds at once
BLOCK = 2_048
PIVOTS = 128
GROUPS, GROUP_BYTES = 16, 32 << 20  # groups of a table whose groups fit a task; larger ones are cut by bytes
LEAF = 256
SAMPLE, SAMPLE_BYTES = 8_192, 8 << 20  # points that bound how far the neighbours of a row can be


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def block_join(
    queries: DataFrame, points: DataFrame, kernel: Kernel, schema: str, reach: float | None = None, k: int | None = None,
    broadcast_points: int = BROADCAST_POINTS, block: int = BLOCK, pivots: int = PIVOTS,
    about: dict[str, Column] | None = None, choose: Callable | None = None, fold: Callable | None = None, whole_groups: bool = False,
    bound: Callable | None = None,
) -> DataFrame:
    """Apply ``kernel(queries, points)`` to all block pairs that may lie within reach.

    A block has at most ``block`` rows; with ``whole_groups`` the kernel takes all
    rows of a task at once (with ``choose`` all near points of a cell) and sees to its own memory. ``fold`` reduces what the
    blocks of one task returned for a query cell.

    Both sides have columns ``id`` and ``v`` (array of doubles), points may carry
    more. ``reach`` is a fixed distance; with ``k`` the reach of each query cell is
    a proven bound on the distance to its k-th nearest point. Where neither says
    which cells matter, ``choose(query cells, point cells, distances of pivots)``
    gives the pairs; the cells have their number, their rows ``rows``, their radius
    ``r`` and the aggregates ``about``. With ``bound(queries, some points)``, a proven reach of every
    single query, a query only goes to groups with a cell in its own reach and carries it as ``limit``.
    """
    spark = queries.sparkSession
    # The width of a row is taken as that of its vector; points may carry one more array of that width.
    size = points.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first() if broadcast_points or bound else None
    if broadcast_points and size["n"] <= broadcast_points and size["n"] * (16 * size["width"] + 64) <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast(points.toPandas())

        def whole(batches):
            for batch in batches:
                step = len(batch) if whole_groups else max(1, CELLS // max(1, len(shared.value)))
                for i in range(0, len(batch), max(1, step)):
                    if len(shared.value):
                        yield kernel(batch.iloc[i : i + step].reset_index(drop=True), shared.value)

        return queries.mapInPandas(whole, schema)

    some = max(pivots, min(SAMPLE, SAMPLE_BYTES // (16 * size["width"] + 64))) if bound else pivots
    sample = points.orderBy(stable_order(F.col("id")), "id").limit(some).select("id", "v").toPandas()
    centres = matrix(sample["v"][:pivots])
    held = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if len(batch):
                d = distances(matrix(batch["v"]), held.value)
                yield batch.assign(cell=d.argmin(1).astype("int32"), gap=d.min(1))

    def placed(df: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(assign, f"{fields}, cell int, gap double")

    q, p = placed(queries), placed(points)
    more = [c.alias(name) for name, c in (about or {}).items()]
    q_cells, p_cells = (df.groupBy("cell").agg(F.count("*").alias("rows"), F.max("gap").alias("r"), *more).toPandas() for df in (q, p))
    between = distances(centres, centres)
    pairs = choose(q_cells, p_cells, between) if choose else _cell_pairs(q_cells, p_cells, between, reach, k)
    width = centres.shape[1] if len(centres) else 0
    q_first, q_parts, q_groups = _groups(q_cells, between, block, width)
    p_first, p_parts, p_groups = _groups(p_cells, between, block, width)
    near: dict[int, list[int]] = {}
    for i, j in pairs:
        near.setdefault(i, []).append(j)
    # At most the square of the groups of a table, which are few.
    met = {(g, h) for i, j in pairs for g in range(q_first[i], q_first[i] + q_parts[i]) for h in range(p_first[j], p_first[j] + p_parts[j])}
    held_near = spark.sparkContext.broadcast({i: np.array(sorted(js)) for i, js in near.items()})

    def dealt(df: DataFrame, first: dict[int, int], parts: dict[int, int], own: str, other: str | None, with_: dict[int, set[int]]) -> DataFrame:
        """Every row once for each group of the other side that a cell near its own belongs to; without ``other`` once, with its own group."""
        rows = [(c, first[c], n, sorted(with_.get(c, ()))) for c, n in parts.items()]
        plan = spark.createDataFrame(rows, "_c int, _first int, _n int, _with array<int>")  # a row for each cell
        spread = df.join(F.broadcast(plan), F.col("cell") == F.col("_c")).withColumn(own, F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
        return (spread.withColumn(other, F.explode("_with")) if other else spread).drop("_c", "_first", "_n", "_with", "gap")

    q_with: dict[int, set[int]] = {}
    p_with: dict[int, set[int]] = {}
    if bound:
        left = cut_lineage(_in_reach(dealt(q, q_first, q_parts, "qg", None, {}), sample, centres, p_cells, p_first, p_parts, bound))
        for g, j in left.select("qg", F.explode("near").alias("near")).distinct().collect():  # at most the groups times the cells
            p_with.setdefault(j, set()).add(g)
        met = {(g, h) for j, gs in p_with.items() for g in gs for h in range(p_first[j], p_first[j] + p_parts[j])}
        left = left.withColumn("pg", F.explode("pg")).drop("near")
    else:
        for i, j in pairs:
            q_with.setdefault(i, set()).update(range(p_first[j], p_first[j] + p_parts[j]))
            p_with.setdefault(j, set()).update(range(q_first[i], q_first[i] + q_parts[i]))
        left = dealt(q, q_first, q_parts, "qg", "pg", q_with)
    right = dealt(p, p_first, p_parts, "pg", "qg", p_with)
    # Own key names on the second side keep two uses of the same table apart.
    right = right.withColumnsRenamed({c: f"{c}_" for c in ("qg", "pg")})
    right = right.repartition(max(1, len(met)), "qg_", "pg_")  # a task for about each pair: partitions that are put together by size would run in a row
    left = left.repartition(max(1, len(met)), "qg", "pg")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if whole_groups and not choose and len(a) and len(b):
            return kernel(a, b)
        a = a.sort_values("cell", kind="stable")
        cell = b["cell"].to_numpy()
        for c, rows in a.groupby("cell", sort=False):
            to = b[np.isin(cell, held_near.value.get(int(c), ()))].reset_index(drop=True)
            if not len(to):
                continue
            if whole_groups:
                found.append(kernel(rows.reset_index(drop=True), to))
                continue
            mine = [kernel(rows.iloc[i : i + block].reset_index(drop=True), to.iloc[j : j + block].reset_index(drop=True))
                    for i in range(0, len(rows), block) for j in range(0, len(to), block)]
            mine = pd.concat(mine, ignore_index=True) if len(mine) > 1 else mine[0]
            found.append(fold(mine) if fold and len(mine) else mine)
        if found:
            return pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]
        return pd.DataFrame({n.strip().split()[0]: [] for n in schema.split(",")})

    return left.groupBy("qg", "pg").cogroup(right.groupBy("qg_", "pg_")).applyInPandas(run, schema)


def _in_reach(queries, sample, centres, cells, first, parts, bound) -> DataFrame:
    """``queries`` with ``limit``, their cells within it (``near``) and the groups of these (``pg``)."""
    ids, r = cells["cell"].to_numpy().astype("int32"), cells["r"].to_numpy(dtype=float)
    groups = np.zeros((len(ids), max((first[c] + parts[c] for c in first), default=0)), dtype="int32")
    for at, c in enumerate(ids):
        groups[at, first[c] : first[c] + parts[c]] = 1
    held = queries.sparkSession.sparkContext.broadcast((sample, centres, ids, r, groups))

    def limited(batches):
        sample, centres, ids, r, groups = held.value
        for batch in batches:
            if not len(batch):
                continue
            v, limit = matrix(batch["v"]), bound(batch, sample)
            gap = distances(v, centres[ids]) - r[None, :]
            near = ~(gap > (limit + _slack(v, centres))[:, None]) & np.isfinite(v).all(1)[:, None]  # a point nowhere has no neighbours
            yield batch.assign(limit=limit, near=[ids[x] for x in near], pg=[np.flatnonzero(x).astype("int32") for x in near.astype("int32") @ groups])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInPandas(limited, f"{fields}, limit double, near array<int>, pg array<int>")


def _groups(cells: pd.DataFrame, between: np.ndarray, block: int, width: int) -> tuple[dict[int, int], dict[int, int], int]:
    """(first group, number of groups) of every cell, and the number of all groups.

    Cells are taken in a chain, each the nearest one left; a cell larger than a group has several to itself.
    """
    rows = dict(zip(cells["cell"].astype(int), cells["rows"].astype(int)))
    most = max(block, min(GROUP_BYTES // (16 * width + 100), math.ceil(sum(rows.values()) / GROUPS)))
    first, parts, group, filled = {}, {}, -1, most
    left, at = set(rows), None
    while left:
        at = min(left, key=lambda c: (between[at, c] if at is not None else 0.0, c))
        left.remove(at)
        n = rows[at]
        parts[at] = max(1, math.ceil(n / most))
        if parts[at] > 1 or filled + n > most:
            first[at], filled = group + 1, most if parts[at] > 1 else n
            group += parts[at]
        else:
            first[at], filled = group, filled + n
    return first, parts, group + 1


def _cell_pairs(q_cells, p_cells, between, reach, k) -> list[tuple[int, int]]:
    """Pairs of cells whose smallest possible distance is within reach."""
    out = []
    p_id, p_r, p_n = p_cells["cell"].to_numpy(), p_cells["r"].to_numpy(), p_cells["rows"].to_numpy()
    for i, rq in zip(q_cells["cell"], q_cells["r"]):
        d = between[int(i), p_id]
        limit = reach
        if k is not None:
            # Points of a cell lie within d + rq + rp of every query of cell i.
            far = d + rq + p_r
            order = np.argsort(far)
            filled = np.searchsorted(np.cumsum(p_n[order]), k)
            limit = far[order][min(filled, len(order) - 1)]
        near = d - rq - p_r <= limit + 1e-9
        out += [(int(i), int(j)) for j in p_id[near]]
    return out


def _leaves(v: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers, ascending in each leaf, of ``v`` halved along its widest side until a leaf has ``size`` rows at most."""
    out, todo = [], [np.arange(len(v))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        held = v[rows]
        side = held[:, int((held.max(0) - held.min(0)).argmax())] if v.shape[1] else np.zeros(len(rows))
        order, half = np.argpartition(side, len(rows) // 2), len(rows) // 2
        todo += [np.sort(rows[order[:half]]), np.sort(rows[order[half:]])]
    return out


def _boxes(v: np.ndarray, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([f(v[x], axis=0) for x in leaves]) for f in (np.min, np.max))


def _slack(va: np.ndarray, vb: np.ndarray) -> float:
    """More than rounding moves a distance."""
    sizes = [np.abs(x[np.isfinite(x)]).max(initial=0.0) for x in (va, vb)]
    return 1e-7 * (1.0 + max(sizes) * math.sqrt(max(1, va.shape[1])))


def near_leaves(va: np.ndarray, vb: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows of a, leaves of rows of b whose box may lie within ``reach`` of them, the nearest first) for every leaf of ``va``."""
    if not len(va) or not len(vb):
        return
    leaves, slack = _leaves(vb, LEAF), _slack(va, vb)
    low, high = _boxes(vb, leaves)
    for rows in _leaves(va, LEAF):
        q = va[rows]
        with np.errstate(invalid="ignore"):
            gap = np.maximum(0.0, np.maximum(low - q.max(0), q.min(0) - high))
            bound = np.nan_to_num(np.sqrt((gap * gap).sum(1)), nan=0.0, posinf=np.inf)
        order = np.argsort(bound, kind="stable")
        yield rows, [leaves[i] for i in order[: np.searchsorted(bound[order], reach + slack, "right")]]


def _search(va: np.ndarray, vb: np.ndarray, k: int, own: np.ndarray | None, ids: np.ndarray, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, distances): the k nearest of every row, ties by row of b; leaves whose box is out of reach are not read.

    ``limit`` bounds each row's reach; what lies beyond it may be left out.
    """
    if not len(va) or not len(vb):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    leaves = _leaves(vb, LEAF)
    low, high = _boxes(vb, leaves)
    slack = _slack(va, vb)
    found = []
    for rows in _leaves(va, LEAF):
        q = va[rows]
        with np.errstate(invalid="ignore"):
            gap = np.maximum(0.0, np.maximum(low - q.max(0), q.min(0) - high))
            bound = np.nan_to_num(np.sqrt((gap * gap).sum(1)), nan=0.0, posinf=np.inf)
        best, at = np.full((len(q), k), np.inf), np.full((len(q), k), len(vb))
        order, i, step = np.argsort(bound, kind="stable"), 0, 2
        most = np.inf if limit is None else limit[rows]
        while i < len(order) and not bound[order[i]] > np.minimum(best[:, -1], most).max() + slack:
            some = np.concatenate([leaves[x] for x in order[i : i + step]])
            i, step = i + step, min(2 * step, 8)
            with np.errstate(invalid="ignore"):
                d = np.round(distances(q, vb[some]), 9)
            d[~np.isfinite(d)] = np.inf
            if own is not None:
                d[own[rows][:, None] == ids[some][None, :]] = np.inf
            both, where = np.concatenate([best, d], 1), np.concatenate([at, np.broadcast_to(some, d.shape)], 1)
            r, c = np.nonzero((both <= np.partition(both, k - 1, axis=1)[:, k - 1 : k]) & np.isfinite(both))
            d, x = both[r, c], where[r, c]
            sorted_ = np.lexsort((x, d, r))
            r, d, x = r[sorted_], d[sorted_], x[sorted_]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            r, d, x, place = (y[place < k] for y in (r, d, x, place))
            best, at = np.full_like(best, np.inf), np.full_like(at, len(vb))
            best[r, place], at[r, place] = d, x
        r, c = np.nonzero(np.isfinite(best))
        found.append((rows[r], at[r, c], best[r, c]))
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest(
    queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, extra: dict[str, str] | None = None, **settings,
) -> DataFrame:
    """(id, other, distance, rank, extra...): the k nearest points of every query, ties by point id."""
    extra = extra or {}
    take = k + 1 if exclude_self else k

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id").reset_index(drop=True)
        ids, mine = b["id"].to_numpy(), a["id"].to_numpy()
        rows, cols, d = _search(matrix(a["v"]), matrix(b["v"]), k, mine if exclude_self else None, ids, a["limit"].to_numpy() if "limit" in a else None)
        out = pd.DataFrame({"id": mine[rows], "other": ids[cols], "distance": d})
        for c in extra:
            out[c] = b[c].to_numpy()[cols]
        return out

    def bound(a: pd.DataFrame, some: pd.DataFrame) -> np.ndarray:
        """Distance to the k-th nearest of some points: the k nearest of all are no farther."""
        rows, _, d = _search(matrix(a["v"]), matrix(some["v"]), k, a["id"].to_numpy() if exclude_self else None, some["id"].to_numpy())
        limit = np.zeros(len(a))
        np.maximum.at(limit, rows, d)
        return np.where(np.bincount(rows, minlength=len(a)) >= k, limit, np.inf)

    fields = "".join(f", {c} {t}" for c, t in extra.items())
    id_type = dict(points.dtypes)["id"]
    found = block_join(queries.select("id", "v"), points, kernel, f"id {id_type}, other {id_type}, distance double{fields}", k=take, whole_groups=True, bound=bound, **settings)
    w = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def smote(df: DataFrame, label: str = "label", k: int = 5, **settings) -> DataFrame:
    """(id, v, label): synthetic rows that bring every class up to the largest one.

    A synthetic row lies between a row of the class and one of its k nearest
    neighbours inside the class, at a place given by a hash.
    """
    sizes = {r["label"]: r["n"] for r in df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}
    most, made = max(sizes.values()), []
    for value, n in sizes.items():
        want = most - n
        if want <= 0 or n < 2:
            continue
        rows = df.where(F.col(label) == value).select("id", "v")
        near = nearest(rows, rows.withColumn("w", F.col("v")), min(k, n - 1), True, {"w": "array<double>"}, **settings)
        pool = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("near"))
        each, rest = divmod(want, n)
        copies = F.when(F.col("_o") <= rest, each + 1).otherwise(each) if rest else F.lit(each)
        ordered = rows.withColumn("_h", stable_order(F.col("id")))
        if rest:
            from grainfold.operators.ml.prep import _rank_within

            ordered = _rank_within(ordered.withColumn("_one", F.lit(1)), "_one", "_h").withColumnRenamed("_rank", "_o").drop("_one")
        base = ordered.withColumn("_m", copies).where("_m > 0").join(pool, "id")
        # Copies are numbered by two short sequences, so that no row holds an array of all of them.
        thousands = base.withColumn("_t", F.explode(F.sequence(F.lit(0), ((F.col("_m") - 1) / 1000).cast("long"))))
        copy = thousands.select("id", "v", "near", "_m", F.explode(F.sequence(F.col("_t") * 1000 + 1, F.least(F.col("_m").cast("long"), F.col("_t") * 1000 + 1000))).alias("_i")).drop("_m")
        pick = F.element_at("near", (F.pmod(F.xxhash64("id", "_i"), F.size("near")) + 1).cast("int"))["w"]
        at = F.pmod(F.xxhash64("_i", "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        made.append(copy.select(
            F.concat_ws("+", "id", "_i").alias("id"), F.zip_with("v", pick, lambda a, b: a + at * (b - a)).alias("v"), F.lit(value).alias(label)))
    if not made:
        return df.sparkSession.createDataFrame([], f"id string, v array<double>, {label} {dict(df.dtypes)[label]}")
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out
