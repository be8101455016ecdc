"""Graph jobs on distance neighbourhoods: density clusters and label propagation."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.operators.ml import neighbors
from grainfold.operators.ml.neighbors import distances, matrix
from grainfold.session import cut_lineage


def connected_components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): smallest node number reachable. Labels jump along themselves, so rounds grow slowly."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
    both = cut_lineage(both.select("e.x", "e.y").distinct())
    label = cut_lineage(nodes.select("node", F.col("node").alias("component")))
    for _ in range(max_rounds):
        near = both.join(label, F.col("y") == F.col("node")).groupBy(F.col("x").alias("node")).agg(F.min("component").alias("_m"))
        lower = label.join(near, "node", "left").select("node", F.least("component", "_m").alias("component"), F.col("component").alias("_was"))
        jump = lower.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        after = cut_lineage(lower.join(jump, F.col("component") == F.col("_n"), "left").select(
            "node", F.least("component", "_c").alias("component"), "_was"))
        changed = not after.where("component <> _was").isEmpty()
        label = after.drop("_was")
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def _spot(eps: float):
    """Cell of a grid in which any two points lie within ``eps``; null where a coordinate has no safe cell."""
    side = F.lit(0.999 * eps) / F.sqrt(F.greatest(F.size("v"), F.lit(1)))
    return F.when(F.forall("v", lambda x: F.abs(x / side) < 1e12), F.transform("v", lambda x: F.floor(x / side)))


def dbscan(points: DataFrame, eps: float = 0.5, min_points: int = 5, **settings) -> DataFrame:
    """(id, cluster): density clusters of ``points`` (id, v); -1 is noise, clusters are numbered by smallest member.

    Points of one grid cell that fits within ``eps`` need no comparison: a cell of
    ``min_points`` is dense, its core points are one node of the group graph. Only points of other
    cells are counted, up to ``min_points``; contacts are looked for between leaves
    that are near and not yet joined. Only the graph of cells is iterated.
    """
    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        va, vb = matrix(a["v"]), matrix(b["v"])
        n = np.zeros(len(a), dtype="int64")
        for rows, near in neighbors.near_leaves(va, vb, eps):
            for leaf in near:
                rows = rows[n[rows] < min_points]
                if not len(rows):
                    break
                n[rows] += (distances(va[rows], vb[leaf]) <= eps).sum(1)
        return pd.DataFrame({"id": a["id"], "n": n})

    id_type = dict(points.dtypes)["id"]
    noise = id_type if id_type == "string" else "bigint"
    placed = points.select("id", "v", (_spot(eps) if eps > 0 else F.lit(None).cast("array<bigint>")).alias("spot"))
    full = placed.where("spot IS NOT NULL").groupBy("spot").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).select("spot", F.lit(True).alias("_full"))
    placed = cut_lineage(placed.join(full, "spot", "left").select("id", "v", "spot", F.col("_full").isNotNull().alias("full")))
    alone = placed.where("NOT full").select("id", "v")
    near = neighbors.block_join(alone, points, count, f"id {id_type}, n bigint", reach=eps, whole_groups=True, **settings)
    counted = near.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_points).select("id")
    core_ids = cut_lineage(counted.unionByName(placed.where("full").select("id")).where("id IS NOT NULL").distinct())
    held = placed.join(core_ids, "id")
    # A node is the least id of the core points of a cell, or the id where there is no cell.
    nodes = held.where("spot IS NOT NULL").groupBy("spot").agg(F.min("id").alias("_least"))
    core = cut_lineage(held.join(nodes, "spot", "left").select("id", "v", F.coalesce("_least", "id").alias("node")))
    if core.isEmpty():
        return points.select("id", F.lit(-1).cast(noise).alias("cluster"))

    def contacts(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """A spanning set of contacts between nodes: enough edges to join what touches, not all pairs."""
        va, vb = matrix(a["v"]), matrix(b["v"])
        names, which = np.unique(np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()]), return_inverse=True)
        x, y, root = which[: len(a)], which[len(a) :], np.arange(len(names))
        for rows, near in neighbors.near_leaves(va, vb, eps):
            for leaf in near:
                mine, other = root[x[rows]], root[y[leaf]]
                if mine[0] == other[0] and (mine == mine[0]).all() and (other == mine[0]).all():
                    continue  # one group already
                r, c = np.nonzero(distances(va[rows], vb[leaf]) <= eps)
                linked = np.unique(mine[r] * len(names) + other[c])
                root = joined(root, linked // len(names), linked % len(names))
        other = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"a": names[other], "b": names[root[other]]})

    def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Roots after the edges (x, y): the least name of each group, for all edges at once."""
        if (root[x] == root[y]).all():
            return root
        while True:
            low = np.minimum(root[x], root[y])
            after = root.copy()
            np.minimum.at(after, root[x], low)
            np.minimum.at(after, root[y], low)
            after = after[after]
            if (after == root).all():
                return root
            root = after

    edges = neighbors.block_join(core, core, contacts, f"a {id_type}, b {id_type}", reach=eps, whole_groups=True, **settings)
    # Rows that share an id are one point of the graph, wherever they lie.
    spread = core.groupBy("id").agg(F.collect_set("node").alias("_s")).where(F.size("_s") > 1)
    edges = edges.unionByName(spread.select(F.col("_s")[0].alias("a"), F.explode("_s").alias("b")).where("a <> b"))
    groups = cut_lineage(connected_components(edges, core.select("node").distinct()))
    marked = cut_lineage(core.join(groups, "node").select("id", "v", F.col("component").alias("cluster")))

    def touch(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(b["cluster"].to_numpy(), kind="stable")  # ids keep their type: the first of the sorted clusters that touches
        va, vb, cluster, ids = matrix(a["v"]), matrix(b["v"])[order], b["cluster"].to_numpy()[order], a["id"].to_numpy()
        first = np.full(len(a), len(b))
        for rows, near in neighbors.near_leaves(va, vb, eps):
            for leaf in near:
                d = distances(va[rows], vb[leaf]) <= eps
                first[rows] = np.minimum(first[rows], np.where(d, leaf[None, :], len(b)).min(1))
        hit = first < len(b)
        return pd.DataFrame({"id": ids[hit], "cluster": cluster[first[hit]]})

    edge = placed.join(core_ids, "id", "left_anti").select("id", "v")
    border = neighbors.block_join(edge, marked, touch, f"id {id_type}, cluster {id_type}", reach=eps, whole_groups=True, **settings)
    border = border.groupBy("id").agg(F.min("cluster").alias("cluster"))
    known = marked.select("id", "cluster").unionByName(border)
    return points.select("id").join(known, "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast(noise)).alias("cluster"))


def propagate(
    points: DataFrame, labelled: str, classes: Sequence[float], k: int = 7, alpha: float | None = None,
    rounds: int = 30, tolerance: float = 1e-3, **settings,
) -> DataFrame:
    """(id, prediction, confidence): labels spread over the k-nearest-neighbour graph of ``points`` (id, v).

    With ``alpha=None`` known labels are held fixed (propagation); otherwise each round
    mixes ``alpha`` of the neighbours with the start labels (spreading).
    """
    points = cut_lineage(points.select("id", "v", labelled))
    near = neighbors.nearest(points.select("id", "v"), points.select("id", "v"), k, exclude_self=True, **settings)
    edges = cut_lineage(near.select("id", "other"))
    share = [F.when(F.col(labelled) == c, 1.0).when(F.col(labelled).isNotNull(), 0.0).otherwise(0.0).alias(f"s{i}") for i, c in enumerate(classes)]
    start = cut_lineage(points.select("id", F.col(labelled).isNotNull().alias("known"), *share))
    names = [f"s{i}" for i in range(len(classes))]
    now = start.select("id", *names)
    gap = None
    for _ in range(rounds):
        moved = edges.join(now, edges["other"] == now["id"]).groupBy(edges["id"].alias("_id")).agg(*[F.avg(n).alias(f"_{n}") for n in names])
        both = start.join(moved, F.col("id") == F.col("_id"), "left")
        mixed = {}
        for n in names:
            got = F.coalesce(F.col(f"_{n}"), F.lit(0.0))
            mixed[n] = F.when(F.col("known"), F.col(n)).otherwise(got) if alpha is None else alpha * got + (1 - alpha) * F.col(n)
        after = both.select("id", *[c.alias(n) for n, c in mixed.items()])
        if alpha is None:
            total = sum((F.col(n) for n in names), F.lit(0.0))
            after = after.select("id", *[F.coalesce(F.try_divide(F.col(n), total), F.lit(0.0)).alias(n) for n in names])
        after = cut_lineage(after)
        gap = after.join(now.select(F.col("id").alias("_i"), *[F.col(n).alias(f"_{n}") for n in names]), F.col("id") == F.col("_i")).agg(
            F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(n) - F.col(f"_{n}")) for n in names]))).first()[0]
        now = after
        if gap is not None and gap < tolerance:
            break
    else:
        if gap is not None and gap >= tolerance:
            warnings.warn(f"labels still moved by {gap:.3g} after {rounds} rounds", stacklevel=2)
    total = sum((F.col(n) for n in names), F.lit(0.0))
    shares = F.array(*[F.col(n) for n in names])
    best = F.array_position(shares, F.array_max(shares))
    return now.select("id", F.array(*[F.lit(float(c)) for c in classes])[(best - 1).cast("int")].alias("prediction"),
                      F.coalesce(F.try_divide(F.array_max(shares), total), F.lit(0.0)).alias("confidence"))
