"""Connected components of a link table by alternating large and small stars, for any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import discard, keep_narrow, sent


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(sent(least, 2 * rows), "a").select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Edges point from the smaller to the larger end; every node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(sent(least, 2 * rows), "a").select("m", "b").where("m <> b").select(F.col("m").alias("a"), "b")
    return joined.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link, root being the least node of its component; every star ends at its root.

    Each round writes its edges to the shared folder; the rounds end when the edges no longer change.
    """
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = keep_narrow(edges, "stars")
    before = mark(edges)
    while True:
        old, edges = edges, keep_narrow(_small_star(_large_star(edges, before[0]), before[0]), "stars")
        now = mark(edges)
        discard(old)
        if now == before:
            break
        before = now
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    out._folder = edges._folder
    return out
