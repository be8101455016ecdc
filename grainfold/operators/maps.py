"""Map data: valid coordinates, centre and zoom, points, grids, clusters, regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref



class MapError(ValueError):
    """No usable coordinates."""


def coordinates(df: DataFrame, lat: str, lon: str, extra: Sequence[str] = (), cap: int | None = None) -> DataFrame:
    """Rows with valid latitude and longitude."""
    names = [c for c in dict.fromkeys(extra) if c and c not in (lat, lon)]
    points = df.select(fc.number_of(df, lat).alias(lat), fc.number_of(df, lon).alias(lon), *[ref(c) for c in names])
    points = points.where(ref(lat).between(-90, 90) & ref(lon).between(-180, 180))
    points = points if cap is None else points.limit(cap)
    if points.isEmpty():
        raise MapError("no valid latitude/longitude values")
    return points


def center_zoom(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row: mean position and a zoom level from the larger span."""
    span = F.greatest(F.max(ref(lat)) - F.min(ref(lat)), F.max(ref(lon)) - F.min(ref(lon)), F.lit(0.02))
    zoom = F.bround(F.log2(F.lit(360.0) / span)) - 1
    return points.agg(
        F.avg(ref(lat)).alias("lat"), F.avg(ref(lon)).alias("lon"),
        F.greatest(F.lit(1.0), F.least(F.lit(12.0), zoom)).alias("zoom"))


def scatter_map(df: DataFrame, lat: str, lon: str, color: str | None = None, size: str | None = None) -> DataFrame:
    points = coordinates(df, lat, lon, [color, size])
    return points.withColumn(size, fc.number_of(points, size)) if size else points


def bubble_map(df: DataFrame, lat: str, lon: str, size: str, color: str | None = None) -> DataFrame:
    return scatter_map(df, lat, lon, color, size)


def density_map(df: DataFrame, lat: str, lon: str, z: str | None = None) -> DataFrame:
    """Points, with weight ``z`` when given."""
    points = coordinates(df, lat, lon, [z] if z else [])
    return points.withColumn(z, fc.number_of(points, z)).na.drop(subset=[z]) if z else points


def grid_map(df: DataFrame, lat: str, lon: str, grid_size: int = 30) -> DataFrame:
    """Mean position and count of every cell of an even grid."""
    grid = int(grid_size)
    if grid < 1:
        raise MapError("a grid needs at least one cell a side")
    points = coordinates(df, lat, lon)
    a0, a1, o0, o1 = points.agg(F.min(ref(lat)), F.max(ref(lat)), F.min(ref(lon)), F.max(ref(lon))).first()
    step_a, step_o = max((a1 - a0) / grid, 1e-9), max((o1 - o0) / grid, 1e-9)
    return points.groupBy(
        F.floor((ref(lat) - F.lit(a0)) / F.lit(step_a)).alias("row"),
        F.floor((ref(lon) - F.lit(o0)) / F.lit(step_o)).alias("col"),
    ).agg(F.avg(ref(lat)).alias("lat"), F.avg(ref(lon)).alias("lon"), F.count("*").alias("count"))


def cluster_map(df: DataFrame, lat: str, lon: str, n_clusters: int = 5, extra: Sequence[str] = ()) -> DataFrame:
    """Points with their KMeans group on standardised coordinates."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    points = coordinates(df, lat, lon, extra)
    k = int(n_clusters)
    if k < 2:
        raise MapError("give at least two clusters")
    model = Pipeline(stages=[
        VectorAssembler(inputCols=[lat, lon], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_v", withMean=True),
        KMeans(k=k, seed=42, featuresCol="_v", predictionCol="_p"),
    ]).fit(points)
    return model.transform(points).withColumn("cluster", F.concat(F.lit("Cluster "), F.col("_p") + 1)).drop("_raw", "_v", "_p")


def choropleth(df: DataFrame, location: str, value: str | None = None, limit: int | None = None) -> DataFrame:
    """Mean value, or count, per region; with ``limit`` the first regions by name only."""
    held = df.select(ref(location).cast("string").alias(location), *([fc.number_of(df, value).alias("_v")] if value else []))
    if value:
        out = held.na.drop(subset=["_v"]).groupBy(ref(location)).agg(F.avg("_v").alias("value"))
    else:
        out = held.groupBy(ref(location)).agg(F.count("*").alias("value"))
    return out if limit is None else out.orderBy(ref(location)).limit(limit)


BUILDERS = {
    "scatter_map": scatter_map, "bubble_map": bubble_map, "density_map": density_map, "heat_map": density_map,
    "hexbin_map": grid_map, "cluster_map": cluster_map, "choropleth": choropleth,
}
