"""Ranked search: tags by text, then places, then vectors, as one ordered union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import geo, order, vectors
from .filters import name_contains

CITY_KM = 75.0


def tag_stage(scope: DataFrame, links: DataFrame, query: str, limit: int) -> DataFrame:
    """Images with a matching tag; the limit counts a row per matching tag, as a join gives them."""
    hits = links.where(name_contains(query))
    joined = scope.join(hits, scope["id"] == hits["image_id"]).orderBy(*order.total_order(), "name").limit(limit)
    return _placed(joined.groupBy(*scope.columns).agg(F.min("name").alias("__name")).drop("__name"), order.total_order())


def country_stage(scope: DataFrame, country: str, limit: int) -> DataFrame:
    return _placed(scope.where(F.col("gps_country") == country).orderBy(*order.total_order()).limit(limit), order.total_order())


def place_stage(scope: DataFrame, lat: float, lon: float, limit: int) -> DataFrame:
    """Images within the city radius, nearest first."""
    near = geo.near_point(scope, lat, lon, CITY_KM).orderBy("km", "id").limit(limit)
    return _placed(near, [F.col("km"), F.col("id")]).drop("km")


def vector_stage(scope: DataFrame, table: DataFrame, query: list[float], limit: int) -> DataFrame:
    """Nearest vectors first, then the scope: ranking is not aware of it."""
    pool = vectors.nearest(table, query, vectors.pool_size(limit))
    ranked = pool.join(scope, "id")
    return _placed(ranked, [F.col("distance"), F.col("id")]).drop("distance")


def _placed(rows: DataFrame, by: list) -> DataFrame:
    """Stages are bounded by their limits, so one window numbers them."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*by)))


def search(scope: DataFrame, everyone: DataFrame, stages: list[DataFrame], limit: int) -> DataFrame:
    """(rank, id, file_type, paired_image_id): stages in turn, each hit with its visible partner beside it, cut at the limit.

    The half that isn't raw stands first; a cut through a pair keeps both.
    """
    columns = ["id", "file_type", "paired_image_id", "pos"]
    found = order.ordered_union([s.select(*columns) for s in stages])
    hits = found.withColumn("place", F.row_number().over(Window.orderBy("stage", "pos")))
    partner = everyone.select(F.col("id").alias("__id"), F.col("file_type").alias("__type"), F.col("paired_image_id").alias("__pair"))
    joined = hits.join(partner, hits["paired_image_id"] == partner["__id"], "left")
    both = joined.select("place", F.explode(F.filter(F.array(F.struct("id", "file_type", "paired_image_id"), F.struct(F.col("__id").alias("id"), F.col("__type").alias("file_type"), F.col("__pair").alias("paired_image_id"))), lambda x: x["id"].isNotNull())).alias("x")).select("place", "x.*")
    first = both.groupBy("id", "file_type", "paired_image_id").agg(F.min("place").alias("place"))
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("place", (F.col("file_type") == "raw").cast("int"), "id")))
    return order.boundary_safe(ranked, limit).select("rank", "id", "file_type", "paired_image_id")
