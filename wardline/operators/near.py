"""Points near other points, and points inside regions, by grid hashing.

Points are hashed to square cells as wide as the radius, so that everything within
the radius of a point lies in its own or one of the eight neighbouring cells. One
equi-join on the cell replaces the quadratic distance join; the exact great-circle
distance decides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.geo import KM_PER_DEGREE, haversine_km, usable
from wardline.operators.skew import split_join

LAT_RANGE = (33.0, 43.0)
LON_RANGE = (124.0, 132.0)
#: Points of either side in one cell beyond which the cell is split over several tasks.
HOT_CELL = 2000


def _steps(radius_km: float, lat_range: tuple[float, float]) -> tuple[float, float]:
    """Cell height and width in degrees, a hair larger than the radius anywhere in the latitude range."""
    lat_step = radius_km / KM_PER_DEGREE * 1.000001
    worst = min(89.0, max(abs(lat_range[0]), abs(lat_range[1])) + lat_step)
    return lat_step, lat_step / math.cos(math.radians(worst))


def _points(df: DataFrame, key: str, lat: str, lon: str, side: str, lat_range, lon_range) -> DataFrame:
    return (
        df.select(F.col(key).alias(f"{side}_key"), F.col(lat).cast("double").alias(f"{side}_lat"), F.col(lon).cast("double").alias(f"{side}_lon"))
        .where(F.col(f"{side}_key").isNotNull() & usable(F.col(f"{side}_lat"), F.col(f"{side}_lon"), lat_range, lon_range))
        .distinct()
    )


def _celled(points: DataFrame, side: str, steps: tuple[float, float]) -> DataFrame:
    return points.withColumn("cell_y", F.floor(F.col(f"{side}_lat") / steps[0])).withColumn("cell_x", F.floor(F.col(f"{side}_lon") / steps[1]))


def _spread(points: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """A copy of each point for every offset cell."""
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    return points.withColumn("move", F.explode(moves)).withColumn("cell_y", F.col("cell_y") + F.col("move.dy")).withColumn("cell_x", F.col("cell_x") + F.col("move.dx"))


def near_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    *,
    radius_km: float,
    left_key: str,
    right_key: str | None = None,
    left_lat: str = "latitude",
    left_lon: str = "longitude",
    right_lat: str = "latitude",
    right_lon: str = "longitude",
    lat_range: tuple[float, float] = LAT_RANGE,
    lon_range: tuple[float, float] = LON_RANGE,
    hot_cell: int = HOT_CELL,
) -> DataFrame:
    """All pairs at most ``radius_km`` apart: ``left_key, right_key, km``.

    Without ``right`` the points are joined with themselves: pairs of different keys,
    the smaller key first. Distances equal to the radius count. Rows with a null key,
    and positions that are null or outside the ranges (which must not cross the date
    line or a pole), take no part. Repeated rows count once; a key at several
    positions is near if any of them is, with the least distance. Other columns of
    either side are not read. An empty side gives no rows.
    """
    steps = _steps(radius_km, lat_range)
    own = right is None
    points_l = _celled(_points(left, left_key, left_lat, left_lon, "l", lat_range, lon_range), "l", steps)
    if own:
        points_r = _celled(_points(left, left_key, left_lat, left_lon, "r", lat_range, lon_range), "r", steps)
        offsets = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]  # half of the neighbours: each pair of cells meets once
    else:
        points_r = _celled(_points(right, right_key, right_lat, right_lon, "r", lat_range, lon_range), "r", steps)
        offsets = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    met = split_join(points_l, _spread(points_r, offsets), ["cell_y", "cell_x"], hot_cell)
    close = met.withColumn("km", haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).where(F.col("km") <= radius_km)
    if own:
        same_cell = (F.col("move.dy") == 0) & (F.col("move.dx") == 0)
        close = close.where((F.col("l_key") != F.col("r_key")) & (~same_cell | (F.col("l_key") < F.col("r_key")) | (F.col("l_lat") != F.col("r_lat")) | (F.col("l_lon") != F.col("r_lon"))))
        a, b = F.least("l_key", "r_key"), F.greatest("l_key", "r_key")
    else:
        a, b = F.col("l_key"), F.col("r_key")
    return close.groupBy(a.alias("left_key"), b.alias("right_key")).agg(F.min("km").alias("km"))


def points_in_regions(
    points: DataFrame,
    regions: DataFrame,
    *,
    point_key: str,
    region_key: str,
    lat: str = "latitude",
    lon: str = "longitude",
    ring: str = "ring",
    cell_km: float = 5.0,
    hot_cell: int = HOT_CELL,
    lat_range: tuple[float, float] = LAT_RANGE,
    lon_range: tuple[float, float] = LON_RANGE,
) -> DataFrame:
    """``point_key, region_key`` for each point inside a region.

    ``ring`` is an array of ``struct<lat, lon>`` corners, closed implicitly. A region is
    copied, without its ring, to the cells of its bounding box and joined with the points
    of these cells; the ring is joined to the points met and its crossings are counted.
    Crowded cells and regions are split over several tasks. Regions with a null or shorter ring than
    three corners contain nothing; points on the upper or right border are outside.
    """
    steps = _steps(cell_km, lat_range)
    pts = _celled(_points(points, point_key, lat, lon, "p", lat_range, lon_range), "p", steps)
    shapes = regions.select(F.col(region_key).alias("region_key"), F.col(ring).alias("ring")).where(F.col("region_key").isNotNull() & (F.size("ring") >= 3)).distinct()
    bound = lambda agg, field, step: F.floor(agg(F.transform("ring", lambda c: c[field])) / step)
    boxes = shapes.select(
        "region_key",
        *[bound(agg, field, step).alias(name) for name, agg, field, step in (("y0", F.array_min, "lat", steps[0]), ("y1", F.array_max, "lat", steps[0]), ("x0", F.array_min, "lon", steps[1]), ("x1", F.array_max, "lon", steps[1]))],
    )
    cells = boxes.withColumn("cell_y", F.explode(F.sequence("y0", "y1"))).withColumn("cell_x", F.explode(F.sequence("x0", "x1"))).select("region_key", "cell_y", "cell_x").distinct()
    met = split_join(pts, cells, ["cell_y", "cell_x"], hot_cell).select("p_key", "p_lat", "p_lon", "region_key")
    met = split_join(met, shapes, ["region_key"], 10 * hot_cell)
    following = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    crossed = F.zip_with(
        "ring",
        following,
        lambda a, b: F.when(
            ((a["lat"] > F.col("p_lat")) != (b["lat"] > F.col("p_lat"))) & (F.col("p_lon") < (b["lon"] - a["lon"]) * (F.col("p_lat") - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]), 1
        ).otherwise(0),
    )
    inside = F.aggregate(crossed, F.lit(0), lambda s, x: s + x) % 2 == 1
    return met.where(inside).select(F.col("p_key").alias("point_key"), "region_key").distinct()
