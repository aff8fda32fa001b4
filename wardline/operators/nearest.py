"""Nearest neighbours by counted grid cells, and what builds on grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.geo import KM_PER_DEGREE, haversine_km, usable
from wardline.operators.near import LAT_RANGE, LON_RANGE
from wardline.operators.sequences import in_pieces, running
from wardline.operators.skew import split_join
from wardline.session import cut

#: Width of cells, in km, beyond which the search goes through all facilities.
WHOLE_KM = 2_000.0


def nearest(
    points: DataFrame,
    facilities: DataFrame | None = None,
    *,
    point_key: str,
    facility_key: str | None = None,
    k: int = 1,
    start_km: float = 1.0,
    lat_range: tuple[float, float] = LAT_RANGE,
    lon_range: tuple[float, float] = LON_RANGE,
) -> DataFrame:
    """``point, facility, km, place`` (1 to k, ties by the smaller key) of the k nearest facilities of each point.

    Facilities are counted in cells of ``start_km`` and in cells twice, four times, ... as
    wide. The smallest cell around a point that holds enough of them bounds the distance
    of its k-th nearest by the cell's diagonal; that is the radius of its search, one
    join with the facilities in cells of that width. Points far from all facilities
    search a radius as wide as need be, up to everything. Without ``facilities`` a
    point's neighbours are the other points. Rows without usable position or key take no
    part (latitudes within 60 degrees), of a repeated key one position counts; with fewer
    than k facilities all are given.
    """
    own = facilities is None
    placed = lambda df, key, name: df.where(F.col(key).isNotNull() & usable(F.col("latitude"), F.col("longitude"), lat_range, lon_range)).groupBy(F.col(key).alias(name)).agg(F.min(F.struct("latitude", "longitude")).alias("at")).select(name, "at.*")
    left = cut(placed(points, point_key, "point"))
    right = left.withColumnRenamed("point", "facility") if own else cut(placed(facilities, facility_key, "facility"))
    need = k + own
    top = math.ceil(math.log2(WHOLE_KM / start_km))
    worst, least = max(map(abs, lat_range)), 0.0 if lat_range[0] <= 0 <= lat_range[1] else min(map(abs, lat_range))
    lat_step = start_km / KM_PER_DEGREE
    lon_step = lat_step / math.cos(math.radians(min(89.0, worst)))
    # a cell is widest in km at the latitude nearest to the equator; the last factor covers the curvature of wide ones
    diagonal = start_km * math.hypot(1.0, math.cos(math.radians(least)) / math.cos(math.radians(min(89.0, worst)))) * 1.06
    cell = lambda c, step: F.floor(F.col(c) / step)
    celled = lambda df: df.withColumn("y", cell("latitude", lat_step)).withColumn("x", cell("longitude", lon_step))
    every = F.explode(F.sequence(F.lit(0), F.lit(top)))
    wider = lambda c: F.when(F.col("level") == top, 0).otherwise(F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))))
    counts = celled(right).groupBy("y", "x").agg(F.count("*").alias("n")).withColumn("level", every)
    full = counts.groupBy("level", wider("y").alias("cy"), wider("x").alias("cx")).agg(F.sum("n").alias("n")).where(F.col("n") >= need).drop("n")
    around = celled(left).select("y", "x").distinct().withColumn("level", every).withColumns({"cy": wider("y"), "cx": wider("x")})
    chosen = split_join(around, full, ["level", "cy", "cx"]).groupBy("y", "x").agg(F.min("level").alias("level"))
    searching = cut(celled(left).join(chosen, ["y", "x"], "left").select("point", "latitude", "longitude", F.coalesce("level", F.lit(top)).alias("level")))
    used = [r.level for r in searching.select("level").distinct().collect()]  # at most top + 1 numbers
    width = F.pow(F.lit(2.0), F.col("level"))
    ring = lambda c, step: F.when(F.col("level") == top, 0).otherwise(F.floor(F.col(c) / (width * (step * diagonal * 1.25 / start_km))))
    moved = lambda c: F.explode(F.when(F.col("level") == top, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    asked = searching.withColumns({"cy": ring("latitude", lat_step), "cx": ring("longitude", lon_step)}).withColumn("cy", moved("cy")).withColumn("cx", moved("cx"))
    there = right.withColumn("level", F.explode(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>"))).withColumns({"cy": ring("latitude", lat_step), "cx": ring("longitude", lon_step)}).withColumnsRenamed({"latitude": "f_lat", "longitude": "f_lon"})
    met = split_join(asked, there, ["level", "cy", "cx"]).withColumn("km", haversine_km(F.col("latitude"), F.col("longitude"), F.col("f_lat"), F.col("f_lon")))
    met = met.where((F.col("level") == top) | (F.col("km") <= width * diagonal))
    if own:
        met = met.where(F.col("point") != F.col("facility"))
    order = Window.partitionBy("point").orderBy("km", "facility")
    return met.select("point", "facility", "km").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def top_share_excluded(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """Drops the top ``share`` of each group by value: all rows at least as large as the value at rank ceil(share n)."""
    order = [F.desc(value)]
    ranked = running(in_pieces(rows, group, order), group, order, {"__rank": F.lit(1)})
    sizes = rows.groupBy(group).agg(F.ceil(F.lit(share) * F.count("*")).alias("__cut"))
    at = ranked.join(sizes, group).where(F.col("__rank") == F.col("__cut")).select(group, F.col(value).alias("__at"))
    return rows.join(at, group).where(F.col(value) < F.col("__at")).drop("__at")


def grid(points: DataFrame, group: str, cell_km: float = 1.0) -> DataFrame:
    """Cells of a square grid over each group's envelope of positions, one cell wider all around:
    ``group, grid_row, grid_col, latitude, longitude`` of the cells' centres."""
    at = points.where(usable(F.col("latitude"), F.col("longitude")))
    box = at.groupBy(group).agg(F.min("latitude").alias("s"), F.max("latitude").alias("n"), F.min("longitude").alias("w"), F.max("longitude").alias("e"), F.avg("latitude").alias("mid"))
    dy = F.lit(cell_km / 111.32)
    box = box.withColumn("dy", dy).withColumn("dx", F.lit(cell_km) / (111.32 * F.cos(F.radians("mid"))))
    box = box.withColumn("rows", F.ceil((F.col("n") - F.col("s")) / F.col("dy")) + 2).withColumn("cols", F.ceil((F.col("e") - F.col("w")) / F.col("dx")) + 2)
    cells = box.withColumn("grid_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("grid_col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    return cells.select(group, "grid_row", "grid_col", (F.col("s") + (F.col("grid_row") - 0.5) * F.col("dy")).alias("latitude"), (F.col("w") + (F.col("grid_col") - 0.5) * F.col("dx")).alias("longitude"))
