"""Sites, grids and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.geo import usable
from wardline.functions.numbers import rounded
from wardline.operators.merging import first_kept
from wardline.operators.near import near_pairs
from wardline.operators.nearest import grid, nearest, top_share_excluded
from wardline.plans.rates import DEMAND, demand_points
from wardline.sources.tables import table


def metres(km: Column) -> Column:
    return F.floor(km * 1000 + 0.5).cast("long")


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells per town of a 1 km grid over its demand points, and the corner cells' centres."""
    cells = grid(demand_points(spark, d), "municipality_code")
    return cells.groupBy("municipality_code").agg(F.count("*").alias("cells"), (F.max("grid_row") + 1).alias("grid_rows"), (F.max("grid_col") + 1).alias("grid_cols"), rounded(F.min("latitude")).alias("south"), rounded(F.max("longitude")).alias("east"))


def envelope(spark: SparkSession, d: str) -> DataFrame:
    at = table(spark, d, "candidate_sites").where(usable(F.col("latitude"), F.col("longitude"))).select("candidate_id", "municipality_code", "latitude", "longitude").distinct()
    return at.groupBy("municipality_code").agg(F.count("*").alias("n"), F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"), rounded(F.avg("latitude")).alias("mid"))


def nearest_facility(spark: SparkSession, d: str) -> DataFrame:
    """Every site's nearest hospital, beside the distance stated by an earlier run."""
    sites = table(spark, d, "candidate_sites")
    best = nearest(sites, table(spark, d, "existing_hospitals"), point_key="candidate_id", facility_key="node_id")
    stated = sites.groupBy("candidate_id").agg(F.max("nearest_facility_km").alias("stated"))
    return best.join(stated, best.point == stated.candidate_id).select("candidate_id", metres(F.col("km")).alias("nearest_m"), metres(F.col("stated")).alias("stated_m"))


def separation_filter(spark: SparkSession, d: str) -> DataFrame:
    """Sites with a usable position and no hospital within 1 km."""
    sites = table(spark, d, "candidate_sites")
    close = near_pairs(sites, table(spark, d, "existing_hospitals"), radius_km=1.0, left_key="candidate_id", right_key="node_id").select(F.col("left_key").alias("candidate_id")).distinct()
    return sites.where(usable(F.col("latitude"), F.col("longitude"))).select("candidate_id").distinct().join(close, "candidate_id", "left_anti")


def top_share_exclusion(spark: SparkSession, d: str) -> DataFrame:
    people = demand_points(spark, d).where("people > 0").select("administrative_code", "municipality_code", F.col("people").cast("long").alias("people"))
    return top_share_excluded(people, "municipality_code", "people", 0.3)


def knn_links(spark: SparkSession, d: str) -> DataFrame:
    """Links from each demand point to its four nearest, both ways, with minutes made from the distance."""
    near = nearest(demand_points(spark, d), point_key="administrative_code", k=4)
    minutes = rounded(F.greatest(F.lit(8.0), F.col("km") * 1.35 / 50.0 * 60.0), 2)
    links = near.select(F.col("point").alias("src"), F.col("facility").alias("dst"), minutes.alias("minutes"))
    return links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "minutes")).distinct()


def twin_points(spark: SparkSession, d: str) -> DataFrame:
    """Different sites at one position to six decimals, as (first, other)."""
    at = table(spark, d, "candidate_sites").where(usable(F.col("latitude"), F.col("longitude"))).select("candidate_id", F.format_string("%.6f,%.6f", "longitude", "latitude").alias("place")).distinct()
    w = Window.partitionBy("place")
    return at.withColumn("first_id", F.min("candidate_id").over(w)).where(F.col("candidate_id") != F.col("first_id")).select("first_id", "candidate_id", "place")


def merge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Sites of the health list first, then the others, one per address; those without address all stay."""
    sites = table(spark, d, "candidate_sites").select("candidate_id", "road_address").distinct()
    family = F.when(F.startswith("candidate_id", F.lit("PHF-")), 0).otherwise(1)
    key = F.lower(F.regexp_replace("road_address", r"\s+", ""))
    return first_kept(sites, key, [family, F.col("candidate_id"), F.col("road_address")]).select("candidate_id", "road_address")


def shortlist_topk(spark: SparkSession, d: str) -> DataFrame:
    """Per town the five sites of most people, and all sites of the health list."""
    sites = table(spark, d, "candidate_sites").groupBy("candidate_id").agg(F.min("municipality_code").alias("municipality_code"), F.max("cell_population_estimate").alias("people"))
    w = Window.partitionBy("municipality_code").orderBy(F.desc_nulls_last("people"), "candidate_id")
    return sites.withColumn("place", F.row_number().over(w).cast("long")).where((F.col("place") <= 5) | F.startswith("candidate_id", F.lit("PHF-")))


QUERIES = {f.__name__: f for f in (grid_cells, envelope, nearest_facility, separation_filter, top_share_exclusion, knn_links, twin_points, merge_dedupe, shortlist_topk)}

_OK = "latitude between 33 and 43 and longitude between 124 and 132"
_KM = "12742.0176 * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"
ORACLES = {
    "grid_cells": f"""with {DEMAND}, b as (select municipality_code, min(latitude) s, max(latitude) n, min(longitude) w, max(longitude) e, avg(latitude) mid from demand where {_OK} group by 1),
  g as (select *, 1.0 / 111.32::double dy, 1.0 / (111.32::double * cos(radians(mid))) dx from b), c as (select *, cast(ceil((n - s) / dy) as bigint) + 2 r, cast(ceil((e - w) / dx) as bigint) + 2 c from g)
select municipality_code, r * c cells, r grid_rows, c grid_cols, floor((s + (-0.5) * dy) * 1e6 + 0.5) / 1e6 south, floor((w + (c - 1 - 0.5) * dx) * 1e6 + 0.5) / 1e6 east from c""",
    "envelope": f"""select municipality_code, count(*) n, min(latitude) south, max(latitude) north, min(longitude) west, max(longitude) east, floor(avg(latitude) * 1e6 + 0.5) / 1e6 mid
from (select distinct candidate_id, municipality_code, latitude, longitude from candidate_sites where {_OK}) group by 1""",
    "nearest_facility": f"""with a as (select candidate_id, any_value(latitude) latitude, any_value(longitude) longitude, max(nearest_facility_km) stated from candidate_sites where {_OK} group by 1),
  b as (select node_id, any_value(latitude) latitude, any_value(longitude) longitude from existing_hospitals where {_OK} group by 1)
select candidate_id, cast(floor(min({_KM}) * 1000 + 0.5) as bigint) nearest_m, cast(floor(max(stated) * 1000 + 0.5) as bigint) stated_m from a, b group by 1""",
    "separation_filter": f"""select distinct candidate_id from candidate_sites where {_OK} and candidate_id not in (select a.candidate_id from candidate_sites a join existing_hospitals b
  on b.latitude between a.latitude - 0.012 and a.latitude + 0.012 and b.longitude between a.longitude - 0.02 and a.longitude + 0.02
  where a.latitude between 33 and 43 and a.longitude between 124 and 132 and b.latitude between 33 and 43 and b.longitude between 124 and 132 and {_KM} <= 1.0)""",
    "top_share_exclusion": f"""with {DEMAND}, p as (select administrative_code, municipality_code, people, row_number() over (partition by municipality_code order by people desc) k, ceil(0.3::double * count(*) over (partition by municipality_code)) c from demand where people > 0)
select administrative_code, municipality_code, people from p where people < (select people from p q where q.municipality_code = p.municipality_code and q.k = q.c)""",
    "knn_links": f"""with {DEMAND}, a as (select administrative_code k, latitude, longitude from demand where {_OK}),
  n as (select s, t, km from (select *, row_number() over (partition by s order by km, t) place from (select a.k s, b.k t, {_KM} km from a join a b on a.k <> b.k)) where place <= 4),
  l as (select s src, t dst, floor(greatest(8.0, km * 1.35::double / 50.0 * 60.0) * 1e2 + 0.5) / 1e2 "minutes" from n) select src, dst, "minutes" from l union select dst, src, "minutes" from l""",
    "twin_points": f"""select first_id, candidate_id, place from (select *, min(candidate_id) over (partition by place) first_id from (select distinct candidate_id, printf('%.6f,%.6f', longitude, latitude) place from candidate_sites where {_OK})) where candidate_id <> first_id""",
    "merge_dedupe": r"""with s as (select distinct candidate_id, road_address, nullif(lower(regexp_replace(road_address, '\s+', '', 'g')), '') k from candidate_sites)
select candidate_id, road_address from (select *, row_number() over (partition by k order by case when candidate_id like 'PHF-%' then 0 else 1 end, candidate_id, road_address) n from s where k is not null) where n = 1
union all select candidate_id, road_address from s where k is null""",
    "shortlist_topk": """select candidate_id, municipality_code, people, place from (select *, row_number() over (partition by municipality_code order by people desc nulls last, candidate_id) place
  from (select candidate_id, min(municipality_code) municipality_code, max(cell_population_estimate) people from candidate_sites group by 1)) where place <= 5 or candidate_id like 'PHF-%'""",
}
