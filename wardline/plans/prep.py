"""Queries of the core training-data operators (near points, orphans, rejects)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.geo import EARTH_KM
from wardline.functions.geo import usable
from wardline.operators.near import near_pairs, points_in_regions
from wardline.operators.orphans import orphan_references
from wardline.operators.rejects import DEMAND_FIELDS, Field, parse_records
from wardline.session import utc_micros
from wardline.sources.tables import table

KINDS = ("demand", "candidate", "hospital", "ambulance_base")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    sites, hospitals = table(spark, d, "candidate_sites"), table(spark, d, "existing_hospitals")
    near_sites = near_pairs(sites, radius_km=0.08, left_key="candidate_id")
    unaware = sites.where(F.col("nearest_facility_km").isNull() | (F.col("nearest_facility_km") > 0.5))
    near_hospitals = near_pairs(unaware, hospitals, radius_km=0.5, left_key="candidate_id", right_key="node_id")
    pairs = near_sites.select(F.lit("site_site").alias("near_kind"), "left_key", "right_key").unionByName(near_hospitals.select(F.lit("site_hospital").alias("near_kind"), "left_key", "right_key"))
    return pairs.select("near_kind", F.least("left_key", "right_key").alias("key_a"), F.greatest("left_key", "right_key").alias("key_b"))


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Per site the hospitals within 1 km: their number and the least distance in metres."""
    sites, hospitals = table(spark, d, "candidate_sites"), table(spark, d, "existing_hospitals")
    pairs = near_pairs(sites, hospitals, radius_km=1.0, left_key="candidate_id", right_key="node_id")
    return pairs.groupBy(F.col("left_key").alias("candidate_id")).agg(F.count("*").alias("hospitals"), F.floor(F.min("km") * 1000 + 0.5).cast("long").alias("nearest_m"))


def p1_regions(spark: SparkSession, d: str) -> DataFrame:
    """Hospitals inside the regions of towns: of each town's envelope of sites, the hexagon without the corners."""
    at = table(spark, d, "candidate_sites").where(usable(F.col("latitude"), F.col("longitude")) & F.col("municipality_code").isNotNull())
    box = at.groupBy("municipality_code").agg(F.min("latitude").alias("s"), F.max("latitude").alias("n"), F.min("longitude").alias("w"), F.max("longitude").alias("e"))
    third = lambda i: F.col("w") + (F.col("e") - F.col("w")) * (i / 3)
    middle = (F.col("s") + F.col("n")) / 2
    corners = [("s", third(1)), ("s", third(2)), (middle, F.col("e")), ("n", third(2)), ("n", third(1)), (middle, F.col("w"))]
    ring = F.array(*[F.struct((F.col(y) if isinstance(y, str) else y).alias("lat"), x.alias("lon")) for y, x in corners])
    inside = points_in_regions(table(spark, d, "existing_hospitals"), box.select("municipality_code", ring.alias("ring")), point_key="node_id", region_key="municipality_code")
    return inside.select(F.col("point_key").alias("node_id"), F.col("region_key").alias("municipality_code"))


def node_table(spark: SparkSession, d: str) -> DataFrame:
    """``id, staged, retired`` of all rows of the four node tables."""
    parts = []
    for name, kind, key in (("demand_population", "demand", "administrative_code"), ("candidate_sites", "candidate", "candidate_id"), ("existing_hospitals", None, "node_id"), ("ambulance_bases", None, "node_id")):
        t = table(spark, d, name)
        node = F.concat(F.col("municipality_code"), F.lit(f"::{kind}::"), F.col(key)) if kind else F.col(key)
        parts.append(t.select(node.alias("id"), utc_micros(t, "staged_at").alias("staged"), utc_micros(t, "retired_at").alias("retired")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def route_references(spark: SparkSession, d: str) -> DataFrame:
    routes = table(spark, d, "road_times")
    return routes.select(
        "route_id",
        utc_micros(routes, "collected_at").alias("ref_at"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("ref_id")) for c in ("origin_id", "destination_id")])).alias("ref"),
    ).select("route_id", "ref_at", "ref.ref_field", "ref.ref_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(route_references(spark, d), node_table(spark, d)).select("route_id", "ref_field", "reason").distinct()


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per kind of node table, month of collection (UTC) and reason; repeats of a route count once."""
    kind = F.get(F.split("ref_id", "::"), F.lit(1))
    rows = orphan_references(route_references(spark, d), node_table(spark, d)).distinct()
    return (
        rows.withColumn("node_kind", F.when(kind.isin(*KINDS), kind).otherwise("other"))
        .withColumn("month", F.date_format(F.expr("date_add(date'1970-01-01', cast(floor(ref_at / 86400000000D) as int))"), "yyyy-MM"))
        .groupBy("node_kind", "month", "ref_field", "reason")
        .agg(F.count("*").alias("orphans"))
    )


def _rejects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = parse_records(table(spark, d, "demand_raw"), "c0", DEMAND_FIELDS)
    staged = parse_records(table(spark, d, "demand_population"), "population", (Field("population", "count"),))
    return raw, staged


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    raw, staged = _rejects(spark, d)
    bad = F.col("reject_reason").isNotNull()
    both = raw.where(bad).select(F.lit("demand_raw").alias("record_table"), F.col("line_id").cast("string").alias("record_key"), F.col("reject_reason").alias("reason"))
    return both.unionByName(staged.where(bad).select(F.lit("demand_population").alias("record_table"), F.col("administrative_code").alias("record_key"), F.col("reject_reason").alias("reason"))).distinct()


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid records of demand_raw, typed."""
    raw, _ = _rejects(spark, d)
    return raw.where(F.col("reject_reason").isNull()).select("line_id", *[F.col("p_" + f.name).alias(f.name) for f in DEMAND_FIELDS])


def p4_population(spark: SparkSession, d: str) -> DataFrame:
    """The rows of demand_population whose population is a count, with it as a number; repeats count once."""
    _, staged = _rejects(spark, d)
    return staged.where(F.col("reject_reason").isNull()).select("administrative_code", "municipality_code", F.col("p_population").alias("population"), "households").distinct()


QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest, "p1_regions": p1_regions, "p3_found": p3_found, "p3_by_month": p3_by_month, "p4_found": p4_found, "p4_loaded": p4_loaded, "p4_population": p4_population}

_OK = "latitude between 33 and 43 and longitude between 124 and 132"
_KM = f"{2 * EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"
_NEAR_SITE_HOSPITAL = f"""
  s as (select distinct candidate_id k, latitude, longitude, nearest_facility_km from candidate_sites where {_OK}),
  h as (select distinct node_id k, latitude, longitude from existing_hospitals where {_OK})
"""
_NODES = """
  nodes as (
    select id, min(staged_at) staged, case when count(*) = count(retired_at) then max(retired_at) end retired from (
      select municipality_code || '::demand::' || administrative_code id, staged_at, retired_at from demand_population
      union all select municipality_code || '::candidate::' || candidate_id, staged_at, retired_at from candidate_sites
      union all select node_id, staged_at, retired_at from existing_hospitals
      union all select node_id, staged_at, retired_at from ambulance_bases) where id is not null group by id),
  refs as (
    select route_id, 'origin_id' ref_field, origin_id ref_id, (collected_at::timestamptz at time zone 'UTC') ref_at from road_times
    union select route_id, 'destination_id', destination_id, (collected_at::timestamptz at time zone 'UTC') from road_times),
  orphans as (
    select route_id, ref_field, ref_id, ref_at,
      case when n.id is null then 'missing' when ref_at < staged then 'late' when ref_at >= retired then 'deleted' end reason
    from refs left join nodes n on n.id = ref_id where ref_id is not null)
"""
_FIELD = '("([^"]|"")*"|[^",]*)'
_COUNT = r"([0-9]+|[0-9]{1,3}(,[0-9]{3})*)"
_PARSED = rf"""
  lines as (select line_id, regexp_replace(regexp_replace(coalesce(c0, ''), '^' || chr(65279), ''), chr(13) || '$', '') r from demand_raw),
  shaped as (select line_id, r, regexp_full_match(r, '(?s){_FIELD}(,{_FIELD})*') ok from lines),
  cells as (select line_id, ok, case when ok then list_transform(regexp_extract_all(',' || r, '(?s),{_FIELD}', 0),
      lambda x: case when x[2:2] = '"' then replace(x[3:-2], '""', '"') else x[2:] end) end v from shaped),
  trimmed as (select *, list_transform(v, lambda x: trim(x, ' ' || chr(9))) t from cells),
  judged as (select *, case when not ok then 'quoting' when len(v) <> 12 then 'column_count'
    when not (regexp_full_match(t[1], '[0-9]{{10}}') and regexp_full_match(t[3], '[0-9]{{5}}')
      and regexp_full_match(t[4], '{_COUNT}') and coalesce(try_cast(replace(t[4], ',', '') as hugeint) <= 9999999, false)
      and regexp_full_match(t[5], '{_COUNT}') and coalesce(try_cast(replace(t[5], ',', '') as hugeint) <= 9999999, false)
      and (t[6] = '' or (regexp_full_match(t[6], '-?[0-9]+([.][0-9]+)?') and try_cast(t[6] as double) between 33 and 43))
      and (t[7] = '' or (regexp_full_match(t[7], '-?[0-9]+([.][0-9]+)?') and try_cast(t[7] as double) between 124 and 132)))
      then 'invalid_value' end reason from trimmed)
"""
ORACLES = {
    "p1_found": f"""
with {_NEAR_SITE_HOSPITAL}
select 'site_site' near_kind, a.k key_a, b.k key_b from s a join s b on a.k < b.k and b.latitude between a.latitude - 0.001 and a.latitude + 0.001
  and b.longitude between a.longitude - 0.002 and a.longitude + 0.002 where {_KM} <= 0.08
union select 'site_hospital', least(a.k, b.k), greatest(a.k, b.k) from s a join h b on b.latitude between a.latitude - 0.006 and a.latitude + 0.006
  and b.longitude between a.longitude - 0.01 and a.longitude + 0.01 where {_KM} <= 0.5 and (a.nearest_facility_km is null or a.nearest_facility_km > 0.5)""",
    "p1_nearest": f"""
with {_NEAR_SITE_HOSPITAL}
select a.k candidate_id, count(distinct b.k) hospitals, cast(floor(min({_KM}) * 1000 + 0.5) as bigint) nearest_m from s a join h b
  on b.latitude between a.latitude - 0.012 and a.latitude + 0.012 and b.longitude between a.longitude - 0.02 and a.longitude + 0.02 where {_KM} <= 1.0 group by 1""",
    "p1_regions": f"""with box as (select municipality_code, min(latitude) s, max(latitude) n, min(longitude) w, max(longitude) e from candidate_sites where {_OK} and municipality_code is not null group by 1),
  c as (select municipality_code, unnest([1, 2, 3, 4, 5, 6]) i, unnest([s, s, (s + n) / 2, n, n, (s + n) / 2]) y, unnest([w + (e - w) * (1 / 3::double), w + (e - w) * (2 / 3::double), e, w + (e - w) * (2 / 3::double), w + (e - w) * (1 / 3::double), w]) x from box),
  sides as (select a.municipality_code, a.y ay, a.x ax, b.y by_, b.x bx from c a join c b on a.municipality_code = b.municipality_code and b.i = a.i % 6 + 1),
  h as (select distinct node_id, latitude, longitude from existing_hospitals where {_OK})
select distinct node_id, municipality_code from (select node_id, municipality_code, latitude, longitude, count(*) filter ((ay > latitude) <> (by_ > latitude) and longitude < (bx - ax) * (latitude - ay) / (by_ - ay) + ax) k
  from h, sides group by 1, 2, 3, 4) where k % 2 = 1""",
    "p3_found": f"with {_NODES} select distinct route_id, ref_field, reason from orphans where reason is not null",
    "p3_by_month": f"""with {_NODES} select case when split_part(ref_id, '::', 2) in ('demand', 'candidate', 'hospital', 'ambulance_base') then split_part(ref_id, '::', 2) else 'other' end node_kind,
  strftime(ref_at, '%Y-%m') "month", ref_field, reason, count(*) orphans from (select distinct * from orphans) where reason is not null group by all""",
    "p4_found": f"""with {_PARSED} select 'demand_raw' record_table, cast(line_id as varchar) record_key, reason from judged where reason is not null
union select 'demand_population', administrative_code, 'invalid_value' from demand_population where not coalesce(regexp_full_match(trim(population, ' ' || chr(9)), '{_COUNT}')
  and coalesce(try_cast(replace(trim(population, ' ' || chr(9)), ',', '') as hugeint) <= 9999999, false), false)""",
    "p4_loaded": f"""with {_PARSED} select line_id, t[1] administrative_code, v[2] administrative_name, t[3] municipality_code, cast(replace(t[4], ',', '') as integer) population,
  cast(replace(t[5], ',', '') as integer) households, try_cast(nullif(t[6], '') as double) latitude, try_cast(nullif(t[7], '') as double) longitude, v[8] coordinate_source,
  v[9] matched_address, v[10] kakao_place_id, v[11] geocoding_status, v[12] demand_rate_status from judged where reason is null""",
    "p4_population": f"""select distinct administrative_code, municipality_code, cast(replace(trim(population, ' ' || chr(9)), ',', '') as integer) population, households from demand_population
  where coalesce(regexp_full_match(trim(population, ' ' || chr(9)), '{_COUNT}') and coalesce(try_cast(replace(trim(population, ' ' || chr(9)), ',', '') as hugeint) <= 9999999, false), false)""",
}
