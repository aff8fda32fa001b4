"""Staged tables: codes, provenance, completeness, stated matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.geo import usable
from wardline.functions.labels import first_text
from wardline.functions.numbers import rounded
from wardline.functions.similarity import address_similarity, contained, name_similarity, normalized, simple, simple_normal
from wardline.operators.skew import split_join
from wardline.plans.prep import node_table
from wardline.plans.routes import part
from wardline.sources.tables import table

NAME_WEIGHT, ADDRESS_WEIGHT = 0.55, 0.45
REVIEW_BELOW = 0.72


def dictionary_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of states from 0 in their order, and how often each unit was in them."""
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    codes = per.select("event_type").distinct().withColumn("code", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))
    return per.join(codes, "event_type").select("user_id", "code", "n")


def canvas_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of sites on a canvas of 0 to 100 over all of them, north up."""
    at = table(spark, d, "candidate_sites").where(usable(F.col("latitude"), F.col("longitude"))).groupBy("candidate_id").agg(F.min("latitude").alias("y"), F.min("longitude").alias("x"))
    box = at.agg(F.min("y").alias("s"), F.max("y").alias("n"), F.min("x").alias("w"), F.max("x").alias("e"))
    return at.join(F.broadcast(box)).select("candidate_id", rounded(100.0 * (F.col("x") - F.col("w")) / (F.col("e") - F.col("w")), 4).alias("x"), rounded(100.0 * (F.col("n") - F.col("y")) / (F.col("n") - F.col("s")), 4).alias("y"))  # box is one row


def provenance_lists(spark: SparkSession, d: str) -> DataFrame:
    """Per town the sources of its routes: providers, profiles and pair sets in order, first and last day, and whether there is one provider only."""
    r = table(spark, d, "road_times")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    day = F.date_format(F.col("collected_at").try_cast("timestamp"), "yyyy-MM-dd")
    return r.groupBy("municipality_code").agg(
        listed("routing_provider").alias("providers"), listed("routing_profile").alias("profiles"), listed("pair_set").alias("pair_sets"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), (F.count_distinct("routing_provider") == 1).alias("single_provider")
    )


def missing_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per table of nodes and column, of any type: rows, missing and blank values."""
    out = None
    for name in ("demand_population", "candidate_sites", "existing_hospitals", "ambulance_bases"):
        t = table(spark, d, name)
        counts = [F.struct(F.lit(c).alias("field"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_if(F.trim(F.col(c).cast("string")) == "").alias("blank")) for c in t.columns]
        tall = t.agg(F.count("*").alias("n"), F.array(*counts).alias("counts")).select(F.lit(name).alias("table_name"), "n", F.explode("counts").alias("c")).select("table_name", "c.field", "n", "c.missing", "c.blank")
        out = tall if out is None else out.unionByName(tall)
    return out


def hour_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Per town the hours of the day without any route, as a list, and whether all 24 are there."""
    seen = table(spark, d, "road_times").where("collected_at is not null").groupBy("municipality_code").agg(F.array_sort(F.collect_set(F.hour(F.col("collected_at").try_cast("timestamp")))).alias("hours"))
    lacking = F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(23)), "hours"))
    return seen.select("municipality_code", F.size("hours").cast("long").alias("present"), F.array_join(lacking, ",").alias("lacking"), (F.size("hours") == 24).alias("complete"))


def unused_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Per town and kind of node, and month of collection (UTC): how many of its nodes no route of that month leaves."""
    month = F.date_format(F.col("collected_at").try_cast("timestamp"), "yyyy-MM")
    used = table(spark, d, "road_times").select(F.col("origin_id").alias("id"), month.alias("month")).where("id is not null and month is not null").distinct()
    nodes = node_table(spark, d).select("id").where("id is not null").distinct()
    per = lambda rows, *more: rows.groupBy(part("id", 0).alias("municipality_code"), part("id", 1).alias("kind"), *more)
    known = per(nodes).agg(F.count("*").alias("nodes"))
    months = per(used.join(nodes, "id", "left_semi"), "month").agg(F.count("*").alias("used"))
    return known.join(months, ["municipality_code", "kind"]).select("municipality_code", "kind", "month", "nodes", (F.col("nodes") - F.col("used")).alias("unused"))


def stated_match_review(spark: SparkSession, d: str) -> DataFrame:
    """Hospitals with a stated register name: how alike the names are, and whether that asks for review."""
    h = table(spark, d, "existing_hospitals").where("hira_hospital_name is not null").select("node_id", "hospital_name", "hira_hospital_name", "capacity_match_score").distinct()
    score = name_similarity(F.col("hospital_name"), F.col("hira_hospital_name"))
    return h.withColumn("score", score).select("node_id", rounded(F.col("score"), 4).alias("similarity"), rounded(F.col("capacity_match_score"), 4).alias("stated"), (normalized(F.col("hospital_name")) == normalized(F.col("hira_hospital_name"))).alias("exact"), (F.col("score") < REVIEW_BELOW).alias("review"))


def stated_names_contained(spark: SparkSession, d: str) -> DataFrame:
    """Hospitals whose stated register name equals theirs, or contains it or is contained in it, as far as plain letters tell."""
    h = table(spark, d, "existing_hospitals").select("node_id", "hospital_name", "hira_hospital_name").where("hira_hospital_name is not null and hospital_name is not null").distinct()
    a, b = F.col("hospital_name"), F.col("hira_hospital_name")
    told = h.where(simple(a) & simple(b)).select("node_id", (simple_normal(a) == simple_normal(b)).alias("exact"), contained(a, b, 4).alias("contained"))
    return told.where("exact or contained")


def phone_match_scores(spark: SparkSession, d: str) -> DataFrame:
    """Hospitals and register institutions of a town with one phone: weighted similarity of names and addresses, the best institution each (ties: the larger symbol)."""
    digits = lambda c: F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(7))
    towns = table(spark, d, "municipality_summary").select("municipality_code", "municipality_name").distinct()
    h = table(spark, d, "existing_hospitals").join(towns, "municipality_code").select("node_id", "municipality_name", "hospital_name", first_text(F.col("road_address"), F.col("lot_address")).alias("place"), digits(F.col("phone")).alias("tel")).where("length(tel) = 7").distinct()
    r = table(spark, d, "hira_institutions").select("care_symbol", "municipality_name", "hira_hospital_name", "address", digits(F.col("phone")).alias("tel")).where("length(tel) = 7").distinct()
    met = split_join(h, r, ["municipality_name", "tel"])  # a number that stands for none may be in all rows
    score = NAME_WEIGHT * name_similarity(F.col("hospital_name"), F.col("hira_hospital_name")) + ADDRESS_WEIGHT * address_similarity(F.col("place"), F.col("address"))
    return met.withColumn("score", score).groupBy("node_id").agg(F.max(F.struct("score", "care_symbol")).alias("m")).select("node_id", F.col("m.care_symbol").alias("care_symbol"), rounded(F.col("m.score"), 4).alias("score"))


QUERIES = {f.__name__: f for f in (dictionary_codes, canvas_positions, provenance_lists, missing_counts, hour_completeness, unused_nodes, stated_match_review, stated_names_contained, phone_match_scores)}

_NODES = """(select municipality_code || '::demand::' || administrative_code id from demand_population union select municipality_code || '::candidate::' || candidate_id from candidate_sites
  union select node_id from existing_hospitals union select node_id from ambulance_bases)"""
_COLUMNS = {
    "demand_population": "administrative_code administrative_name municipality_code population coordinate_source matched_address kakao_place_id geocoding_status demand_rate_status coordinate_reference_url coordinate_basis households latitude longitude staged_at retired_at",
    "candidate_sites": "candidate_id candidate_name municipality_code road_address candidate_source land_feasibility_status coordinate_source matched_address kakao_place_id geocoding_status routing_status administrative_code latitude longitude cell_population_estimate nearest_facility_km grid_row grid_col staged_at retired_at",
    "existing_hospitals": "node_id hospital_name emergency_category phone road_address lot_address postal_code coordinate_source matched_address municipality_code routing_status hira_hospital_name hira_encrypted_care_symbol hira_institution_type capacity_snapshot_period registered_emergency_institution registered_adult_icu capacity_match_method capacity_match_review_required capacity_source capacity_semantics egen_institution_code egen_overall_grade egen_mandatory_area_result egen_match_review_required egen_evaluation_source latitude longitude emergency_room_beds critical_care_beds inpatient_beds ct_units mri_units capacity_match_score egen_evaluation_year staged_at retired_at",
    "ambulance_bases": "node_id source_province fire_station safety_center regional_unit base_name address coordinate_source matched_address kakao_place_id municipality_assignment geocoding_status routing_status ambulance_count latitude longitude staged_at retired_at",
}
ORACLES = {
    "dictionary_codes": "select user_id, code, n from (select event_type, user_id, count(*) n from events group by 1, 2) join (select event_type, row_number() over (order by event_type) - 1 code from (select distinct event_type from events)) using (event_type)",
    "canvas_positions": """with a as (select candidate_id, min(latitude) y, min(longitude) x from candidate_sites where latitude between 33 and 43 and longitude between 124 and 132 group by 1), b as (select min(y) s, max(y) n, min(x) w, max(x) e from a)
select candidate_id, floor(100.0::double * (x - w) / (e - w) * 1e4 + 0.5) / 1e4 x, floor(100.0::double * (n - y) / (n - s) * 1e4 + 0.5) / 1e4 y from a, b""",
    "provenance_lists": """select municipality_code, coalesce(array_to_string(list_sort(list(distinct routing_provider) filter (routing_provider is not null)), ','), '') providers, coalesce(array_to_string(list_sort(list(distinct routing_profile) filter (routing_profile is not null)), ','), '') profiles,
  coalesce(array_to_string(list_sort(list(distinct pair_set) filter (pair_set is not null)), ','), '') pair_sets, strftime(min(collected_at::timestamptz at time zone 'UTC'), '%Y-%m-%d') first_day, strftime(max(collected_at::timestamptz at time zone 'UTC'), '%Y-%m-%d') last_day,
  count(distinct routing_provider) = 1 single_provider from road_times group by 1""",
    "missing_counts": " union all ".join(f"select '{t}' table_name, '{c}' field, count(*) n, count(*) filter ({c} is null) missing, count(*) filter (trim(cast({c} as varchar)) = '') blank from {t}" for t, names in _COLUMNS.items() for c in names.split()),
    "hour_completeness": """with h as (select municipality_code, list(distinct cast(hour(collected_at::timestamptz at time zone 'UTC') as integer)) hs from road_times where collected_at is not null group by 1)
select municipality_code, cast(len(hs) as bigint) present, array_to_string(list_filter(generate_series(0, 23), lambda x: not list_contains(hs, cast(x as integer))), ',') lacking, len(hs) = 24 complete from h""",
    "unused_nodes": f"""with n as (select split_part(id, '::', 1) municipality_code, split_part(id, '::', 2) kind, count(*) nodes from {_NODES} where id is not null group by 1, 2),
  u as (select split_part(id, '::', 1) municipality_code, split_part(id, '::', 2) kind, m, count(*) used from (select distinct origin_id id, strftime(collected_at::timestamptz at time zone 'UTC', '%Y-%m') m from road_times where collected_at is not null)
    where id in (select id from {_NODES} where id is not null) group by 1, 2, 3)
select municipality_code, kind, m "month", nodes, nodes - used unused from n join u using (municipality_code, kind)""",
    "stated_names_contained": """with h as (select distinct node_id, hospital_name a, hira_hospital_name b from existing_hospitals where regexp_full_match(hospital_name, '[가-힣\x20-\x7e]*') and regexp_full_match(hira_hospital_name, '[가-힣\x20-\x7e]*')),
  n as (select node_id, lower(regexp_replace(a, '[^가-힣A-Za-z0-9]', '', 'g')) x, lower(regexp_replace(b, '[^가-힣A-Za-z0-9]', '', 'g')) y from h),
  t as (select node_id, x = y exact, least(length(x), length(y)) >= 4 and (contains(x, y) or contains(y, x)) contained from n) select * from t where exact or contained""",
}
