"""What staged tables still lack, overrides, selections, labels, attempts and reread files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.documents import Declared, path_errors
from wardline.functions.geo import usable
from wardline.functions.labels import town_stem, truthy
from wardline.functions.numbers import clamp, rounded, uniform
from wardline.operators.allocation import observed_or_share, region_totals
from wardline.operators.merging import overridden
from wardline.operators.nearest import nearest
from wardline.operators.reach import reach
from wardline.plans.prep import node_table
from wardline.plans.rates import DEMAND, demand_points
from wardline.plans.routes import _EDGES, _TIMES, known_edges, part
from wardline.plans.spatial import _KM
from wardline.session import ensure_checkpoint_dir
from wardline.sources.files import keyed_records, read_csv
from wardline.sources.sinks import split_rejects, write_csv
from wardline.sources.tables import table

TABLES = (("ambulance_bases", "ambulance_base"), ("demand_population", "demand"), ("existing_hospitals", "hospital"), ("candidate_sites", "candidate"))


def coordinate_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Per town: rows and rows with a usable position of each kind of node, the kinds that lack some as a text, and whether none does.

    Bases count for the town whose name stands in their address.
    """
    towns = table(spark, d, "municipality_summary").select("municipality_code", "municipality_name").distinct()
    bases = table(spark, d, "ambulance_bases").select("node_id", F.get(F.split(F.trim("address"), r"\s+"), F.lit(1)).alias("municipality_name"), "latitude", "longitude").join(towns, "municipality_name")
    keys = {"demand": ("demand_population", "administrative_code"), "hospital": ("existing_hospitals", "node_id"), "candidate": ("candidate_sites", "candidate_id")}
    rows = bases.select(F.lit("ambulance_base").alias("kind"), F.col("node_id").alias("key"), "municipality_code", "latitude", "longitude")
    for kind, (name, key) in keys.items():
        rows = rows.unionByName(table(spark, d, name).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "municipality_code", "latitude", "longitude"))
    per = rows.groupBy("municipality_code", "kind", "key").agg(F.max(usable(F.col("latitude"), F.col("longitude")).cast("long")).alias("ok")).groupBy("municipality_code", "kind").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"))
    one = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    wide = towns.select("municipality_code").join(per, "municipality_code", "left").groupBy("municipality_code").agg(*[one(kind, c).alias(f"{kind}_{name}") for _, kind in TABLES for c, name in (("n", "rows"), ("ok", "placed"))])
    lacking = F.array_compact(F.array(*[F.when(F.col(f"{kind}_rows") != F.col(f"{kind}_placed"), F.lit(kind)) for _, kind in TABLES]))
    return wide.withColumn("lacking", F.array_join(lacking, ", ")).withColumn("complete", F.col("lacking") == "")


def position_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Positions of demand points, replaced by those of the first site that stands for them, and overrides that fit no point."""
    sites = table(spark, d, "candidate_sites").where(F.col("administrative_code").isNotNull() & usable(F.col("latitude"), F.col("longitude")))
    first = sites.groupBy("administrative_code").agg(F.min(F.struct("candidate_id", "latitude", "longitude")).alias("m")).select("administrative_code", "m.latitude", "m.longitude")
    points = table(spark, d, "demand_population").where("administrative_code is not null and retired_at is null").groupBy("administrative_code").agg(F.min(F.struct("latitude", "longitude")).alias("m")).select("administrative_code", "m.latitude", "m.longitude")
    return overridden(points, first, "administrative_code", ["latitude", "longitude"])


def observed_or_proportional(spark: SparkSession, d: str) -> DataFrame:
    """Routes a day per town: as observed where the town's flag says that it is ready, else its share of all by population."""
    towns = table(spark, d, "municipality_summary").select("municipality_code", F.col("population_202608").alias("people"), truthy(F.col("ready_for_simulation")).alias("ready")).distinct()
    seen = table(spark, d, "road_times").where("duration_minutes is not null").groupBy("municipality_code").agg(F.count("*").cast("double").alias("observed"))
    total = seen.agg(F.sum("observed").alias("total"))
    rows = towns.join(seen, "municipality_code", "left").join(F.broadcast(total)).withColumn("observed", F.when(F.col("ready"), F.col("observed")))  # total is one row
    return observed_or_share(rows, "observed", "total", "people").select("municipality_code", rounded(F.col("amount") / 243.0, 4).alias("daily"), "basis")


def without_subtotals(spark: SparkSession, d: str) -> DataFrame:
    """Demand points per town without subtotal rows, whose code ends in five zeros, and how many of those were left out."""
    rows = demand_points(spark, d)
    subtotal = F.endswith("administrative_code", F.lit("00000"))
    return rows.groupBy("municipality_code").agg(F.count_if(~subtotal).alias("points"), F.count_if(subtotal).alias("subtotals"), F.sum(F.when(~subtotal, F.col("people")).otherwise(0)).cast("long").alias("people"))


def selected_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Sites by the rule of their source: those of the grid inside it and of at least 100 people, all others with a road address."""
    s = table(spark, d, "candidate_sites").select("candidate_id", "candidate_source", "grid_row", "cell_population_estimate", "road_address").distinct()
    gridded = F.startswith("candidate_id", F.lit("GRID-"))
    kept = F.when(gridded, F.col("grid_row").isNotNull() & (F.col("cell_population_estimate") >= 100)).otherwise(F.col("road_address").isNotNull())
    return s.where(kept).groupBy("candidate_source").agg(F.count_distinct("candidate_id").alias("sites"))


def grade_maps(spark: SparkSession, d: str) -> DataFrame:
    """Per town a map of grades to numbers of hospitals, as JSON text in the order of the grades."""
    h = table(spark, d, "existing_hospitals").where("egen_overall_grade is not null").select("node_id", "municipality_code", "egen_overall_grade").distinct()
    per = h.groupBy("municipality_code", "egen_overall_grade").agg(F.count("*").alias("n"))
    return per.groupBy("municipality_code").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("egen_overall_grade", "n"))))).alias("grades"))  # few grades a town


def robust_best(spark: SparkSession, d: str) -> DataFrame:
    """Over years of shipping as variants: how often the best supplier of all lines stays the best, as a share, and all that ever are."""
    l = table(spark, d, "lineitem").withColumn("variant", F.year("l_shipdate"))
    value = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    best = F.max(F.struct("v", (-F.col("l_suppkey")).alias("k")))
    whole = l.groupBy("l_suppkey").agg(F.sum(value).alias("v")).agg((-best["k"]).alias("baseline"))
    runs = l.groupBy("variant", "l_suppkey").agg(F.sum(value).alias("v")).groupBy("variant").agg((-best["k"]).alias("best"))
    ever = F.array_sort(F.collect_set("best"))  # at most one a year
    return runs.join(F.broadcast(whole)).groupBy("baseline").agg(F.count("*").alias("runs"), F.count_if(F.col("best") == F.col("baseline")).alias("stays"), rounded(F.avg((F.col("best") == F.col("baseline")).cast("double"))).alias("fraction"), F.array_join(ever, ",").alias("ever_best"))  # whole is one row


def geocode_attempts(spark: SparkSession, d: str) -> DataFrame:
    """What to ask a geocoder for each base, in order: its address, then ever less exact names; blank and repeated ones left out."""
    towns = table(spark, d, "municipality_summary").select("municipality_name").distinct()
    b = table(spark, d, "ambulance_bases").select("node_id", "source_province", "fire_station", "base_name", "address", town_stem(F.regexp_replace("fire_station", "소방서$", "")).alias("stem")).distinct()
    named = b.join(towns.withColumn("stem", town_stem(F.col("municipality_name"))), "stem", "left")
    words = lambda *c: F.trim(F.concat_ws(" ", *c))
    attempts = F.array(F.trim("address"), words("source_province", "municipality_name", "base_name"), words("source_province", "municipality_name", "fire_station", "base_name"), words("municipality_name", "base_name"))
    asked = F.array_distinct(F.filter(attempts, lambda x: x.isNotNull() & (x != "")))
    return named.select("node_id", F.posexplode(asked).alias("place", "text")).select("node_id", F.col("place").cast("long"), "text")


def verified_positions(spark: SparkSession, d: str) -> DataFrame:
    """Demand points whose matched address names their own town, per status: verified and not."""
    towns = table(spark, d, "municipality_summary").select("municipality_code", "municipality_name").distinct()
    p = table(spark, d, "demand_population").select("administrative_code", "municipality_code", "matched_address", "geocoding_status").distinct().join(towns, "municipality_code")
    inside = F.coalesce(F.contains("matched_address", "municipality_name"), F.lit(False))
    return p.groupBy("geocoding_status").agg(F.count_if(inside).alias("verified"), F.count_if(~inside).alias("elsewhere"))


def route_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Routes that cannot be taken, apart from the others with the first problem that holds, per provider."""
    problem = F.when(F.col("origin_id").isNull() | F.col("destination_id").isNull(), "missing_end").when(F.col("duration_minutes").isNull(), "no_route").when(F.col("duration_minutes") < 0, "bad_duration")
    good, bad = split_rejects(table(spark, d, "road_times"), problem)
    return good.withColumn("problem", F.lit("none")).unionByName(bad).groupBy("routing_provider", "problem").agg(F.count("*").alias("n"))


def nearest_base_by_time(spark: SparkSession, d: str) -> DataFrame:
    """The base with the least measured minutes to each demand point (ties: the smaller id)."""
    ways = known_edges(spark, d).where((part("src", 1) == "ambulance_base") & (part("dst", 1) == "demand"))
    return ways.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("minutes", "src")).alias("m")).select("node", F.col("m.src").alias("base"), rounded(F.col("m.minutes"), 4).alias("minutes"))


def labelled_origins(spark: SparkSession, d: str) -> DataFrame:
    """The ten origins of most routes in each town with the label of their node; unknown ones keep their id."""
    r = table(spark, d, "road_times").where("origin_id is not null").groupBy("municipality_code", "origin_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("municipality_code").orderBy(F.desc("n"), "origin_id")
    top = r.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10")
    node = lambda kind, key: F.concat_ws("::", "municipality_code", F.lit(kind), key)
    labels = table(spark, d, "demand_population").select(node("demand", "administrative_code").alias("origin_id"), F.col("administrative_name").alias("label"))
    labels = labels.unionByName(table(spark, d, "candidate_sites").select(node("candidate", "candidate_id").alias("origin_id"), F.col("candidate_name").alias("label")))
    labels = labels.unionByName(table(spark, d, "existing_hospitals").select(F.col("node_id").alias("origin_id"), F.col("hospital_name").alias("label")))
    labels = labels.unionByName(table(spark, d, "ambulance_bases").select(F.col("node_id").alias("origin_id"), F.col("base_name").alias("label")))
    wanted = labels.join(top.select("origin_id").distinct(), "origin_id", "left_semi").groupBy("origin_id").agg(F.min("label").alias("label"))
    return top.join(wanted, "origin_id", "left").select("municipality_code", "place", "origin_id", F.coalesce("label", "origin_id").alias("label"), "n")


def travel_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """Mean least minutes from a base to the demand points of a town, scaled by the hour's mean against the whole day's."""
    bases = table(spark, d, "ambulance_bases").select(F.col("node_id").alias("node"))
    times = reach(known_edges(spark, d), bases).where(part("node", 1) == "demand").groupBy(part("node", 0).alias("municipality_code")).agg(F.avg("minutes").alias("minutes"))
    r = table(spark, d, "road_times").where("duration_minutes >= 0 and collected_at is not null")
    hours = r.groupBy(F.hour(F.col("collected_at").try_cast("timestamp")).cast("long").alias("hour")).agg(F.sum(F.floor(F.col("duration_minutes") * 100 + 0.5)).alias("s"), F.count("*").alias("n"))
    day = hours.agg((F.sum("s") / F.sum("n")).alias("mean"))
    scaled = hours.join(F.broadcast(day)).select("hour", (F.col("s") / F.col("n") / F.col("mean")).alias("multiplier"))  # 24 rows
    return times.join(F.broadcast(scaled)).select("municipality_code", "hour", rounded(F.col("minutes") * F.col("multiplier"), 4).alias("minutes"))


def uniform_deciles(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the tenth into which a number drawn from their key falls, with prices clamped to 1,000 … 100,000."""
    o = table(spark, d, "orders").select(F.floor(uniform(F.col("o_orderkey")) * 10).cast("long").alias("tenth"), clamp(F.col("o_totalprice"), 1000.0, 100000.0).alias("price"))
    return o.groupBy("tenth").agg(F.count("*").alias("orders"), F.min("price").alias("least"), F.max("price").alias("most"))


#: What the properties of an event must be.
EVENT_PROPERTIES = (Declared("k", "integer", required=True, least=0, most=89), Declared("note", "text"))


def property_errors(spark: SparkSession, d: str) -> DataFrame:
    """Events whose JSON properties don't fit their declaration: the path and what is wrong."""
    return table(spark, d, "events").select("event_id", F.explode(path_errors(F.col("props"), EVENT_PROPERTIES)).alias("e")).select("event_id", "e.path", "e.problem")


def _fresh(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def reread_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites written as CSV and read again, text for text."""
    place = _fresh(spark, "sites")
    fields = ["candidate_id", "candidate_name", "road_address", "latitude"]
    write_csv(table(spark, d, "candidate_sites"), place, fields)
    schema = T.StructType([*[T.StructField(f, T.StringType()) for f in fields[:3]], T.StructField("latitude", T.DoubleType())])
    return read_csv(spark, place, schema, fields).drop("source_file")


def reread_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Routes written in one folder a town and read again with where each row came from: rows and files agree with the town."""
    place = _fresh(spark, "routes")
    r = table(spark, d, "road_times").where("municipality_code is not null").select("route_id", "municipality_code", F.col("municipality_code").alias("folder"))
    r.repartition("folder", F.pmod(F.xxhash64("route_id"), F.lit(4))).write.partitionBy("folder").parquet(place)
    back = spark.read.schema("route_id long, municipality_code string").parquet(f"{place}/folder=*").withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), "folder=([^/]*)/", 1))
    return back.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("source") != F.col("municipality_code")).alias("misplaced"))


def reread_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers of each nation and hundred of keys as a JSON object by id, read again as records."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey", F.floor(F.col("c_custkey") / 100).alias("hundred"))
    entry = F.struct(F.col("c_custkey").cast("string").alias("key"), F.struct("c_name", "c_acctbal").alias("value"))
    documents = c.groupBy("c_nationkey", "hundred").agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("customers"))).alias("value"))  # at most a hundred each
    record = T.StructType([T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])
    return keyed_records(documents, "customers", record).select("id", "c_name", "c_acctbal")


def ready_town_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of the towns whose flag says that they are ready, per town; the others are not read further."""
    ready = table(spark, d, "municipality_summary").where(truthy(F.col("ready_for_simulation"))).select("municipality_code").distinct()
    return table(spark, d, "road_times").select("municipality_code", "duration_minutes").join(ready, "municipality_code", "left_semi").groupBy("municipality_code").agg(F.count("*").alias("n"), rounded(F.avg("duration_minutes"), 4).alias("minutes"))


def region_members(spark: SparkSession, d: str) -> DataFrame:
    """Sites that stand for a demand point of a region that demand points know, by the five digits of the region."""
    regions = table(spark, d, "demand_population").select(F.substring("administrative_code", 1, 5).alias("region")).distinct()
    sites = table(spark, d, "candidate_sites").select("candidate_id", F.substring("administrative_code", 1, 5).alias("region")).where("region is not null").distinct()
    return sites.join(regions, "region", "left_semi").groupBy("region").agg(F.count("*").alias("sites"))


def station_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Bases by the town of their station, whatever their address says: how many addresses agree, and how many are overruled or in no known town."""
    towns = table(spark, d, "municipality_summary").select("municipality_name", "municipality_code", town_stem(F.col("municipality_name")).alias("stem")).distinct()
    b = table(spark, d, "ambulance_bases").select("node_id", "fire_station", F.get(F.split(F.trim("address"), r"\s+"), F.lit(1)).alias("named")).distinct()
    known = b.join(towns, F.regexp_replace("fire_station", "소방서$", "") == F.col("stem"))
    agrees = F.col("named") == F.col("municipality_name")
    return known.groupBy("municipality_code").agg(F.count("*").alias("bases"), F.count_if(agrees).alias("agree"), F.count_if(~agrees).alias("overruled"), F.count_if(F.col("named").isNull()).alias("unnamed"))


def region_sums(spark: SparkSession, d: str) -> DataFrame:
    """People, points and vehicles stated for all towns, and for those of one region."""
    t = table(spark, d, "municipality_summary").distinct()
    sums = {"population_202608": "people", "demand_point_count": "points", "ambulance_count": "vehicles"}
    return region_totals(t, "municipality_code", sums).withColumn("region", F.lit("all")).unionByName(region_totals(t, "municipality_code", sums, "6101").withColumn("region", F.lit("6101")))


def hourly_rates(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type in every hour of the day against the type's mean hour; 0 where an hour has none."""
    e = table(spark, d, "events").where("ts is not null")
    per = e.groupBy("event_type", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    whole = e.groupBy("event_type").agg(F.count("*").alias("total")).withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    return whole.join(per, ["event_type", "hour"], "left").select("event_type", "hour", rounded(F.coalesce(F.col("n") * 24.0 / F.col("total"), F.lit(0.0))).alias("rate"))


def hour_partition(spark: SparkSession, d: str) -> DataFrame:
    """Per town, whether the hours in which its providers collect are disjoint, and cover the day."""
    seen = table(spark, d, "road_times").where("collected_at is not null and routing_provider is not null").select("municipality_code", "routing_provider", F.hour(F.col("collected_at").try_cast("timestamp")).alias("hour")).distinct()
    per = seen.groupBy("municipality_code", "hour").agg(F.count("*").alias("providers"))
    return per.groupBy("municipality_code").agg(F.count_if(F.col("providers") > 1).alias("shared"), (24 - F.count("*")).alias("uncovered")).withColumn("partition", (F.col("shared") == 0) & (F.col("uncovered") == 0))


#: Corrections of towns that lists are known to name in another way.
CORRECTED = {"달빛": "달빛시", "가람": "가람시"}


def corrected_towns(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations per town by the first word of the area, after known corrections, and whether the town is known."""
    first = F.get(F.split(F.trim("area_nm"), r"\s+"), F.lit(0))
    town = F.lit(None)
    for wrong, right in CORRECTED.items():
        town = F.coalesce(town, F.when(first == wrong, right))
    towns = table(spark, d, "municipality_summary").select(F.col("municipality_name").alias("town"), F.lit(True).alias("known")).distinct()
    e = table(spark, d, "egen_evaluations").select("instt_cd", F.coalesce(town, first).alias("town")).distinct()
    return e.groupBy("town").agg(F.count("*").alias("n")).join(towns, "town", "left").select("town", "n", F.coalesce("known", F.lit(False)).alias("known"))


def half_even_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Eighths of quantities rounded to hundredths half to even, counted."""
    return table(spark, d, "lineitem").select(F.bround(F.col("l_quantity") / 8, 2).alias("eighth")).groupBy("eighth").agg(F.count("*").alias("n"))


def routability_probe(spark: SparkSession, d: str) -> DataFrame:
    """Sites and their nearest hospital: whether a way between them is measured there and back, counted per town."""
    sites, hospitals = table(spark, d, "candidate_sites"), table(spark, d, "existing_hospitals")
    best = nearest(sites, hospitals, point_key="candidate_id", facility_key="node_id")
    towns = sites.groupBy("candidate_id").agg(F.min("municipality_code").alias("municipality_code"))
    pairs = best.join(towns, best.point == towns.candidate_id).select("municipality_code", F.concat_ws("::", "municipality_code", F.lit("candidate"), "candidate_id").alias("site"), F.col("facility").alias("hospital"))
    edges = known_edges(spark, d)
    way = lambda src, dst, name: edges.select(F.col("src").alias(src), F.col("dst").alias(dst), F.lit(True).alias(name))
    met = pairs.join(way("site", "hospital", "out"), ["site", "hospital"], "left").join(way("hospital", "site", "back"), ["site", "hospital"], "left")
    there, back = F.col("out").isNotNull(), F.col("back").isNotNull()
    return met.groupBy("municipality_code").agg(F.count("*").alias("sites"), F.count_if(there).alias("out"), F.count_if(back).alias("back"), F.count_if(there & back).alias("both"))


def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that no base can reach over any number of legs, per town and kind."""
    nodes = node_table(spark, d).select(F.col("id").alias("node")).where("node is not null").distinct()
    bases = table(spark, d, "ambulance_bases").select(F.col("node_id").alias("node"))
    return nodes.join(reach(known_edges(spark, d), bases), "node", "left_anti").groupBy(part("node", 0).alias("municipality_code"), part("node", 1).alias("kind")).agg(F.count("*").alias("n"))


def label_codes(spark: SparkSession, d: str) -> DataFrame:
    """The code and the name of labels that end in a code of ten digits in brackets; other labels have no code."""
    p = table(spark, d, "demand_population").select("administrative_code", F.concat("administrative_name", F.lit("  ("), "administrative_code", F.lit(")")).alias("label")).distinct()
    code = F.nullif(F.regexp_extract("label", r"\(([0-9]{10})\)\s*$", 1), F.lit(""))
    return p.select("administrative_code", code.alias("code"), F.trim(F.regexp_replace("label", r"\s*\([0-9]{10}\)\s*$", "")).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (
        ready_town_routes, region_members, station_overrides, region_sums, hourly_rates, hour_partition, corrected_towns, half_even_quantities, routability_probe, isolated_nodes, label_codes,
        coordinate_completeness, position_overrides, observed_or_proportional, without_subtotals, selected_by_source, grade_maps, robust_best, geocode_attempts, verified_positions, route_dead_letters,
        nearest_base_by_time, labelled_origins, travel_by_hour, uniform_deciles, property_errors, reread_sites, reread_partitions, reread_records,
    )
}

_OK = "coalesce(latitude between 33 and 43 and longitude between 124 and 132, false)"
_NAMES = """names as (select id, min(label) label from (select municipality_code || '::demand::' || administrative_code id, administrative_name label from demand_population
  union all select municipality_code || '::candidate::' || candidate_id, candidate_name from candidate_sites union all select node_id, hospital_name from existing_hospitals union all select node_id, base_name from ambulance_bases) group by 1)"""
ORACLES = {
    "coordinate_completeness": rf"""with t as (select distinct municipality_code, municipality_name from municipality_summary),
  a as (select 'ambulance_base' kind, node_id k, municipality_code, {_OK} ok from ambulance_bases join t on regexp_split_to_array(trim(address), '\s+')[2] = municipality_name
    union all select 'demand', administrative_code, municipality_code, {_OK} from demand_population union all select 'hospital', node_id, municipality_code, {_OK} from existing_hospitals union all select 'candidate', candidate_id, municipality_code, {_OK} from candidate_sites),
  k as (select municipality_code, kind, k, max(ok) ok from a group by 1, 2, 3),
  w as (select t.municipality_code, {', '.join(f"count(case when kind = '{k}' then 1 end) {k}_rows, count(case when kind = '{k}' and ok then 1 end) {k}_placed" for _, k in TABLES)} from t left join k using (municipality_code) group by 1),
  l as (select *, concat_ws(', ', {', '.join(f"case when {k}_rows <> {k}_placed then '{k}' end" for _, k in TABLES)}) lacking from w)
select *, lacking = '' complete from l""",
    "position_overrides": f"""with o as (select administrative_code, arg_min(latitude, candidate_id) y, arg_min(longitude, candidate_id) x from candidate_sites where administrative_code is not null and {_OK} group by 1),
  p as (select administrative_code, any_value(latitude) y, any_value(longitude) x from demand_population where administrative_code is not null and retired_at is null group by 1)
select coalesce(p.administrative_code, o.administrative_code) administrative_code, coalesce(o.y, p.y) latitude, coalesce(o.x, p.x) longitude,
  case when p.administrative_code is null then 'unmatched' when o.administrative_code is not null then 'override' else 'own' end basis from p full join o on p.administrative_code = o.administrative_code""",
    "observed_or_proportional": """with t as (select distinct municipality_code, population_202608 people, coalesce(lower(trim(ready_for_simulation)) = 'true', false) ready from municipality_summary),
  s as (select municipality_code, count(*)::double n from road_times where duration_minutes is not null group by 1), a as (select sum(n) total from s), j as (select t.*, case when ready then n end n, total from t left join s using (municipality_code), a)
select municipality_code, floor(coalesce(n, total * people / sum(people) over ()) / 243.0::double * 1e4 + 0.5) / 1e4 daily, case when n is null then 'proportional' else 'observed' end basis from j""",
    "without_subtotals": f"""with {DEMAND} select municipality_code, count(*) filter (administrative_code not like '%00000') points, count(*) filter (administrative_code like '%00000') subtotals,
  cast(coalesce(sum(people) filter (administrative_code not like '%00000'), 0) as bigint) people from demand group by 1""",
    "selected_by_source": """select candidate_source, count(distinct candidate_id) sites from candidate_sites
where case when candidate_id like 'GRID-%' then grid_row is not null and cell_population_estimate >= 100 else road_address is not null end group by 1""",
    "grade_maps": """with h as (select distinct node_id, municipality_code, egen_overall_grade g from existing_hospitals where egen_overall_grade is not null), p as (select municipality_code, g, count(*) n from h group by 1, 2)
select municipality_code, '{' || string_agg('"' || g || '":' || n, ',' order by g) || '}' grades from p group by 1""",
    "robust_best": """with l as (select year(l_shipdate) m, l_suppkey s, sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint)) v from lineitem group by 1, 2), w as (select s, sum(v) v from l group by 1), b as (select s baseline from w order by v desc, s limit 1),
  r as (select m, s from (select *, row_number() over (partition by m order by v desc, s) k from l) where k = 1)
select baseline, count(*) runs, count(*) filter (s = baseline) stays, floor(avg(case when s = baseline then 1 else 0 end) * 1e6 + 0.5) / 1e6 fraction, array_to_string(list_sort(list(distinct s)), ',') ever_best from r, b group by 1""",
    "geocode_attempts": r"""with t as (select distinct municipality_name n from municipality_summary), b as (select distinct node_id, source_province p, fire_station f, base_name b, address a from ambulance_bases),
  j as (select b.*, t.n from b left join t on regexp_replace(regexp_replace(f, '소방서$', ''), '[시군구]$', '') = regexp_replace(n, '[시군구]$', '')),
  x as (select node_id, [trim(a), trim(concat_ws(' ', p, n, b)), trim(concat_ws(' ', p, n, f, b)), trim(concat_ws(' ', n, b))] v from j),
  y as (select node_id, list_filter(v, lambda e, i: e is not null and e <> '' and list_position(v, e) = i) v from x)
select node_id, unnest(generate_series(0, len(v) - 1)) place, unnest(v) "text" from y""",
    "verified_positions": """with p as (select distinct administrative_code, municipality_code, matched_address, geocoding_status from demand_population), t as (select distinct municipality_code, municipality_name from municipality_summary)
select geocoding_status, count(*) filter (coalesce(contains(matched_address, municipality_name), false)) verified, count(*) filter (not coalesce(contains(matched_address, municipality_name), false)) elsewhere from p join t using (municipality_code) group by 1""",
    "route_dead_letters": """select routing_provider, case when origin_id is null or destination_id is null then 'missing_end' when duration_minutes is null then 'no_route' when duration_minutes < 0 then 'bad_duration' else 'none' end problem, count(*) n from road_times group by 1, 2""",
    "nearest_base_by_time": f"""with {_EDGES} select dst node, src base, floor(m * 1e4 + 0.5) / 1e4 "minutes" from (select *, row_number() over (partition by dst order by m, src) k from edges
where split_part(src, '::', 2) = 'ambulance_base' and split_part(dst, '::', 2) = 'demand') where k = 1""",
    "labelled_origins": f"""with {_NAMES}, r as (select municipality_code, origin_id, count(*) n from road_times where origin_id is not null group by 1, 2), t as (select *, row_number() over (partition by municipality_code order by n desc, origin_id) place from r)
select municipality_code, place, origin_id, coalesce(label, origin_id) label, n from t left join names on id = origin_id where place <= 10""",
    "travel_by_hour": f"""with recursive {_TIMES}, t as (select split_part(node, '::', 1) municipality_code, avg(m) minutes_ from times where split_part(node, '::', 2) = 'demand' group by 1),
  h as (select cast(hour(collected_at::timestamptz at time zone 'UTC') as bigint) "hour", sum(cast(floor(duration_minutes * 100 + 0.5) as bigint)) s, count(*) n from road_times where duration_minutes >= 0 and collected_at is not null group by 1)
select municipality_code, "hour", floor(minutes_ * ((s / n) / ((select sum(s) from h) / (select sum(n) from h))) * 1e4 + 0.5) / 1e4 "minutes" from t, h""",
    "uniform_deciles": """select cast(floor(('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8))::bigint / 4294967296.0::double * 10) as bigint) tenth, count(*) orders, min(greatest(1000.0::double, least(100000.0::double, o_totalprice))) least, max(greatest(1000.0::double, least(100000.0::double, o_totalprice))) most from orders group by 1""",
    "property_errors": """select event_id, 'k' path, case when not json_valid(coalesce(props, '')) or json_type(props, '$.k') is null then 'is required' when json_type(props, '$.k') not in ('UBIGINT', 'BIGINT') then 'must be an integer'
  when (props ->> '$.k')::bigint < 0 then 'must be at least 0' else 'must be at most 89' end problem from events where coalesce(not json_valid(coalesce(props, '')) or json_type(props, '$.k') is null or json_type(props, '$.k') not in ('UBIGINT', 'BIGINT') or (props ->> '$.k')::bigint not between 0 and 89, true)""",
    "reread_sites": "select candidate_id, candidate_name, road_address, latitude from candidate_sites",
    "reread_partitions": "select municipality_code source, count(*) n, 0::bigint misplaced from road_times where municipality_code is not null group by 1",
    "reread_records": "select cast(c_custkey as varchar) id, c_name, c_acctbal from customer",
    "ready_town_routes": """select municipality_code, count(*) n, floor(avg(duration_minutes) * 1e4 + 0.5) / 1e4 "minutes" from road_times
  where municipality_code in (select municipality_code from municipality_summary where coalesce(lower(trim(ready_for_simulation)) = 'true', false)) group by 1""",
    "region_members": """select region, count(*) sites from (select distinct candidate_id, substr(administrative_code, 1, 5) region from candidate_sites where administrative_code is not null)
  where region in (select substr(administrative_code, 1, 5) from demand_population) group by 1""",
    "station_overrides": r"""with t as (select distinct municipality_name n, municipality_code c from municipality_summary), b as (select distinct node_id, fire_station, regexp_split_to_array(trim(address), '\s+')[2] a from ambulance_bases)
select c municipality_code, count(*) bases, count(*) filter (a = n) agree, count(*) filter (a <> n) overruled, count(*) filter (a is null) unnamed from b join t on regexp_replace(fire_station, '소방서$', '') = regexp_replace(n, '[시군구]$', '') group by 1""",
    "region_sums": """with t as (select distinct * from municipality_summary) select 'all' region, cast(sum(population_202608) as bigint) people, cast(sum(demand_point_count) as bigint) points, cast(sum(ambulance_count) as bigint) vehicles from t
  union all select '6101', cast(sum(population_202608) as bigint), cast(sum(demand_point_count) as bigint), cast(sum(ambulance_count) as bigint) from t where municipality_code like '6101%'""",
    "hourly_rates": """with e as (select event_type, cast(hour(ts) as bigint) h from events where ts is not null), w as (select event_type, count(*) total from e group by 1), p as (select event_type, h, count(*) n from e group by 1, 2), a as (select event_type, total, unnest(generate_series(0, 23)) h from w)
select a.event_type, a.h "hour", floor(coalesce(n * 24.0::double / total, 0) * 1e6 + 0.5) / 1e6 rate from a left join p on a.event_type is not distinct from p.event_type and a.h = p.h""",
    "hour_partition": """with s as (select distinct municipality_code, routing_provider, hour(collected_at::timestamptz at time zone 'UTC') h from road_times where collected_at is not null and routing_provider is not null), p as (select municipality_code, h, count(*) n from s group by 1, 2),
  c as (select municipality_code, count(*) filter (n > 1) shared, 24 - count(*) uncovered from p group by 1) select *, shared = 0 and uncovered = 0 "partition" from c""",
    "corrected_towns": r"""with e as (select distinct instt_cd, case split_part(trim(area_nm), ' ', 1) when '달빛' then '달빛시' when '가람' then '가람시' else split_part(trim(area_nm), ' ', 1) end town from egen_evaluations)
select town, count(*) n, town in (select municipality_name from municipality_summary) known from e group by 1""",
    "half_even_quantities": "select round_even(l_quantity / 8, 2) eighth, count(*) n from lineitem group by 1",
    "routability_probe": f"""with {_EDGES}, a as (select candidate_id, min((latitude, longitude)) p from candidate_sites where {_OK} group by 1), t as (select candidate_id, min(municipality_code) c from candidate_sites group by 1),
  s as (select candidate_id, c, p[1] latitude, p[2] longitude from a join t using (candidate_id)), h as (select node_id, p[1] latitude, p[2] longitude from (select node_id, min((latitude, longitude)) p from existing_hospitals where {_OK} group by 1)),
  k as (select candidate_id, c, arg_min(node_id, (km, node_id)) h from (select candidate_id, c, node_id, {_KM} km from s a, h b) group by 1, 2), e as (select src, dst from edges)
select c municipality_code, count(*) sites, count(o.src) "out", count(b.src) back, count(case when o.src is not null and b.src is not null then 1 end) "both" from k
  left join e o on o.src = c || '::candidate::' || candidate_id and o.dst = h left join e b on b.dst = c || '::candidate::' || candidate_id and b.src = h group by 1""",
    "isolated_nodes": f"""with recursive {_TIMES} select split_part(id, '::', 1) municipality_code, split_part(id, '::', 2) kind, count(*) n from ids where id is not null and id not in (select node from times) group by 1, 2""",
    "label_codes": "select distinct administrative_code, case when administrative_code similar to '[0-9]{10}' then administrative_code end code, trim(administrative_name) name from demand_population",
}
