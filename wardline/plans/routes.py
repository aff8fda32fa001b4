"""Route matrices, travel times, assignments and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.geo import usable
from wardline.functions.labels import town_stem
from wardline.functions.numbers import count_of, rounded
from wardline.operators.checks import Rule, duplicates, violations
from wardline.operators.merging import evolved, last_wins, registry_differences, tiers
from wardline.operators.reach import best_edges, reach
from wardline.operators.skew import split_join
from wardline.plans.prep import node_table
from wardline.plans.rates import DEMAND, demand_points
from wardline.sources.tables import table


def part(node: str, i: int) -> Column:
    """The i-th part of a node id: 0 the town's code, 1 the kind."""
    return F.get(F.split(node, "::"), F.lit(i))



def known_edges(spark: SparkSession, d: str) -> DataFrame:
    """Least minutes of each directed pair of known nodes."""
    edges = best_edges(table(spark, d, "road_times"), "origin_id", "destination_id", "duration_minutes")
    nodes = node_table(spark, d).select("id").where("id is not null").distinct()
    return edges.join(nodes, edges.src == nodes.id, "left_semi").join(nodes, edges.dst == nodes.id, "left_semi")


def latest_measurement(spark: SparkSession, d: str) -> DataFrame:
    """Of each pair the row collected last, per town: pairs, mean minutes, and routes reused."""
    r = table(spark, d, "road_times").where("origin_id is not null and destination_id is not null and collected_at is not null")
    at = F.col("collected_at").try_cast("timestamp")
    best = r.groupBy("origin_id", "destination_id").agg(F.max(F.struct(at.alias("at"), "route_id", "municipality_code", "duration_minutes", "reused_from")).alias("m"))
    return best.groupBy("m.municipality_code").agg(F.count("*").alias("pairs"), rounded(F.avg("m.duration_minutes"), 4).alias("mean_minutes"), F.count("m.reused_from").alias("reused"))


def matrix_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per town and direction of kinds: required pairs by the product of counts, measured pairs, and their share."""
    nodes = node_table(spark, d).select("id").where("id is not null").distinct().groupBy(part("id", 0).alias("municipality_code"), part("id", 1).alias("kind")).agg(F.count("*").alias("n"))
    pairs = known_edges(spark, d)
    inside = pairs.where(part("src", 0) == part("dst", 0))
    measured = inside.groupBy(part("src", 0).alias("municipality_code"), part("src", 1).alias("from_kind"), part("dst", 1).alias("to_kind")).agg(F.count("*").alias("measured"))
    a = nodes.select("municipality_code", F.col("kind").alias("from_kind"), F.col("n").alias("n_from"))
    b = nodes.select("municipality_code", F.col("kind").alias("to_kind"), F.col("n").alias("n_to"))
    required = F.col("n_from") * F.col("n_to") - F.when(F.col("from_kind") == F.col("to_kind"), F.col("n_from")).otherwise(0)
    both = a.join(b, "municipality_code").withColumn("required", required).drop("n_from", "n_to")
    done = both.join(measured, ["municipality_code", "from_kind", "to_kind"], "left").na.fill({"measured": 0})
    return done.withColumn("coverage", rounded(F.try_divide(F.col("measured").cast("double"), F.col("required").cast("double")))).withColumn("complete", F.col("measured") == F.col("required"))


def missing_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Demand points without a measured way to any hospital of their town."""
    points = demand_points(spark, d).select("municipality_code", F.concat_ws("::", "municipality_code", F.lit("demand"), "administrative_code").alias("node"))
    to_hospital = known_edges(spark, d).where(part("dst", 1) == "hospital")
    return points.join(to_hospital, points.node == to_hospital.src, "left_anti")


def base_reach(spark: SparkSession, d: str) -> DataFrame:
    """Least minutes from the nearest base to every node over at most three measured legs."""
    bases = table(spark, d, "ambulance_bases").select(F.col("node_id").alias("node"))
    return reach(known_edges(spark, d), bases, legs=3).select("node", rounded(F.col("minutes"), 4).alias("minutes"))


def base_times(spark: SparkSession, d: str) -> DataFrame:
    """Least minutes from the nearest base to every node that can be reached, over any number of measured legs."""
    bases = table(spark, d, "ambulance_bases").select(F.col("node_id").alias("node"))
    return reach(known_edges(spark, d), bases).select("node", rounded(F.col("minutes"), 4).alias("minutes"))


def coverage_times(spark: SparkSession, d: str) -> DataFrame:
    """Per town the demand points that a base can reach over any number of legs, and the sum of people / (1 + least minutes)."""
    people = demand_points(spark, d).select("municipality_code", F.concat_ws("::", "municipality_code", F.lit("demand"), "administrative_code").alias("node"), "people")
    bases = table(spark, d, "ambulance_bases").select(F.col("node_id").alias("node"))
    times = reach(known_edges(spark, d), bases)
    return people.join(times, "node").groupBy("municipality_code").agg(F.count("*").alias("points"), F.floor(F.sum(F.col("people") / (1 + F.col("minutes"))) + 0.5).cast("long").alias("score"))


def coverage_score(spark: SparkSession, d: str) -> DataFrame:
    """Sum of people / (1 + minutes) over the demand points with a way from a base."""
    people = demand_points(spark, d).select(F.concat_ws("::", "municipality_code", F.lit("demand"), "administrative_code").alias("dst"), "people")
    ways = known_edges(spark, d).where(part("src", 1) == "ambulance_base").join(people, "dst")
    return ways.groupBy(F.col("src").alias("base")).agg(F.count("*").alias("points"), F.floor(F.sum(F.col("people") / (1 + F.col("minutes"))) + 0.5).cast("long").alias("score"))


def lacking_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Demand points whose ways to the hospitals of their town are not all measured: hospitals required, measured and lacking."""
    nodes = node_table(spark, d).select("id").where("id is not null").distinct()
    points = nodes.where(part("id", 1) == "demand").select(part("id", 0).alias("municipality_code"), F.col("id").alias("node"))
    required = nodes.where(part("id", 1) == "hospital").groupBy(part("id", 0).alias("municipality_code")).agg(F.count("*").alias("required"))
    inside = known_edges(spark, d).where((part("dst", 1) == "hospital") & (part("src", 1) == "demand") & (part("src", 0) == part("dst", 0)))
    measured = inside.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("measured"))
    both = points.join(required, "municipality_code").join(measured, "node", "left").na.fill({"measured": 0})
    return both.where("measured < required").select("municipality_code", "node", "required", "measured", (F.col("required") - F.col("measured")).alias("lacking"))


def hourly_travel(spark: SparkSession, d: str) -> DataFrame:
    """Mean minutes per town and hour of collection against the town's mean over the day."""
    r = table(spark, d, "road_times").where("duration_minutes >= 0 and collected_at is not null")
    per = r.groupBy("municipality_code", F.hour(F.col("collected_at").try_cast("timestamp")).cast("long").alias("hour")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("duration_minutes") * 100 + 0.5)).alias("s"))
    w = Window.partitionBy("municipality_code")
    day = F.sum("s").over(w) / F.sum("n").over(w)
    return per.select("municipality_code", "hour", "n", rounded(F.col("s") / F.col("n") / 100.0, 4).alias("minutes"), rounded((F.col("s") / F.col("n")) / day, 4).alias("multiplier"))


def twin_route_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Routes from bases that a site lacks and can take over from a site at its place (to six decimals): the quickest, ties to the smaller twin."""
    sites = table(spark, d, "candidate_sites").where(usable(F.col("latitude"), F.col("longitude"))).select(F.concat_ws("::", "municipality_code", F.lit("candidate"), "candidate_id").alias("node"), F.format_string("%.6f,%.6f", "longitude", "latitude").alias("place")).distinct()
    ways = known_edges(spark, d).where(part("src", 1) == "ambulance_base")
    best = ways.join(sites, ways.dst == sites.node).groupBy("place", "src").agg(F.min(F.struct("minutes", "node")).alias("m"))
    met = split_join(sites, best, ["place"]).where(F.col("node") != F.col("m.node"))
    fresh = met.join(ways.select("src", F.col("dst").alias("node")), ["src", "node"], "left_anti")
    return fresh.select(F.col("src").alias("origin_id"), F.col("node").alias("destination_id"), F.col("m.node").alias("reused_from"), rounded(F.col("m.minutes"), 4).alias("minutes"))


def tiered_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The town of each base: by its address, else the only town of its station's other bases, else by the station's name."""
    bases = last_wins(table(spark, d, "ambulance_bases"), ["node_id"], ["staged_at"])
    towns = table(spark, d, "municipality_summary").select("municipality_name", "municipality_code").distinct()
    named = F.get(F.split(F.trim("address"), r"\s+"), F.lit(1))
    by_address = bases.join(towns.select(F.col("municipality_name").alias("t1"), F.col("municipality_code").alias("c1")), named == F.col("t1"), "left")
    station = by_address.where("c1 is not null").groupBy("fire_station").agg(F.min("c1").alias("c2"), F.count_distinct("c1").alias("n")).where("n = 1").drop("n")
    stem = towns.select(town_stem(F.col("municipality_name")).alias("t3"), F.col("municipality_code").alias("c3"))
    rows = by_address.join(station, "fire_station", "left").join(stem, F.regexp_replace("fire_station", "소방서$", "") == F.col("t3"), "left")
    code, tag = tiers(("address_exact", F.col("c1")), ("station_inferred", F.col("c2")), ("name_inferred", F.col("c3")))
    return rows.select("node_id", code.alias("municipality_code"), tag.alias("assignment"))


def mandatory_optional_join(spark: SparkSession, d: str) -> DataFrame:
    """Hospitals per town with the town's name (mandatory) and their evaluation counts (optional)."""
    h = table(spark, d, "existing_hospitals").select("node_id", "municipality_code", "egen_overall_grade", "inpatient_beds").distinct()
    towns = table(spark, d, "municipality_summary").select("municipality_code", "municipality_name").distinct()
    e = table(spark, d, "egen_evaluations").select("instt_cd", "area_nm", "pass_fail").distinct().groupBy(F.col("area_nm").alias("municipality_name")).agg(F.count("*").alias("evaluations"), F.sum((F.col("pass_fail") == "PASS").cast("long")).alias("passed"))
    per = h.groupBy("municipality_code").agg(F.count("*").alias("hospitals"), F.sum(F.coalesce("inpatient_beds", F.lit(0)).cast("long")).alias("beds"), F.array_join(F.array_sort(F.collect_set("egen_overall_grade")), "").alias("grades"))
    return per.join(towns, "municipality_code").join(e, "municipality_name", "left")


def semi_filtered_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Beds of register institutions by type in towns that have evaluated institutions; unknown beds count 0."""
    r = table(spark, d, "hira_institutions").select("care_symbol", "institution_type", "municipality_name", "bed_total", "opened_on").distinct()
    seen = table(spark, d, "egen_evaluations").select(F.col("area_nm").alias("municipality_name")).distinct()
    return r.join(seen, "municipality_name", "left_semi").groupBy("municipality_name", "institution_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("bed_total", F.lit(0)).cast("long")).alias("beds"), F.count("bed_total").alias("known"), F.min("opened_on").alias("first_opened"))


def registry_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Counts stated per town that the tables do not bear out."""
    stated = table(spark, d, "municipality_summary").select("municipality_code", F.col("demand_point_count").alias("demand"), F.col("existing_emergency_hospital_count").alias("hospitals"), F.col("ambulance_base_row_count").alias("bases"))
    town = part("id", 0)
    n = lambda k: F.count(F.when(part("id", 1) == k, 1))
    own = node_table(spark, d).select("id").where("id is not null").distinct().groupBy(town.alias("municipality_code")).agg(n("demand").alias("demand"), n("hospital").alias("hospitals"), n("ambulance_base").alias("bases"))
    return registry_differences(stated, own, "municipality_code", ["demand", "hospitals", "bases"])


def violations_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules per table: number of rows."""
    routes, people, sites = table(spark, d, "road_times"), table(spark, d, "demand_population"), table(spark, d, "candidate_sites")
    off = ~usable(F.col("latitude"), F.col("longitude"))
    found = violations(
        routes,
        "road_times",
        "route_id",
        [
            Rule("negative_duration", F.col("duration_minutes") < 0),
            Rule("missing_duration", F.col("duration_minutes").isNull()),
            Rule("minutes_differ_from_seconds", F.abs(F.col("duration_minutes") * 60 - F.col("duration_seconds")) > 1),
            Rule("missing_end", F.col("origin_id").isNull() | F.col("destination_id").isNull()),
            Rule("same_ends", F.col("origin_id") == F.col("destination_id")),
        ],
    )
    found = found.unionByName(violations(people, "demand_population", "administrative_code", [Rule("population_not_a_count", count_of(F.col("population")).isNull()), Rule("unusable_position", off)]))
    found = found.unionByName(violations(sites, "candidate_sites", "candidate_id", [Rule("unusable_position", off), Rule("grid_id_without_cell", F.startswith("candidate_id", F.lit("GRID-")) & F.col("grid_row").isNull())]))
    found = found.unionByName(duplicates(sites, "candidate_sites", "candidate_id"))
    return found.groupBy("table_name", "rule").agg(F.count("*").alias("n"), F.count_distinct("record_key").alias("keys"))


def evolving_schema_scan(spark: SparkSession, d: str) -> DataFrame:
    """Routes collected before April lack the later columns; read together these have defaults."""
    r = table(spark, d, "road_times")
    old = r.where("loaded_at < timestamp_ntz'2026-04-01 00:00:00'").drop("pair_set", "reused_from")
    new = r.where("loaded_at >= timestamp_ntz'2026-04-01 00:00:00'")
    return evolved(new, old, defaults={"pair_set": "before_pair_sets"}).groupBy("pair_set").agg(F.count("*").alias("n"), F.count("reused_from").alias("reused"))


QUERIES = {
    f.__name__: f
    for f in (
        known_edges, latest_measurement, matrix_coverage, missing_pairs, lacking_pairs, base_reach, base_times, coverage_times, coverage_score, hourly_travel, twin_route_reuse, tiered_assignment,
        mandatory_optional_join, semi_filtered_capacity, registry_mismatch, violations_report, evolving_schema_scan,
    )
}

_IDS = """ids as (select municipality_code || '::demand::' || administrative_code id from demand_population union select municipality_code || '::candidate::' || candidate_id from candidate_sites
  union select node_id from existing_hospitals union select node_id from ambulance_bases)"""
_EDGES = f"""{_IDS}, edges as (select origin_id src, destination_id dst, min(duration_minutes) m from road_times
  where duration_minutes >= 0 and origin_id <> destination_id and origin_id in (select id from ids where id is not null) and destination_id in (select id from ids where id is not null) group by 1, 2)"""
_OFF = "not coalesce(latitude between 33 and 43 and longitude between 124 and 132, false)"
_TIMES = f"""{_EDGES}, times(node, m) using key (node) as (select distinct node_id, 0.0::double from ambulance_bases where node_id is not null
  union select e.dst, min(t.m + e.m)::double from times t join edges e on t.node = e.src left join recurring.times r on r.node = e.dst where r.node is null or t.m + e.m < r.m group by e.dst)"""
ORACLES = {
    "base_times": f'with recursive {_TIMES} select node, floor(m * 1e4 + 0.5) / 1e4 "minutes" from times',
    "coverage_times": f"""with recursive {DEMAND}, {_TIMES} select municipality_code, count(*) points, cast(floor(sum(people / (1 + m)) + 0.5) as bigint) score from times
  join demand on node = municipality_code || '::demand::' || administrative_code group by 1""",
    "lacking_pairs": f"""with {_EDGES}, h as (select split_part(id, '::', 1) c, count(*) required from ids where split_part(id, '::', 2) = 'hospital' group by 1),
  m as (select src, count(*) measured from edges where split_part(dst, '::', 2) = 'hospital' and split_part(src, '::', 1) = split_part(dst, '::', 1) group by 1)
select c municipality_code, id node, required, coalesce(measured, 0) measured, required - coalesce(measured, 0) lacking from ids join h on split_part(id, '::', 1) = c left join m on src = id
where split_part(id, '::', 2) = 'demand' and coalesce(measured, 0) < required""",
    "known_edges": f'with {_EDGES} select src, dst, m "minutes" from edges',
    "latest_measurement": """with r as (select distinct *, collected_at::timestamptz at_ from road_times where origin_id is not null and destination_id is not null and collected_at is not null),
  b as (select *, row_number() over (partition by origin_id, destination_id order by at_ desc, route_id desc) k from r)
select municipality_code, count(*) pairs, floor(avg(duration_minutes) * 1e4 + 0.5) / 1e4 mean_minutes, count(reused_from) reused from b where k = 1 group by 1""",
    "matrix_coverage": f"""with {_EDGES}, n as (select split_part(id, '::', 1) c, split_part(id, '::', 2) k, count(*) n from ids where id is not null group by 1, 2),
  q as (select a.c municipality_code, a.k from_kind, b.k to_kind, cast(a.n * b.n - case when a.k = b.k then a.n else 0 end as bigint) required from n a join n b on a.c = b.c),
  m as (select split_part(src, '::', 1) c, split_part(src, '::', 2) f, split_part(dst, '::', 2) t, count(*) measured from edges where split_part(src, '::', 1) = split_part(dst, '::', 1) group by 1, 2, 3)
select municipality_code, from_kind, to_kind, required, coalesce(measured, 0) measured, floor(coalesce(measured, 0) / nullif(required, 0)::double * 1e6 + 0.5) / 1e6 coverage, coalesce(measured, 0) = required complete
from q left join m on c = municipality_code and f = from_kind and t = to_kind""",
    "missing_pairs": f"""with {_EDGES}, {DEMAND} select municipality_code, municipality_code || '::demand::' || administrative_code node from demand
where municipality_code || '::demand::' || administrative_code not in (select src from edges where split_part(dst, '::', 2) = 'hospital')""",
    "base_reach": f"""with {_EDGES}, l0 as (select distinct node_id node, 0.0::double m from ambulance_bases where node_id is not null),
  l1 as (select node, min(m) m from (select * from l0 union all select dst, l0.m + e.m from l0 join edges e on node = src) group by 1),
  l2 as (select node, min(m) m from (select * from l1 union all select dst, l1.m + e.m from l1 join edges e on node = src) group by 1),
  l3 as (select node, min(m) m from (select * from l2 union all select dst, l2.m + e.m from l2 join edges e on node = src) group by 1)
select node, floor(m * 1e4 + 0.5) / 1e4 "minutes" from l3""",
    "coverage_score": f"""with {_EDGES}, {DEMAND} select src base, count(*) points, cast(floor(sum(people / (1 + m)) + 0.5) as bigint) score from edges
join demand on dst = municipality_code || '::demand::' || administrative_code where split_part(src, '::', 2) = 'ambulance_base' group by 1""",
    "hourly_travel": """with p as (select municipality_code, cast(hour(collected_at::timestamptz at time zone 'UTC') as bigint) "hour", count(*) n, sum(cast(floor(duration_minutes * 100 + 0.5) as bigint)) s
  from road_times where duration_minutes >= 0 and collected_at is not null group by 1, 2)
select municipality_code, "hour", n, floor(s / n / 100.0::double * 1e4 + 0.5) / 1e4 "minutes", floor((s / n) / (sum(s) over (partition by municipality_code) / sum(n) over (partition by municipality_code)) * 1e4 + 0.5) / 1e4 multiplier from p""",
    "twin_route_reuse": f"""with {_EDGES}, s as (select distinct municipality_code || '::candidate::' || candidate_id node, printf('%.6f,%.6f', longitude, latitude) place from candidate_sites where latitude between 33 and 43 and longitude between 124 and 132),
  w as (select * from edges where split_part(src, '::', 2) = 'ambulance_base'), b as (select place, src, arg_min(node, (m, node)) twin, min(m) m from w join s on dst = node group by 1, 2)
select src origin_id, node destination_id, twin reused_from, floor(m * 1e4 + 0.5) / 1e4 "minutes" from s join b using (place) where node <> twin and not exists (select 1 from w where w.src = b.src and w.dst = s.node)""",
    "tiered_assignment": r"""with b as (select * from (select *, row_number() over (partition by node_id order by staged_at desc nulls last) k from ambulance_bases) where k = 1),
  t as (select distinct municipality_name n, municipality_code c from municipality_summary), a as (select b.*, t.c c1 from b left join t on regexp_split_to_array(trim(address), '\s+')[2] = t.n),
  s as (select fire_station, min(c1) c2 from a where c1 is not null group by 1 having count(distinct c1) = 1)
select node_id, coalesce(c1, c2, t.c) municipality_code, case when c1 is not null then 'address_exact' when c2 is not null then 'station_inferred' when t.c is not null then 'name_inferred' else 'unresolved' end assignment
from a left join s on a.fire_station = s.fire_station left join t on regexp_replace(a.fire_station, '소방서$', '') = regexp_replace(t.n, '[시군구]$', '')""",
    "mandatory_optional_join": """with h as (select distinct node_id, municipality_code, egen_overall_grade, inpatient_beds from existing_hospitals),
  p as (select municipality_code, count(*) hospitals, cast(sum(coalesce(inpatient_beds, 0)) as bigint) beds, coalesce(array_to_string(list_sort(list(distinct egen_overall_grade) filter (egen_overall_grade is not null)), ''), '') grades from h group by 1),
  e as (select area_nm, count(*) evaluations, cast(sum(case when pass_fail = 'PASS' then 1 when pass_fail is not null then 0 end) as bigint) passed from (select distinct instt_cd, area_nm, pass_fail from egen_evaluations) group by 1)
select m.municipality_name, p.municipality_code, hospitals, beds, grades, evaluations, passed from p join (select distinct municipality_code, municipality_name from municipality_summary) m on p.municipality_code = m.municipality_code left join e on area_nm = m.municipality_name""",
    "semi_filtered_capacity": """select municipality_name, institution_type, count(*) n, cast(sum(coalesce(bed_total, 0)) as bigint) beds, count(bed_total) known, min(opened_on) first_opened
from (select distinct care_symbol, institution_type, municipality_name, bed_total, opened_on from hira_institutions) where municipality_name in (select area_nm from egen_evaluations) group by 1, 2""",
    "registry_mismatch": f"""with {_IDS}, n as (select split_part(id, '::', 1) c, count(*) filter (split_part(id, '::', 2) = 'demand') d, count(*) filter (split_part(id, '::', 2) = 'hospital') h, count(*) filter (split_part(id, '::', 2) = 'ambulance_base') b from ids where id is not null group by 1),
  j as (select coalesce(municipality_code, c) municipality_code, * exclude (municipality_code) from municipality_summary full join n on c = municipality_code)
select municipality_code, field, left_value, right_value from (
  select municipality_code, 'demand' field, cast(demand_point_count as bigint) left_value, d right_value from j
  union all select municipality_code, 'hospitals', cast(existing_emergency_hospital_count as bigint), h from j
  union all select municipality_code, 'bases', cast(ambulance_base_row_count as bigint), b from j) where left_value is distinct from right_value""",
    "violations_report": f"""with v as (
  select 'road_times' table_name, unnest([case when duration_minutes < 0 then 'negative_duration' end, case when duration_minutes is null then 'missing_duration' end,
    case when abs(duration_minutes * 60 - duration_seconds) > 1 then 'minutes_differ_from_seconds' end, case when origin_id is null or destination_id is null then 'missing_end' end,
    case when origin_id = destination_id then 'same_ends' end]) "rule", cast(route_id as varchar) k from road_times
  union all select 'demand_population', unnest([case when not coalesce(regexp_full_match(trim(population, ' ' || chr(9)), '[0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})*') and try_cast(replace(trim(population, ' ' || chr(9)), ',', '') as hugeint) <= 9999999, false) then 'population_not_a_count' end,
    case when {_OFF} then 'unusable_position' end]), administrative_code from demand_population
  union all select 'candidate_sites', unnest([case when {_OFF} then 'unusable_position' end, case when candidate_id like 'GRID-%' and grid_row is null then 'grid_id_without_cell' end]), candidate_id from candidate_sites
  union all select 'candidate_sites', 'duplicate_key', candidate_id from (select distinct * from candidate_sites) group by candidate_id having count(*) > 1)
select table_name, "rule", count(*) n, count(distinct k) "keys" from v where "rule" is not null group by 1, 2""",
    "evolving_schema_scan": """select case when loaded_at < timestamp '2026-04-01' then 'before_pair_sets' else coalesce(pair_set, 'before_pair_sets') end pair_set, count(*) n, count(case when loaded_at >= timestamp '2026-04-01' then reused_from end) reused
from road_times where loaded_at is not null group by 1""",
}
