"""Counts, rates and allocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.labels import address_key, base_place, first_text, town_stem, truthy
from wardline.functions.numbers import band, count_of, rounded
from wardline.operators.allocation import even_share, largest_remainder, share_of
from wardline.operators.checks import require_none
from wardline.operators.merging import last_wins
from wardline.sources.tables import table

MISSING_PRIORITY = "4-NOT SPECIFIED"
# The severity class of each priority; others are minor.
CLASSES = {"1-URGENT": "critical", "2-HIGH": "severe", "3-MEDIUM": "moderate"}


def demand_points(spark: SparkSession, d: str) -> DataFrame:
    """One row per administrative code with its population as a number (0 where it is no count)."""
    t = table(spark, d, "demand_population")
    return t.where(F.col("administrative_code").isNotNull()).dropDuplicates(["administrative_code"]).withColumn("people", F.coalesce(count_of(F.col("population")), F.lit(0)))


def daily_rate_by_municipality(spark: SparkSession, d: str) -> DataFrame:
    """Dispatches per nation and year, per day with leap years counted, with the list of segments they came from."""
    orders, customers, nations = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    require_none(customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").select("c_custkey"), "customers of unknown nations")
    year = F.year("o_orderdate").cast("long")
    per = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", year.alias("year")).agg(F.count("*").alias("annual"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))
    leap = ((F.col("year") % 4 == 0) & (F.col("year") % 100 != 0)) | (F.col("year") % 400 == 0)
    return per.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("municipality"), "year", "annual", rounded(F.col("annual") / F.when(leap, 366).otherwise(365), 4).alias("daily"), "segments")


def unmapped_station_check(spark: SparkSession, d: str) -> DataFrame:
    """Route rows per town code, and whether the summary of towns has the code."""
    towns = table(spark, d, "municipality_summary").select("municipality_code", F.lit(True).alias("known")).distinct()
    return table(spark, d, "road_times").groupBy("municipality_code").agg(F.count("*").alias("n")).join(towns, "municipality_code", "left").select("municipality_code", "n", F.coalesce("known", F.lit(False)).alias("known"))


def dispatch_counts_two_measures(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")).agg(F.count("*").alias("n"), F.sum((F.col("o_orderpriority") != MISSING_PRIORITY).cast("long")).alias("n_recorded"))


def category_share_table(spark: SparkSession, d: str) -> DataFrame:
    """Share of all and of the recorded rows; the label of missing ones has no share of the recorded."""
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))
    missing = F.col("value") == MISSING_PRIORITY
    everything = Window.partitionBy()
    label = F.coalesce(*[F.when(F.col("value") == k, F.lit(v)) for k, v in CLASSES.items()], F.when(~missing, "minor"), F.lit("missing"))
    recorded = F.sum(F.when(~missing, F.col("n"))).over(everything)
    return c.select("value", label.alias("model_type"), "n", rounded(100.0 * F.col("n") / F.sum("n").over(everything), 4).alias("pct_all"), F.when(~missing, rounded(100.0 * F.col("n") / recorded, 4)).alias("pct_recorded"))


def seasonality_profile(spark: SparkSession, d: str) -> DataFrame:
    """A month against its year's monthly mean, averaged over the years that have all twelve."""
    per = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")).agg(F.count("*").alias("n"))
    year = Window.partitionBy("year")
    return per.withColumn("months", F.count("*").over(year)).withColumn("mean", F.avg("n").over(year)).where("months = 12").groupBy("month").agg(F.count("*").alias("years"), F.sum("n").alias("total"), rounded(F.avg(F.col("n") / F.col("mean"))).alias("multiplier"))


def value_band_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", band(F.col("value"), 10, 0, 120, 100).alias("band")).agg(F.count("*").alias("n"))


def base_label_cleanup(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "existing_hospitals").select("node_id", "road_address", "lot_address", "registered_adult_icu").distinct()
    best = first_text(F.col("road_address"), F.col("lot_address"))
    return b.select("node_id", base_place(best).alias("place"), address_key(best).alias("address_key"), truthy(F.col("registered_adult_icu")).alias("icu"))


def code_label_split(spark: SparkSession, d: str) -> DataFrame:
    """The parts of an administrative name, its level, and the code's prefix."""
    p = demand_points(spark, d)
    parts = F.split(F.trim("administrative_name"), r"\s+")
    return p.select("administrative_code", F.substring("administrative_code", 1, 5).alias("prefix"), F.size(parts).cast("long").alias("level"), F.get(parts, F.lit(0)).alias("province"), town_stem(F.get(parts, F.lit(1))).alias("town"), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), " ").alias("district"), F.endswith("administrative_code", F.lit("00000")).alias("subtotal"))


def first_nonempty_fallback(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "ambulance_bases")
    return b.select("node_id", first_text(F.col("regional_unit"), F.col("safety_center"), F.col("fire_station")).alias("unit"), first_text(F.col("matched_address"), F.col("address")).alias("place")).distinct()


def vehicle_explode(spark: SparkSession, d: str) -> DataFrame:
    """One row per vehicle with ordinal ids per town; bases without vehicles give none."""
    b = last_wins(table(spark, d, "ambulance_bases"), ["node_id"], ["staged_at"]).where("ambulance_count > 0")
    one = b.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("ambulance_count"))))
    w = Window.partitionBy("municipality_code").orderBy("node_id", "n")
    return one.withColumn("municipality_code", F.substring("node_id", 1, 5)).select("municipality_code", "node_id", F.col("n").cast("long").alias("n"), F.format_string("%s::ambulance::%03d", F.col("municipality_code"), F.row_number().over(w)).alias("vehicle_id"))


def largest_remainder_fleet(spark: SparkSession, d: str) -> DataFrame:
    """All vehicles shared out by population, at least one per town."""
    t = table(spark, d, "municipality_summary").withColumn("fleet", F.sum("ambulance_count").over(Window.partitionBy()))
    return largest_remainder(t, "population_202608", "fleet", "municipality_code", least=1).select("municipality_code", F.col("ambulance_count").cast("long").alias("has"), "units")


def share_allocation(spark: SparkSession, d: str) -> DataFrame:
    """The stated population of a town shared out over its demand points by households."""
    towns = table(spark, d, "municipality_summary").select("municipality_code", "population_202608")
    p = demand_points(spark, d).join(towns, "municipality_code")
    weight = F.greatest(F.coalesce("households", F.lit(0)), F.lit(0))
    return p.select("administrative_code", "municipality_code", rounded(share_of(F.col("population_202608"), weight, "municipality_code"), 4).alias("allocated"))


def hourly_rate_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Calls per demand point and hour: shares of its town's routes collected in that hour, by population."""
    hours = table(spark, d, "road_times").where("collected_at is not null").groupBy("municipality_code", F.hour(F.col("collected_at").try_cast("timestamp")).cast("long").alias("hour")).agg(F.count("*").alias("calls"))
    p = demand_points(spark, d).where("people > 0").withColumn("share", F.col("people") / F.sum("people").over(Window.partitionBy("municipality_code")))
    return p.join(hours, "municipality_code").select("administrative_code", "hour", rounded(F.col("calls") * F.col("share"), 4).alias("calls"))


def even_split_population(spark: SparkSession, d: str) -> DataFrame:
    """The population of a demand point spread evenly over its candidate cells."""
    cells = table(spark, d, "candidate_sites").where("administrative_code is not null").select("candidate_id", "administrative_code").distinct()
    people = demand_points(spark, d).select("administrative_code", "people")
    return cells.join(people, "administrative_code").select("candidate_id", "administrative_code", rounded(even_share(F.col("people"), "administrative_code"), 4).alias("share"))


def town_totals(spark: SparkSession, d: str) -> DataFrame:
    """Stated totals of towns beside those that the tables give."""
    towns = table(spark, d, "municipality_summary").select("municipality_code", F.col("population_202608").cast("long").alias("stated"), truthy(F.col("ready_for_simulation")).alias("ready"))
    own = demand_points(spark, d).groupBy("municipality_code").agg(F.sum("people").alias("people"), F.count("*").alias("points"), F.sum(F.col("latitude").isNull().cast("long")).alias("unplaced"))
    return towns.join(own, "municipality_code", "left").na.fill(0)


QUERIES = {
    f.__name__: f
    for f in (
        daily_rate_by_municipality, unmapped_station_check, dispatch_counts_two_measures, category_share_table, seasonality_profile, value_band_histogram, base_label_cleanup, code_label_split,
        first_nonempty_fallback, vehicle_explode, largest_remainder_fleet, share_allocation, hourly_rate_expansion, even_split_population, town_totals,
    )
}

DEMAND = r"""demand as (select * from (select *, row_number() over (partition by administrative_code) k,
  case when regexp_full_match(trim(population, ' ' || chr(9)), '[0-9]+|[0-9]{1,3}(,[0-9]{3})*') and try_cast(replace(trim(population, ' ' || chr(9)), ',', '') as hugeint) <= 9999999
    then cast(replace(trim(population, ' ' || chr(9)), ',', '') as bigint) else 0 end people
  from demand_population where administrative_code is not null) where k = 1)"""
ORACLES = {
    "daily_rate_by_municipality": """select n_name municipality, y as "year", annual, floor(annual / (case when (y % 4 = 0 and y % 100 <> 0) or y % 400 = 0 then 366 else 365 end) * 1e4 + 0.5) / 1e4 daily, segments
from (select c_nationkey, cast(year(o_orderdate) as bigint) y, count(*) annual, array_to_string(list_sort(list(distinct c_mktsegment)), ',') segments
  from orders join customer on o_custkey = c_custkey group by 1, 2) join nation on c_nationkey = n_nationkey""",
    "unmapped_station_check": """select r.municipality_code, n, m.municipality_code is not null known from (select municipality_code, count(*) n from road_times group by 1) r
left join (select distinct municipality_code from municipality_summary) m on r.municipality_code = m.municipality_code""",
    "dispatch_counts_two_measures": """select o_orderstatus status, cast(year(o_orderdate) as bigint) "year", cast(month(o_orderdate) as bigint) "month", count(*) n,
  cast(sum(case when o_orderpriority <> '4-NOT SPECIFIED' then 1 else 0 end) as bigint) n_recorded from orders group by 1, 2, 3""",
    "category_share_table": """select o_orderpriority "value", case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'severe' when '3-MEDIUM' then 'moderate' when '4-NOT SPECIFIED' then 'missing' else 'minor' end model_type,
  count(*) n, floor(100.0::double * count(*) / sum(count(*)) over () * 1e4 + 0.5) / 1e4 pct_all,
  case when o_orderpriority <> '4-NOT SPECIFIED' then floor(100.0::double * count(*) / sum(case when o_orderpriority <> '4-NOT SPECIFIED' then count(*) end) over () * 1e4 + 0.5) / 1e4 end pct_recorded from orders group by 1""",
    "seasonality_profile": """select "month", count(*) "years", cast(sum(n) as bigint) total, floor(avg(n / mean) * 1e6 + 0.5) / 1e6 multiplier from (select *, count(*) over (partition by y) full_months, avg(n) over (partition by y) mean
  from (select cast(year(o_orderdate) as bigint) y, cast(month(o_orderdate) as bigint) "month", count(*) n from orders group by 1, 2)) where full_months = 12 group by 1""",
    "value_band_histogram": """select event_type, case when "value" is null then 'missing' when "value" < 0 or "value" > 120 then 'outlier' when "value" >= 100 then '100+'
  else cast(cast(floor("value" / 10) * 10 as integer) as varchar) || '-' || cast(cast(floor("value" / 10) * 10 as integer) + 9 as varchar) end band, count(*) n from events group by 1, 2""",
    "base_label_cleanup": r"""select node_id, nullif(trim(regexp_replace(best, '\s*\(.*$', '')), '') place, lower(regexp_replace(regexp_replace(regexp_replace(best, '[(,].*$', ''), '\s+', '', 'g'), '^한울도?', '')) address_key, icu
from (select distinct node_id, coalesce(nullif(trim(road_address), ''), nullif(trim(lot_address), '')) best, coalesce(lower(trim(registered_adult_icu)) = 'true', false) icu, road_address, lot_address, registered_adult_icu from existing_hospitals)""",
    "code_label_split": rf"""with {DEMAND}, p as (select administrative_code, regexp_split_to_array(trim(administrative_name), '\s+') p from demand)
select administrative_code, administrative_code[1:5] prefix, cast(len(p) as bigint) "level", p[1] province, regexp_replace(p[2], '[시군구]$', '') town, array_to_string(p[3:], ' ') district, administrative_code like '%00000' subtotal from p""",
    "first_nonempty_fallback": """select distinct node_id, coalesce(nullif(trim(regional_unit), ''), nullif(trim(safety_center), ''), nullif(trim(fire_station), '')) unit, coalesce(nullif(trim(matched_address), ''), nullif(trim(address), '')) place from ambulance_bases""",
    "vehicle_explode": """with b as (select node_id[1:5] municipality_code, node_id, ambulance_count from (select *, row_number() over (partition by node_id order by staged_at desc nulls last) k from ambulance_bases) where k = 1 and ambulance_count > 0)
select municipality_code, node_id, n, printf('%s::ambulance::%03d', municipality_code, row_number() over (partition by municipality_code order by node_id, n)) vehicle_id from (select *, unnest(generate_series(1, ambulance_count)) n from b)""",
    "largest_remainder_fleet": """with q as (select *, (sum(ambulance_count) over () - count(*) over ()) * population_202608 / (sum(population_202608) over ())::double quota, sum(ambulance_count) over () - count(*) over () spare from municipality_summary),
  r as (select *, floor(quota) whole, quota - floor(quota) fraction from q), s as (select *, spare - sum(whole) over () remaining, row_number() over (order by fraction desc, municipality_code desc) place from r)
select municipality_code, cast(ambulance_count as bigint) has, cast(1 + whole + case when place <= remaining then 1 else 0 end as bigint) units from s""",
    "share_allocation": f"""with {DEMAND}, w as (select administrative_code, d.municipality_code, population_202608, greatest(coalesce(households, 0), 0) w from demand d join municipality_summary m on d.municipality_code = m.municipality_code)
select administrative_code, municipality_code, floor(population_202608 * (w / nullif(sum(w) over (partition by municipality_code), 0)::double) * 1e4 + 0.5) / 1e4 allocated from w""",
    "hourly_rate_expansion": f"""with {DEMAND}, h as (select municipality_code, cast(hour(collected_at::timestamptz at time zone 'UTC') as bigint) "hour", count(*) calls from road_times where collected_at is not null group by 1, 2),
  p as (select administrative_code, municipality_code, people / (sum(people) over (partition by municipality_code))::double share from demand where people > 0)
select administrative_code, "hour", floor(calls * share * 1e4 + 0.5) / 1e4 calls from p join h on p.municipality_code = h.municipality_code""",
    "even_split_population": f"""with {DEMAND} select candidate_id, c.administrative_code, floor(people / (count(*) over (partition by c.administrative_code))::double * 1e4 + 0.5) / 1e4 share
from (select distinct candidate_id, administrative_code from candidate_sites where administrative_code is not null) c join demand on c.administrative_code = demand.administrative_code""",
    "town_totals": f"""with {DEMAND} select m.municipality_code, cast(population_202608 as bigint) stated, coalesce(lower(trim(ready_for_simulation)) = 'true', false) ready, coalesce(people, 0) people, coalesce(points, 0) points, coalesce(unplaced, 0) unplaced
from municipality_summary m left join (select municipality_code, cast(sum(people) as bigint) people, count(*) points, cast(sum(case when latitude is null then 1 else 0 end) as bigint) unplaced from demand group by 1) d on m.municipality_code = d.municipality_code""",
}
