"""Summaries of operation logs and of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.numbers import hour_of, rounded, survival
from wardline.operators.estimates import estimate, paired
from wardline.operators.sequences import changes, in_pieces, running, with_previous
from wardline.sources.tables import table

#: Golden minutes and decay per minute of each severity class, as parameters of the example curves.
PROFILES = {"critical": (5.0, 0.08), "severe": (15.0, 0.03), "moderate": (30.0, 0.01), "minor": (120.0, 0.001)}


def cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("long")


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


def episode_summary_kpi(spark: SparkSession, d: str) -> DataFrame:
    """Per day: events, units, values over the non-null, and the share of clicks."""
    e = table(spark, d, "events")
    n = lambda k: F.sum((F.col("event_type") == k).cast("long"))
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("events"),
        F.count_distinct("user_id").alias("units"),
        F.sum(cents(F.col("value"))).alias("value_cents"),
        rounded(F.percentile("value", F.lit(0.9)), 4).alias("p90"),
        n("click").alias("clicks"),
        rounded(n("click") / F.count("*")).alias("click_share"),
    )


def by_type_kpi(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.min(v).alias("least"), F.max(v).alias("most"), rounded(F.sum(cents(v)) / F.count(v) / 100.0, 4).alias("mean"), rounded(F.percentile("value", F.lit(0.9)), 4).alias("p90"))


def metric_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Mean and interval per unit and metric, the metrics turned into rows."""
    e = table(spark, d, "events").select("user_id", F.col("value").alias("minutes"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    tall = e.unpivot(["user_id"], ["minutes", "k"], "metric", "v")
    return tall.groupBy("user_id", "metric").agg(*estimate(F.col("v")))


def paired_differences(spark: SparkSession, d: str) -> DataFrame:
    """Events per day of each type against views."""
    per = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").cast("double").alias("v"))
    return paired(per, "day", "event_type", "v", "view")


def combined_variance(spark: SparkSession, d: str) -> DataFrame:
    """Per customer segment: sums of the nations' mean order prices, their deviations and intervals combined."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    per = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"))
    var, err = F.sum(F.col("sd") * F.col("sd")), F.sum(F.col("sd") * F.col("sd") / F.col("n"))
    return per.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("parts"), rounded(F.sum("mean"), 2).alias("mean"), rounded(F.sqrt(var), 2).alias("sd"), rounded(1.96 * F.sqrt(err), 2).alias("half_width"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """A part's revenue in cents per ship mode of order year (the variants' scores)."""
    l = table(spark, d, "lineitem")
    return l.groupBy(F.col("l_partkey").alias("part"), F.year("l_shipdate").cast("long").alias("year")).agg(F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("score"))


def ranked_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """The ten best parts of each year by revenue (ties: the smaller key)."""
    w = Window.partitionBy("year").orderBy(F.desc("score"), "part")
    return _scores(spark, d).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10")


def baseline_rank(spark: SparkSession, d: str) -> DataFrame:
    """Where the first year's best part stands in every other year, and whether it is still the best."""
    s = _scores(spark, d)
    first = s.groupBy("year").agg(F.max(F.struct("score", (-F.col("part")).alias("k"))).alias("m")).groupBy().agg(F.min_by("m", "year").alias("m"), F.min("year").alias("base_year")).select((-F.col("m.k")).alias("base"), "base_year")
    own = s.join(F.broadcast(first), F.col("part") == F.col("base")).where(F.col("year") != F.col("base_year")).select("year", "base", F.col("score").alias("own"))  # first is one row
    ahead = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("part") < F.col("base")))
    places = s.join(F.broadcast(own), "year").groupBy("base", "year").agg((F.count_if(ahead) + 1).alias("place"))  # own is one row a year
    return places.select(F.col("base").alias("part"), "year", "place", (F.col("place") == 1).alias("still_best"))


def state_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The events at which a unit's state differs from the one before."""
    return changes(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


def new_legs(spark: SparkSession, d: str) -> DataFrame:
    """Legs of equal state: their number and the most events of one, per unit."""
    order = ["ts", "event_id"]
    pieced = in_pieces(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", order)
    told = with_previous(pieced, "user_id", order, ["event_type"])
    begun = told.withColumn("new", F.when(F.col("__before").isNotNull() & F.struct("event_type").eqNullSafe(F.col("__before")), 0).otherwise(1)).drop("__before")
    legs = running(begun, "user_id", order, {"leg": F.col("new")}).groupBy("user_id", "leg").agg(F.count("*").alias("n"))
    return legs.groupBy("user_id").agg(F.max("leg").cast("long").alias("legs"), F.max("n").alias("longest"))


def running_mean(spark: SparkSession, d: str) -> DataFrame:
    """A unit's mean value up to each event; null before its first value."""
    order, c = ["ts", "event_id"], cents(F.col("value"))
    pieced = in_pieces(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", order)
    sums = running(pieced, "user_id", order, {"s": c, "n": c.isNotNull().cast("long")})
    return sums.select("event_id", F.when(F.col("n") > 0, rounded(F.col("s") / F.col("n") / 100.0, 4)).alias("mean"))


def schedule_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Hours at which routes change between busier and quieter than the mean hour, on the ring of 24 hours."""
    h = table(spark, d, "road_times").where("collected_at is not null").groupBy(F.hour(F.col("collected_at").try_cast("timestamp")).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    busy = h.withColumn("busy", F.col("n") > F.avg("n").over(everything))
    order = Window.orderBy("hour")  # 24 rows
    before = F.coalesce(F.lag("busy").over(order), F.last("busy").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return busy.withColumn("before", before).where(F.col("busy") != F.col("before")).select("hour", "busy")


def survival_curve(spark: SparkSession, d: str) -> DataFrame:
    """Expected survivors per severity class if the events' values were minutes until care."""
    e = table(spark, d, "events").where("value is not null")
    curves = [F.struct(F.lit(k).alias("profile"), survival(F.col("value"), *p).alias("s")) for k, p in PROFILES.items()]
    return e.select("event_type", hour_of(F.col("value")).alias("hour"), F.explode(F.array(*curves)).alias("c")).groupBy("event_type", "c.profile").agg(F.count("*").alias("n"), rounded(F.avg("c.s"), 5).alias("survival"), F.max("hour").cast("long").alias("last_hour"))


def treatment_success(spark: SparkSession, d: str) -> DataFrame:
    """Hospitals able to treat: an intensive unit registered and a scanner, by grade; missing grades apart."""
    h = table(spark, d, "existing_hospitals").select("node_id", "egen_overall_grade", "registered_adult_icu", "ct_units", "mri_units").distinct()
    able = (F.coalesce(F.lower(F.trim("registered_adult_icu")), F.lit("")) == "true") & (F.coalesce("ct_units", F.lit(0)) + F.coalesce("mri_units", F.lit(0)) > 0)
    return h.groupBy(F.coalesce("egen_overall_grade", F.lit("none")).alias("grade")).agg(F.count("*").alias("n"), F.sum(able.cast("long")).alias("able"), rounded(F.avg(able.cast("double"))).alias("rate"))


def k_subsets(spark: SparkSession, d: str) -> DataFrame:
    """The shortlist of pairs among each town's five best sites by people, ranked within it by the people of both."""
    s = table(spark, d, "candidate_sites").groupBy("candidate_id").agg(F.min("municipality_code").alias("town"), F.max("cell_population_estimate").alias("people"))
    top = s.withColumn("n", F.row_number().over(Window.partitionBy("town").orderBy(F.desc_nulls_last("people"), "candidate_id"))).where("n <= 5 and people is not null")
    b = top.select("town", F.col("candidate_id").alias("second"), F.col("people").alias("people_b"))
    pairs = top.withColumnRenamed("candidate_id", "first").join(b, "town").where(F.col("first") < F.col("second")).withColumn("score", rounded(F.col("people") + F.col("people_b"), 1))
    return pairs.select("town", "first", "second", "score", F.row_number().over(Window.partitionBy("town").orderBy(F.desc("score"), "first", "second")).cast("long").alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        event_counts, episode_summary_kpi, by_type_kpi, metric_estimates, paired_differences, combined_variance, ranked_alternatives, baseline_rank, state_deltas, new_legs, running_mean,
        schedule_boundaries, survival_curve, treatment_success, k_subsets,
    )
}

_C = 'cast(floor("value" * 100 + 0.5) as bigint)'
_EST = "count(v) n, floor(avg(v) * 1e6 + 0.5) / 1e6 mean, floor(case when count(v) >= 2 then stddev_samp(v) end * 1e6 + 0.5) / 1e6 sd, floor(case when count(v) >= 2 then avg(v) - 1.96::double * stddev_samp(v) / sqrt(count(v)) end * 1e6 + 0.5) / 1e6 low, floor(case when count(v) >= 2 then avg(v) + 1.96::double * stddev_samp(v) / sqrt(count(v)) end * 1e6 + 0.5) / 1e6 high"
_SCORES = 's as (select l_partkey part, cast(year(l_shipdate) as bigint) y, cast(sum(cast(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) as bigint)) as bigint) score from lineitem group by 1, 2), r as (select *, row_number() over (partition by y order by score desc, part) place from s)'
ORACLES = {
    "event_counts": "select event_type, count(*) n from events group by 1",
    "episode_summary_kpi": f"""select strftime(ts, '%Y-%m-%d') "day", count(*) events, count(distinct user_id) units, cast(sum({_C}) as bigint) value_cents, floor(quantile_cont("value", 0.9) * 1e4 + 0.5) / 1e4 p90,
  cast(sum(case when event_type = 'click' then 1 when event_type is not null then 0 end) as bigint) clicks, floor(sum(case when event_type = 'click' then 1 else 0 end) / count(*) * 1e6 + 0.5) / 1e6 click_share from events group by 1""",
    "by_type_kpi": f"""select event_type, count(*) n, count("value") valued, min("value") least, max("value") most, floor(sum({_C}) / count("value") / 100.0::double * 1e4 + 0.5) / 1e4 mean, floor(quantile_cont("value", 0.9) * 1e4 + 0.5) / 1e4 p90 from events group by 1""",
    "metric_estimates": f"""select user_id, metric, {_EST} from (select user_id, 'minutes' metric, "value" v from events union all select user_id, 'k', try_cast(json_extract_string(props, '$.k') as double) from events) group by 1, 2""",
    "paired_differences": f"""with p as (select strftime(ts, '%Y-%m-%d') "day", event_type, count(*)::double c from events group by 1, 2)
select a.event_type, {_EST} from (select a.event_type, a.c - b.c v from p a join p b on a."day" = b."day" and b.event_type = 'view' where a.event_type <> 'view') a group by 1""",
    "combined_variance": """select segment, count(*) parts, floor(sum(mean) * 100 + 0.5) / 100 mean, floor(sqrt(sum(sd * sd)) * 100 + 0.5) / 100 sd, floor(1.96::double * sqrt(sum(sd * sd / n)) * 100 + 0.5) / 100 half_width
from (select c_mktsegment segment, c_nationkey, count(*) n, avg(o_totalprice) mean, stddev_samp(o_totalprice) sd from orders join customer on o_custkey = c_custkey group by 1, 2) group by 1""",
    "ranked_alternatives": f'with {_SCORES} select part, y "year", score, place from r where place <= 10',
    "baseline_rank": f"""with {_SCORES}, f as (select part, y from r where place = 1 and y = (select min(y) from r)) select r.part, r.y "year", place, place = 1 still_best from r join f on r.part = f.part where r.y <> f.y""",
    "state_deltas": """select event_id, user_id, event_type from (select *, row_number() over w n, lag(event_type) over w p from events window w as (partition by user_id order by ts, event_id)) where n = 1 or event_type is distinct from p""",
    "new_legs": """with e as (select *, case when event_type is not distinct from lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end f from events),
  g as (select *, sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding) leg from e), l as (select user_id, leg, event_type, count(*) n from g group by 1, 2, 3)
select user_id, cast(max(leg) as bigint) legs, max(n) longest from l group by 1""",
    "running_mean": f"""select event_id, floor(sum({_C}) over w / count("value") over w / 100.0::double * 1e4 + 0.5) / 1e4 mean from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",
    "schedule_boundaries": """with h as (select cast(hour(collected_at::timestamptz at time zone 'UTC') as bigint) "hour", count(*) n from road_times where collected_at is not null group by 1),
  b as (select *, n > avg(n) over () busy from h), c as (select *, coalesce(lag(busy) over (order by "hour"), last_value(busy) over (order by "hour" rows between unbounded preceding and unbounded following)) p from b)
select "hour", busy from c where busy <> p""",
    "survival_curve": """with p(profile, golden, decay) as (values ('critical', 5.0::double, 0.08::double), ('severe', 15.0, 0.03), ('moderate', 30.0, 0.01), ('minor', 120.0, 0.001))
select event_type, profile, count(*) n, floor(avg(exp(-decay * greatest(0.0, "value" - golden))) * 1e5 + 0.5) / 1e5 survival, cast(max(cast(floor("value" / 60) as bigint) % 24) as bigint) last_hour from events, p where "value" is not null group by 1, 2""",
    "treatment_success": """select coalesce(egen_overall_grade, 'none') grade, count(*) n, cast(sum(a) as bigint) able, floor(avg(a) * 1e6 + 0.5) / 1e6 rate
from (select distinct node_id, egen_overall_grade, registered_adult_icu, ct_units, mri_units, case when coalesce(lower(trim(registered_adult_icu)), '') = 'true' and coalesce(ct_units, 0) + coalesce(mri_units, 0) > 0 then 1 else 0 end a from existing_hospitals) group by 1""",
    "k_subsets": """with s as (select candidate_id, min(municipality_code) town, max(cell_population_estimate) people from candidate_sites group by 1),
  t as (select * from (select *, row_number() over (partition by town order by people desc nulls last, candidate_id) n from s) where n <= 5 and people is not null),
  q as (select a.town, a.candidate_id "first", b.candidate_id "second", floor((a.people + b.people) * 10 + 0.5) / 10 score from t a join t b on a.town = b.town and a.candidate_id < b.candidate_id)
select *, row_number() over (partition by town order by score desc, "first", "second") place from q""",
}
