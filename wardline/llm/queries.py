"""Queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.abuse import severity, train
from wardline.llm.matching import FOUND_CONFIDENCE, match
from wardline.llm.mixing import mix
from wardline.llm.variants import variant_classes, variant_pairs
from wardline.llm.tokens import token_counts, token_ids
from wardline.sources.tables import table


def _town() -> Column:
    """A town's name without its suffix."""
    return F.regexp_replace("municipality_name", "[시군구]$", "")


def hospital_rows(spark: SparkSession, d: str) -> DataFrame:
    """existing_hospitals as the entity operators take it; towns by code."""
    towns = table(spark, d, "municipality_summary").select(F.col("municipality_code").alias("block"), _town().alias("town")).dropDuplicates(["block"])
    rows = table(spark, d, "existing_hospitals").select(
        F.col("node_id").alias("key"),
        F.col("municipality_code").alias("block"),
        F.col("hospital_name").alias("name"),
        F.col("hira_hospital_name").alias("stated"),
        "phone",
        F.array("road_address", "lot_address").alias("addresses"),
        F.col("postal_code").alias("postal"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.array("emergency_room_beds", "critical_care_beds", "inpatient_beds").alias("beds"),
    )
    return rows.join(towns, "block", "left")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = hospital_rows(spark, d)
    return variant_pairs(variant_classes(rows), rows.select("key", "name"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row of existing_hospitals with its class; unlinked rows are classes of their own."""
    rows = hospital_rows(spark, d)
    return rows.select("key").distinct().join(variant_classes(rows), "key", "left").select(F.col("key").alias("node_id"), F.coalesce("class_id", "key").alias("class_id"))


def register_rows(spark: SparkSession, d: str) -> DataFrame:
    """hira_institutions as the entity operators take it; towns by name."""
    return table(spark, d, "hira_institutions").select(
        F.col("care_symbol").alias("key"),
        _town().alias("block"),
        F.col("hira_hospital_name").alias("name"),
        F.lit(None).cast("string").alias("stated"),
        _town().alias("town"),
        "phone",
        F.array("address").alias("addresses"),
        F.col("postal_code").alias("postal"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.array().cast("array<int>").alias("beds"),
        F.col("bed_total").alias("size"),
    )


def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    """egen_evaluations as the entity operators take it."""
    town = F.regexp_replace("area_nm", "[시군구]$", "")
    return table(spark, d, "egen_evaluations").select(
        F.col("instt_cd").alias("key"),
        town.alias("block"),
        F.col("instt_nm").alias("name"),
        town.alias("town"),
        F.col("tel").alias("phone"),
        F.array("addr").alias("addresses"),
        F.lit(None).cast("string").alias("stated"),
        F.lit(None).cast("string").alias("postal"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        F.array().cast("array<int>").alias("beds"),
        F.col("bed_cnt").alias("size"),
    )


def source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Both source tables as the entity operators take them, towns by name; the key tells the table."""
    hospitals = hospital_rows(spark, d)
    hospitals = hospitals.withColumn("block", F.col("town")).withColumn("size", F.aggregate("beds", F.lit(0), lambda s, x: s + x))
    both = evaluation_rows(spark, d).withColumn("src_table", F.lit("egen_evaluations")).unionByName(hospitals.withColumn("src_table", F.lit("existing_hospitals")))
    return both.withColumn("key", F.concat("src_table", F.lit("|"), "key"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every source row that has a candidate, its likeliest record and the confidence."""
    found = match(source_rows(spark, d), register_rows(spark, d))
    parts = F.split("key", r"\|", 2)
    return found.select(parts[0].alias("src_table"), parts[1].alias("src_key"), F.col("record").alias("care_symbol"), "confidence")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).where(F.col("confidence") >= FOUND_CONFIDENCE).select("src_table", "src_key", "care_symbol")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents").select("doc_id", "source", "text"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), table(spark, d, "mix_targets"))[1]


def _severities(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    return severity(documents, train(documents, table(spark, d, "moderation_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _severities(spark, d).where("found").select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _severities(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, found ones, their rate and the mean severity per source."""
    found = F.col("found").cast("int")
    return _severities(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.sum(found).alias("found"), F.avg(found).alias("rate"), F.avg("severity").alias("mean_severity"))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p5_found": p5_found, "p5_matches": p5_matches, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
ORACLES: dict[str, str] = {}
