import math
import random

import pytest
from pyspark.sql import functions as F

from wardline.functions.documents import Declared, path_errors
from wardline.functions.numbers import clamp, uniform
from wardline.operators.allocation import observed_or_share, region_totals
from wardline.operators.merging import overridden
from wardline.sources.sinks import append_rejects, split_rejects, write_checked


def test_path_errors(spark):
    declared = (Declared("a.n", "number", required=True, least=0, most=10), Declared("i", "integer"), Declared("t", "text"), Declared("b", "boolean"), Declared("l", "array"))
    cases = {
        '{"a": {"n": 1.5}, "i": 2, "t": "x", "b": true, "l": [1]}': [],
        '{"a": {"n": -1}}': [("a.n", "must be at least 0")],
        '{"a": {"n": 11}, "i": 2.5}': [("a.n", "must be at most 10"), ("i", "must be an integer")],
        '{"a": {"n": "1"}, "t": 3, "b": 1, "l": {}}': [("a.n", "must be a number"), ("t", "must be a text"), ("b", "must be true or false"), ("l", "must be an array")],
        '{"a": {"n": null}, "i": null}': [("a.n", "is required")],
        '{"a": 1}': [("a.n", "is required")],
        "not json": [("a.n", "is required")],
        "": [("a.n", "is required")],
        None: [("a.n", "is required")],
    }
    df = spark.createDataFrame([(k,) for k in cases], "doc string")
    got = {r.doc: [tuple(e) for e in r.e] for r in df.withColumn("e", path_errors(F.col("doc"), declared)).collect()}
    assert got == cases


def test_overrides_and_shares(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None), (None, 2.0)], "k string, x double")
    over = spark.createDataFrame([("b", 5.0), ("z", 6.0), (None, 9.0)], "k string, x double")
    assert sorted((r.k or "", r.x, r.basis) for r in overridden(rows, over, "k", ["x"]).collect()) == [("", 2.0, "own"), ("", 9.0, "unmatched"), ("a", 1.0, "own"), ("b", 5.0, "override"), ("z", 6.0, "unmatched")]
    t = spark.createDataFrame([("a", 3.0, 12.0, 1), ("b", None, 12.0, 2), ("c", None, 12.0, None)], "k string, seen double, total double, w int")
    assert {r.k: (r.amount, r.basis) for r in observed_or_share(t, "seen", "total", "w").collect()} == {"a": (3.0, "observed"), "b": (8.0, "proportional"), "c": (None, "proportional")}


def test_region_totals(spark):
    df = spark.createDataFrame([("11a", 1), ("11b", None), ("12a", 5)], "code string, n int")
    assert region_totals(df, "code", {"n": "total"}).first().total == 6 and region_totals(df, "code", {"n": "total"}, "11").first().total == 1
    with pytest.raises(ValueError):
        region_totals(df, "code", {"n": "total"}, "13")


def test_uniform_and_clamp(spark):
    df = spark.range(4000).select(uniform(F.col("id")).alias("u"), clamp(F.col("id").cast("double"), 10.0, 20.0).alias("c"))
    low, high, mean, least, most = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.min("c"), F.max("c")).first()
    assert 0 <= low and high < 1 and math.isclose(mean, 0.5, abs_tol=0.02) and (least, most) == (10.0, 20.0)
    assert spark.range(1).select(clamp(F.lit(None).cast("double"), 1.0, 2.0)).first()[0] is None


def test_rejects_are_split_and_appended_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, None), (3, None)], "id long, v string")
    good, bad = split_rejects(df, F.when(F.col("v").isNull(), "empty"))
    assert [r.id for r in good.collect()] == [1] and good.columns == df.columns
    place = str(tmp_path / "dead")
    append_rejects(bad, place, ["id"])
    append_rejects(bad.unionByName(spark.createDataFrame([(4, "x", "late")], "id long, v string, problem string")), place, ["id"])
    assert sorted((r.id, r.problem) for r in spark.read.parquet(place).collect()) == [(2, "empty"), (3, "empty"), (4, "late")]


def test_write_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "k int, v string")
    assert write_checked(df, str(tmp_path / "t")).count() == 3
    with pytest.raises(ValueError):
        write_checked(df.withColumn("v", F.udf(lambda: str(random.random())).asNondeterministic()()), str(tmp_path / "u"))
