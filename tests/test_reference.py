"""The relational operators against hand-made cases."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.labels import address_key, base_place, first_text, truthy
from wardline.functions.numbers import band, count_of, hour_of, survival
from wardline.operators.allocation import even_share, largest_remainder, share_of
from wardline.operators.checks import Rule, duplicates, require_none, violations
from wardline.operators.estimates import estimate, paired
from wardline.operators.sequences import changes
from wardline.operators.merging import evolved, first_kept, last_wins, registry_differences, tiers
from wardline.operators.nearest import grid, top_share_excluded
from wardline.operators.reach import best_edges, reach
from wardline.sources.files import keyed_records, read_csv, read_text_lines, require_columns, verify_manifest
from wardline.sources.sinks import collect_missing, documents, first_success, write_csv


def test_reach_on_a_path_graph(spark):
    routes = [("a", "b", 4.0), ("a", "b", 9.0), ("a", "c", 10.0), ("b", "c", 3.0), ("b", "d", 12.0), ("c", "d", 2.0), ("c", "a", 10.0), ("d", "a", 1.0), ("a", "e", -1.0), ("a", "e", float("inf")), ("a", "e", None), ("e", "e", 1.0)]
    edges = best_edges(spark.createDataFrame(routes, "s string, t string, m double"), "s", "t", "m")
    source = spark.createDataFrame([("a",), ("a",), (None,)], "node string")
    at = lambda legs: {r.node: r.minutes for r in reach(edges, source, legs).collect()}
    assert at(None) == {"a": 0.0, "b": 4.0, "c": 7.0, "d": 9.0}
    assert at(1) == {"a": 0.0, "b": 4.0, "c": 10.0} and at(0) == {"a": 0.0}


def test_allocation(spark):
    df = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 2, 10)], "k string, w int, t int")
    assert {r.k: r.units for r in largest_remainder(df, "w", "t", "k").collect()} == {"a": 2, "b": 3, "c": 5}
    assert {r.k: r.units for r in largest_remainder(df, "w", "t", "k", least=3).collect()} == {"a": 3, "b": 3, "c": 4}
    g = spark.createDataFrame([("x", 600.0, 1.0), ("x", 600.0, 2.0), ("y", 6.0, 0.0)], "g string, t double, w double")
    assert sorted((r.g, r.s, r.e) for r in g.select("g", share_of(F.col("t"), F.col("w"), "g").alias("s"), even_share(F.col("t"), "g").alias("e")).collect() if r.s) == [("x", 200.0, 300.0), ("x", 400.0, 300.0)]


def test_estimates_and_pairs(spark):
    df = spark.createDataFrame([(1, "base", 1.0), (2, "base", 2.0), (1, "new", 3.0), (2, "new", 4.0), (3, "new", 9.0), (1, "one", 5.0)], "seed int, variant string, v double")
    got = {r.variant: r for r in paired(df, "seed", "variant", "v", "base").collect()}
    assert (got["new"].n, got["new"].mean, got["new"].sd) == (2, 2.0, 0.0)
    assert got["one"].n == 1 and got["one"].sd is None and got["one"].low is None
    (e,) = df.agg(*estimate(F.col("v"))).collect()
    assert math.isclose(e.high - e.mean, e.mean - e.low, abs_tol=2e-6)


def test_changes(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "b", "a"])], "u int, t int, s string")
    assert [r.t for r in changes(df, "u", ["t"], ["s"]).orderBy("t").collect()] == [0, 2, 4, 5]


def test_merging(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n"), (None, 2, "m"), ("", 3, "e")], "k string, o int, v string")
    assert {r.v for r in last_wins(df, ["k"], ["o"]).collect()} == {"y", "z", "m", "e"}
    assert {r.v for r in first_kept(df, F.col("k"), ["o"]).collect()} == {"x", "z", "n", "m", "e"}
    value, tag = tiers(("one", F.col("k")), ("two", F.when(F.col("o") == 1, F.lit("w"))))
    assert {(r.x, r.y) for r in df.select(value.alias("x"), tag.alias("y")).collect()} == {("a", "one"), ("b", "one"), ("w", "two"), (None, "unresolved"), ("", "one")}
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), spark.createDataFrame([("a", 1), ("c", 3)], "k string, n int")
    assert {(r.k, r.left_value, r.right_value) for r in registry_differences(left, right, "k", ["n"]).collect()} == {("b", 2, None), ("c", None, 3)}
    both = evolved(left, spark.createDataFrame([("d",)], "k string"), defaults={"n": 0})
    assert {r.k: r.n for r in both.collect()}["d"] == 0


def test_checks(spark):
    df = spark.createDataFrame([(1, -1.0), (2, None), (3, 5.0), (3, 6.0), (3, 6.0)], "k int, v double")
    assert {(r.rule, r.record_key) for r in violations(df, "t", "k", [Rule("negative", F.col("v") < 0), Rule("missing", F.col("v").isNull())]).collect()} == {("negative", "1"), ("missing", "2")}
    assert [r.record_key for r in duplicates(df, "t", "k").collect()] == ["3"]
    require_none(df.where("false"), "nothing")
    with pytest.raises(ValueError, match="bad"):
        require_none(df, "bad")


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(count_of(F.lit(" 1,234\t"))) == 1234 and value(count_of(F.lit("12,34"))) is None and value(count_of(F.lit("99999999999999999999"))) is None
    assert value(hour_of(F.lit(1500.0))) == 1 and value(hour_of(F.lit(-1.0))) == 23
    assert value(survival(F.lit(3.0), 5.0, 0.1)) == 1.0 and math.isclose(value(survival(F.lit(15.0), 5.0, 0.1)), math.exp(-1))
    assert [value(band(F.lit(v).cast("double"), 10, 0, 120, 100)) for v in (None, -1, 0, 19.5, 100, 121)] == ["missing", "outlier", "0-9", "10-19", "100+", "outlier"]
    assert value(first_text(F.lit(" "), F.lit(None).cast("string"), F.lit(" b "))) == "b"
    assert value(base_place(F.lit("가 (나)"))) == "가" and value(base_place(F.lit("(나)"))) is None and value(address_key(F.lit("한울도 가람시  A로 1, 2층"))) == "가람시a로1"
    assert value(truthy(F.lit(" TRUE "))) and not value(truthy(F.lit(None).cast("string")))


def test_grid_and_top_share(spark):
    points = spark.createDataFrame([("t", 35.0, 127.0), ("t", 35.02, 127.0), ("t", None, 127.0)], "g string, latitude double, longitude double")
    cells = grid(points, "g")
    assert (cells.count(), cells.agg(F.max("grid_row")).first()[0], cells.agg(F.max("grid_col")).first()[0]) == (10, 4, 1)
    people = spark.createDataFrame([("t", v) for v in (9, 8, 8, 8, 5, 4, 3, 2, 1, 1)], "g string, v int")
    assert sorted(r.v for r in top_share_excluded(people, "g", "v", 0.3).collect()) == [1, 1, 2, 3, 4, 5]


def test_files(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿a,b\n1,\"x \"\"y\"\"\n z\"\n".encode())
    got = read_csv(spark, str(tmp_path / "u.csv"), needed=["a", "b"]).collect()
    assert [(r.a, r.b) for r in got] == [("1", 'x "y"\n z')] and got[0].source_file.endswith("u.csv")
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(spark.range(1), ["x"], "table")
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.txt").write_bytes("년도,월\n가,1".encode("cp949"))
    (tmp_path / "k/b.txt").write_bytes("﻿년도".encode())
    assert sorted((r.line_no, r.line) for r in read_text_lines(spark, str(tmp_path / "k")).collect()) == [(1, "년도"), (1, "년도,월"), (2, "가,1")]


def test_keyed_records_and_manifest(spark, tmp_path):
    record = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("beds", T.IntegerType())])
    docs = spark.createDataFrame([('{"h": {"z": {"beds": 1}, "a": {"name": "n", "beds": 2}}}',), ('{"h": [{"id": "q", "beds": 3}]}',), ("{}",)], "value string")
    assert [(r.ordinal, r.id, r.beds) for r in keyed_records(docs, "h", record).orderBy("beds").collect()] == [(0, "z", 1), (1, "n", 2), (0, "q", 3)]
    (tmp_path / "f.bin").write_bytes(b"abc")
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    manifest = spark.createDataFrame([("f.bin", 3, digest), ("f.bin", 4, digest), ("f.bin", 3, "00"), ("g.bin", 3, digest)], "path string, bytes long, sha256 string")
    assert sorted(r.problem for r in verify_manifest(spark, manifest, str(tmp_path)).collect()) == ["digest", "missing", "size"]


def test_sinks_and_collection(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "x")], "k int, l array<int>, s string")
    write_csv(df, str(tmp_path / "out"), ["s", "l"], files=1)
    assert [(r.s, r.l) for r in read_csv(spark, str(tmp_path / "out")).collect()] == [("x", "[1,2]")]
    assert documents(df, "k").first().document == '{"k":1,"l":[1,2],"s":"x"}'
    required = spark.createDataFrame([(f"n{i}",) for i in range(6)], "k string")
    measured = spark.createDataFrame([("n0",)], "k string")

    def call(keys: pd.DataFrame) -> pd.DataFrame:
        return keys.assign(minutes=[float(k[1:]) if k != "n3" else None for k in keys.k], error=["no way" if k == "n3" else None for k in keys.k])

    got = collect_missing(required, measured, ["k"], call, "k string, minutes double, error string", budget=3)
    assert sorted((r.k, r.error) for r in got.collect()) == [("n1", None), ("n2", None), ("n3", "no way")]
    tried = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>").select(first_success(F.col("t"), lambda x: F.when(x > "a", F.upper(x))).alias("x"))
    assert tried.first().x == "B"
