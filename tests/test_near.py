import math
import random

from pyspark.sql import functions as F

from wardline.operators.near import near_pairs, points_in_regions
from wardline.operators.nearest import nearest

POINT = "k string, latitude double, longitude double"


def km(a, b):
    la, lo, lb, lp = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def cloud(n, seed=1):
    r = random.Random(seed)
    return [(f"p{i:03d}", r.choice((33.0, 38.0, 42.98)) + r.random() * 0.02, 127 + r.random() * 0.02) for i in range(n)]


def pairs(df):
    return {(r.left_key, r.right_key) for r in df.collect()}


def test_self_join_equals_brute_force_and_hot_cells_change_nothing(spark):
    rows = cloud(250)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and km(a, b) <= 0.3}
    df = spark.createDataFrame(rows, POINT)
    got = near_pairs(df, radius_km=0.3, left_key="k")
    assert pairs(got) == want and got.count() == len(want)
    assert pairs(near_pairs(df, radius_km=0.3, left_key="k", hot_cell=2)) == want


def test_two_sides_equal_brute_force(spark):
    a, b = cloud(120), [("q" + k, y, x) for k, y, x in cloud(150, 5)]
    want = {(p[0], q[0]) for p in a for q in b if km(p, q) <= 0.5}
    got = near_pairs(spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT), radius_km=0.5, left_key="k", right_key="k", hot_cell=3)
    assert pairs(got) == want


def test_unusable_rows_repeats_and_ties(spark):
    rows = [("a", 35.0, 127.0), ("a", 35.0, 127.0), ("b", 35.0, 127.0), ("c", None, 127.0), ("d", 0.0, 0.0), (None, 35.0, 127.0), ("e", float("nan"), 127.0), ("f", 35.0, None)]
    df = spark.createDataFrame(rows, POINT).withColumn("km", F.lit("clash")).withColumn("cell_x", F.lit("clash"))
    assert pairs(near_pairs(df, radius_km=0.1, left_key="k")) == {("a", "b")}
    empty = df.where("false")
    assert near_pairs(empty, radius_km=0.1, left_key="k").count() == 0
    assert near_pairs(df, empty, radius_km=0.1, left_key="k", right_key="k").count() == 0


def test_a_key_at_two_positions_has_its_least_distance(spark):
    df = spark.createDataFrame([("a", 35.0, 127.0), ("a", 35.0005, 127.0), ("b", 35.0006, 127.0)], POINT)
    (row,) = near_pairs(df, radius_km=0.1, left_key="k").collect()
    assert abs(row.km - km((0, 35.0005, 127.0), (0, 35.0006, 127.0))) < 1e-9


def test_points_in_regions(spark):
    ring = [(35.0, 127.0), (35.0, 127.2), (35.1, 127.2), (35.1, 127.1), (35.05, 127.1), (35.05, 127.0)]
    regions = spark.createDataFrame([("L", ring), ("flat", ring[:2]), ("none", None)], "r string, ring array<struct<lat:double,lon:double>>")
    points = spark.createDataFrame([("in", 35.02, 127.05), ("in2", 35.08, 127.15), ("notch", 35.08, 127.05), ("out", 36.0, 127.1), ("bad", None, 127.1)], POINT)
    got = {(r.point_key, r.region_key) for r in points_in_regions(points, regions, point_key="k", region_key="r").collect()}
    assert got == {("in", "L"), ("in2", "L")}


def test_crowded_regions_and_cells_change_nothing(spark):
    ring = [(33.0, 127.0), (33.0, 127.02), (33.02, 127.01)]
    regions = spark.createDataFrame([("T", ring), ("T", ring), ("U", [(y, x + 0.005) for y, x in ring])], "r string, ring array<struct<lat:double,lon:double>>")
    df = spark.createDataFrame(cloud(250), POINT)
    get = lambda **more: {(r.point_key, r.region_key) for r in points_in_regions(df, regions, point_key="k", region_key="r", **more).collect()}
    whole = get()
    assert whole == get(hot_cell=2) == get(cell_km=0.3) and len(whole) > 40


def test_both_sides_of_a_crowded_cell_are_split(spark):
    few, many = spark.createDataFrame([(f"a{i}", 35.0, 127.0 + i * 1e-6) for i in range(3)], POINT), spark.createDataFrame([(f"b{i:03d}", 35.0, 127.0 + i * 1e-6) for i in range(300)], POINT)
    assert near_pairs(few, many, radius_km=0.5, left_key="k", right_key="k", hot_cell=20).count() == 900


def test_nearest_equals_brute_force(spark):
    a, b = cloud(60, 2), [("q" + k, y, x) for k, y, x in cloud(40, 7)]
    got = {(r.point, r.place): r.facility for r in nearest(spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT), point_key="k", facility_key="k", k=2, start_km=0.2).collect()}
    for p in a:
        ranked = sorted((km(p, q), q[0]) for q in b)
        assert [got[p[0], 1], got[p[0], 2]] == [ranked[0][1], ranked[1][1]]


def test_nearest_of_sparse_few_and_far_facilities(spark):
    points = [("near", 33.0, 127.0), ("edge", 33.1, 127.0), ("far", 42.9, 131.9), ("lone", 36.0, 124.1)]
    crowd = [(f"c{i:02d}", 33.0 + i * 0.001, 127.0) for i in range(40)] + [("north", 42.0, 131.0)]
    df, fs = spark.createDataFrame(points, POINT), spark.createDataFrame(crowd, POINT)
    for k in (1, 3, 41, 60):
        got = {(r.point, r.place): (r.facility, round(r.km, 6)) for r in nearest(df, fs, point_key="k", facility_key="k", k=k, start_km=0.5).collect()}
        assert len(got) == 4 * min(k, 41)
        for p in points:
            ranked = sorted((km(p, q), q[0]) for q in crowd)[:k]
            assert [got[p[0], i + 1] for i in range(len(ranked))] == [(name, round(d, 6)) for d, name in ranked]
    own = {(r.point, r.place): r.facility for r in nearest(df, point_key="k", k=2).collect()}
    for p in points:
        assert [own[p[0], 1], own[p[0], 2]] == [q for _, q in sorted((km(p, q), q[0]) for q in points if q != p)][:2]
    assert nearest(df, fs.where("false"), point_key="k", facility_key="k").count() == 0 and nearest(df.where("false"), point_key="k").count() == 0
