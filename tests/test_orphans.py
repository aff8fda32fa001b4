import random

from pyspark.sql import functions as F

from wardline.operators import orphans
from wardline.operators.orphans import key_runs, orphan_references

REF = "row long, ref_id string, ref_at long"
PARENT = "id string, staged long, retired long"


def brute(refs, parents):
    spans = {}
    for k, s, r in parents:
        if k is not None:
            s, r = -(2**63) if s is None else s, 2**63 - 1 if r is None else r
            old = spans.get(k, (s, r))
            spans[k] = (min(s, old[0]), max(r, old[1]))
    out = []
    for row, k, at in refs:
        if k is None:
            continue
        if k not in spans:
            out.append((row, "missing"))
        elif at is not None and at < spans[k][0]:
            out.append((row, "late"))
        elif at is not None and at >= spans[k][1]:
            out.append((row, "deleted"))
    return sorted(out)


def world(seed=3):
    r = random.Random(seed)
    ids = [f"a::{r.choice('xy')}::{n:0{w}d}" for n in range(0, 9000, r.randint(1, 3)) for w in (r.choice((3, 4, 7)),)][:700] + ["", "a", "7", "007", "a::x::" + "9" * 25, "가나::12", "a::x::1 "]
    parents = [(k, r.choice((None, 10, 50)), r.choice((None, None, 60))) for k in ids]
    refs = [(i, r.choice(ids + ["a::x::1", "a::x::00001", "b::x::0001", "a::x::", "a::X::0001", "9", None]), r.choice((None, 5, 30, 60, 99))) for i in range(3000)]
    return refs, parents


def found(df):
    return sorted((r.row, r.reason) for r in df.collect())


def test_equals_brute_force(spark, monkeypatch):
    refs, parents = world()
    a, b = spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT)
    assert found(orphan_references(a, b)) == brute(refs, parents)
    monkeypatch.setattr(orphans, "BROADCAST_BYTES", -1)
    assert found(orphan_references(a, b)) == brute(refs, parents)


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    refs, parents = world(4)
    refs = refs[:200] + refs[:50]
    a, b = spark.createDataFrame(refs, REF), spark.createDataFrame(parents + parents[:9], PARENT)
    clash = a.withColumn("missing", F.lit("m")).withColumn("staged", F.lit(1)).withColumn("reason", F.lit("old")).withColumn("salt", F.lit(0)).withColumn("stem", F.lit("s")).withColumn("number", F.lit("n"))
    got = orphan_references(clash, b)
    assert found(got) == brute(refs, parents) and {r.missing for r in got.collect()} == {"m"}
    assert orphan_references(a.where("false"), b).count() == 0
    assert {r.reason for r in orphan_references(a, b.where("false")).collect()} == {"missing"}


def test_runs_are_contiguous_and_cut_at_buckets(spark):
    parents = spark.createDataFrame([(f"k{n}", None, None) for n in [*range(4090, 4100), 5000]], PARENT)
    runs = sorted((r.start, r.end, len(r.staged)) for r in key_runs(parents).collect())
    assert runs == [(4090, 4095, 6), (4096, 4099, 4), (5000, 5000, 1)]


def test_a_hot_reference_is_whole(spark):
    refs = [(i, "k1", 5) for i in range(2000)] + [(9999, "k2", 5)]
    parents = spark.createDataFrame([("k1", 6, None), ("k2", 1, None)], PARENT)
    assert orphan_references(spark.createDataFrame(refs, REF), parents).count() == 2000
