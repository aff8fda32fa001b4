import random

from pyspark.sql import functions as F

from wardline.operators.nearest import top_share_excluded
from wardline.operators.sequences import changes, in_pieces, running, with_previous

ROW = "unit string, at long, event long, state string, value double"


def log(n, seed=3):
    r = random.Random(seed)
    return [(r.choice(("hot", "hot", "hot", "b", None)), r.randrange(n // 2), i, r.choice(("x", "y", None)), r.choice((None, 1.0, 2.5))) for i in range(n)]


def by_unit(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[1], x[2])):
        out.setdefault(row[0], []).append(row)
    return out


def test_running_sums_and_rows_before_across_pieces(spark):
    rows = log(300)
    df = spark.createDataFrame(rows, ROW)
    want_sum, want_before, want_changes = {}, {}, set()
    for unit in by_unit(rows).values():
        total, before = 0.0, None
        for row in unit:
            total += row[4] or 0.0
            want_sum[row[2]] = total
            want_before[row[2]] = before
            if before is None or before != (row[3],):
                want_changes.add(row[2])
            before = (row[3],)
    for pieces in (1, 2, 7, 64):
        pieced = in_pieces(df, "unit", ["at", "event"], pieces)
        got = {r.event: r.s for r in running(pieced, "unit", ["at", "event"], {"s": F.col("value")}).collect()}
        assert got == want_sum
        before = {r.event: None if r["__before"] is None else tuple(r["__before"]) for r in with_previous(pieced, "unit", ["at", "event"], ["state"]).collect()}
        assert before == want_before
    assert {r.event for r in changes(df, "unit", ["at", "event"], ["state"]).collect()} == want_changes
    assert changes(df.where("false"), "unit", ["at", "event"], ["state"]).count() == 0


def test_top_share(spark):
    rows = [("a", v) for v in (1, 2, 2, 3, 9, 9, 9, 9, 10, 11)] + [("b", 5)]
    got = sorted((r.g, r.v) for r in top_share_excluded(spark.createDataFrame(rows, "g string, v int"), "g", "v", 0.3).collect())
    assert got == [("a", 1), ("a", 2), ("a", 2), ("a", 3)]
