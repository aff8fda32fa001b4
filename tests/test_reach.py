import heapq
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.operators.reach import reach
from wardline.plans import routes
from wardline.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_base_times_are_shortest_over_any_number_of_legs(spark):
    ways = defaultdict(list)
    for e in routes.known_edges(spark, SF).collect():
        ways[e.src].append((e.dst, e.minutes))
    queue = [(0.0, b.node_id) for b in table(spark, SF, "ambulance_bases").select("node_id").where("node_id is not null").distinct().collect()]
    want: dict[str, float] = {}
    heapq.heapify(queue)
    while queue:
        minutes, node = heapq.heappop(queue)
        if node not in want:
            want[node] = minutes
            for to, leg in ways[node]:
                heapq.heappush(queue, (minutes + leg, to))
    got = {r.node: r.minutes for r in routes.QUERIES["base_times"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[n], want[n], abs_tol=1e-4) for n in want)


def test_unfinished_times_are_an_error(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(5)], "src string, dst string, minutes double")
    start = spark.createDataFrame([("n0",)], "node string")
    with pytest.raises(RuntimeError):
        reach(chain, start, rounds=3)
    assert reach(chain, start, legs=3).agg(F.max("minutes")).first()[0] == 3.0 and reach(chain, start).count() == 6
