from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardline import session
from wardline.operators.skew import split_join


class Context:
    master = "spark://head:7077"

    def getCheckpointDir(self):
        return None


class Session:
    sparkContext = Context()
    conf = {}


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://head:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        Context.master = master
        with pytest.raises(RuntimeError):
            session.ensure_checkpoint_dir(Session())


def test_release_deletes_what_cut_wrote(spark):
    session.ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    df = session.cut(spark.range(10))
    (written,) = set(folder.iterdir()) - before
    assert df.count() == 10
    session.release(df)
    assert not written.exists()
    session.release(spark.range(3))  # nothing was written for it


def test_split_join_meets_every_pair_once(spark):
    a = spark.range(300).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.col("id").alias("x"))
    b = spark.range(200).select((F.col("id") % 5).alias("k"), F.col("id").alias("y"))
    nulls = spark.createDataFrame([(None, -1)], "k long, x long")
    want = {(r.x, r.y) for r in a.join(b, "k").collect()}
    for crowd in (7, 60, 1000):
        got = [(r.x, r.y) for r in split_join(a.unionByName(nulls), b, ["k"], crowd).collect()]
        assert len(got) == len(want) and set(got) == want
    assert split_join(a, b.where("false"), ["k"], 7).count() == 0
