"""python tests/llm/ablation.py DIR: what the messages of belief propagation change, with all evidence and with little.

The reference is the match by all evidence; with little evidence (names, kinds and
beds, as in lists without addresses) odds alone and beliefs are judged by it.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from compare import spark_session  # noqa: E402
from wardline.llm import matching, queries  # noqa: E402
from wardline.session import cut, ship_package  # noqa: E402


def best(scored: DataFrame, by: str) -> DataFrame:
    top = scored.groupBy("left").agg(F.max(F.struct(by, "right")).alias("m")).where(F.col(f"m.{by}") >= 0.5)
    return top.select("left", F.col("m.right").alias("right"))


def compare(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    candidates = cut(candidates)
    alone = best(candidates.withColumn("p", 1 / (1 + F.exp(-F.col("log_odds")))), "p")
    return cut(alone), cut(best(matching.beliefs(candidates), "confidence"))


def main(folder: str) -> None:
    spark = spark_session()
    ship_package(spark)
    rows, register = queries.source_rows(spark, folder), queries.register_rows(spark, folder)
    classes, candidates = matching.scored(rows, register)
    several = candidates.groupBy("left").count().where("count > 1").count()
    print("classes", classes.select("class_id").distinct().count(), "candidates", candidates.count(), "classes with several", several)
    odds, truth = compare(candidates)
    print("all evidence: odds alone find", odds.count(), "beliefs", truth.count(), "differ", odds.exceptAll(truth).count() + truth.exceptAll(odds).count())
    for fields in (("name", "kind", "beds"), ("name", "kind", "beds", "postal"), ("name", "kind", "phone")):
        _, little = matching.scored(rows, register, fields)
        for label, got in zip(("odds alone", "beliefs"), compare(little)):
            right = got.join(truth, ["left", "right"], "left_semi").count()
            print(", ".join(fields), label, "found", got.count(), "right", right, "of", truth.count())


if __name__ == "__main__":
    main(sys.argv[1])
