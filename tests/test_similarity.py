import math

from pyspark.sql import functions as F

from wardline.functions.similarity import address_similarity, name_similarity, normal_text, normalized, pair_similarity


def test_values(spark):
    assert normal_text(" Ａb-１ 병원") == "ab1병원" and normal_text(None) == ""
    assert pair_similarity("", "a", 4, True) == pair_similarity(None, "a", 4, True) == 0.0
    assert pair_similarity("가나다라", "마가나다라", 4, True) == 1.0 and pair_similarity("나다", "마가나다라", 4, False) < 1.0
    assert math.isclose(pair_similarity("abcd", "abxd", 4, False), 0.75) and pair_similarity("abxyz", "abqrs", 4, True) == 0.4
    df = spark.createDataFrame([("가나다 병원", "가나다병원"), (None, "x"), ("", "")], "a string, b string")
    got = df.select(name_similarity(F.col("a"), F.col("b")).alias("n"), address_similarity(F.col("a"), F.col("b")).alias("d"), normalized(F.col("a")).alias("x")).collect()
    assert [(r.n, r.d, r.x) for r in got] == [(1.0, 1.0, "가나다병원"), (0.0, 0.0, ""), (0.0, 0.0, "")]
