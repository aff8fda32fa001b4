"""The queries on stated matches and common phones, on a small fixture judged by hand."""

from pyspark.sql import types as T

from wardline.plans import staging

H = "node_id string, municipality_code string, hospital_name string, hira_hospital_name string, capacity_match_score double, phone string, road_address string, lot_address string"
R = "care_symbol string, municipality_name string, hira_hospital_name string, address string, phone string"


def write(spark, place, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{place}/{name}.parquet")


def test_stated_and_phone_matches(spark, tmp_path):
    d = str(tmp_path)
    hospitals = [
        ("h1", "1", "나다라 병원", "나다라병원", 0.9, "02-555-1234", "가람시 꽃길 1", None),
        ("h1", "1", "나다라 병원", "나다라병원", 0.9, "02-555-1234", "가람시 꽃길 1", None),
        ("h2", "1", "나다라병원 응급", "의료법인 나다라병원", 0.5, "5551234", None, "가람시 나루동 7"),
        ("h3", "1", "전혀다른의원", "나다라병원", None, "000", "가람시 꽃길 1", None),
        ("h4", "1", None, "나다라병원", None, None, None, None),
        ("h5", "2", "나다라병원", None, None, "02-555-1234", None, None),
    ]
    write(spark, d, "existing_hospitals", hospitals, H)
    write(spark, d, "hira_institutions", [("r1", "가람시", "나다라병원", "가람시 꽃길 1", "555-1234"), ("r2", "가람시", "마바사의원", "가람시 별길 2", "+82-2-555-1234"), ("r3", "솔뫼시", "나다라병원", None, "555-1234")], R)
    write(spark, d, "municipality_summary", [("1", "가람시"), ("2", "솔뫼시")], "municipality_code string, municipality_name string")
    got = {r.node_id: (r.similarity, r.exact, r.review) for r in staging.stated_match_review(spark, d).collect()}
    assert got["h1"] == (1.0, True, False) and got["h2"][0] > 0.7 and got["h2"][1] is False
    assert got["h3"][2] is True and got["h4"][:1] == (0.0,) and "h5" not in got
    best = {r.node_id: (r.care_symbol, r.score) for r in staging.phone_match_scores(spark, d).collect()}
    assert best["h1"] == ("r1", 1.0) and best["h2"][0] == "r1" and best["h5"][0] == "r3" and set(best) == {"h1", "h2", "h5"}
    assert isinstance(staging.phone_match_scores(spark, d).schema["score"].dataType, T.DoubleType)
