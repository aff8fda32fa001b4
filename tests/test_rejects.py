import csv
import io
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.operators.rejects import DEMAND_FIELDS, Field, _parse, _strict, _typed, _value, parse_records, split_record

GOOD = '6102000073,"한울도 ""솔뫼시"", 동",61020,"9,460",3349,33.06,130.35,x,y,,ok,ok'


def run(records, fields=DEMAND_FIELDS):
    return _parse(pa.array(records, pa.string()), fields)[1].to_pylist()


def test_reasons():
    swap = lambda a, b: GOOD.replace(a, b)
    cases = {
        GOOD: None,
        swap("33.06", ""): None,
        swap("33.06", "33."): "invalid_value",
        swap("33.06", ".5"): "invalid_value",
        swap("33.06", "-.5"): "invalid_value",
        swap("33.06", "+33.5"): "invalid_value",
        swap("33.06", "\u00a033.06"): "invalid_value",
        swap("33.06", " 33.06\t"): None,
        swap('"9,460"', '"1,2345"'): "invalid_value",
        swap('"9,460"', '"1,234,567"'): None,
        swap('"9,460"', '""'): "invalid_value",
        swap("33.06", "-33.06"): "invalid_value",
        swap("33.06", "43.0001"): "invalid_value",
        swap("33.06", "3.3e1"): "invalid_value",
        swap("33.06", "43"): None,
        swap("3349", " 3349\t"): None,
        swap("3349", ""): "invalid_value",
        swap("3349", "10000000"): "invalid_value",
        swap("3349", "0009999999"): None,
        swap("3349", "1,234"): "column_count",
        swap('"9,460"', '"94,60"'): "invalid_value",
        swap("61020,", "６1020,"): "invalid_value",
        swap("y,,ok", 'y,"",ok'): None,
        swap("y,,ok", 'y, "",ok'): "quoting",
        swap("x,y", 'x"x,y'): "quoting",
        swap("x,y", '"x"x,y'): "quoting",
        swap("x,y", '"x,y'): "quoting",
        swap("x,y", "x,y,z"): "column_count",
        swap("x,y", "x\ny,y"): None,
        "": "column_count",
        None: "column_count",
        GOOD + "\n" + GOOD: "column_count",
    }
    assert {k: run([k])[0] for k in cases} == cases
    many = list(cases) * 40
    random.Random(1).shuffle(many)
    assert run(many) == [cases[k] for k in many]


def test_single_values():
    field = (Field("population", "count"),)
    assert run(["12", " 1,234", None, "", "1.5", "９", "12,34"] * 3, field) == [None, None, *["invalid_value"] * 5] * 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text('a,"\n é', max_size=5), min_size=1, max_size=6))
def test_split_undoes_quoting(fields):
    text = io.StringIO()
    csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    assert split_record(text.getvalue()) == fields


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text('a,"\n\r1', max_size=8), max_size=40))
def test_blocks_equal_single_records(records):
    two = (Field("a"), Field("b", "count"))
    assert run(records, two) == [r for x in records for r in run([x], two)]


@settings(max_examples=300, deadline=None)
@given(st.text('0129 \t,.-+e３', max_size=12), st.sampled_from([DEMAND_FIELDS[0], DEMAND_FIELDS[3], DEMAND_FIELDS[5], Field("x")]))
def test_strict_and_columnar_rules_agree(text, field):
    column, good = _typed(pa.array([text], pa.string()), field)
    assert _value(text, field)[1] == good[0] and (not good[0] or _value(text, field)[0] == column[0].as_py())


def test_only_bad_records_are_read_strictly():
    records, calls = [GOOD] * 3000, []
    for i in range(0, 3000, 13):
        records[i] = (GOOD.replace("33.06", "37."), GOOD + ",", GOOD.replace("x", 'x"'), None)[i % 4]
    _, reasons = _parse(pa.array(records, pa.string()), DEMAND_FIELDS, lambda r, f: calls.append(r) or _strict(r, f))
    assert len(calls) == sum(r is not None for r in reasons.to_pylist()) == len(range(0, 3000, 13))


def test_table_is_kept_whole(spark):
    rows = [(1, "﻿" + GOOD + "\r"), (1, "﻿" + GOOD + "\r"), (2, "bad"), (3, None), (4, "x" * 300_000)]
    df = spark.createDataFrame(rows, "line_id long, c0 string").withColumn("Reject_Reason", F.lit("old")).withColumn("p_population", F.lit("old"))
    got = parse_records(df, "c0", DEMAND_FIELDS).orderBy("line_id").collect()
    assert [(r.line_id, r.p_population, r.reject_reason) for r in got] == [(1, 9460, None), (1, 9460, None), (2, None, "column_count"), (3, None, "column_count"), (4, None, "column_count")]
    assert got[0].p_administrative_name == '한울도 "솔뫼시", 동' and got[0].p_kakao_place_id == "" and got[0].p_latitude == 33.06
    assert parse_records(df.where("false"), "c0", DEMAND_FIELDS).count() == 0
