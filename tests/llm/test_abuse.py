import random

import numpy as np
import pytest
from pyspark.sql import functions as F

abuse = pytest.importorskip("wardline.llm.abuse")


def corpus(seed, n):
    r = random.Random(seed)
    plain = ["Set the limit to {} and sort the index again.", "The road graph keeps a stale copy of the join.", "This damn driver is slow.", "What a stupid mistake of mine, row {}."]
    bad = ["You {a} {b}, get off this site.", "Read it again, you {a} {b}!", "Nobody wants a {a} {b} like you here."]
    rows = []
    for i in range(n):
        parts = [r.choice(plain).format(r.randint(0, 999)) for _ in range(r.randint(1, 8))]
        label = r.random() < 0.3
        if label:
            word = r.choice(["clown", "c l o w n", "cl0wn", "clowwwn", "pig", "p1g", "moron", "m​oron"])
            parts.insert(r.randint(0, len(parts)), r.choice(bad).format(a=r.choice(["useless", "pathetic", "filthy", "u$eless"]), b=word))
        rows.append((i, " ".join(parts), int(label)))
    return rows


def test_folding():
    same = ["you useless clown", "YOU  u$eless  cl0wn", "you useless c l o w n", "you use​less clowwwn", "you usеless clоwn"]
    assert len({abuse.segments(t)[0] for t in same}) == 1
    assert abuse.segments("a1b2. 12 3\nx") and abuse.segments(None) == abuse.segments("") == abuse.segments(" \n") == []
    assert np.array_equal(np.sort(abuse.features(("camera",))[:1]) >= 0, [True])
    assert abuse._key("camear") == abuse._key("camera")


def test_held_out_accuracy(spark):
    train, test = corpus(1, 500), corpus(2, 400)
    r = random.Random(3)
    labels = [(i, who, flag if r.random() > 0.05 else 1 - flag) for i, _, flag in train for who in ("a", "b")[: r.randint(1, 2)]] + [(None, "a", 1), (3, None, None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    model = abuse.train(docs, spark.createDataFrame(labels, "doc_id long, reviewer string, flagged int"))
    found = {x.doc_id for x in abuse.severity(spark.createDataFrame([(i, t) for i, t, _ in test], "doc_id long, text string"), model).where("found").collect()}
    true = {i for i, _, flag in test if flag}
    assert len(found & true) >= 0.95 * len(true) and len(found & true) >= 0.95 * len(found)


def test_rows_and_columns(spark):
    model = abuse.fit([abuse.segments(t) for _, t, _ in corpus(1, 120)], np.array([3 * f for _, _, f in corpus(1, 120)]))
    rows = [(1, None), (2, ""), (3, "You useless clown, get off this site."), (3, "You useless clown, get off this site."), (4, "fine " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Severity", F.lit("old")).withColumn("found", F.lit("old"))
    got = sorted((r.doc_id, round(r.severity, 6), r.found, round(sum(r[f"p_grade_{g}"] for g in range(4)), 6)) for r in abuse.severity(df, model).collect())
    assert [g[0] for g in got] == [1, 2, 3, 3, 4] and {g[3] for g in got} == {1.0}
    assert got[0][1:3] == got[1][1:3] == (0.0, False) and got[2] == got[3] and got[2][1] > got[4][1]
    assert abuse.severity(df.where("false"), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "You clown.")], "doc_id long, text string")
    model = abuse.train(docs, spark.createDataFrame([], "doc_id long, reviewer string, flagged int"))
    assert abuse.severity(docs, model).first().severity < 1e-6


def test_grades(spark):
    rows = [(1, "a", 0), (1, "b", 0), (2, "a", 1), (2, "b", 0), (3, "a", 1), (4, "a", 1), (4, "b", 1), (5, "a", None)]
    got = {r.doc_id: r.grade for r in abuse.graded(spark.createDataFrame(rows, "doc_id long, reviewer string, flagged int")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}
