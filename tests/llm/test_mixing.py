import pytest

mixing = pytest.importorskip("wardline.llm.mixing")

DOC = "doc_id long, source string, tokens long"
TARGET = "plan_id string, size_ratio double, source string, target_weight double, max_repeats int"


def docs(spark):
    rows = [(i, "big", 10) for i in range(600)] + [(1000 + i, "small", 5) for i in range(20)] + [(2000, "big", 0), (2001, None, 300), (2002, "big", None), (0, "big", 10)]
    return spark.createDataFrame(rows, DOC)  # 6,400 tokens


def report(result):
    return {(r.plan_id, r.source): r for r in result[1].collect()}


@pytest.fixture(params=[20_000, 50])
def pieces(request, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_ROWS", request.param)


def test_budgets_caps_and_absent_sources(spark, pieces):
    targets = [("p", 0.5, "big", 3.0, 2), ("p", 0.5, "small", 1.0, 3), ("p", 0.5, "none", 1.0, 9), ("q", 3.0, "big", 1.0, 1), ("r", 0.1, "small", 0.0, 5), (None, 1.0, "big", 1.0, 1)]
    result = mixing.mix(docs(spark), spark.createDataFrame(targets, TARGET))
    r = report(result)
    assert r["p", "small"].reached_tokens == 300 and r["p", "small"].exhausted and r["p", "small"].most_copies == 3
    assert abs(r["p", "big"].reached_tokens - (3200 - 300)) <= 5 and r["p", "none"].reached_tokens == 0
    assert r["q", "big"].reached_tokens == 6000 and r["q", "big"].most_copies == 1
    assert r["r", "small"].reached_tokens == 0 and set(r) == {("p", "big"), ("p", "small"), ("p", "none"), ("q", "big"), ("r", "small")}
    chosen = result[0].collect()
    assert all(x.copies <= {"p": {"big": 2, "small": 3}, "q": {"big": 1}}[x.plan_id][x.source] for x in chosen)
    assert len({(x.plan_id, x.doc_id) for x in chosen}) == len(chosen)
    left = report(mixing.mix(docs(spark), spark.createDataFrame(targets, TARGET), shortfall="leave"))
    assert abs(left["p", "big"].reached_tokens - 3200 * 3 / 5) <= 5 and left["p", "small"].reached_tokens == 300


def test_partial_epochs_and_salted_join(spark, pieces, monkeypatch):
    targets = spark.createDataFrame([("p", 250 / 6400, "small", 1.0, 9)], TARGET)
    one = report(mixing.mix(docs(spark), targets))["p", "small"]
    assert abs(one.reached_tokens - 250) <= 2.5 and one.most_copies == 3
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    assert report(mixing.mix(docs(spark), targets))["p", "small"].reached_tokens == one.reached_tokens


def test_empty_tables(spark):
    targets = spark.createDataFrame([("p", 0.5, "big", 1.0, 2)], TARGET)
    chosen, shares = mixing.mix(docs(spark).where("false"), targets)
    assert chosen.count() == 0 and shares.first().reached_tokens == 0
    chosen, shares = mixing.mix(docs(spark), targets.where("false"))
    assert chosen.count() == 0 and shares.count() == 0
