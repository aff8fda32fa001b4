"""Matching entities across sources without keys, by loopy belief propagation.

Rows of a source that mean one institution form a class. A class and a register record
of the same town with near names and compatible kinds are a candidate, with log odds
from what they agree and disagree on; the weights are fitted to the candidates
themselves. Two kinds of hard one-to-one factors tie the candidates together: a class
has at most one record, and a record belongs to one institution. Messages pass between
them until they settle; the marginals are the confidences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.linkage import Field, fit
from wardline.llm.places import agreements, folded, name_agreements
from wardline.llm.variants import candidate_links, compared, headed, linked_classes
from wardline.session import cut, release

#: Confidence from which a pair counts as a match.
FOUND_CONFIDENCE = 0.5
#: Rounds by which messages must have settled; it takes about as many as the longest chain of competing candidates.
ROUNDS = 300
SETTLED = 1e-4
#: Share of the old message that is kept from a round on, against oscillation.
DAMPING = ((0, 0.0), (8, 0.5), (60, 0.8))

#: Fields of a candidate, and how often their levels occur among matches and others before anything is fitted.
FIELDS = (
    Field("name", (0.75, 0.1, 0.08, 0.05, 0.02), (0.02, 0.05, 0.13, 0.4, 0.4)),
    Field("kind", (0.8, 0.15, 0.05), (0.6, 0.25, 0.15)),
    Field("phone", (0.1, 0.9), (0.995, 0.005)),
    Field("road", (0.1, 0.9), (0.995, 0.005)),
    Field("lot", (0.1, 0.9), (0.995, 0.005)),
    Field("postal", (0.2, 0.8), (0.98, 0.02)),
    Field("near", (0.9, 0.05, 0.03, 0.02), (0.01, 0.01, 0.08, 0.9)),
    Field("beds", (0.1, 0.1, 0.8), (0.9, 0.05, 0.05)),
)
#: Fields that tell of the place and size; on balance against a record, they make a class its rival.
PLACE = ("phone", "road", "lot", "postal", "near", "beds")


def levels() -> dict[str, Column]:
    """Levels of the fields of a candidate ``a, b, edits, kind_a, kind_b``."""
    x, y = F.col("a.size"), F.col("b.size")
    off = F.abs(x - y)
    beds = F.when((x > 0) & (y > 0), F.when(off <= F.greatest(F.lit(4.0), y * 0.04), 2).when(off <= y * 0.12, 1).otherwise(0))
    return name_agreements() | {"beds": beds} | {k: v for k, v in agreements("a", "b").items() if k in PLACE}


def _lone(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges that share no end with another, the others)."""
    ends = lambda side: edges.groupBy(side).agg(F.count("*").alias(f"{side}_n"))
    counted = cut(edges.join(ends("left"), "left").join(ends("right"), "right").withColumn("lone", (F.col("left_n") == 1) & (F.col("right_n") == 1)).drop("left_n", "right_n"))
    return counted.where("lone").drop("lone"), counted.where("not lone").drop("lone")


def beliefs(candidates: DataFrame, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """``left, right, confidence`` of the candidates ``left, right, log_odds, rival`` (distinct pairs).

    Sum-product messages in odds. The factor of a left node lets at most one of its
    candidates be true. That of a right node lets it belong to one institution: either
    to any of the candidates that nothing speaks against (rows of one institution that
    were not joined beforehand), or to a single ``rival``. Both factors need only sums
    over the other candidates, so that a round is two grouped sums joined back. Lone
    candidates keep their own odds; rounds go over the competing ones until no marginal
    moves by ``settled`` or more, and that more than ``rounds`` would be needed is an error.
    """
    odds = F.exp(F.least(F.greatest("log_odds", F.lit(-30.0)), F.lit(30.0)))
    lone, edges = _lone(candidates.select("left", "right", "rival", odds.alias("odds"), F.lit(1.0).alias("from_left"), F.lit(1.0).alias("from_right"), F.lit(-1.0).alias("marginal")))
    for n in range(rounds):
        out = edges.withColumn("arriving", F.col("odds") * F.col("from_right"))
        sums = out.groupBy("left").agg(F.sum("arriving").alias("left_sum"))
        out = out.join(sums, "left").withColumn("from_left", 1 / (1 + F.greatest(F.col("left_sum") - F.col("arriving"), F.lit(0.0)))).withColumn("leaving", F.col("odds") * F.col("from_left"))
        friend = F.when(F.col("rival"), 0.0).otherwise(F.log1p("leaving"))
        foe = F.when(F.col("rival"), F.col("leaving")).otherwise(0.0)
        ends = out.groupBy("right").agg(F.sum(friend).alias("friends"), F.sum(foe).alias("foes"))
        others = F.exp(F.greatest(F.col("friends") - friend, F.lit(0.0)))  # all states of the other friends
        rivals = F.greatest(F.col("foes") - foe, F.lit(0.0))
        fresh = F.when(F.col("rival"), 1 / (others + rivals)).otherwise(1 / (1 + rivals / others))
        kept = max(share for since, share in DAMPING if n >= since)
        told = out.join(ends, "right").withColumn("from_right", (1 - kept) * fresh + kept * F.col("from_right"))
        belief = F.col("odds") * F.col("from_left") * F.col("from_right")
        now = cut(told.withColumn("before", F.col("marginal")).withColumn("marginal", belief / (1 + belief)).select("left", "right", "rival", "odds", "from_left", "from_right", "marginal", F.abs(F.col("marginal") - F.col("before")).alias("change")))
        if n:
            release(edges)
        edges = now
        change = edges.agg(F.max("change")).first()[0]
        if change is None or change < settled:
            break
    else:
        raise RuntimeError(f"beliefs still move by {change} after {rounds} rounds")
    alone = lone.select("left", "right", (F.col("odds") / (1 + F.col("odds"))).alias("confidence"))
    return alone.unionByName(edges.select("left", "right", F.col("marginal").alias("confidence")))


def scored(rows: DataFrame, register: DataFrame, fields: Sequence[str] = tuple(f.name for f in FIELDS)) -> tuple[DataFrame, DataFrame]:
    """(``key, class_id`` of all rows, candidates ``left, right, log_odds, rival`` of the classes), judged by ``fields``."""
    sized = lambda folded_rows, raw: folded_rows.join(raw.groupBy("key").agg(F.max("size").cast("double").alias("size")), "key")
    left, right = (cut(headed(cut(sized(folded(raw), raw)))) for raw in (rows, register))
    classes = linked_classes(left.drop("size", "head"))
    of_class = cut(left.select("key", "head").join(classes, "key", "left").withColumn("class_id", F.coalesce("class_id", "key")))
    # rows equal in all but their key are compared once, for all of them
    one, record = (side.join(side.groupBy("head").agg(F.count("*").alias("n")).withColumnRenamed("head", "key"), "key").drop("head") for side in (left, right))
    links = compared(candidate_links(one, record), one, record, levels())
    pairs = cut(links.select("key_a", "key_b", (F.col("a.n") * F.col("b.n")).alias("n"), *fields))
    weights = fit(pairs, [f for f in FIELDS if f.name in fields])
    pairs = pairs.withColumn("log_odds", weights.log_odds()).withColumn("rival", weights.of([c for c in PLACE if c in fields]) < 0)
    best = F.max(F.struct("log_odds", (~F.col("rival")).alias("friend")))
    of_head = of_class.select(F.col("head").alias("key_a"), F.col("class_id").alias("left")).distinct()
    likeliest = pairs.join(of_head, "key_a").groupBy("left", "key_b").agg(best.alias("m"))
    pooled = likeliest.join(right.select(F.col("head").alias("key_b"), F.col("key").alias("right")), "key_b").select("left", "right", "m.log_odds", (~F.col("m.friend")).alias("rival"))
    return of_class.select("key", "class_id"), pooled


def match(rows: DataFrame, register: DataFrame) -> DataFrame:
    """``key, record, confidence``: each row's likeliest record of the register, if any is a candidate.

    Both sides as in ``folded`` with ``size`` (beds in all) beside. Rows linked as
    variants of each other share evidence and result. Every row has a confidence of its
    own class; compare it with FOUND_CONFIDENCE. Rows without a readable name match
    nothing. Equal confidences prefer the smaller record.
    """
    of_class, candidates = scored(rows, register)
    best = beliefs(candidates).groupBy("left").agg(F.min(F.struct((-F.col("confidence")).alias("unlikely"), "right")).alias("best"))
    return of_class.join(best, of_class.class_id == best.left).select("key", F.col("best.right").alias("record"), (-F.col("best.unlikely")).alias("confidence"))
