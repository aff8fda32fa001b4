"""Mixing sources to target weights, measured in tokens.

Each source gets a budget of tokens; its documents are put in a hash-random order,
running token sums are taken over that order in pieces, and the source is cut exactly
where its budget ends, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import cut

#: Documents per piece of a source's order: no window holds many more.
PIECE_ROWS = 20_000
#: Rows of plan and source that are sent to every task; beyond it their join is salted.
BROADCAST_ROWS = 50_000
SALTS = 32


def budgets(totals: DataFrame, targets: DataFrame, corpus_tokens: DataFrame, shortfall: str = "refill") -> DataFrame:
    """Token budget of each plan and source.

    A plan's size is ``size_ratio`` times the tokens of all documents. Sources get it
    in proportion to their weights, but none more than ``max_repeats`` times its own
    tokens; what a capped or absent source cannot take goes to the plan's others in
    proportion to theirs, as far as these can take it; with ``shortfall="leave"`` it
    stays out and the mix is smaller. Sources in order of cap / weight are capped up to
    the first that can take its proportion of what is left. Repeated target rows of a source add their weights and keep the smallest cap;
    null or negative weights, ratios and caps count as 0.
    """
    positive = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    wanted = (
        targets.where(F.col("plan_id").isNotNull() & F.col("source").isNotNull())
        .groupBy("plan_id", "source")
        .agg(F.max(positive("size_ratio")).alias("size_ratio"), F.sum(positive("target_weight").cast("double")).alias("weight"), F.min(positive("max_repeats")).cast("long").alias("max_repeats"))
    )
    plan = Window.partitionBy("plan_id")
    rows = wanted.join(totals, "source", "left").join(F.broadcast(corpus_tokens)).na.fill({"source_tokens": 0, "source_docs": 0})  # corpus_tokens is one row
    rows = rows.withColumn("size", F.max("size_ratio").over(plan) * F.col("corpus_tokens")).withColumn("cap", F.col("source_tokens") * F.col("max_repeats"))
    rows = rows.withColumn("target_share", F.try_divide("weight", F.sum("weight").over(plan)))
    level = Window.partitionBy("plan_id").orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(0.0)), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    used = F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0))
    rows = rows.withColumn("left_size", F.col("size") - F.coalesce(F.sum(used).over(before), F.lit(0))).withColumn("per_weight", F.try_divide(F.col("left_size"), F.sum("weight").over(after)))
    fits = (F.col("weight") > 0) & (F.col("per_weight") * F.col("weight") <= F.col("cap"))
    rows = rows.withColumn("open_level", F.max(F.when(fits, F.col("per_weight"))).over(plan))
    if shortfall == "leave":
        rows = rows.withColumn("open_level", F.try_divide("size", F.sum("weight").over(plan)))
    elif shortfall != "refill":
        raise ValueError(f"shortfall is refill or leave, not {shortfall!r}")
    # capped sources come first; from the first open one on, the level is the same
    budget = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("open_level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("open_level") * F.col("weight")))
    return rows.withColumn("budget", F.greatest(budget, F.lit(0.0))).select("plan_id", "source", "size", "target_share", "max_repeats", "source_tokens", "source_docs", "cap", "budget")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17, shortfall: str = "refill") -> tuple[DataFrame, DataFrame]:
    """``(documents, report)`` of every plan.

    ``docs``: ``doc_id, source, tokens``. The documents come as ``plan_id, source,
    doc_id, tokens, copies`` (1 to max_repeats). Repeated doc_ids count once; documents
    without source or without tokens enter no mix but the tokens of all count for the
    size. A source is cut at the document nearest to its budget, so it misses the budget
    by half a document at most. The report has a row per plan and source, sources that
    are absent or got nothing too.
    """
    docs = cut(docs.groupBy("doc_id").agg(F.first("source").alias("source"), F.max(F.coalesce("tokens", F.lit(0))).alias("tokens")))
    corpus = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("corpus_tokens"))
    live = docs.where(F.col("source").isNotNull() & (F.col("tokens") > 0))
    totals = live.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    plans = cut(budgets(totals, targets, corpus, shortfall))

    # the hash-random order of a source, in pieces of at most about PIECE_ROWS documents
    place = F.xxhash64("doc_id", F.lit(seed))
    pieces = -(-docs.count() // PIECE_ROWS) or 1
    ordered = live.withColumn("place", place).withColumn("piece", F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * pieces))
    inside = Window.partitionBy("source", "piece").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = ordered.groupBy("source", "piece").agg(F.sum("tokens").alias("piece_tokens"))
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("piece_tokens").over(earlier), F.lit(0))).drop("piece_tokens")
    running = ordered.withColumn("sum_inside", F.sum("tokens").over(inside)).join(starts, ["source", "piece"]).withColumn("upto", F.col("start") + F.col("sum_inside"))

    cuts = plans.where(F.col("budget") > 0).select("plan_id", "source", "budget", "max_repeats", "source_tokens")
    cuts = cuts.withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("source_tokens")), F.col("max_repeats"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_tokens"))
    extra = F.when((F.col("epochs") < F.col("max_repeats")) & (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")), 1).otherwise(0)
    if plans.count() <= BROADCAST_ROWS:
        met = running.join(F.broadcast(cuts), "source")
    else:
        salted = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = running.withColumn("salt", F.pmod("place", F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"])
    chosen = met.withColumn("copies", (F.col("epochs") + extra).cast("int")).where(F.col("copies") > 0).select("plan_id", "source", "doc_id", "tokens", "copies")

    reached = chosen.groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    plan = Window.partitionBy("plan_id")
    report = (
        plans.join(reached, ["plan_id", "source"], "left")
        .na.fill({"reached_tokens": 0, "documents": 0, "most_copies": 0})
        .withColumn("plan_tokens", F.sum("reached_tokens").over(plan))
        .select(
            "plan_id",
            "source",
            "target_share",
            F.try_divide(F.col("reached_tokens").cast("double"), F.col("plan_tokens").cast("double")).alias("reached_share"),
            F.floor(F.col("size") + 0.5).cast("long").alias("plan_target_tokens"),
            "plan_tokens",
            "reached_tokens",
            "source_tokens",
            "documents",
            "max_repeats",
            "most_copies",
            (F.col("budget") >= F.col("cap")).alias("exhausted"),
        )
    )
    return chosen, report
