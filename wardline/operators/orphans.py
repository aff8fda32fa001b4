"""References to records that do not exist, are not yet known, or are already deleted.

Any key text splits exactly into a stem, the width of its trailing digits and their
number, so keys become integers without losing a byte. Within a stem the sorted
parent numbers compress into contiguous runs; a reference is matched as-of to the
preceding run start and is an orphan if it lies beyond the run's end. A run carries
the life spans of its keys as arrays addressed by ``number - start``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import cut

#: Numbers per bucket: runs are cut at bucket borders so that no window holds more distinct keys than this.
BUCKET = 4096
#: Flagged keys up to this many bytes are sent to every task; beyond it the join is salted.
BROADCAST_BYTES = 16 << 20
SALTS = 32


def _coded(df: DataFrame, key: str) -> DataFrame:
    """Adds ``stem, width, number, bucket`` of ``key``; at most 18 trailing digits go into the number."""
    digits = F.regexp_extract(F.col(key), r"([0-9]{0,18})$", 1)
    return (
        df.withColumn("width", F.length(digits))
        .withColumn("stem", F.expr(f"substring(`{key}`, 1, char_length(`{key}`) - width)"))
        .withColumn("number", F.when(F.col("width") > 0, digits.cast("long")).otherwise(F.lit(0).cast("long")))
        .withColumn("bucket", F.floor(F.col("number") / BUCKET))
    )


def key_runs(parents: DataFrame) -> DataFrame:
    """Contiguous runs of parent keys.

    ``parents``: ``id, staged, retired`` (microseconds; null staged: known since ever,
    null retired: still valid). Repeated ids join their spans: the earliest staged, the
    latest retired. Gives ``stem, width, bucket, start, end, staged[], retired[]``.
    """
    never = F.lit(9223372036854775807)
    since_ever = F.lit(-9223372036854775807)
    known = parents.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.coalesce("staged", since_ever)).alias("staged"), F.max(F.coalesce("retired", never)).alias("retired"))
    place = Window.partitionBy("stem", "width", "bucket").orderBy("number")
    breaks = F.when(F.col("number") - F.lag("number").over(place) == 1, 0).otherwise(1)
    numbered = _coded(known, "id").withColumn("breaks", breaks).withColumn("run", F.sum("breaks").over(place))
    spans = F.array_sort(F.collect_list(F.struct("number", "staged", "retired")))
    return (
        numbered.groupBy("stem", "width", "bucket", "run")
        .agg(F.min("number").alias("start"), F.max("number").alias("end"), spans.alias("spans"))
        .select("stem", "width", "bucket", "start", "end", F.col("spans.staged").alias("staged"), F.col("spans.retired").alias("retired"))
    )


def match_runs(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """As-of match of distinct ids (column ``ref_id``, others kept) to the preceding run start.

    Adds ``missing, staged, retired``. One shuffle on the bucket: runs and ids are
    unioned and the last run start at or before each number is carried forward.
    """
    kept = [c for c in ids.columns if c != "ref_id"]
    events = _coded(ids, "ref_id").withColumn("run", F.lit(None)).unionByName(
        runs.select("stem", "width", "bucket", F.col("start").alias("number"), F.struct("start", "end", "staged", "retired").alias("run")), allowMissingColumns=True
    )
    # a run start sorts before a reference of the same number
    order = Window.partitionBy("stem", "width", "bucket").orderBy("number", F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("at", F.last("run", ignorenulls=True).over(order)).where(F.col("ref_id").isNotNull())
    found = F.col("at").isNotNull() & (F.col("number") <= F.col("at.end"))
    step = (F.col("number") - F.col("at.start") + 1).cast("int")
    return seen.select(
        "ref_id",
        *kept,
        (~found).alias("missing"),
        F.when(found, F.try_element_at("at.staged", step)).alias("staged"),
        F.when(found, F.try_element_at("at.retired", step)).alias("retired"),
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose ``ref_id`` has no parent, or none at their time, with a ``reason``.

    ``refs``: ``ref_id`` and ``ref_at`` (microseconds, may be null) beside any other
    columns, which are kept; one named ``reason`` is replaced. Repeated rows give
    repeated rows. Reasons:
    ``missing`` (no such parent, byte for byte), ``late`` (``ref_at`` before the parent
    was staged), ``deleted`` (at or after it was retired); the first that holds. A null
    ``ref_id`` refers to nothing and gives no row; a null ``ref_at`` can only be
    ``missing``. An empty parent table makes every reference missing.

    The references are first reduced to distinct ids with the span of their times
    (combined before the shuffle, so a hot id is one row), these are matched to the
    runs, and only ids that can offend are joined back.
    """
    refs = refs.where(F.col("ref_id").isNotNull()).drop("reason")
    ids = refs.groupBy("ref_id").agg(F.min("ref_at").alias("first_at"), F.max("ref_at").alias("last_at"))
    offends = F.col("missing") | (F.col("first_at") < F.col("staged")) | (F.col("last_at") >= F.col("retired"))
    span = F.struct("missing", "staged", "retired").alias("__span")
    flagged = cut(match_runs(ids, key_runs(parents)).where(offends).select("ref_id", span))
    size = flagged.agg(F.sum(F.length("ref_id") + 48)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = refs.join(F.broadcast(flagged), "ref_id")
    else:
        salted = flagged.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = refs.withColumn("__salt", F.pmod(F.xxhash64(*refs.columns), F.lit(SALTS)).cast("int")).join(salted, ["ref_id", "__salt"]).drop("__salt")
    reason = F.when(F.col("__span.missing"), "missing").when(F.col("ref_at") < F.col("__span.staged"), "late").when(F.col("ref_at") >= F.col("__span.retired"), "deleted")
    return met.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("__span")
