"""Variant spellings of names: rows that mean the same institution, linked.

Rows of a town that share a token of place are a shard. A trie join enumerates, shard by
shard, the spellings within a few letters of each other, also after putting their
syllables in one order. Rows under such spellings are compared field by field, with
weights fitted to the candidates; likely pairs are linked and the links closed into classes.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.components import components
from wardline.llm.linkage import Field, fit
from wardline.llm.names import _HANGUL, compatible, romanized, spelled
from wardline.llm.places import COMPARED, agreements, folded, name_agreements, place_tokens
from wardline.llm.trie import Form, near_rows
from wardline.operators.skew import split_join
from wardline.session import cut

#: Probability from which two rows are linked.
LINKED = 0.9
#: Fields of a link, and how often their levels occur among rows of one institution and others that share a place and nearly a name, before anything is fitted.
FIELDS = (
    Field("name", (0.6, 0.15, 0.1, 0.1, 0.05), (0.05, 0.05, 0.1, 0.4, 0.4)),
    Field("kind", (0.8, 0.15, 0.05), (0.5, 0.3, 0.2)),
    Field("phone", (0.1, 0.9), (0.99, 0.01)),
    Field("road", (0.1, 0.9), (0.9, 0.1)),
    Field("lot", (0.1, 0.9), (0.9, 0.1)),
    Field("postal", (0.2, 0.8), (0.8, 0.2)),
    Field("near", (0.9, 0.06, 0.03, 0.01), (0.1, 0.1, 0.1, 0.7)),
    Field("emergency", (0.1, 0.9), (0.8, 0.2)),
    Field("wards", (0.15, 0.85), (0.9, 0.1)),
)
#: Keys of one name that are handled as one row when a class is written out in pairs.
CHUNK = 500
#: Rows of a town beyond which its names are cut into pieces; one task compares 20,000 words with as many in some 20 s.
TOWN = 40_000


@lru_cache(100_000)
def spellings(core: str) -> tuple[Form, ...]:
    """Strings of a core for the trie of a town, with the edits allowed.

    By letters (a syllable more or less is up to three edits), by letters of the sorted
    syllables (parts in another order), by transcription, and by the sorted letters of
    that, which count an edit more. Transcriptions are asked for only where the core is
    in Latin letters. Short ones allow fewer edits.
    """
    latin = not _HANGUL.search(core)
    roman = core if latin else romanized(core)
    out = [
        Form("r", roman, 3 if len(roman) >= 8 else 2, 3, latin),
        Form("t", "".join(sorted(roman)), 1 if len(roman) >= 8 else 0, 1, latin, 1),
    ]
    if not latin:
        letters, turned = spelled(core), spelled("".join(sorted(core)))
        out += [Form("h", letters, 3 if len(letters) >= 7 else 2, 3), Form("s", turned, 2 if len(letters) >= 7 else 1, 2)]
    return tuple(out)


@lru_cache(100_000)
def wide_spellings(core: str) -> tuple[Form, ...]:
    """Strings of a core for the trie of one place, where rows agree in more than the name.

    A lost syllable and a wrong letter beside it are allowed, and of cores of up to
    three syllables every order of them is asked for, wrong letters or not.
    """
    latin = not _HANGUL.search(core)
    roman = core if latin else romanized(core)
    out = [
        Form("r", roman, 4 if len(roman) >= 8 else 3 if len(roman) >= 6 else 2, 4, latin),
        Form("t", "".join(sorted(roman)), 1 if len(roman) >= 8 else 0, 1, latin, 1),
    ]
    if not latin:
        letters, turned = spelled(core), spelled("".join(sorted(core)))
        out += [Form("h", letters, 4 if len(letters) >= 8 else 3 if len(letters) >= 6 else 2, 4), Form("s", turned, 3 if len(letters) >= 7 else 1, 3)]
        if len(core) <= 3:
            orders = {"".join(p) for p in permutations(core)} - {core}
            out += [Form("p", letters, 2, 2, False), *(Form("p", spelled(p), 2 if len(letters) >= 7 else 1, 2) for p in sorted(orders))]
    return tuple(out)


def same_kind(a: Column, b: Column) -> Column:
    """Kinds that can be the same house: equal, one unknown, or an orthopedic one not told fully."""
    part = (F.least(a, b) == "orthopedic") & F.greatest(a, b).startswith("orthopedic")
    return (a == b) | (a == "") | (b == "") | part


def headed(rows: DataFrame) -> DataFrame:
    """Rows with the ``head`` that stands for all rows equal in all but their key: the smallest key of them."""
    same = rows.withColumn("same", F.md5(F.to_json(F.struct(*[c for c in rows.columns if c != "key"])).cast("binary")))
    return split_join(same, same.groupBy("same").agg(F.min("key").alias("head")), ["same"]).drop("same")


def candidate_links(left: DataFrame, right: DataFrame | None = None, town: int = TOWN) -> DataFrame:
    """``key_a, key_b, edits, kind_a, kind_b``: rows of near names and compatible kinds, within ``left`` those that share a place token.

    Within ``left`` one stands for all rows equal in all but their key; it is linked to
    each of the others, so that a crowd of equal rows gives as many links as rows. Rows
    that differ in any evidence are all compared. With ``right`` the links go from rows
    of ``left`` to all rows of ``right`` in their town whose names are near, however many
    bear them, and to those that share a place token under names a little farther off.
    """
    def named(rows: DataFrame, shard: Column, *more: Column) -> DataFrame:
        return rows.where(F.col("block").isNotNull()).select("key", "block", F.explode("readings").alias("reading"), *more).select(shard.alias("shard"), "key", F.col("reading.core").alias("word"), F.col("reading.kind").alias("kind"))

    def at_places(rows: DataFrame) -> DataFrame:
        tokens = rows.withColumn("tokens", F.array_distinct(place_tokens())).select("key", "block", "readings", F.explode("tokens").alias("token"))
        return named(tokens, F.concat_ws("\x1e", "block", "token"), F.col("token"))

    if right is None:
        equal = cut(headed(left.where(F.size("readings") > 0)))
        heads = equal.where(F.col("key") == F.col("head"))
        met = near_rows(at_places(heads), None, wide_spellings, compatible, same_kind)
        kind = F.array_max(F.col("readings.kind"))
        met = met.unionByName(equal.where(F.col("key") != F.col("head")).select(F.col("head").alias("key_a"), F.col("key").alias("key_b"), F.lit(0).alias("edits"), kind.alias("kind_a"), kind.alias("kind_b")))
    else:
        whole = F.col("block").cast("string")
        met = near_rows(named(left, whole), named(right, whole), spellings, compatible, same_kind, town)
        met = met.unionByName(near_rows(at_places(left), at_places(right), wide_spellings, compatible, same_kind))
    best = F.min(F.struct("edits", (F.col("kind_a") != F.col("kind_b")).alias("differ"), "kind_a", "kind_b"))
    return met.groupBy("key_a", "key_b").agg(best.alias("name")).select("key_a", "key_b", "name.edits", "name.kind_a", "name.kind_b")


def compared(links: DataFrame, left: DataFrame, right: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """Links with the columns ``levels``, made of the rows' ``COMPARED`` columns as ``a`` and ``b``; these are joined once, and narrow."""
    keyed = lambda rows, side: rows.select(F.col("key").alias(f"key_{side}"), F.struct(*[c for c in COMPARED if c in rows.columns]).alias(side))
    return cut(links).join(keyed(left, "a"), "key_a").join(keyed(right, "b"), "key_b").withColumns(levels)


def variant_classes(rows: DataFrame, linked: float = LINKED) -> DataFrame:
    """``key, class_id`` of every row that is linked to another; see ``folded`` for the columns of ``rows``."""
    return linked_classes(cut(folded(rows)), linked)


def linked_classes(plain: DataFrame, linked: float = LINKED) -> DataFrame:
    """``key, class_id`` of every folded row that is linked to another.

    Weights are fitted to all candidates; those of a probability of ``linked`` or more
    are links. Rows of different ``block`` are never linked (the block is a fact, not a
    guess). A row without a readable name, or with nothing about its place, is in no class.
    A row whose kind is unknown joins houses of one kind only, those it agrees with most.
    """
    names = [f.name for f in FIELDS]
    pairs = cut(compared(candidate_links(plain), plain, plain, name_agreements() | agreements("a", "b")).select("key_a", "key_b", "kind_a", "kind_b", *names))
    weights = fit(pairs, FIELDS, matching=0.5)
    links = cut(pairs.withColumn("points", weights.log_odds()).where(F.col("points") >= math.log(linked / (1 - linked))).select("key_a", "key_b", "kind_a", "kind_b", "points"))
    unsure = links.where((F.col("kind_a") == "") != (F.col("kind_b") == ""))
    turned = unsure.select(F.when(F.col("kind_a") == "", F.col("key_a")).otherwise(F.col("key_b")).alias("key"), F.greatest("kind_a", "kind_b").alias("kind"), "points")
    chosen = turned.groupBy("key", "kind").agg(F.max("points").alias("points")).groupBy("key").agg(F.max_by("kind", F.struct("points", "kind")).alias("chosen"))
    mixed = unsure.withColumn("key", F.when(F.col("kind_a") == "", F.col("key_a")).otherwise(F.col("key_b"))).join(chosen, "key").where(F.greatest("kind_a", "kind_b") == F.col("chosen"))
    sure = links.where((F.col("kind_a") == "") == (F.col("kind_b") == ""))
    kept = sure.select("key_a", "key_b").unionByName(mixed.select("key_a", "key_b"))
    return components(kept.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))).withColumnRenamed("node", "key")


def variant_pairs(classes: DataFrame, names: DataFrame) -> DataFrame:
    """``node_a, node_b``, smaller first: rows of one class whose names differ in any byte.

    ``names``: ``key, name``. Rows of one name meet the other names of their class, not
    each other. A null name differs from every other and from no null.
    """
    rows = classes.join(names.dropDuplicates(["key"]), "key").select("class_id", "key", F.coalesce("name", F.lit("\0")).alias("name"))
    sizes = rows.groupBy("class_id", "name").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunked = rows.join(sizes, ["class_id", "name"]).withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks"))
    spelling = chunked.groupBy("class_id", "name", "chunk").agg(F.collect_set("key").alias("keys"))
    a = spelling.select("class_id", F.col("name").alias("name_a"), F.col("keys").alias("keys_a"))
    b = spelling.select("class_id", F.col("name").alias("name_b"), F.col("keys").alias("keys_b"))
    met = a.join(b, "class_id").where(F.col("name_a") < F.col("name_b"))
    pairs = met.select(F.explode("keys_a").alias("x"), "keys_b").select("x", F.explode("keys_b").alias("y"))
    return pairs.select(F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b"))
