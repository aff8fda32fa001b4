"""Similarity of names and addresses as vectorized functions.

``normal``: NFKC, lower case, letters and digits only. Ratios are those of matching
blocks (twice their length over both lengths).
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_text(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum()) if isinstance(text, str) else ""


def pair_similarity(a: str | None, b: str | None, contained_from: int, block: bool) -> float:
    """0 if either is empty; 1 if the shorter is at least ``contained_from`` long and inside
    the longer; else the ratio or, with ``block``, the longest common block over the shorter if that is more."""
    x, y = normal_text(a), normal_text(b)
    if not x or not y:
        return 0.0
    short, long = sorted((x, y), key=len)
    if len(short) >= contained_from and short in long:
        return 1.0
    match = SequenceMatcher(None, x, y, autojunk=False)
    share = match.find_longest_match().size / len(short) if block else 0.0
    return max(match.ratio(), share)


def normalized(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(normal_text, na_action=None), "string")(text)


def _similarity(contained_from: int, block: bool):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([pair_similarity(x, y, contained_from, block) for x, y in zip(a, b)], dtype="float64")

    return run


def simple(text: Column) -> Column:
    """Whether a text holds only Hangul syllables and ASCII, which normalizing leaves as they are."""
    return F.coalesce(text.rlike(r"^[가-힣\x20-\x7e]*$"), F.lit(False))


def simple_normal(text: Column) -> Column:
    """``normal`` of a simple text as a column expression."""
    return F.lower(F.regexp_replace(text, "[^가-힣A-Za-z0-9]", ""))


def contained(a: Column, b: Column, least: int) -> Column:
    """Whether one of two simple texts, normalized, of at least ``least`` letters lies within the other; false for other texts."""
    x, y = simple_normal(a), simple_normal(b)
    return F.coalesce(simple(a) & simple(b) & (F.least(F.length(x), F.length(y)) >= least) & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def _similar(a: Column, b: Column, least: int, block: bool) -> Column:
    """What columns can tell is told by columns; only the rest is compared letter by letter."""
    inside = contained(a, b, least)
    left = lambda c: F.when(~inside & a.isNotNull() & b.isNotNull(), c)
    return F.when(inside, 1.0).otherwise(F.pandas_udf(_similarity(least, block), "double")(left(a), left(b)))


def name_similarity(a: Column, b: Column) -> Column:
    """0 to 1; names contained in one another from 4 letters on are equal."""
    return _similar(a, b, 4, True)


def address_similarity(a: Column, b: Column) -> Column:
    """0 to 1; addresses contained in one another from 8 letters on are equal."""
    return _similar(a, b, 8, False)
