"""Column functions on labels and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_text(*columns: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def address_key(address: Column) -> Column:
    """An address up to spacing, case, the province and what follows a bracket or comma."""
    cut = F.regexp_replace(address, r"[(,].*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(cut, r"\s+", ""), r"^한울도?", ""))


def base_place(label: Column) -> Column:
    """A label up to its first bracket; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(label, r"\s*\(.*$", "")), F.lit(""))


def town_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"[시군구]$", "")


def truthy(text: Column) -> Column:
    """CSV flags: true in any case; everything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(text)) == "true", F.lit(False))
