"""Declared JSON documents: errors with the path at which they stand."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Declared:
    """A value of a document: ``kind`` is text, number, integer, boolean or array; bounds are included."""

    path: str
    kind: str
    required: bool = False
    least: float | None = None
    most: float | None = None


# Types of JSON values as the variant functions name them.
_KINDS = {"text": r"^STRING$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "boolean": r"^BOOLEAN$", "array": r"^ARRAY.*$"}
_WANTED = {"text": "must be a text", "number": "must be a number", "integer": "must be an integer", "boolean": "must be true or false", "array": "must be an array"}


def path_errors(document: Column, declared: Sequence[Declared]) -> Column:
    """Array of ``struct<path, problem>``, one for each declared value that does not fit.

    Of a value the first problem that holds: ``is required``, a wrong type, a bound. A
    null or broken document lacks everything; a JSON null counts as absent. Values that
    are not declared are let through.
    """
    whole = F.try_parse_json(document)
    problems = []
    for v in declared:
        at = F.try_variant_get(whole, f"$.{v.path}", "variant")
        kind = F.schema_of_variant(at)
        absent = at.isNull() | (kind == "VOID")
        problem = F.when(absent, F.lit("is required") if v.required else F.lit(None)).when(~kind.rlike(_KINDS[v.kind]), _WANTED[v.kind])
        number = F.try_variant_get(whole, f"$.{v.path}", "double")
        if v.least is not None:
            problem = problem.when(number < v.least, f"must be at least {v.least:g}")
        if v.most is not None:
            problem = problem.when(number > v.most, f"must be at most {v.most:g}")
        problems.append(F.struct(F.lit(v.path).alias("path"), problem.alias("problem")))
    return F.filter(F.array(*problems), lambda p: p["problem"].isNotNull())
