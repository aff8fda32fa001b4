"""Rows that fail to parse: valid records loaded, the others set apart with a reason.

Blocks of records take a columnar path: one vectorized shape test, one bulk CSV parse
and one vectorized test per typed field. A block that fails a test is halved until its
failing records stand alone, the running count of failures telling which halves are
clean; only the isolated records go through the strict reader that names the reason,
the rest of the block stays on the columnar path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Records of the first, largest block.
BLOCK = 4096

COUNT = r"(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})*)"
DECIMAL = r"-?[0-9]+(?:\.[0-9]+)?"
_COUNT, _DECIMAL = re.compile(COUNT), re.compile(DECIMAL)


@dataclass(frozen=True)
class Field:
    """A declared field: ``kind`` is text, digits, count or decimal.

    ``width``: exact number of digits. ``low, high``: bounds, included; an empty
    decimal is null and valid, an empty count is not. Kept free of Spark so that it
    ships to the tasks as it is.
    """

    name: str
    kind: str = "text"
    width: int = 0
    low: float = 0.0
    high: float = 9_999_999

    @property
    def spark_type(self) -> T.DataType:
        return {"count": T.IntegerType(), "decimal": T.DoubleType()}.get(self.kind, T.StringType())

    @property
    def arrow_type(self) -> pa.DataType:
        return {"count": pa.int32(), "decimal": pa.float64()}.get(self.kind, pa.string())


DEMAND_FIELDS = (
    Field("administrative_code", "digits", width=10),
    Field("administrative_name"),
    Field("municipality_code", "digits", width=5),
    Field("population", "count"),
    Field("households", "count"),
    Field("latitude", "decimal", low=33, high=43),
    Field("longitude", "decimal", low=124, high=132),
    Field("coordinate_source"),
    Field("matched_address"),
    Field("kakao_place_id"),
    Field("geocoding_status"),
    Field("demand_rate_status"),
)


def _shape(fields: int) -> str:
    """A record of so many well-quoted fields, as one linear-time pattern.

    Line ends in unquoted fields are left to the strict reader: the bulk parser would
    take them for the end of a record.
    """
    field = r'(?:[^",\r\n]*|"(?:[^"]|"")*")'
    return rf"(?s)\A{field}(?:,{field}){{{fields - 1}}}\z"


def split_record(record: str) -> list[str] | None:
    """The fields of one CSV record, unquoted; None if its quoting is not well-formed."""
    fields, at, end = [], 0, len(record)
    while True:
        if at < end and record[at] == '"':
            parts, start = [], at + 1
            while True:
                close = record.find('"', start)
                if close < 0:
                    return None
                parts.append(record[start:close])
                if close + 1 < end and record[close + 1] == '"':
                    parts.append('"')
                    start = close + 2
                    continue
                break
            fields.append("".join(parts))
            at = close + 1
            if at < end and record[at] != ",":
                return None
        else:
            comma = record.find(",", at)
            stop = end if comma < 0 else comma
            if '"' in record[at:stop]:
                return None
            fields.append(record[at:stop])
            at = stop
        if at >= end:
            return fields
        at += 1


def _mask(good: pa.Array) -> np.ndarray:
    return pc.fill_null(good, False).to_numpy(zero_copy_only=False)


def _typed(values: pa.Array, field: Field) -> tuple[pa.Array, np.ndarray]:
    """The values in the field's type (null where invalid), and which of them are valid."""
    if field.kind == "text":
        return values, np.ones(len(values), bool)
    trimmed = pc.utf8_trim(values, " \t")
    if field.kind == "digits":
        good = pc.match_substring_regex(trimmed, rf"\A[0-9]{{{field.width}}}\z")
        return trimmed, _mask(good)
    if field.kind == "count":
        counts = pc.match_substring_regex(trimmed, rf"\A{COUNT}\z")
        plain = pc.utf8_ltrim(pc.replace_substring(trimmed, ",", ""), "0")
        counts = pc.and_(counts, pc.less_equal(pc.utf8_length(plain), 9))
        number = pc.if_else(counts, pc.if_else(pc.equal(plain, ""), "0", plain), None).cast(pa.int32())
        return number, _mask(pc.less_equal(number, int(field.high)))
    empty = pc.equal(trimmed, "")
    number = pc.if_else(pc.match_substring_regex(trimmed, rf"\A(?:{DECIMAL})\z"), trimmed, None).cast(pa.float64())
    within = pc.and_(pc.greater_equal(number, field.low), pc.less_equal(number, field.high))
    return number, _mask(empty) | _mask(within)


def _columns(records: pa.Array, fields: tuple[Field, ...]) -> list[pa.Array] | None:
    """The text columns of well-shaped records by one bulk parse, or None if it doesn't give one row for each."""
    if len(fields) == 1:
        return [records]  # a single value, not a record: nothing to split
    data = ("\n".join(records.to_pylist()) + "\n").encode()
    try:
        parsed = pyarrow.csv.read_csv(
            pa.BufferReader(data),
            read_options=pyarrow.csv.ReadOptions(column_names=[f.name for f in fields], use_threads=False, block_size=len(data) + 1),
            parse_options=pyarrow.csv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pyarrow.csv.ConvertOptions(column_types={f.name: pa.string() for f in fields}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    return [c.combine_chunks() for c in parsed.columns] if parsed.num_rows == len(records) else None


def _value(text: str, field: Field) -> tuple[object, bool]:
    """One value in the field's type, and whether it is valid; the same rules as ``_typed``."""
    if field.kind == "text":
        return text, True
    text = text.strip(" \t")
    if field.kind == "digits":
        return text, len(text) == field.width and text.isascii() and text.isdigit()
    if field.kind == "count":
        plain = text.replace(",", "").lstrip("0") if _COUNT.fullmatch(text) else "x"
        good = len(plain) <= 9 and plain != "x" and int(plain or 0) <= field.high
        return (int(plain or 0) if good else None), good
    if text == "":
        return None, True
    if not _DECIMAL.fullmatch(text):
        return None, False
    number = float(text)
    return number, field.low <= number <= field.high


def _strict(record: str | None, fields: tuple[Field, ...]) -> tuple[list, str | None]:
    """Typed values and the reason of one record, null values if there is a reason."""
    nothing = [None] * len(fields)
    if len(fields) == 1:
        if record is None:
            return nothing, "invalid_value"
        values = [record]
    else:
        values = split_record(record or "")
        if values is None:
            return nothing, "quoting"
        if len(values) != len(fields):
            return nothing, "column_count"
    typed = [_value(value, field) for value, field in zip(values, fields)]
    return ([v for v, _ in typed], None) if all(good for _, good in typed) else (nothing, "invalid_value")


def _isolated(good: np.ndarray) -> list[int]:
    """Positions that fail a test, found by halving: a part without failures is left at once."""
    failures = np.r_[0, np.cumsum(~good)]
    alone, parts = [], [(0, len(good))]
    while parts:
        start, stop = parts.pop()
        if failures[start] == failures[stop]:
            continue
        if stop - start == 1:
            alone.append(start)
            continue
        middle = (start + stop) // 2
        parts += [(middle, stop), (start, middle)]
    return alone


def _parse(records: pa.Array, fields: tuple[Field, ...], strict: Callable = _strict) -> tuple[list[pa.Array], pa.Array]:
    """Typed columns and reasons of a block, in the records' order."""
    shaped = _mask(pc.match_substring_regex(records, _shape(len(fields)))) if len(fields) > 1 else _mask(pc.is_valid(records))
    bad = _isolated(shaped)
    rest = np.delete(np.arange(len(records)), bad)
    texts = _columns(records.take(pa.array(rest)) if bad else records, fields)
    if texts is None and len(rest) > 1:  # the parser takes the block otherwise than the shape does
        half = len(records) // 2
        (a, x), (b, y) = _parse(records.slice(0, half), fields, strict), _parse(records.slice(half), fields, strict)
        return [pa.concat_arrays(c) for c in zip(a, b)], pa.concat_arrays([x, y])
    if texts is None:
        bad, rest, texts = list(range(len(records))), rest[:0], [pa.array([], pa.string())] * len(fields)
    typed = [_typed(values, field) for values, field in zip(texts, fields)]
    invalid = _isolated(np.logical_and.reduce([good for _, good in typed])) if len(rest) else []
    clean = np.delete(np.arange(len(rest)), invalid)
    bad = [*bad, *rest[invalid].tolist()]
    judged = [strict(records[i].as_py(), fields) for i in bad]
    order = pa.array(np.argsort(np.r_[rest[clean], np.array(bad, np.int64)]))
    columns = []
    for i, (field, (values, _)) in enumerate(zip(fields, typed)):
        good = values.take(pa.array(clean)) if invalid else values
        columns.append(pa.concat_arrays([good, pa.array([v[i] for v, _ in judged], field.arrow_type)]).take(order) if bad else good)
    reasons = pa.concat_arrays([pa.nulls(len(clean), pa.string()), pa.array([reason for _, reason in judged], pa.string())]).take(order)
    return columns, reasons


def parse_records(df: DataFrame, text: str, fields: tuple[Field, ...], prefix: str = "p_") -> DataFrame:
    """``df`` with the typed fields of its column ``text``, and ``reject_reason``.

    One leading U+FEFF and one trailing CR are dropped. Reasons, the first that holds:
    ``quoting``, ``column_count``, ``invalid_value``; null for a valid row. A rejected
    row has null fields. With one declared field the text is a value, not a record.
    A null record counts as an empty one (a null value is invalid). All columns of
    ``df`` are kept but those named like a new one (``prefix`` and field name, or
    ``reject_reason``, in any case), which the new one replaces. Repeated rows stay
    repeated, an empty table gives an empty one: rows out = rows in.
    """
    added = [T.StructField(prefix + f.name, f.spark_type) for f in fields] + [T.StructField("reject_reason", T.StringType())]
    new = {f.name.lower() for f in added}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    schema = T.StructType([*[df.schema.fields[i] for i in kept], *added])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = batch.column(at).cast(pa.string())
            if len(fields) > 1:
                records = pc.replace_substring_regex(pc.replace_substring_regex(records, "\\A\ufeff", ""), "\r\\z", "")
            for start in range(0, len(records), BLOCK):
                columns, reasons = _parse(records.slice(start, BLOCK), fields)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(start, BLOCK) for i in kept], *columns, reasons], names=schema.names)

    return df.mapInArrow(run, schema)
