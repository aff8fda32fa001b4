"""What rows of institutions tell about their place, folded to comparable keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.geo import KM_PER_DEGREE, haversine_km, usable
from wardline.llm.names import clean, parse

_ROAD = re.compile(r"([가-힣]+)\s*([로길])\s*(\d*)\s*(?:번\s*길)?\s*(\d*)\s*(-\s*\d+)?")
_FLOOR = re.compile(r"\([^)]*\)?|,.*|지?하?\s?\d+\s*층.*|본관|별관|응급실")
_LOT = re.compile(r"([가-힣]+(?:동|읍|면|리|가))\s+(\d+(?:-\d+)?)\s*(?:번지)?(?![\d로길])")

#: Distance up to which a position speaks for a pair, in km; the cells that near rows share are twice as wide.
NEAR_KM = 0.12
#: Cosine of 43 degrees, the most northern latitude of a usable position; farther south cells are wider than need be.
LEAST_COSINE = 0.731


def road_key(address: str | None) -> str | None:
    """Road and house number, whatever stands between and after them; None without a number."""
    found = _ROAD.search(_FLOOR.sub(" ", clean(address)))
    if not found:
        return None
    road, ending, side, house, part = (x or "" for x in found.groups())
    return road + ending + side + house + part.replace(" ", "") if side or house else None


def lot_key(address: str | None) -> str | None:
    """District and lot number."""
    found = _LOT.search(clean(address))
    return f"{found.group(1)} {found.group(2)}" if found else None


def phone_key(phone: str | None) -> str | None:
    """The last seven digits: area code, country code and punctuation vary."""
    digits = re.sub(r"\D", "", clean(phone))
    return digits[-7:] if len(digits) >= 7 else None


def readings_of(name: str | None, town: str | None, stated: str | None) -> list[tuple[str, str]]:
    """Readings of a name, then those of a stated one that are of a kind of the name's own."""
    own = parse(name, town)
    kinds = {kind for _, kind in own}
    return list(dict.fromkeys([*own, *((core, kind) for core, kind in parse(stated, town) if kind in kinds)]))


FOLDED = "key string, block string, readings array<struct<core:string,kind:string>>, phone string, road string, lot string, postal string, lat double, lon double, beds array<int>"


def folded(rows: DataFrame) -> DataFrame:
    """One row per key with its readings of the name and keys of its place.

    ``rows``: ``key, block, name, town, phone, addresses (array), postal, lat, lon,
    beds (array)``, and ``stated`` if there is another list's name for the row: it may
    be wrong, but is a further reading of the row's own kind. Repeated keys keep one row.
    Rows with a null key are left out. A null or empty name has no readings of its own.
    """
    columns = ["key", "block", "name", "town", "phone", "addresses", "postal", "lat", "lon", "beds", "stated"]
    rows = rows if "stated" in rows.columns else rows.withColumn("stated", F.lit(None).cast("string"))
    ok = usable(F.col("lat"), F.col("lon"))
    one = rows.where(F.col("key").isNotNull()).select(*columns).withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double")).withColumn("beds", F.col("beds").cast("array<int>"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    one = one.repartition(tasks, "key").dropDuplicates(["key"])  # few bytes, much work: not to be coalesced
    one = one.withColumn("lon", F.when(ok, F.col("lon"))).withColumn("lat", F.when(ok, F.col("lat")))

    readings = pa.list_(pa.struct([("core", pa.string()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = lambda keys: next((k for k in keys if k), None)
        for batch in batches:
            f = {n: batch.column(i).to_pylist() for i, n in enumerate(columns) if n not in ("key", "block", "postal", "lat", "lon", "beds")}
            parsed = [[{"core": c, "kind": k} for c, k in readings_of(*names)] for names in zip(f["name"], f["town"], f["stated"])]
            kept = lambda n: batch.column(columns.index(n))
            arrays = [
                kept("key"),
                kept("block"),
                pa.array(parsed, readings),
                pa.array(map(phone_key, f["phone"]), pa.string()),
                pa.array([first(map(road_key, a or [])) for a in f["addresses"]], pa.string()),
                pa.array([first(map(lot_key, a or [])) for a in f["addresses"]], pa.string()),
                *map(kept, ("postal", "lat", "lon", "beds")),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "block", "readings", "phone", "road", "lot", "postal", "lat", "lon", "beds"])

    return one.mapInArrow(run, FOLDED)


def place_tokens(near_km: float = NEAR_KM) -> Column:
    """Tokens that rows of one place share: phone, road, lot, postal code, beds, and cells of the four
    grids shifted by half a cell, of which points within half a cell share one.

    Rows without a common token agree at most in their names, kinds and wards, which
    does not link them.
    """
    step_lat = 2 * near_km / KM_PER_DEGREE
    step_lon = step_lat / LEAST_COSINE  # the exact distance is judged later
    cells = [
        F.when(F.col("lat").isNotNull(), F.concat_ws(" ", F.lit(f"G{i}{j}"), F.floor(F.col("lat") / step_lat + i / 2), F.floor(F.col("lon") / step_lon + j / 2)))
        for i in (0, 1)
        for j in (0, 1)
    ]
    named = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c[0].upper()), F.col(c))) for c in ("phone", "road", "lot")]
    named.append(F.when(F.col("postal").isNotNull(), F.concat(F.lit("Z"), F.col("postal"))))
    beds = F.when(F.size("beds") >= 2, F.when(F.get("beds", F.lit(0)).isNotNull() & F.get("beds", F.lit(1)).isNotNull(), F.concat_ws(" ", F.lit("B"), F.get("beds", F.lit(0)), F.get("beds", F.lit(1)))))
    return F.array_compact(F.array(*named, *cells, beds))


#: Columns that comparisons of two rows read; ``n`` are the equal rows that one stands for.
COMPARED = ("phone", "road", "lot", "postal", "lat", "lon", "beds", "size", "n")


def agreements(a: str, b: str) -> dict[str, Column]:
    """How far two folded rows (struct columns) agree on place and size, as levels; null where either is silent.

    ``phone``, ``road``, ``lot``, ``postal``, ``emergency`` (both kinds of emergency beds)
    and ``wards``: 1 equal, 0 not. ``near``: 0 within ``NEAR_KM``, 1 to 250 m, 2 to 1 km, 3 beyond.
    """
    def both(x: Column, y: Column, same: Column) -> Column:
        return F.when(x.isNull() | y.isNull(), None).when(same, 1).otherwise(0)

    at = lambda s, f: F.col(f"{s}.{f}")
    bed = lambda s, i: F.get(at(s, "beds"), F.lit(i))
    km = haversine_km(at(a, "lat"), at(a, "lon"), at(b, "lat"), at(b, "lon"))
    near = F.when(km.isNull(), None).when(km <= NEAR_KM, 0).when(km <= 0.25, 1).when(km <= 1.0, 2).otherwise(3)
    emergency = F.when(bed(a, 1).isNull() | bed(b, 1).isNull(), None).otherwise(both(bed(a, 0), bed(b, 0), (bed(a, 0) == bed(b, 0)) & (bed(a, 1) == bed(b, 1))))
    wards = both(bed(a, 2), bed(b, 2), F.abs(bed(a, 2) - bed(b, 2)) <= F.greatest(F.lit(8), bed(a, 2) * 0.04))
    equal = {c: both(at(a, c), at(b, c), at(a, c) == at(b, c)) for c in ("phone", "road", "lot", "postal")}
    return equal | {"near": near, "emergency": emergency, "wards": wards}


def name_agreements() -> dict[str, Column]:
    """Levels of a link's names: ``name``, the edits up to 4, and ``kind``, 0 equal, 1 unknown on a side, 2 compatible."""
    known = (F.col("kind_a") != "") & (F.col("kind_b") != "")
    return {"name": F.least(F.col("edits"), F.lit(4)), "kind": F.when(~known, 1).when(F.col("kind_a") == F.col("kind_b"), 0).otherwise(2)}
