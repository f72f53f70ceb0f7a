"""Coordinates against a gazetteer: nearest place, corrected address fields, place names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean
from ..session import stage_measured
from .candidates import join_block
from .ordering import add_row_id
from .skew import left_join_unique

EARTH_KM = 6371.0088  # fixed value: mean earth radius


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the unit sphere, one row each: no special case at poles or date line."""
    a, b = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def _z_order(points: np.ndarray) -> np.ndarray:
    """The bits of the three coordinates by turns, 20 each: near numbers are mostly near points."""
    cells = np.clip(((points + 1) / 2 * (1 << 20)).astype(np.int64), 0, (1 << 20) - 1)
    out = np.zeros(len(points), dtype=np.int64)
    for bit in range(20):
        for axis in range(3):
            out |= ((cells[:, axis] >> bit) & 1) << (3 * bit + axis)
    return out


#: Leaves are cut so that looking through them costs a point about as much as looking through the places of those it visits:
#: the square root of so many times the places, up to a number that is held at once. A leaf has at least so many places.
LEAVES_SQUARED, MOST_LEAVES, LEAF_PLACES = 15, 1 << 15, 8


_LEAF = "leaf long, cx double, cy double, cz double, radius double, x double, y double, z double"


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _leaf_of(places: pd.DataFrame) -> pd.DataFrame:
    """The middle of a leaf, the greatest angle of a place to it, and the place next to it."""
    points = places[["x", "y", "z"]].to_numpy()
    middle = points.mean(axis=0)
    norm = np.linalg.norm(middle)
    middle = middle / norm if norm > 1e-9 else points[0]
    angles = _angles(points, middle[None])[:, 0]
    row = [places["leaf"].iloc[0], *middle, angles.max(), *points[angles.argmin()]]
    return pd.DataFrame([row], columns=[x.split()[0] for x in _LEAF.split(", ")])


class Leaves:
    """All leaves as caps of the sphere, and one place of each."""

    def __init__(self, rows: pd.DataFrame):
        self.leaf = rows["leaf"].to_numpy(dtype=np.int64)
        self.middle = rows[["cx", "cy", "cz"]].to_numpy()
        self.radius = rows["radius"].to_numpy()
        self.place = rows[["x", "y", "z"]].to_numpy()

    def visited(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf that comes as near as the nearest of the known places, or as ``reach`` (angles)."""
        at, leaf = [], []
        for low in range(0, len(points), 64):
            some = points[low : low + 64]
            known = _angles(some, self.place).min(axis=1)
            # the slack covers the rounding of small angles: about a metre
            x, y = np.nonzero(_angles(some, self.middle) - self.radius <= np.minimum(known, reach)[:, None] + 2e-7)
            at.append(x + low)
            leaf.append(self.leaf[y])
        return np.concatenate(at), np.concatenate(leaf)


def _places_in_leaves(gazetteer: DataFrame, fields: list[str], lat: str, lon: str, place_id: str) -> DataFrame:
    """id, _lat, _lon, fields, x, y, z and leaf of every place with coordinates, as a table.

    Places are sorted along a space-filling curve and cut into leaves of equal counts, so a leaf is small where
    places are dense and wide where they are rare.
    """

    @F.pandas_udf("x double, y double, z double, curve long")
    def put(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        points = _on_sphere(a.to_numpy(dtype=float), b.to_numpy(dtype=float))
        return pd.DataFrame({"x": points[:, 0], "y": points[:, 1], "z": points[:, 2], "curve": _z_order(points)})

    rows = gazetteer.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    rows = rows.select(F.col(place_id).alias("id"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), *fields)
    rows = rows.withColumn("_p", put(F.col("_lat").cast("double"), F.col("_lon").cast("double")))
    placed, seen = stage_measured(add_row_id(rows.select("*", "_p.*").drop("_p"), ["curve", "id"], 0, "_at"), "places", n=F.count(F.lit(1)))
    size = max(LEAF_PLACES, math.ceil(seen["n"] / min(MOST_LEAVES, math.isqrt(LEAVES_SQUARED * seen["n"]) + 1)))
    return placed.withColumn("leaf", F.floor(F.col("_at") / size).cast("long")).drop("_at", "curve")


def leaves_to_visit(where: DataFrame, places: DataFrame, reach: float = math.pi) -> DataFrame:
    """(_lat, _lon, leaf) for every leaf that may hold the nearest place of a point within an angle of ``reach``."""
    rows = places.select("leaf", "x", "y", "z").groupBy("leaf").applyInPandas(_leaf_of, _LEAF).toPandas()  # at most MOST_LEAVES
    leaves = where.sparkSession.sparkContext.broadcast(Leaves(rows))
    fields = T.StructType([*where.select("_lat", "_lon").schema.fields, T.StructField("leaf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                a, b = (np.asarray(c.cast(pa.float64())) for c in batch.columns)
                at, leaf = leaves.value.visited(_on_sphere(a, b), reach)
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf)], names=fields.names)

    if not len(rows):
        return where.select("_lat", "_lon", F.lit(0).cast("long").alias("leaf")).limit(0)
    return where.select("_lat", "_lon").mapInArrow(run, fields)


def nearest_place(
    df: DataFrame,
    gazetteer: DataFrame,
    radius_km: float | None,
    fields: list[str],
    lat: str = "latitude",
    lon: str = "longitude",
    place_id: str = "place_id",
) -> DataFrame:
    """Nearest gazetteer entry per distinct coordinate, with its ``fields``; with ``radius_km`` only within it.

    Places lie in leaves of bounded size. A point is compared with the places of those leaves only that come as near as the
    nearest of one known place a leaf; so also a point far from all places meets few of them. Each distinct
    coordinate is looked up once, however many records share it; equally near places go by their id.
    """
    where = df.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).dropna().distinct()
    places = _places_in_leaves(gazetteer, fields, lat, lon, place_id)
    reach = math.pi if radius_km is None else radius_km / EARTH_KM
    points = leaves_to_visit(where, places, reach).withColumn("id", F.xxhash64("_lat", "_lon"))
    near = join_block(points, places.select("leaf", "id", "_lat", "_lon", *fields), ["leaf"], "id", False)
    km = haversine_km(F.col("_lat_l"), F.col("_lon_l"), F.col("_lat_r"), F.col("_lon_r"))
    near = near.withColumn("km", km)
    if radius_km is not None:
        near = near.where(F.col("km") <= radius_km)
    payload = F.struct("km", F.col("id_r").alias("place_id"), *[F.col(f"{f}_r").alias(f) for f in fields])
    return near.groupBy(F.col("_lat_l").alias(lat), F.col("_lon_l").alias(lon)).agg(F.min(payload).alias("_place"))


def reverse_geocode_fix(
    df: DataFrame, gazetteer: DataFrame, fields: dict[str, str], radius_km: float | None = None, lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Overwrite address columns by the nearest place's value where it has one.

    ``fields`` maps record columns to gazetteer columns, e.g. ``{"zip": "postcode"}``. Rows without
    coordinates (or, with a radius, with no place within it) stay as they are.
    """
    place = nearest_place(df, gazetteer, radius_km, list(dict.fromkeys(fields.values())), lat, lon)
    joined = left_join_unique(df, place, [lat, lon])
    return joined.select(
        *[
            F.coalesce(F.col(f"_place.{fields[c]}").cast(df.schema[c].dataType), F.col(c)).alias(c)
            if c in fields
            else F.col(c)
            for c in df.columns
        ]
    )


# fixed values: record column to gazetteer column, per preset
GEO_FIELDS = {
    "usa": {"state": "state", "zip": "postcode", "county": "county", "city": "city"},
    "febrl": {"state": "state", "postcode": "postcode", "suburb": "suburb"},
}


def attach_place_name(
    df: DataFrame, gazetteer: DataFrame, radius_km: float | None = None, lat: str = "latitude", lon: str = "longitude", out: str = "display_name"
) -> DataFrame:
    """The nearest place's display name, null without coordinates (or with none within a radius)."""
    place = nearest_place(df, gazetteer, radius_km, ["display_name"], lat, lon)
    joined = left_join_unique(df, place, [lat, lon])
    return joined.select(*df.columns, F.col("_place.display_name").alias(out))


def geocode(df: DataFrame, gazetteer: DataFrame, name: str) -> DataFrame:
    """Coordinates of a named place: equal cleaned names, the first entry winning."""
    first = gazetteer.groupBy(clean(F.col("display_name")).alias("_name")).agg(
        F.min(F.struct("place_id", "latitude", "longitude")).alias("_place")
    )
    joined = left_join_unique(df.withColumn("_name", clean(F.col(name))), first.where("_name is not null"), ["_name"])
    return joined.select(*df.columns, F.col("_place.latitude").alias("latitude"), F.col("_place.longitude").alias("longitude"))
