"""Schemas of the engine's tables; a field's physical dimension is in its metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .functions import units as U

DENSITY, RATE = U.MASS / U.LENGTH**3, U.NONE / U.TIME


def field(name: str, kind: T.DataType, dimension: U.Dimension | None = None) -> T.StructField:
    return T.StructField(name, kind, True, dimension.metadata() if dimension else {})


D, L, I = T.DoubleType(), T.LongType(), T.IntegerType()
PARTICLES = T.StructType(
    [field("particle_id", L), *(field(a, D, U.LENGTH) for a in "xyz"), field("density", D, DENSITY), field("volume", D, U.LENGTH**3), field("temperature", D, U.TEMPERATURE), field("xhii", D, U.NONE)]
)
STARS = T.StructType([field("star_id", L), *(field(a, D, U.LENGTH) for a in "xyz"), field("mass", D, U.MASS), field("metallicity", D, U.NONE), field("formation_a", D, U.NONE)])
FACES = T.StructType([field("cell_id", L), field("neighbour_id", L), field("kind", T.StringType()), field("area", D, U.LENGTH**2), *(field(f"n{a}", D, U.NONE) for a in "xyz")])
DIRECTIONS = T.StructType([field("dir", I), *(field(f"d{a}", D, U.NONE) for a in "xyz")])
TIME_SERIES = T.StructType([field("metric", T.StringType()), field("step", L), field("time_elapsed", D, U.TIME), field("redshift", D), field("scale_factor", D), field("val", D)])
#: Columns written to the first snapshot only.
STATIC_COLUMNS = ("x", "y", "z", "density", "mass", "source", "volume")


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """``df`` if it has the expected columns, types and, where it states any, dimensions; else ValueError."""
    for want in expected:
        if want.name not in df.columns:
            raise ValueError(f"column {want.name} is missing")
        have = df.schema[want.name]
        if have.dataType != want.dataType:
            raise ValueError(f"column {want.name} is {have.dataType.simpleString()}, expected {want.dataType.simpleString()}")
        if have.metadata.get("dimension") and have.metadata["dimension"] != want.metadata.get("dimension", have.metadata["dimension"]):
            raise ValueError(f"column {want.name} has dimension {have.metadata['dimension']}")
    return df


def describe(df: DataFrame) -> list[tuple[str, str, dict]]:
    """(name, type, metadata) of each column."""
    return [(f.name, f.dataType.simpleString(), f.metadata) for f in df.schema]
