"""Scans: paths, splits, chunks, units, filters, adjacency decoding, inline sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units as U
from ..schema import check_schema
from ..session import materialise


def resolve_paths(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """The path itself, or the files (or tables) with that suffix directly inside it, sorted. Any file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if path.endswith(suffix) or files.getFileStatus(where).isFile():
        return [path]
    return sorted(s.getPath().toString() for s in files.listStatus(where) if s.getPath().getName().endswith(suffix))


def snapshot_dirs(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, path) of the numbered snapshot folders below ``path``, ascending."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = ((s.getPath().getName(), s.getPath().toString()) for s in files.listStatus(where) if s.isDirectory())
    return sorted((int(m[1]), p) for n, p in names if (m := re.fullmatch(r"(?:snapshot=)?(\d+)", n)))


def read_columns(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], schema=None) -> DataFrame:
    """A projected scan of several files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths).select(*columns)


def convert_units(df: DataFrame, factors: dict[str, tuple[float, U.Dimension]], expect: dict[str, U.Dimension] | None = None) -> DataFrame:
    """Columns times their factors, with the dimension as metadata; a dimension other than expected raises."""
    out = df
    for name, (factor, dimension) in factors.items():
        if expect and name in expect and (expect[name].length, expect[name].time, expect[name].mass, expect[name].temperature) != (dimension.length, dimension.time, dimension.mass, dimension.temperature):
            raise ValueError(f"{name} has dimension {dimension}, expected {expect[name]}")
        out = out.withColumn(name, (F.col(name) * F.lit(factor)).alias(name, metadata=dimension.metadata()))
    return out


def vector_columns(df: DataFrame, column: str, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """An array column as one column a component."""
    return df.select("*", *(F.col(column)[i].alias(n) for i, n in enumerate(names))).drop(column)


def file_regions(sizes: Sequence[int], workers: int) -> list[list[tuple[int, int, int]]]:
    """(file, start, end) pieces of each worker: rows are dealt evenly in file order, the last worker takes the remainder."""
    total = sum(sizes)
    share = total // workers
    bounds = [share * i for i in range(workers)] + [total]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    out = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        pieces = ((i, max(low, s) - s, min(high, s + n) - s) for i, (s, n) in enumerate(zip(starts, sizes, strict=True)))
        out.append([p for p in pieces if p[1] < p[2]])
    return out


def chunk_bounds(spark: SparkSession, start: int, end: int, size: int) -> DataFrame:
    """(chunk, chunk_start, chunk_end) of [start, end) in pieces of ``size``."""
    n = max(0, -(-(end - start) // size))
    rows = spark.range(n).withColumnRenamed("id", "chunk")
    begin = F.lit(start) + F.col("chunk") * size
    return rows.select("chunk", begin.alias("chunk_start"), F.least(begin + size, F.lit(end)).alias("chunk_end"))


def in_ranges(df: DataFrame, order: str, rows: int = 1_000_000) -> DataFrame:
    """``df`` dealt to ranges of the key that hold about ``rows`` rows each, with the range's number in ``__part``; written once, so
    that what is derived from it sees the same ranges."""
    parts = max(1, -(-df.count() // rows))
    return materialise(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "ranged")


def with_row_index(df: DataFrame, key: str, rows: int = 1_000_000, name: str = "row_index") -> DataFrame:
    """0-based position in order of a unique key. Ranges of about ``rows`` rows are numbered by themselves and shifted by the rows
    of the ranges before, whatever the keys' values are, so no task orders more than a range; there are few ranges."""
    ranged = in_ranges(df, key, rows)
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    numbered = ranged.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1).join(totals, "__part")
    return numbered.withColumn(name, F.col("__nth") + F.col("__shift")).drop("__part", "__nth", "__shift")


def zip_by_index(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of two tables paired by position, each in order of its key; the longer one's rest is dropped."""
    return with_row_index(left, left_key).join(with_row_index(right, right_key), "row_index")


def spawned(tables: dict[str, DataFrame], key: str) -> tuple[DataFrame, int]:
    """One table of columns that come as tables of their own (key and values), and its number of rows; tables of unequal length
    or with other keys raise."""
    counts = {name: t.count() for name, t in tables.items()}
    if len(set(counts.values())) > 1:
        raise ValueError(f"columns have unequal lengths: {counts}")
    frames = list(tables.values())
    out = frames[0]
    for t in frames[1:]:
        out = out.join(t, key)
    out = materialise(out, "spawned")
    n = out.count()
    if frames and n != next(iter(counts.values())):
        raise ValueError(f"columns have other keys: {n} rows of {next(iter(counts.values()))} match")
    return out, n


#: Names of the gas columns in snapshots of the other code.
GAS = {"PartType0/Coordinates": "position", "PartType0/Density": "density", "PartType0/InternalEnergy": "internal_energy", "PartType0/ElectronAbundance": "electron_abundance", "PartType0/ParticleIDs": "particle_id", "PartType0/Masses": "mass"}


def gas_columns(df: DataFrame, initial_fraction: float | None = None) -> DataFrame:
    """Gas columns under the engine's names; the electron abundance is not read where an initial fraction is given."""
    names = {k: v for k, v in GAS.items() if k in df.columns and not (initial_fraction is not None and v == "electron_abundance")}
    out = df.select(*(F.col(f"`{k}`").alias(v) for k, v in names.items()))
    return out if initial_fraction is None else out.withColumn("xhii", F.lit(float(initial_fraction)))


def formed_stars(stars: DataFrame, column: str = "formation_a") -> DataFrame:
    """Stars only: wind particles carry a formation scale factor of 0 or less."""
    return stars.where(F.col(column) > 0)


def decode_connections(edges: DataFrame, bits: str = "connection_type") -> DataFrame:
    """Edge rows between two inner cells, with the periodic flag. Bits 0..3: first periodic, first boundary, second periodic,
    second boundary. Dropped: -1, any boundary, both ends periodic."""
    flag = lambda i: F.shiftright(F.col(bits), i).bitwiseAND(1) == 1
    kept = edges.where((F.col(bits) != -1) & ~flag(1) & ~flag(3) & ~(flag(0) & flag(2)))
    return kept.withColumns({"periodic1": flag(0), "periodic2": flag(2)})


def explicit_sources(spark: SparkSession, sources: Sequence[tuple[Sequence[float], float]]) -> DataFrame:
    """(source_id, x, y, z, rate) of sources listed in the parameters."""
    rows = [(i, *map(float, p), float(r)) for i, (p, r) in enumerate(sources)]
    return spark.createDataFrame(rows, "source_id long, x double, y double, z double, rate double")


class Registry:
    """Table name -> reader; the last one registered for a name counts."""

    def __init__(self):
        self.readers: dict[str, Callable[[], DataFrame]] = {}

    def register(self, name: str, reader: Callable[[], DataFrame]) -> None:
        self.readers[name] = reader

    def read(self, name: str, expected=None) -> DataFrame:
        df = self.readers[name]()
        return check_schema(df, expected) if expected is not None else df
