"""Snapshots, time series and their schedule."""

from __future__ import annotations

import math
from collections.abc import Sequence

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STATIC_COLUMNS
from ..session import delete_path
from ..sources.scan import snapshot_dirs


class OutputTimer:
    """Fires when the time has reached the next output time, or at the end; then waits for one interval more."""

    def __init__(self, interval: float, first: float = 0.0):
        self.interval, self.next, self.number = interval, first, 0

    def due(self, time: float, finished: bool = False) -> bool:
        return finished or time >= self.next

    def fired(self) -> int:
        number, self.number, self.next = self.number, self.number + 1, self.next + self.interval
        return number


def schedule(times: DataFrame, interval: float, first: float = 0.0, time: str = "time") -> DataFrame:
    """The same for a table of steps whose distance is below the interval: each slot's first step gets the slot's number."""
    slot = F.floor((F.col(time) - first) / interval).cast("long")
    return times.where(F.col(time) >= first).groupBy(slot.alias("snapshot")).agg(F.min(time).alias("time"))


def prepare(spark: SparkSession, path: str, policy: str = "panic") -> None:
    """Folder policy before the first snapshot: ``panic`` if it has any, ``overwrite`` them one by one, or ``delete`` it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return
    if policy == "panic" and snapshot_dirs(spark, path):
        raise FileExistsError(path)
    if policy == "delete":
        delete_path(spark, path)
    elif policy not in ("panic", "overwrite"):
        raise ValueError(f"unknown policy {policy!r}")


def selected_fields(columns: Sequence[str], fields: Sequence[str] | str) -> list[str]:
    """Desired columns; ``all`` or a list, in which an unknown field raises."""
    if fields == "all":
        return list(columns)
    if unknown := [f for f in fields if f not in columns]:
        raise ValueError(f"unknown output fields {unknown}")
    return [c for c in columns if c in fields]


def write_snapshot(df: DataFrame, path: str, number: int, attributes: dict, fields: Sequence[str] | str = "all", files: int = 1, key: str = "particle_id", padding: int = 3) -> str:
    """Write snapshot ``number``: dynamic columns always, static ones with the first only, scalars to ``meta``.

    Rows are dealt to ``files`` files by ranges of the key.
    """
    name = f"{path}/snapshot={number:0{padding}d}"
    wanted = selected_fields(df.columns, fields)
    if key not in wanted:
        wanted = [key, *wanted]
    static = [c for c in wanted if c in STATIC_COLUMNS]
    dealt = df.select(*wanted).repartitionByRange(files, key)
    dealt.drop(*static).write.mode("overwrite").parquet(f"{name}/dynamic")
    if number == 0 and static:
        dealt.select(key, *static).write.mode("overwrite").parquet(f"{path}/static")
    row = {"snapshot": number, **{k: float(v) for k, v in attributes.items()}}
    df.sparkSession.createDataFrame([row]).coalesce(1).write.mode("overwrite").parquet(f"{name}/meta")
    return name


def read_snapshot(spark: SparkSession, path: str, number: int | None = None, key: str = "particle_id") -> DataFrame:
    """A snapshot (the last by default) with its static columns."""
    found = dict(snapshot_dirs(spark, path))
    number = max(found) if number is None else number
    dynamic = spark.read.parquet(f"{found[number]}/dynamic")
    if any(p.endswith("/static") for p in _children(spark, path)):
        return dynamic.join(spark.read.parquet(f"{path}/static"), key)
    return dynamic


def _children(spark: SparkSession, path: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in files.listStatus(where)]


def read_attributes(spark: SparkSession, path: str, number: int) -> dict:
    return spark.read.parquet(f"{dict(snapshot_dirs(spark, path))[number]}/meta").first().asDict()


def split_columns(df: DataFrame, key: str, static: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(static, dynamic) tables that join on the key."""
    kept = [c for c in df.columns if c in static]
    return df.select(key, *kept), df.drop(*kept)


class TimeSeries:
    """An append table (metric, step, time_elapsed, redshift, scale_factor, val), emptied when it is opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        delete_path(spark, path)

    def append(self, step: int, time: dict, values: dict[str, float]) -> None:
        rows = [(m, step, time.get("time_elapsed"), time.get("redshift"), time.get("scale_factor"), float(v)) for m, v in values.items() if v is not None]
        kind = "metric string, step long, time_elapsed double, redshift double, scale_factor double, val double"
        self.spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").partitionBy("metric").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def as_yaml(self, metric: str) -> str:
        """The series as a list of time and value entries."""
        rows = self.read().where(F.col("metric") == metric).orderBy("step").collect()
        entry = lambda r: {"time": {k: r[k] for k in ("time_elapsed", "redshift", "scale_factor") if r[k] is not None and not math.isnan(r[k])}, "val": r.val}
        return yaml.safe_dump([entry(r) for r in rows])


class Performance:
    """Runtimes by category and counts, dumped as average, total and number of calls."""

    def __init__(self):
        self.runtimes: dict[str, list[float]] = {}
        self.numbers: dict[str, int] = {}

    def record(self, category: str, seconds: float) -> None:
        self.runtimes.setdefault(category, []).append(seconds)

    def record_number(self, category: str, n: int) -> None:
        self.numbers[category] = n

    def summary(self) -> dict:
        runs = {k: {"average": sum(v) / len(v), "total": sum(v), "num_calls": len(v)} for k, v in sorted(self.runtimes.items())}
        return {**runs, **dict(sorted(self.numbers.items()))}

    def as_yaml(self) -> str:
        return yaml.safe_dump(self.summary())
