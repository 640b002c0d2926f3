"""Reading by planned regions: several Parquet files as one sequence of rows, cut into a contiguous region for each worker.

A Python data source: the planner gets a partition for each region, whose task opens the files of its region and reads the row
groups and columns that it needs, and no others. Pushed comparisons are tested on a row group's statistics before it is read, and on
its rows after. Positions are those of the files, so filters and columns don't move regions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .scan import file_regions, resolve_paths

PLACE = "region int, file int, row long"
COMPARE = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, as tasks open it without Spark, and the path on it."""
    if "://" in path:
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Region(InputPartition):
    number: int
    pieces: list[tuple[int, int, int]]  # (file, first row, row after the last)


class RegionReader(DataSourceReader):
    def __init__(self, schema: StructType, files: list[str], regions: list[list[tuple[int, int, int]]]):
        self.names, self.files, self.regions = [f.name for f in schema.fields], files, regions
        self.tests: list[tuple[str, str, object]] = []  # (column, comparison, value)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column is None or column in ("region", "file", "row"):
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "is_valid", None))
            elif isinstance(f, In):
                self.tests.append((column, "is_in", list(f.value)))
            elif type(f) in COMPARE:
                self.tests.append((column, COMPARE[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> Sequence[Region]:
        return [Region(i, pieces) for i, pieces in enumerate(self.regions)]

    def _may_hold(self, group: pq.RowGroupMetaData, places: dict[str, int]) -> bool:
        """Whether a row group's statistics leave room for rows that pass the tests."""
        for column, test, value in self.tests:
            stats = group.column(places[column]).statistics
            if stats is None or not stats.has_min_max or test == "is_valid":
                continue
            low, high = stats.min, stats.max
            wanted = value if test == "is_in" else [value]
            try:
                fits = {"equal": lambda v: low <= v <= high, "is_in": lambda v: low <= v <= high, "greater": lambda v: high > v, "greater_equal": lambda v: high >= v, "less": lambda v: low < v, "less_equal": lambda v: low <= v}  # noqa: B023
                if not any(fits[test](v) for v in wanted):
                    return False
            except TypeError:  # statistics of another type than the value: they tell nothing
                continue
        return True

    def _passed(self, table: pa.Table) -> pa.Table:
        for column, test, value in self.tests:
            data = table[column]
            if test == "is_valid":
                keep = pc.is_valid(data)
            elif test == "is_in":
                keep = pc.is_in(data, value_set=pa.array(value).cast(data.type))
            else:
                keep = getattr(pc, test)(data, pa.scalar(value).cast(data.type))
            table = table.filter(pc.fill_null(keep, False))
        return table

    def read(self, partition: Region) -> Iterator[pa.RecordBatch]:
        wanted = [n for n in self.names if n not in ("region", "file", "row")]
        for number, begin, end in partition.pieces:
            store, path = store_of(self.files[number])
            with store.open_input_file(path) as source:
                file, first = pq.ParquetFile(source), 0
                places = {file.metadata.schema.column(i).path: i for i in range(file.metadata.num_columns)}
                for i in range(file.num_row_groups):
                    group = file.metadata.row_group(i)
                    low, high = max(begin, first), min(end, first + group.num_rows)
                    if low < high and self._may_hold(group, places):
                        rows = file.read_row_group(i, columns=wanted or [next(iter(places))]).slice(low - first, high - low)
                        place = {"region": pa.array([partition.number] * len(rows), pa.int32()), "file": pa.array([number] * len(rows), pa.int32()), "row": pa.array(range(low, high), pa.int64())}
                        for name, values in place.items():
                            rows = rows.append_column(name, values)
                        yield from self._passed(rows).select(self.names).to_batches(max_chunksize=10_000)
                    first += group.num_rows


class PlainRegionReader(RegionReader):
    """Without pushdown: Spark tests all rows itself, and refuses a reader with pushdown in a session where it is off."""

    pushFilters = DataSourceReader.pushFilters


class RegionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_regions"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> RegionReader:
        kind = RegionReader if self.options["pushdown"] == "true" else PlainRegionReader
        return kind(schema, json.loads(self.options["files"]), [[tuple(p) for p in r] for r in json.loads(self.options["regions"])])


def read_in_regions(spark: SparkSession, paths: Sequence[str], workers: int, columns: Sequence[str] | None = None, pushdown: bool = False) -> DataFrame:
    """The rows of Parquet files (or folders of them, in order) with region, file and row: partition i holds region i, an even share in
    file order; the last region takes the remainder. ``columns`` are read and no others. With ``pushdown`` comparisons are pushed into the
    files; the session has to have ``spark.sql.python.filterPushdown.enabled`` then, and the result is for one query: Spark 4.1.2 keeps the
    pushed tests with the relation, so another query of the same DataFrame would be filtered too. Files have to be on a file system that pyarrow opens; their rows are counted by a
    Spark job, and the plan has an entry for each file and region.
    """
    found = [f for p in paths for f in resolve_paths(spark, p)]
    table = spark.read.parquet(*found)
    of = table.metadataColumn("_metadata")["file_path"]
    counted = {r[0]: r[1] for r in table.groupBy(of.alias("file")).agg(F.count("*").alias("n")).collect()}  # a row a file
    plain = lambda p: re.sub(r"^file:/*", "/", p)
    sizes = {plain(k): n for k, n in counted.items()}
    regions = file_regions([sizes.get(plain(f), 0) for f in found], workers)
    wanted = [table.schema[c] for c in (columns if columns is not None else table.columns)]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted), PLACE])
    spark.dataSource.register(RegionSource)
    return spark.read.format("row_regions").option("pushdown", str(pushdown).lower()).option("files", json.dumps(found)).option("regions", json.dumps(regions)).option("columns", ddl).load()
