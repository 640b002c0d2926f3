"""Tables written in steps, each of which is there as a whole or not at all.

A Python data source: a task writes its rows to a file of a name of its own and answers with what it wrote; when all tasks have, the
driver writes one manifest that names the files. What no manifest names doesn't count, so a task that is killed, repeated or
run twice leaves nothing, and neither does a job that dies before its manifest. A step has one manifest: a step that is
written again after it was committed changes nothing. Several tables of a step (a snapshot's static and dynamic columns and its
attributes) are staged first and get their manifest together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .regions import store_of


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


class StepWriter(DataSourceArrowWriter):
    def __init__(self, path: str, manifest: str):
        self.path, self.manifest = path, manifest

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = store_of(self.path)
        out, name, rows = None, f"data/{uuid.uuid4().hex}.parquet", 0
        try:
            for batch in iterator:
                if out is None:
                    store.create_dir(f"{folder}/data", recursive=True)
                    out = pq.ParquetWriter(store.open_output_stream(f"{folder}/{name}"), batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:  # what a failed task has written goes with it
            if out is not None:
                out.close()
                store.delete_file(f"{folder}/{name}")
            raise
        if out is None:
            return Written()
        out.close()
        return Written([name], rows)

    def commit(self, messages: list[Written | None]) -> None:
        found = [m for m in messages if m is not None]
        _put(self.path, self.manifest, {"files": sorted(f for m in found for f in m.files), "rows": sum(m.rows for m in found)})

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{folder}/{name}")


class StepSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_steps"

    def writer(self, schema: StructType, overwrite: bool) -> StepWriter:
        return StepWriter(self.options["path"], self.options["manifest"])


def _put(path: str, name: str, content: dict) -> None:
    """A small file that is there as a whole: it gets its name when it is complete."""
    store, folder = store_of(path)
    store.create_dir(f"{folder}/{name.rpartition('/')[0]}", recursive=True)
    part = f"{folder}/{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(json.dumps(content).encode())
    store.move(part, f"{folder}/{name}")


def _get(path: str, name: str) -> dict | None:
    store, folder = store_of(path)
    if store.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{folder}/{name}") as source:
        return json.loads(source.read())


def write_step(path: str, step: int, tables: dict[str, DataFrame], attributes: dict | None = None) -> bool:
    """Write tables and attributes as step ``step``; whether they were written, which they aren't if the step is there already."""
    if committed(path, step) is not None:
        return False
    whole = {"step": step, "attributes": attributes or {}, "tables": {}}
    for name, df in tables.items():
        staged = f"staged/{step}-{name}-{uuid.uuid4().hex}.json"
        df.sparkSession.dataSource.register(StepSource)
        df.write.format("committed_steps").mode("append").option("path", path).option("manifest", staged).save()
        whole["tables"][name] = {**_get(path, staged), "schema": df.schema.simpleString()[len("struct<") : -1]}
    _put(path, f"steps/{step:09d}.json", whole)  # the one commit of all of them
    return True


def committed(path: str, step: int) -> dict | None:
    """The manifest of a step, if it is committed."""
    return _get(path, f"steps/{step:09d}.json")


def steps(path: str) -> list[int]:
    """The committed steps, ascending."""
    store, folder = store_of(path)
    found = store.get_file_info(fs.FileSelector(f"{folder}/steps", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))


def read_steps(spark: SparkSession, path: str, table: str, only: list[int] | None = None) -> DataFrame:
    """The rows of a table in the committed steps (or ``only`` some of them), with step. The steps have one schema."""
    parts = []
    for step in steps(path) if only is None else only:
        manifest = committed(path, step)
        if manifest is None:
            raise FileNotFoundError(f"step {step} of {path}")
        if table in manifest["tables"]:
            entry = manifest["tables"][table]
            fields = ", ".join(_quoted(entry["schema"]))
            df = spark.read.schema(fields).parquet(*(f"{path}/{f}" for f in entry["files"])) if entry["files"] else spark.createDataFrame([], fields)
            parts.append(df.withColumn("step", F.lit(step).cast("long")))
    if not parts:
        raise FileNotFoundError(f"no step of {path} has {table}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _quoted(schema: str) -> Iterator[str]:
    """Top-level ``name:type`` fields as DDL."""
    depth = begin = 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth and i > begin:
            name, _, kind = schema[begin:i].partition(":")
            yield f"`{name}` {kind}"
            begin = i + 1


def vacuum(path: str) -> int:
    """Delete files that no committed step names; how many. Not while a step is being written."""
    store, folder = store_of(path)
    kept = {f for s in steps(path) for t in committed(path, s)["tables"].values() for f in t["files"]}
    found = store.get_file_info(fs.FileSelector(f"{folder}/data", allow_not_found=True))
    lost = [f.path for f in found if f"data/{f.base_name}" not in kept]
    for file in lost + [f.path for f in store.get_file_info(fs.FileSelector(f"{folder}/staged", allow_not_found=True))]:
        store.delete_file(file)
    return len(lost)
