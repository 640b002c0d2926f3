"""Reading by regions and committed steps: rows per worker, pushed filters, killed tasks and repeated steps."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from raysheaf.sources import committed, regions
from raysheaf.sources.scan import file_regions


@pytest.fixture
def files(tmp_path):
    """Three files of 23, 0 and 50 rows in row groups of 7."""
    at, paths = 0, []
    for i, n in enumerate((23, 0, 50)):
        table = pa.table({"id": pa.array(range(at, at + n), pa.int64()), "v": pa.array([None if j % 11 == 0 else j * 0.5 for j in range(at, at + n)], pa.float64()), "s": pa.array([f"s{j % 5}" for j in range(at, at + n)])})
        pq.write_table(table, tmp_path / f"f{i}.parquet", row_group_size=7)
        paths.append(str(tmp_path / f"f{i}.parquet"))
        at += n
    return paths


@pytest.mark.parametrize("workers", [1, 4, 100])
def test_regions_are_read_by_their_tasks(spark, files, workers):
    df = regions.read_in_regions(spark, files, workers)
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.id for r in rows) == list(range(73))
    want = {i: [(f, j) for f, a, b in pieces for j in range(a, b)] for i, pieces in enumerate(file_regions([23, 0, 50], workers))}
    for i, places in want.items():
        mine = sorted((r.file, r.row) for r in rows if r.region == i)
        assert mine == places and {r.task for r in rows if r.region == i} <= {i}
    assert all(r.id == r.row + (0, 23, 23)[r.file] and r.v == (None if r.id % 11 == 0 else r.id * 0.5) for r in rows)


def test_regions_prune_columns_and_push_filters(spark, files, monkeypatch):
    df = regions.read_in_regions(spark, files, 3, ["id", "v"])
    assert df.columns == ["id", "v", "region", "file", "row"]
    some = df.where("id >= 20 AND id < 30 AND v IS NOT NULL AND row % 2 = 0")
    assert sorted(r.id for r in some.collect()) == [i for i in range(20, 30) if i % 11 and (i if i < 23 else i - 23) % 2 == 0]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "id >= 20" not in plan.replace("(id#", "(").split("PythonDataSource")[0] or "GreaterThanOrEqual" in plan or "PushedFilters" in plan
    reader = regions.RegionReader(df.schema, files, file_regions([23, 0, 50], 1))
    left = list(reader.pushFilters([regions.GreaterThanOrEqual(("id",), 60), regions.In(("s",), ("s1", "s9")), regions.EqualTo(("row",), 3)]))
    assert [f.attribute for f in left] == [("row",)]
    read = []
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, i, columns, f=pq.ParquetFile.read_row_group: read.append(i) or f(self, i, columns=[*columns, "s"]))
    ids = [i for p in reader.partitions() for batch in reader.read(p) for i in batch.column("id").to_pylist()]
    assert ids == [i for i in range(60, 73) if f"s{i % 5}" in ("s1", "s9")]
    assert read == [5, 6]  # of 12 row groups: the first file is below 60, the last group has no s1
    assert regions.read_in_regions(spark, files, 2, []).count() == 73


@pytest.mark.parametrize("pushdown", ["true", "false"])
def test_regions_are_read_with_and_without_pushdown(spark, files, pushdown):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, pushdown)
    try:
        df = regions.read_in_regions(spark, files, 3, ["id", "v"])
        assert sorted(r.id for r in df.where("id >= 20 AND id < 30").collect()) == list(range(20, 30))
        assert df.count() == 73  # a filter of one query doesn't stay for the next
        if pushdown == "true":
            assert regions.read_in_regions(spark, files, 3, ["id"], pushdown=True).where("id >= 60").count() == 13
    finally:
        spark.conf.set(name, before)


def frame(spark, n, k=0):
    return spark.range(n).selectExpr("id", f"id * 2 + {k} AS v", "array(struct(id AS a, 'x' AS b)) AS deep").repartition(3)


def test_steps_are_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    assert committed.write_step(path, 0, {"dynamic": frame(spark, 10), "static": frame(spark, 4)}, {"time": 0.0, "note": "first"})
    assert committed.write_step(path, 3, {"dynamic": frame(spark, 5, 100)})
    assert committed.steps(path) == [0, 3] and committed.committed(path, 0)["attributes"] == {"time": 0.0, "note": "first"}
    both = committed.read_steps(spark, path, "dynamic")
    assert sorted((r.step, r.id, r.v) for r in both.collect()) == [(0, i, 2 * i) for i in range(10)] + [(3, i, 2 * i + 100) for i in range(5)]
    assert committed.read_steps(spark, path, "static").first().deep[0].b == "x"
    with pytest.raises(FileNotFoundError):
        committed.read_steps(spark, path, "dynamic", [1])


def test_a_repeated_step_is_written_once(spark, tmp_path):
    path = str(tmp_path / "out")
    assert committed.write_step(path, 1, {"t": frame(spark, 6)})
    assert not committed.write_step(path, 1, {"t": frame(spark, 60)})
    assert committed.read_steps(spark, path, "t").count() == 6
    assert committed.write_step(path, 2, {"t": frame(spark, 6).limit(0)}) and committed.read_steps(spark, path, "t", [2]).count() == 0


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    committed.write_step(path, 1, {"t": frame(spark, 6)})
    bad = frame(spark, 50).withColumn("v", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        committed.write_step(path, 2, {"first": frame(spark, 9), "t": bad})
    assert committed.steps(path) == [1] and committed.read_steps(spark, path, "t").count() == 6
    assert committed.vacuum(path) > 0  # the table that was staged before the other failed
    assert committed.write_step(path, 2, {"first": frame(spark, 9), "t": frame(spark, 50)})
    assert committed.read_steps(spark, path, "t").count() == 56 and committed.vacuum(path) == 0


def test_a_killed_task_is_written_once(spark, tmp_path):
    """A task that dies after it has written its file leaves that file, but no step names it."""
    path = str(tmp_path / "out")
    writer = committed.StepWriter(path, "staged/x.json")
    batches = lambda: iter([pa.RecordBatch.from_pydict({"id": [1, 2]})])
    writer.write(batches())  # killed before it could answer
    again = writer.write(batches())
    writer.commit([again, committed.Written(), None])
    assert committed._get(path, "staged/x.json") == {"files": again.files, "rows": 2}
    writer.abort([again])
    assert committed.vacuum(path) == 1
