"""Line deduplication: lines that many documents share, found in an index of sorted runs.

Method: the index holds runs of (key, docs), a key being 128 bits of a line and docs the documents that a run saw it in. A run is a
table that is bucketed by key and sorted inside each bucket, so runs meet by merging, without a shuffle. A batch of new
documents counts its keys, merge-anti-joins them with the *closed* runs (keys that are known to be in enough documents and
need no more counting) and adds what is left as a run of level 0. When a level has ``FANOUT`` runs they are compacted: merged
into one run of the next level, while keys that reach ``min_docs`` by it leave for a closed run. So a batch costs its own size and
its share of some compactions, and an index is never rewritten as a whole. In the end the runs that are left are merged once.

Counts in runs are of different documents, so their sums are exact; a key is closed by a sum that reaches the bound, and is not
counted afterwards. A manifest names the runs and is replaced last: what it doesn't name doesn't count, so a batch that dies on
its way can be added again, and ``LineIndex.opened`` goes on where another session ended.

Keys are hashed in the tasks that read the texts; a document sends each of its keys once. The hashes of a document's own shared lines
(no more than it has) come back to it, and only documents that have some are moved for that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, lean, materialise, scratch_path, write_text
from .rows import likely, named, pieces

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 8
FANOUT = 4
SPACE = b" \t\n\x0b\x0c\r"


def lines(text: bytes) -> Iterator[bytes]:
    begin = 0
    while (end := text.find(b"\n", begin)) >= 0:
        yield text[begin:end]
        begin = end + 1
    yield text[begin:]


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of a line without surrounding space and in small letters (A-Z only); none if it has too few code points."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, row: str, text_col: str, min_chars: int) -> DataFrame:
    """(file, at, key): each document's keys, each once. ``row`` is a struct with file and at."""
    schema = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("key", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 2):
                for file, at, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                    keys = {k for line in lines((text.as_py() or "").encode()) if (k := key_of(line, min_chars))}
                    if keys:
                        n = len(keys)
                        yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * n, pa.int64()), pa.array([at.as_py()] * n, pa.int64()), pa.array(list(keys), pa.binary())], schema=schema)

    def joined(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 14:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    narrow = docs.select(F.col(row)["file"].alias("file"), F.col(row)["at"].alias("at"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(lean(joined), "file long, at long, key binary")


class LineIndex:
    """Runs of line keys in a folder, of which ``min_docs`` documents make a key a shared one."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.min_docs, self.fanout = spark, path.rstrip("/"), min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.closed: list[str] = []
        self.table = f"line_runs_{uuid.uuid4().hex}"
        layout = f"USING parquet PARTITIONED BY (run) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS"
        spark.sql(f"CREATE TABLE {self.table} (key BINARY, docs LONG, run STRING) {layout} LOCATION '{self.path}/runs'")

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> LineIndex:
        """The index that another session left at ``path``."""
        state = json.loads(spark.read.option("wholetext", True).text(f"{path.rstrip('/')}/manifest.json").first()[0])
        index = cls(spark, path, state["min_docs"], state["fanout"], state["buckets"])
        index.levels, index.closed = state["levels"], state["closed"]
        spark.sql(f"MSCK REPAIR TABLE {index.table}")
        return index

    def _save(self) -> None:
        state = {"min_docs": self.min_docs, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels, "closed": self.closed}
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(state))

    def _read(self, runs: list[str]) -> DataFrame:
        """(key, docs) of some runs. Files of one bucket are read by one task whatever their run, so that equal keys are together."""
        return self.spark.table(self.table).where(F.col("run").isin(runs)).select("key", "docs")

    def _write(self, df: DataFrame) -> str:
        run = uuid.uuid4().hex
        out = df.select("key", "docs", F.lit(run).alias("run")).write.format("parquet").mode("append")
        out.partitionBy("run").bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/runs").saveAsTable(self.table)
        return run

    def _merged(self, runs: list[str]) -> DataFrame:
        return self._read(runs).groupBy("key").agg(F.sum("docs").alias("docs"))

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (run = '{run}')")
            delete_path(self.spark, f"{self.path}/runs/run={run}")

    def add(self, keys: DataFrame) -> None:
        """Add a batch: (key), a row for each document and key of it."""
        fresh = self._write(keys.groupBy("key").agg(F.count("*").alias("docs")))  # written, or the join would move below the count
        old: list[str] = []
        if self.closed:
            old.append(fresh)
            fresh = self._write(self._read([fresh]).hint("merge").join(self._read(self.closed).select("key"), "key", "left_anti"))
        self.levels[0].append(fresh)
        at = 0
        while len(self.levels[at]) >= self.fanout:
            old += self._compact(at)
            at += 1
        self._save()
        self._drop(old)

    def _compact(self, at: int) -> list[str]:
        """Merge the runs of a level into one of the next; keys that are in enough documents by now go to a closed run."""
        runs = self.levels[at]
        whole = self._write(self._merged(runs))
        if len(self.levels) == at + 1:
            self.levels.append([])
        self.closed.append(self._write(self._read([whole]).where(F.col("docs") >= self.min_docs)))
        self.levels[at + 1].append(self._write(self._read([whole]).where(F.col("docs") < self.min_docs)))
        self.levels[at] = []
        return [*runs, whole]

    def shared(self) -> DataFrame:
        """(key): those found in enough of the documents that were added, each once."""
        runs = [r for level in self.levels for r in level] + self.closed  # an open run may hold a closed key from before, so they meet
        return self._merged(runs).where(F.col("docs") >= self.min_docs).select("key")

    def clear(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete_path(self.spark, self.path)


def _rewritten(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text, gone): gone are the keys whose lines go, or null."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 1):
                n_lines, n_dropped, kept = [], [], []
                for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                    text, drop = (text.as_py() or "").encode(), set(gone.as_py() or ())
                    left = [line for line in lines(text) if key_of(line, min_chars) not in drop] if drop else None
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(n_lines[-1] - len(left) if drop else 0)
                    kept.append((b"\n".join(left) if drop else text).decode())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept, pa.string())})

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped and kept, the text without lines whose key ``min_docs`` documents share.

    A line's key is the line without surrounding space ([\\x20\\x09-\\x0D]) and with A-Z in small letters; keys of less than ``min_chars``
    code points never count. Texts are cut at \\n; a null or empty text is one empty line. If all lines go, kept is empty.
    Every row is a document of its own, so rows that repeat an id or a text each count. A null id is kept as it is. An empty table
    gives an empty result; other columns are ignored. Documents are dealt into ``batches`` by their place; the result depends
    neither on that nor on ``fanout``. A document's distinct lines have to fit into a worker's memory.
    """
    spark = docs.sparkSession
    rows, row = named(docs)
    keyed = line_keys(rows, row, text_col, min_chars)
    path = scratch_path(spark, "lines")
    keyed.withColumn("batch", F.pmod(F.xxhash64("file", "at"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    stored = spark.read.schema("file long, at long, key binary, batch int").parquet(path)
    index = LineIndex(spark, scratch_path(spark, "runs"), min_docs, fanout)
    for batch in range(batches):
        index.add(stored.where(F.col("batch") == batch).select("key"))
    shared = materialise(index.shared(), "shared")
    index.clear()
    hits = stored.join(shared, "key").groupBy("file", "at").agg(F.collect_list("key").alias("gone"))
    hits = materialise(hits.select(F.struct("file", "at").alias("row"), "gone"), "gone")
    marked, perhaps = likely(rows, row, hits.select("row"))
    names = [F.col(row), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    some = marked.where(perhaps).select(*names)
    found = hits.select(F.col("row.file").alias("h_file"), F.col("row.at").alias("h_at"), "gone")
    # by merging at every size: what is sent to all tasks at a small one is moved at a large one
    moved = some.hint("merge").join(found, (some[row]["file"] == F.col("h_file")) & (some[row]["at"] == F.col("h_at")), "left").select("doc_id", "text", "gone")
    rest = marked.where(~perhaps).select(*names[1:], F.lit(None).cast("array<binary>").alias("gone"))
    return _rewritten(moved.unionByName(rest), min_chars)


def op12_line_dedup(spark, sf_dir):
    out = drop_shared_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, s.key IS NOT NULL AS gone FROM k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
