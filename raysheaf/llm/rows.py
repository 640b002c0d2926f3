"""A name for every row, so that operators decide on rows and not on ids that may repeat or be null."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

WORDS = 1 << 18  # of 64 bits; a bitmap of rows has that many at most


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or that name with underscores if a column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def named(docs: DataFrame, *rank: Column) -> tuple[DataFrame, str]:
    """``docs`` with one column more, and that column's name: a struct of ``rank`` and the row's place (file, row in it).

    No two rows share a place, and it stays the same however often the rows are read and whatever executors are lost: it is
    Parquet's. A frame that isn't a plain scan of Parquet files is written first.
    """
    if not re.fullmatch(r"Relation \[.*\] parquet\s*", docs._jdf.queryExecution().analyzed().toString(), re.DOTALL):
        docs = materialise(docs, "rows")
    place, name = docs.metadataColumn("_metadata"), unused(docs, "__row")
    ranks = [c.alias(f"rank{i}") for i, c in enumerate(rank)]
    return docs.withColumn(name, F.struct(*ranks, F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))), name


def pieces(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of a text column; a longer text is a slice by itself."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = int(sizes[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _place(row: Column) -> tuple[Column, Column]:
    """A word of the bitmap of ``likely`` and a bit in it, for a row's name."""
    spot = F.xxhash64(row["file"], row["at"])
    return F.pmod(spot, F.lit(WORDS)), F.shiftrightunsigned(spot, 40).bitwiseAND(63).cast("int")


def likely(docs: DataFrame, row: str, wanted: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` with columns more, and a condition that holds for all rows whose ``row`` is in ``wanted`` (one column, written).

    For most others it doesn't hold, so that a join need not move them. What is sent to the tasks is a bitmap of ``WORDS`` words,
    whatever it stands for: as it fills, more rows are moved and the join after it is what decides.
    """
    word, bits = unused(docs, "__word"), unused(docs, "__bits")
    at, bit = _place(F.col("row"))
    bitmap = wanted.toDF("row").select(at.alias(word), bit.alias("bit")).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias(bits))
    at, bit = _place(docs[row])
    return docs.withColumn(word, at).join(F.broadcast(bitmap), word, "left"), F.coalesce(F.bit_get(F.col(bits), bit) == 1, F.lit(False))


def without(docs: DataFrame, row: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of those rows of ``docs`` whose ``row`` isn't in ``gone`` (one column); joined by place alone. Rows that
    the bitmap of ``gone`` tells to stay aren't moved. They are joined by merging at every size, as a large table is."""
    gone = materialise(gone, "gone")
    marked, perhaps = likely(docs, row, gone)
    file, at = unused(marked, "__file"), unused(marked, "__at")
    gone = gone.toDF("row").select(F.col("row.file").alias(file), F.col("row.at").alias(at))
    some = marked.where(perhaps)
    same = (some[row]["file"] == gone[file]) & (some[row]["at"] == gone[at])
    return marked.where(~perhaps).select(*columns).unionByName(some.hint("merge").join(gone, same, "left_anti").select(*columns))
