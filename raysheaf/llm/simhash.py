"""SimHash near-deduplication with deletion-variant signatures.

Method: fingerprints of 64 bits link at ``DISTANCE`` = 4 or fewer differing bits. Cut into 3 segments, one of them differs by
at most one bit (4 // 3 = 1), so its variants with one bit wildcarded meet. Each fingerprint is filed under its 64 variants (a
wildcard position and the rest of that segment), equal keys meet, and each pair that meets is verified.

Copies are merged first: the index holds each distinct fingerprint once, so a group of copies of any size is one entry. Of the
verified pairs of a key a spanning forest leaves the task, so a dense group makes as many links as it has members and not their
square, and connects the same. A key with more than ``HOT`` fingerprints is dealt out in blocks, each pair of which is compared
in a task of its own. Links feed a distributed component search. Nothing is collected on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import lean, materialise
from .components import components
from .rows import named, without

DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
SEED = 42
HOT = 20_000  # rows of a variant that are compared in one task, at most
HELD = 1 << 18  # rows that a task compares at once, about


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64 majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space divides
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(begins, ends[shingle - 1 :].tolist(), strict=True)]
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[i : i + (1 << 16)], dtype=np.uint64)
        count += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, fp (the fingerprint's 64 bits as a signed long). Null text has no words, so 0."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def variant_keys(column: str = "fp", first: int = 0) -> list[Column]:
    """The 64 one-wildcard variants of the three segments; a key holds ``first`` and the wildcard's position above bit 32."""
    keys = []
    for begin, bits in SEGMENTS:
        for bit in range(bits):
            kept = ((1 << bits) - 1) & ~(1 << bit)
            segment = F.shiftrightunsigned(column, begin).bitwiseAND(F.lit(kept).cast("long"))
            keys.append(segment + F.lit((first + begin + bit) << 32).cast("long"))
    return keys


def dealt(index: DataFrame, node: str, hot: int) -> DataFrame:
    """``index`` (key, ``node``, ...) with the rows of a key with more than ``hot`` dealt out in blocks, a key for each two blocks."""
    heavy = materialise(index.groupBy("key").count().where(F.col("count") > hot), "hot-variants")
    if heavy.isEmpty():
        return index
    blocks = F.ceil(F.col("count") / (hot // 2)).cast("long")
    split = index.join(heavy, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    split = split.select("*", F.explode(pairs).alias("pair")).withColumn("key", F.xxhash64("key", "pair.i", "pair.j"))
    return index.join(heavy, "key", "left_anti").unionByName(split.select(index.columns))


def forest(key: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Positions (i, j) of pairs with one key at ``distance`` or fewer differing bits: a spanning forest of all such pairs.

    Keys are sorted. Every row is compared with those that follow it under its key, all rows at once; a pair that is connected
    already makes no edge, so a group of n makes n - 1 edges at most.
    """
    parent = np.arange(len(key))
    edges = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    i, step = np.arange(len(key)), 0
    while len(i):
        step += 1
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        j = i + step
        close = (parent[i] != parent[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= distance)
        for x, y in zip(i[close].tolist(), j[close].tolist(), strict=True):
            one, two = root(x), root(y)
            if one != two:
                parent[max(one, two)] = min(one, two)
                edges.append((x, y))
        if close.any():
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return edges


def links(nodes: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (fp) at ``distance`` or fewer differing bits that connect all that such pairs do.

    Fingerprints that share a variant meet in one task and are compared there; a spanning forest of the close ones leaves it.
    """
    if distance // len(SEGMENTS) > 1:
        raise ValueError("with three segments a distance of up to 5 is complete")

    def run(batches):
        held = None
        for batch in batches:
            part = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            held = part if held is None else np.concatenate([held, part])
            if len(held) >= HELD and held[0, 0] != held[-1, 0]:
                last = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last key may go on
                yield compared(held[:last])
                held = held[last:]
        if held is not None and len(held):
            yield compared(held)

    def compared(rows: np.ndarray) -> pa.RecordBatch:
        pairs = np.array(forest(rows[:, 0], np.ascontiguousarray(rows[:, 1]).view(np.uint64), distance), dtype=np.int64).reshape(-1, 2)
        ends = np.sort(rows[pairs, 1], axis=1)
        ends = np.unique(ends, axis=0) if len(ends) else ends
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    index = nodes.select(F.explode(F.array(*variant_keys())).alias("key"), "fp")
    met = dealt(index, "fp", hot).repartition("key").sortWithinPartitions("key")
    return met.select("key", "fp").mapInArrow(lean(run), "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 4, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row: doc_id, fp, component_id (the smallest id reachable over links, its own included).

    Null, empty and blank texts share the fingerprint 0 and link like any other. Rows without an id take part and get their
    component's id. Repeated rows give repeated results. An empty table gives an empty result; other columns are ignored.
    """
    marked = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes, distance, hot))
    linked = found.join(nodes, found["node"] == nodes["fp"]).select("node", "component", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(linked.join(least, "component").select(F.col("node").alias("fp"), "component_id"), "classes")
    own = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    own = materialise(own, "own")  # so that the join reads both sides from a shuffle and AQE can split a hot fingerprint
    return marked.join(own, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, all its columns unchanged: the one with the smallest id, of rows that repeat it one.

    Rows are told apart by their place; a row without an id gives way to any other.
    """
    rows, row = named(docs, F.col(id_col).isNull(), F.col(id_col))
    gone = near_groups(rows, shingle, distance, row, text_col).where("doc_id <> component_id").select("doc_id")
    return without(rows, row, gone, docs.columns)


def op6_simhash_near_dedup(spark, sf_dir):
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
