"""Removal of repeated byte strings by sorting suffixes, deep-shallow.

A byte goes if a string of ``LENGTH`` bytes that covers it starts at another place too. Sorting every suffix would move the
corpus hundreds of times over, so suffixes are sorted at anchors only. The anchor of a string is the start of the ``GRAM``-byte
run in it with the least hash (the first of equals); it depends on the string's bytes alone, so equal strings have their anchor
at the same offset. Each anchor owns the strings, starting at consecutive bytes, whose anchor it is.

1. Each task lists the anchors of its documents, with a hash of the anchor's run.
2. Runs that start at one place only are dropped. Of the other anchors the owned bytes are read; those with equal bytes, by
   content, form a class. They are merged before anything is grouped, so a passage that a third of the documents share is one row.
3. The classes of a run are sorted: the suffixes right of the anchor and, read backwards, left of it. Multikey quicksort orders
   them to a shallow depth, blind tries order what still agrees there. The common prefixes of neighbours in both orders tell which
   owned strings are equal to one of another class; those of a class with two places or more all repeat.
4. Covered strings become byte spans of all places of their class, and the spans are cut out.

A run with more than ``GROUP`` classes is split before it is sorted: by the offset of the anchor in the string, into ranges, and
in each range by the bytes left and right of the run that all its strings hold. Equal strings stay together, a class that looks
like another one in a range merges with it there, and ranges of one offset have nothing left to sort. So a line that any number of
documents share is spread over tasks. Hashes only bring strings together; contents decide.

Copies of a whole text are one text to these steps; they are covered whole. A text's key is its SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, lean, materialise, release_shuffles
from .rows import named

LENGTH, GRAM = 400, 200
REACH = LENGTH - GRAM  # bytes that an anchor may be into a string, at most
BLOCK = 1 << 19  # bytes whose anchors are found at once
GROUP = 256  # classes of a run that are sorted together, at most
WIDTHS = (26, 1)  # anchor offsets in a range when a run is split, and split again
PAIRS = 12  # up to so many classes are compared in pairs, by their common prefixes
SHALLOW = 12  # bytes that multikey quicksort looks at beyond the common run
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_MASK = (1 << 64) - 1
_AT = 24  # bits of a position within a block


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors:
    """Finds anchors in byte blocks. Hashes are of content only, the same in every task."""

    def __init__(self):
        self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        def powers(of: int) -> np.ndarray:
            steps = np.full(n + 1, of, dtype=np.uint64)
            steps[0] = 1
            return np.cumprod(steps)

        self.power, self.back = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))

    def find(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts ``raw[begins[i]:ends[i]]``, one after another: run hash, text, anchor, first and last owned start, the last
        three counted from the text's begin."""
        n = len(raw)
        if n > len(self.power) - 1:
            self._grow(max(n, 2 * len(self.power)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[raw] * self.power[:n])])
        start = np.arange(n - GRAM + 1)
        run = _mix((total[GRAM:] - total[: n - GRAM + 1]) * self.back[: n - GRAM + 1])
        packed = (run >> np.uint64(_AT) << np.uint64(_AT)) | start.astype(np.uint64)
        width = REACH + 1
        blocks = -(-len(packed) // width) * width
        padded = np.full(blocks, _MASK, dtype=np.uint64)
        padded[: len(packed)] = packed
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        sizes = ends - begins
        counts = sizes - LENGTH + 1  # strings of each text
        text = np.repeat(np.arange(len(begins)), counts)
        first = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + begins[text]
        least = np.minimum(behind[first], ahead[np.minimum(first + width - 1, blocks - 1)])
        anchor = (least & np.uint64((1 << _AT) - 1)).astype(np.int64)
        change = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(text) != 0)]))
        last = np.concatenate([change[1:] - 1, [len(first) - 1]])
        low, high, anchor, text = first[change], first[last], anchor[change], text[change]
        base = begins[text]
        return run[anchor].view(np.int64), text, anchor - base, low - base, high - base


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(run, key, place) of texts (key, text); place packs the anchor, its offset in the first owned string and the number of
    owned strings less 1 as anchor * 2^18 + offset * 2^9 + number."""

    def run(batches):
        anchors = Anchors()
        keys, texts, held = [], [], 0

        def found():
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            runs, text, anchor, low, high = anchors.find(np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends)
            shift = np.array([s for _, s in keys], dtype=np.int64)[text]
            place = ((anchor + shift) << 18) + ((anchor - low) << 9) + (high - low)
            key = pa.array([k for k, _ in keys], pa.binary()).take(pa.array(text))
            return pa.RecordBatch.from_arrays([pa.array(runs), key, pa.array(place)], names=["run", "key", "place"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode()
                for shift in range(0, len(raw) - LENGTH + 1, BLOCK):  # a piece has the strings that start in its block
                    piece = raw[shift : shift + BLOCK + LENGTH - 1]
                    keys.append((key, shift))
                    texts.append(piece)
                    held += len(piece)
                    if held >= BLOCK:
                        yield found()
                        keys, texts, held = [], [], 0
        if texts:
            yield found()

    return docs.select("key", "text").mapInArrow(lean(run), "run long, key binary, place long")


# ---- sorting


def _common(a: bytes, b: bytes, depth: int) -> int:
    """Length of the common prefix, known to be ``depth`` at least."""
    low, high = depth, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while low + 1 < high:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Node:
    __slots__ = ("children", "depth", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.children = depth, leaf, None


def blind_trie(strings: list[bytes], members: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Order of strings that agree on ``depth`` bytes, and each one's common prefix with the one before it.

    A node keeps the depth at which its strings part and one child a byte, not the bytes skipped: a new string walks down
    blindly to some leaf, is compared with that leaf's string once, and is put in where their common prefix ends. The end of a
    string counts as byte -1; equal strings share a leaf.
    """

    def byte(i: int, at: int) -> int:
        return strings[i][at] if at < len(strings[i]) else -1

    root = _Node(len(strings[members[0]]), members[0])
    same: dict[int, list[int]] = {members[0]: [members[0]]}
    for new in members[1:]:
        node, path = root, [root]
        while node.children is not None:
            node = node.children.get(byte(new, node.depth)) or next(iter(node.children.values()))
            path.append(node)
        leaf = node.leaf
        shared = _common(strings[new], strings[leaf], depth)
        if shared == len(strings[new]) == len(strings[leaf]):
            same[leaf].append(new)
            continue
        same[new] = [new]
        fresh = _Node(len(strings[new]), new)
        above = next(i for i, node in enumerate(path) if node.children is None or node.depth >= shared)
        node = path[above]
        if node.children is not None and node.depth == shared:
            node.children[byte(new, shared)] = fresh
            continue
        fork = _Node(shared, leaf)
        fork.children = {byte(leaf, shared): node, byte(new, shared): fresh}
        if above:
            before = path[above - 1]
            before.children[byte(leaf, before.depth)] = fork
        else:
            root = fork
    order, prefix = [], []
    stack: list[tuple[_Node, int]] = [(root, depth)]
    while stack:
        node, shared = stack.pop()
        if node.children is None:
            for i, member in enumerate(same[node.leaf]):
                order.append(member)
                prefix.append(len(strings[member]) if i else shared)
            continue
        inner = sorted(node.children.items(), reverse=True)
        for i, (_, child) in enumerate(inner):
            stack.append((child, shared if i == len(inner) - 1 else node.depth))
    return order, prefix


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Sorted order of strings that agree on ``depth`` bytes, and common prefixes with the string before (0 for the first)."""
    order, prefix = [], []
    limit = depth + shallow
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), depth, depth)]
    while stack:  # members, the depth to look at, their common prefix with what stands before them
        members, at, shared = stack.pop()
        if len(members) == 1:
            order.append(members[0])
            prefix.append(shared)
            continue
        if at >= limit:
            inner, common = blind_trie(strings, members, at)
            common[0] = shared
            order += inner
            prefix += common
            continue
        ends = [m for m in members if len(strings[m]) <= at]
        rest = [m for m in members if len(strings[m]) > at] if ends else members
        parts: list[tuple[list[int], int]] = [(ends, -1)] if ends else []
        if rest:
            pivot = sorted((strings[rest[0]][at], strings[rest[len(rest) // 2]][at], strings[rest[-1]][at]))[1]
            less = [m for m in rest if strings[m][at] < pivot]
            more = [m for m in rest if strings[m][at] > pivot]
            parts += [(x, step) for x, step in ((less, 0), ([m for m in rest if strings[m][at] == pivot], 1), (more, 0)) if x]
        for i in range(len(parts) - 1, -1, -1):
            some, step = parts[i]
            before = shared if i == 0 else at
            if step < 0:  # strings that end here are equal
                stack.extend(([m], at, before if j == 0 else at) for j, m in reversed(list(enumerate(some))))
            else:
                stack.append((some, at + step, before))
    prefix[0] = 0
    return order, prefix


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans, sorted, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _pairwise(order: list[int], prefix: list[int]) -> dict[tuple[int, int], int]:
    """Common prefix of every pair (i, j), i < j, of a few sorted strings."""
    out = {}
    for x, i in enumerate(order):
        least = 1 << 62
        for y in range(x + 1, len(order)):
            least = min(least, prefix[y])
            j = order[y]
            out[(i, j) if i < j else (j, i)] = least
    return out


def covered_offsets(classes: list[tuple[bytes, int, int]], length: int = LENGTH, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """Per class (owned bytes, anchor's offset in the first owned string, number of owned strings less 1) of one run: the anchor
    offsets, as half-open intervals, of those owned strings that another class owns too."""
    n = len(classes)
    if n < 2:
        return [[] for _ in classes]
    same = {c[a : a + gram] for c, a, _ in classes}  # two runs may have one hash
    right_order, right_prefix = deep_shallow([c[a:] for c, a, _ in classes], gram if len(same) == 1 else 0)
    left_order, left_prefix = deep_shallow([c[:a][::-1] for c, a, _ in classes])
    low, high = [a - m for _, a, m in classes], [a for _, a, _ in classes]
    out: list[list[tuple[int, int]]] = [[] for _ in classes]
    if n <= PAIRS:  # each pair's common prefixes are the least of those between its places in the orders
        right = _pairwise(right_order, right_prefix)
        left = _pairwise(left_order, left_prefix)
        for (i, j), shared in right.items():
            begin = max(length - shared, low[i], low[j])
            end = min(left[i, j], high[i], high[j]) + 1
            if begin < end:
                out[i].append((begin, end))
                out[j].append((begin, end))
        return [_united(spans) for spans in out]
    right_rank, left_rank = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    low_, high_ = np.array(low), np.array(high)
    right_cut, left_cut = np.array(right_prefix), np.array(left_prefix)
    edges = {*low, *(h + 1 for h in high), *(length - r for r in right_prefix), *(p + 1 for p in left_prefix)}
    edges = sorted(e for e in edges if min(low) <= e <= max(high) + 1)
    for o, following in zip(edges, edges[1:], strict=False):  # between edges nothing changes
        owners = np.flatnonzero((low_ <= o) & (o <= high_))
        if len(owners) < 2:
            continue
        right_rank[right_order] = np.cumsum(right_cut < length - o)
        left_rank[left_order] = np.cumsum(left_cut < o)
        together = right_rank[owners] * (n + 1) + left_rank[owners]
        _, which, count = np.unique(together, return_inverse=True, return_counts=True)
        for i in owners[count[which] > 1].tolist():
            out[i].append((o, following))
    return [_united(spans) for spans in out]


# ---- the operator


def _class_id(content: bytes, offset: int, number: int) -> bytes:
    return hashlib.sha256(offset.to_bytes(2, "big") + number.to_bytes(2, "big") + content).digest()


def _short_hash(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "big", signed=True)


def _sorted_covers(classes: DataFrame) -> DataFrame:
    """(part, id, begin, end): byte spans, relative to the anchor, of repeated strings of classes (part, id, content, offset,
    number, many); a part is a run or a range of one."""

    def run(batches):
        current, rows, some = None, [], []

        def take():
            found = covered_offsets([(content, offset, number) for _, content, offset, number, _ in rows])
            for (name, _, offset, number, many), offsets in zip(rows, found, strict=True):
                spans = [(offset - number, offset + 1)] if many else offsets
                some.extend((current, name, 1 - end, LENGTH - begin) for begin, end in spans)

        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != current and rows:
                    take()
                    rows = []
                current = part
                rows.append(row)
            if len(some) >= 10_000:
                yield _batch(some, covers)
                some = []
        if rows:
            take()
        if some:
            yield _batch(some, covers)

    covers = pa.schema([("part", pa.int64()), ("id", pa.binary()), ("begin", pa.int64()), ("end", pa.int64())])
    ordered = classes.repartition("part").sortWithinPartitions("part")
    return ordered.select("part", "id", "content", "offset", "number", "many").mapInArrow(lean(run), "part long, id binary, begin long, end long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _ranges(classes: DataFrame, width: int) -> DataFrame:
    """Classes (part, id, content, offset, number, many) cut into ranges of ``width`` anchor offsets: (whole_part, whole_id, part,
    id, content, offset, number, many). All strings of a part hold the bytes that its name hashes."""
    schema = pa.schema([("whole_part", pa.int64()), ("whole_id", pa.binary()), ("part", pa.int64()), ("id", pa.binary()), ("content", pa.binary()), ("offset", pa.int32()), ("number", pa.int32()), ("many", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for part, name, content, offset, number, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = offset - number, offset  # of the anchor in the owned strings
                for first in range(low // width * width, high + 1, width):
                    last = min(first + width - 1, REACH)
                    begin, end = max(first, low), min(last, high)
                    held = content[offset - first : offset + LENGTH - last]
                    inner = content[offset - end : offset - begin + LENGTH]
                    name_of_part = _short_hash(first.to_bytes(2, "big") + part.to_bytes(8, "big", signed=True) + held)
                    rows.append((part, name, name_of_part, _class_id(inner, end, end - begin), inner, end, end - begin, many))
                    if len(rows) == 4096:
                        yield _batch(rows, schema)
                        rows = []
            if rows:
                yield _batch(rows, schema)

    return classes.select("part", "id", "content", "offset", "number", "many").mapInArrow(
        lean(run), "whole_part long, whole_id binary, part long, id binary, content binary, offset int, number int, many boolean"
    )


def _one_cover(covers: DataFrame) -> DataFrame:
    """Covers (part, id, begin, end) with those of a class that overlap or touch made one, so that its places meet each byte once.
    A class has at most one cover a range and string, within fewer than two lengths of bytes."""
    each = covers.groupBy("part", "id").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))

    def add(done, span):
        last = F.element_at(done, -1)
        grown = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))
        return F.when(span["begin"] <= last["end"], joined).otherwise(F.concat(done, F.array(span)))

    spans = F.aggregate(F.slice("spans", 2, F.size("spans")), F.slice("spans", 1, 1), add)
    return each.select("part", "id", F.explode(spans).alias("span")).select("part", "id", "span.begin", "span.end")


def _covers(classes: DataFrame, group: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``_sorted_covers`` of classes in parts of any size: those of more than ``group`` are cut into ranges first."""
    if not widths:
        return materialise(_sorted_covers(classes), "covers")
    hot = materialise(classes.groupBy("part").count().where(F.col("count") > group).select("part"), "hot")
    if hot.isEmpty():
        return materialise(_sorted_covers(classes), "covers")
    cut = materialise(_ranges(classes.join(hot, "part", "left_semi"), widths[0]), "ranges")
    other = F.xxhash64("whole_part", "whole_id")  # two of these that a part merges have one hash by chance only once in 2^64
    merged = cut.groupBy("part", "id", "content", "offset", "number").agg((F.max("many") | (F.min(other) != F.max(other))).alias("many"))
    merged = materialise(merged, "merged")
    found = _covers(merged, group, widths[1:])
    back = cut.select("whole_part", "whole_id", "part", "id").join(found, ["part", "id"])
    back = _one_cover(back.select(F.col("whole_part").alias("part"), F.col("whole_id").alias("id"), "begin", "end"))
    covers = materialise(_sorted_covers(classes.join(hot, "part", "left_anti")).unionByName(back), "covers")
    for table in (hot, cut, merged, found):
        discard(table)
    return covers


def _contexts(docs: DataFrame, wanted: DataFrame, row: str) -> DataFrame:
    """(part, id, key, place, content, offset, number) of all places of ``wanted`` (row, places), read from their texts."""
    schema = pa.schema([("part", pa.int64()), ("id", pa.binary()), ("key", pa.binary()), ("place", pa.int64()), ("content", pa.binary()), ("offset", pa.int32()), ("number", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = []
            for key, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                for p in places:
                    place = p["place"]
                    anchor, offset, number = place >> 18, (place >> 9) & 511, place & 511
                    content = raw[anchor - offset : anchor - offset + number + LENGTH]
                    rows.append((p["run"], _class_id(content, offset, number), key, place, content, offset, number))
                    if len(rows) == 4096:
                        yield _batch(rows, schema)
                        rows = []
            if rows:
                yield _batch(rows, schema)

    joined = docs.join(wanted.select(F.col(row).alias("__wanted"), "places"), F.col(row) == F.col("__wanted"))
    return joined.select("key", "text", "places").mapInArrow(lean(run), "part long, id binary, key binary, place long, content binary, offset int, number int")


def repeated_spans(docs: DataFrame, row: str, group: int = GROUP) -> DataFrame:
    """(key, spans): sorted, disjoint byte spans [begin, end) of repeated strings, for texts (key, text) with any.

    ``docs`` is from ``_keyed``; copies have one key and aren't compared with each other here.
    """
    spark = docs.sparkSession
    long = docs.where(F.octet_length("text") >= LENGTH)
    anchors = materialise(_anchor_rows(long), "anchors")
    spot = F.xxhash64("key", "place")  # compared within a run or class only, where two have one hash by chance once in 2^64
    again = anchors.groupBy("run").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("run")
    again = materialise(again, "again")  # so that the join reads both sides from a shuffle, which AQE can split at a hot run
    dups = anchors.join(again, "run", "left_semi")
    firsts = long.groupBy("key").agg(F.min(row).alias(row))
    wanted = dups.groupBy("key").agg(F.collect_set(F.struct("run", "place")).alias("places")).join(firsts, "key").drop("key")
    contexts = materialise(_contexts(long, wanted, row), "contexts")
    discard(anchors)
    discard(again)
    release_shuffles(spark)
    classes = contexts.groupBy("part", "id", "content", "offset", "number").agg((F.min(spot) != F.max(spot)).alias("many"))
    classes = materialise(classes, "classes")
    release_shuffles(spark)
    covers = _covers(classes, group)
    places = contexts.select("part", "id", "key", "place").join(covers, ["part", "id"])
    anchor = F.shiftright("place", 18)
    places = places.select("key", (anchor + F.col("begin")).alias("begin"), (anchor + F.col("end")).alias("end"))
    longest = places.groupBy("key", "begin").agg(F.max("end").alias("end"))
    spans = longest.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    spans = materialise(spans, "spans")
    for table in (contexts, classes, covers):
        discard(table)
    release_shuffles(spark)
    return spans


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(doc_id, text, key, row) and the name of the last: null text is empty, the key is the text's SHA-256, row its place."""
    rows, row = named(docs)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(row).alias("__row"))
    return rows.withColumn("key", F.unhex(F.sha2("text", 256))), "__row"


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, spans (removed runs [begin, end)), kept (binary, null if nothing was removed),
    text_sha256 (of the text, if it lost nothing or all).

    Lengths and spans count UTF-8 bytes; a character may be cut. Null text is empty. Rows that repeat a text are copies of each
    other and lose all their bytes if these are ``LENGTH`` or more, whatever their ids. An empty table gives an empty result;
    columns other than the two named are ignored. Rows without an id take part like any other.
    """
    rows, row = _keyed(docs, id_col, text_col)
    copies = rows.where(F.octet_length("text") >= LENGTH).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("copied"))
    copies = materialise(copies, "copies")
    spans = repeated_spans(rows, row, group).join(copies, "key", "left_anti")
    spans = materialise(spans, "own-spans")

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            n_bytes, removed, out, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                cuts = _united([(s["begin"], s["end"]) for s in found])
                parts, at = [], 0
                for begin, end in cuts:
                    parts.append(raw[at:begin])
                    at = end
                parts.append(raw[at:])
                n_bytes.append(len(raw))
                removed.append(sum(e - b for b, e in cuts))
                out.append([{"begin": b, "end": e} for b, e in cuts])
                kept.append(b"".join(parts))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())], names=schema.names
            )

    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(c, k) for c, k in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", span), ("kept", T.BinaryType()))]
    )
    cut = rows.join(spans, "key").select("doc_id", "text", "spans").mapInArrow(lean(run), schema)
    size = F.octet_length("text").cast("long")
    narrow = rows.select("doc_id", "key", size.alias("n_bytes"))
    gone = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    text_sha256 = F.lower(F.hex("key")).alias("text_sha256")
    copied = narrow.join(copies, "key").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), gone.alias("spans"), F.lit(b"").alias("kept"), text_sha256)
    fine = narrow.join(copies.select("key").unionByName(spans.select("key")), "key", "left_anti").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast(span).alias("spans"), F.lit(None).cast("binary").alias("kept"), text_sha256
    )
    return cut.withColumn("text_sha256", F.lit(None).cast("string")).unionByName(copied).unionByName(fine)


def op8_suffix_dedup(spark, sf_dir):
    cut = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.when(F.col("kept").isNull(), F.col("text_sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"),
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"),
    )


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by a table of all strings: for tests."""
    raws = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            count[raw[i : i + length]] = count.get(raw[i : i + length], 0) + 1
    out = []
    for raw in raws:
        spans = _united([(i, i + length) for i in range(len(raw) - length + 1) if count[raw[i : i + length]] > 1])
        kept, at = b"", 0
        for begin, end in spans:
            kept, at = kept + raw[at:begin], end
        kept += raw[at:]
        out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out
