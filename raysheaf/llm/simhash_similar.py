"""Near-duplicates by similarity: SimHash signatures, one-wildcard variants, and verified Jaccard similarity.

``simhash`` links fingerprints at a few differing bits, which finds copies with a handful of edits. A similarity of 0.8 over
word shingles is farther: its expected distance is 39 of 256 bits. So two signatures are kept. A 128-bit SimHash of the distinct
words, which few edits move little, is filed under the one-wildcard variants of its six segments and finds candidates. A
256-bit SimHash of the word shingles ranks them, and what its distance lets through is verified on the sets of shingles.

Signatures alone miss pairs, above all those that differ by a passage. So a second search is exact, over the texts that the
first has left apart: two sets of that similarity share one of the first shingles of each in any common order (prefix filter),
so an equality join on these shingles meets every such pair. Sizes and places in the order rule out pairs that can't reach the
similarity; all others that are still apart are verified. The order puts shingles that are frequent in a sample last, which
decides how many pairs meet but not which of them link. Before texts are read for a pair that meets, a sketch of each set bounds
what two can share: the parities of how many hashes fall on each of some bits differ in no more bits than the sets in elements.

Rows of a variant are compared where they meet, and only the edges of a minimum spanning tree leave the task: every row's
closest links among the pairs that count there (a pair counts at one of the variants it shares), so a group of n near copies
makes a few edges a row and not n^2 of them, and a row that is similar to any other meets the verification with its closest one. An edge that fails there isn't replaced:
what it leaves apart is left to the exact search, which thins out nothing. A variant with more than ``HOT`` rows is dealt out in blocks, each pair of which
is compared in a task of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, lean, materialise, release_shuffles, send
from .components import components
from .rows import likely, named, pieces, without
from .simhash import HOT, SEGMENTS, dealt, variant_keys

BITS = 256
NAMES = ("fp", "fp2", "f0", "f1", "f2", "f3")
SLACK = 14  # bits beyond the expected distance of the threshold: two and a half standard deviations
HELD = 100_000  # links that a task holds before it passes them on
SAMPLE_DOCS = 10_000  # documents whose shingles are counted for the order: those with the smallest hashes of their ids
COMMON = 1 << 17  # shingles that the order puts last


def distance_of(similarity: float) -> int:
    """The distance of 256-bit SimHashes up to which documents link, for a Jaccard similarity."""
    cosine = 2 * similarity / (1 + similarity)
    return math.floor(BITS * math.acos(cosine) / math.pi) + SLACK


def _majority(digests: list[bytes], bits: int) -> np.ndarray:
    count = np.zeros(bits, dtype=np.int64)
    for i in range(0, len(digests), 1 << 14):
        some = np.frombuffer(b"".join(digests[i : i + (1 << 14)]), np.uint8).reshape(-1, bits // 8)
        count += np.unpackbits(some, axis=1).sum(0, dtype=np.int64)
    return np.packbits(count * 2 > len(digests)).view(np.int64)


def shingles_of(text: str | None, shingle: int) -> set[bytes]:
    """Runs of ``shingle`` words (ASCII lower case, parted by ASCII white space); of fewer words the whole; of none nothing."""
    words = (text or "").encode().lower().split()
    joined, n = b" ".join(words), len(words)
    if not n:
        return set()
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    size = min(shingle, n)
    begins = (ends - lengths)[: n - size + 1].tolist()
    return {joined[i:j] for i, j in zip(begins, ends[size - 1 :].tolist(), strict=True)}


def signature(text: str | None, shingle: int) -> tuple[tuple[int, ...], np.ndarray]:
    """(2 x 64 bits of the distinct words, 4 x 64 bits of the shingles), zeros without words; the shingles' 64-bit hashes."""
    import xxhash

    parts = shingles_of(text, shingle)
    if not parts:
        return (0,) * len(NAMES), np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh3_128_digest
    halves = [digest(p, 1) for p in parts]
    wide = _majority([h + digest(p, 2) for h, p in zip(halves, parts, strict=True)], BITS)
    narrow = _majority([digest(w, 42) for w in set(text.encode().lower().split())], 128)
    return (*narrow.tolist(), *wide.tolist()), np.unique(np.frombuffer(b"".join(halves), np.uint64)[::2])


def common_shingles(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, how many documents of a bounded sample hold each), of the most frequent ones."""

    def run(batches):
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            found = [signature(t.as_py(), shingle)[1] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], names=["shingle"])

    rank = F.xxhash64(id_col)
    last = docs.select(rank.alias("rank")).orderBy("rank").limit(SAMPLE_DOCS).agg(F.max("rank")).first()[0]
    some = docs.where(rank <= F.lit(last)).limit(SAMPLE_DOCS).select(id_col, text_col).mapInArrow(lean(run), "shingle long")
    counts = some.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    hashes, count = (counts.column(i).to_numpy() for i in range(2))
    hashes = hashes.astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], count[order]


def prefix_of(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles in the common order, one of which any set of that similarity has among its own."""
    known, count = common
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, count[at], 0)
    most = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, rank))][:most]


def sketch_of(hashes: np.ndarray) -> bytes:
    """Bits, whether an odd number of the hashes falls on each: a power of two of them, 64 or more and one a hash or more."""
    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def apart_at_least(one: bytes, two: bytes) -> int:
    """How many elements two sets differ in at least, by their sketches; the longer one is folded to the shorter one's bits."""
    x, y = sorted((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum(dtype=np.int64))


def signatures(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row per row: doc_id, fp and fp2 (of the words), f0 .. f3 (of the shingles), node (of the set of shingles), size (of
    that set), prefix (its first shingles) and sketch."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            *(T.StructField(c, T.LongType()) for c in (*NAMES, "node", "size")),
            T.StructField("prefix", T.ArrayType(T.LongType())),
            T.StructField("sketch", T.BinaryType()),
        ]
    )
    sent = send(docs.sparkSession, common_shingles(docs, shingle, id_col, text_col))

    def run(batches):
        import xxhash

        common = sent()
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            found = [signature(t.as_py(), shingle) for t in batch.column(1)]
            bits = np.array([f for f, _ in found], dtype=np.int64).reshape(-1, len(NAMES))
            nodes = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for _, h in found], dtype=np.uint64).view(np.int64)
            prefixes = [prefix_of(h, common, similarity).view(np.int64) for _, h in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(bits[:, i]) for i in range(len(NAMES))),
                    pa.array(nodes),
                    pa.array([len(h) for _, h in found], pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array([sketch_of(h) for _, h in found], pa.binary()),
                ],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def _meeting(differ: np.ndarray) -> np.ndarray:
    """The wildcard position at which a pair counts, from its differing word bits: of the first segment with at most one, that
    bit, or the segment's first bit if none differs."""
    out = np.full(differ.shape, -1, dtype=np.int64)
    for begin, bits in reversed(SEGMENTS):
        part = differ & np.uint64(((1 << bits) - 1) << begin)
        lowest = np.bitwise_count((part & (~part + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        out = np.where(np.bitwise_count(part) <= 1, np.where(part == 0, begin, lowest), out)
    return out


def _tree(words: np.ndarray, bits: np.ndarray, at: int | None, most: int) -> list[tuple[int, int]]:
    """Edges of at most ``most`` differing bits of a minimum spanning forest (Prim's algorithm), over the pairs that count at
    wildcard position ``at`` (None: all)."""

    def distance(i: int, others: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64)
        return d if at is None else np.where(_meeting(words[others] ^ words[i]) == at, d, BITS + 1)

    left = np.arange(1, len(bits))
    best, parent = distance(0, left), np.zeros(len(left), dtype=np.int64)
    edges = []
    while len(left):
        k = int(best.argmin())
        i = int(left[k])
        if best[k] <= most:
            edges.append((int(parent[k]), i))
        left, best, parent = np.delete(left, k), np.delete(best, k), np.delete(parent, k)
        if len(left):
            d = distance(i, left)
            closer = d < best
            best[closer], parent[closer] = d[closer], i
    return edges


def _linked(rows: DataFrame, most: int) -> DataFrame:
    """(a, b), a < b: tree edges among rows (key, at, node, words, f0 .. f3) that share a key; a pair counts at one key of a half."""

    def run(batches):
        found: set[tuple[int, int]] = set()
        held = None
        for batch in batches:
            part = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            held = part if held is None else np.concatenate([held, part])
            if not len(held):
                continue
            begins = np.concatenate([[0], np.flatnonzero(np.diff(held[:, 0])) + 1])
            compare(held[: begins[-1]], begins[:-1], found)  # the last key may go on
            held = held[begins[-1] :]
            if len(found) > HELD:
                yield pairs(found)
                found = set()
        if held is not None and len(held):
            compare(held, np.zeros(1, dtype=np.int64), found)
        yield pairs(found)

    def pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def compare(some: np.ndarray, begins: np.ndarray, found: set[tuple[int, int]]) -> None:
        sizes = np.diff(np.concatenate([begins, [len(some)]]))
        at, node, words, bits = some[:, 1], some[:, 2], some[:, 3].astype(np.uint64), np.ascontiguousarray(some[:, 4:]).view(np.uint64)
        two = begins[sizes == 2]
        if len(two):
            near = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1, dtype=np.int64) <= most
            near &= _meeting(words[two] ^ words[two + 1]) == at[two]
            for i in two[near].tolist():
                found.add((int(min(node[i : i + 2])), int(max(node[i : i + 2]))))
        for i, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            for j, k in _tree(words[i : i + n], bits[i : i + n], int(at[i]), most):
                x, y = int(node[i + j]), int(node[i + k])
                found.add((min(x, y), max(x, y)))

    return rows.select("key", "at", "node", "words", "f0", "f1", "f2", "f3").mapInArrow(lean(run), "a long, b long")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of texts (node, text): the sorted distinct 64-bit hashes of the shingles, packed."""

    def run(batches):
        import xxhash

        for batch in (part for whole in batches for part in pieces(whole, 1)):
            sets = [np.unique(np.array([xxhash.xxh3_64_intdigest(p) for p in shingles_of(t.as_py(), shingle)], dtype=np.uint64)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(lean(run), "node long, shingles binary")


def verified(edges: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The edges (a, b) whose texts have that Jaccard similarity over their sets of shingles. ``docs``: row, text; ``firsts``: node
    and one row that has its text."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(ends.join(firsts, "node").select("node", F.col("row").alias("first")), "ends")
    marked, perhaps = likely(docs, "row", wanted.select("first"))
    texts = marked.where(perhaps).hint("merge").join(wanted, F.col("row") == F.col("first")).select("node", "text")
    sets = materialise(_shingle_sets(texts, shingle), "shingles")
    release_shuffles(docs.sparkSession)
    both = edges.hint("merge").join(sets.toDF("a", "one"), "a").hint("merge").join(sets.toDF("b", "two"), "b")  # as at a large size

    def run(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kept = materialise(both.select("a", "b", "one", "two").mapInArrow(lean(run), "a long, b long"), "verified")
    for table in (wanted, sets):
        discard(table)
    release_shuffles(docs.sparkSession)
    return kept


def possible(edges: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose sets can have that similarity by the sketches and sizes of ``nodes`` (node, size, sketch)."""
    sketches = nodes.select("node", "size", "sketch")
    both = edges.hint("merge").join(sketches.toDF("a", "n", "one"), "a").hint("merge").join(sketches.toDF("b", "m", "two"), "b")

    def run(batches):
        for batch in batches:
            both = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            differ = [apart_at_least(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(5), strict=True)]
            shared = (both - np.array(differ, dtype=np.int64)) / 2  # at most
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(shared >= similarity * (both - shared) - 1e-9))

    return both.select("a", "b", "n", "one", "m", "two").mapInArrow(lean(run), "a long, b long")


def similar_links(nodes: DataFrame, similarity: float, hot: int = HOT) -> DataFrame:
    """(a, b): links between nodes (node, fp, fp2, f0 .. f3) whose words meet in a variant and whose shingles look that similar."""
    half = F.col("key") >= F.lit(64 << 32)
    index = nodes.select(F.explode(F.array(*variant_keys("fp"), *variant_keys("fp2", 64))).alias("key"), *nodes.columns).select(
        "key", F.shiftright("key", 32).bitwiseAND(63).alias("at"), "node", F.when(half, F.col("fp2")).otherwise(F.col("fp")).alias("words"), "f0", "f1", "f2", "f3"
    )
    return _linked(dealt(index, "node", hot).repartition("key").sortWithinPartitions("key"), distance_of(similarity))


def _apart(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: all pairs among rows (key, size, left, component, node) that share a key, are of different components and
    can have that similarity. ``left`` counts the shingles from the key on, in the common order, so at the first key that two
    sets share they have at most the smaller ``left`` of both in common."""

    def run(batches):
        held, found, n = None, [], 0
        for batch in batches:
            part = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            held = part if held is None else np.concatenate([held, part])
            if not len(held):
                continue
            last = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last key may go on
            for some in compare(held[:last]):
                found.append(some)
                n += len(some)
                if n > HELD:
                    yield pairs(found)
                    found, n = [], 0
            held = held[last:]
        if held is not None and len(held):
            for some in compare(held):
                found.append(some)
                n += len(some)
                if n > HELD:
                    yield pairs(found)
                    found, n = [], 0
        yield pairs(found)

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def compare(some: np.ndarray):
        key, size, left, component, node = np.ascontiguousarray(some.T)
        i, d = np.arange(len(key)), 0
        while len(i):  # row i meets row i + d; sizes ascend within a key, so a row that is too small stays so
            d += 1
            i = i[i + d < len(key)]
            i = i[(key[i] == key[i + d]) & (size[i] >= similarity * size[i + d] - 1e-9)]
            j = i + d
            need = similarity / (1 + similarity) * (size[i] + size[j]) - 1e-9
            near = (component[i] != component[j]) & (np.minimum(left[i], left[j]) >= need)
            x, y = node[i[near]], node[j[near]]
            if len(x):
                yield np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)

    return rows.select("key", "size", "left", "component", "node").mapInArrow(lean(run), "a long, b long")


def links_apart(nodes: DataFrame, groups: DataFrame, similarity: float, hot: int = HOT) -> DataFrame:
    """(a, b): every pair of nodes (node, size, prefix) in different components of ``groups`` (node, component; a node that it
    lacks is one of its own) whose sets may have that similarity. No pair that has it is missing."""
    rows = nodes.join(groups, "node", "left").select("node", "size", F.coalesce("component", "node").alias("component"), F.posexplode("prefix").alias("at", "key"))
    index = rows.select("key", "size", (F.col("size") - F.col("at")).alias("left"), "component", "node")
    return _apart(dealt(index, "node", hot).repartition("key").sortWithinPartitions("key", "size"), similarity)


def _groups(rows: DataFrame, row: str, shingle: int, similarity: float, text_col: str, hot: int) -> DataFrame:
    """(row, component): every row with the least row that it reaches over links."""
    spark = rows.sparkSession
    marked = materialise(signatures(rows, shingle, row, text_col, similarity).withColumnRenamed("doc_id", "row"), "signatures")
    nodes = marked.groupBy("node", *NAMES).agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes, "nodes")
    firsts, members = materialise(nodes.select("node", "row"), "firsts"), materialise(marked.select("row", "node"), "members")
    discard(marked)  # what is wide goes as soon as it has been read
    release_shuffles(spark)
    docs = rows.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    edges = materialise(similar_links(nodes.select("node", *NAMES), similarity, hot).distinct(), "edges")
    release_shuffles(spark)
    near = verified(edges, docs, firsts, shingle, similarity)
    found = components(near)
    met = materialise(links_apart(nodes, found, similarity, hot).distinct(), "met")
    release_shuffles(spark)
    apart = materialise(possible(met, nodes, similarity), "apart")
    discard(met)
    discard(nodes)
    release_shuffles(spark)
    missed = verified(apart, docs, firsts, shingle, similarity)
    if not missed.isEmpty():
        found = components(near.unionByName(missed))
    linked = found.join(firsts, "node")
    least = linked.groupBy("component").agg(F.min("row").alias("least"))
    classes = materialise(linked.join(least, "component").select("node", "least"), "classes")
    own = firsts.join(classes, "node", "left").select("node", F.coalesce("least", "row").alias("component"))
    own = materialise(own, "own")
    out = materialise(members.join(own, "node").select("row", "component"), "groups")
    for table in (firsts, members, edges, near, apart, missed, classes, own):
        discard(table)
    release_shuffles(spark)
    return out


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row: doc_id and component_id, the smallest id reachable over links (its own included).

    Null, empty and blank texts have the same signature and are one. Rows are told apart by their place: an id with two texts is
    in two groups, repeated rows give repeated results, rows without an id take part and give way to any id. An empty table gives
    an empty result; other columns are ignored.
    """
    rows, row = named(docs, F.col(id_col).isNull(), F.col(id_col))
    out = _groups(rows, row, shingle, similarity, text_col, hot)
    return out.select(F.col("row.rank1").alias("doc_id"), F.col("component.rank1").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, all its columns unchanged: the one with the smallest id, of rows that repeat it one.

    Rows are told apart by their place, so repeated ids are no harm; a row without an id gives way to any other.
    """
    rows, row = named(docs, F.col(id_col).isNull(), F.col(id_col))
    gone = _groups(rows, row, shingle, similarity, text_col, HOT).where("row <> component").select("row")
    return without(rows, row, gone, docs.columns)
