"""Prefix trie of conversations: which of them begin with the same turns, and what sharing those turns would save.

Method: a conversation is the array of its turns' digests (32 bytes a turn; texts don't move). Arrays are sorted globally by
range, ties by id, so the conversations below a node are neighbours. Each range is swept once: the longest common prefix with the row
before tells which nodes of the stack end and how many new ones begin; what ends folds its sums into the node above and is put
out. A range begins with the open stack of the range before, rebuilt from that range's last row, so every node begins, gets its children
and is found to be a leaf in exactly one range. All sums are additive over ranges then: nodes that lie across a boundary (those on the
paths of first and last rows) are put out in parts, and the parts, few as they are, are added up by digest.

Equal arrays are spread over ranges by id. The ids that end at a node leave a range in pieces of bounded length, which are hashed
in order as a stream. A parent's least id comes by a join on its digest; children of one parent may be many on one side, which
adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import lean, materialise

WIDTH = 32  # bytes of a turn's digest
PIECE = 4096  # ids in a piece of a node's ends
ROOT = bytes(WIDTH)
EMPTY = hashlib.sha256(b"").hexdigest()
COMPLETE, PART, ENDS = 0, 1, 2


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length stands before it, so that no two turns read the same."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def turn_arrays(conv: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, an array of (turn, digest, chars); chars are code points of the text.

    Null role or text is empty; null turns come first; turns that share a number are ordered by digest, and rows that repeat a
    turn are turns of their own. Rows without a conv_id belong to no conversation. Other columns are ignored. A conversation's
    digests have to fit into one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conv.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", turn_digest(role, text).alias("digest"), F.char_length(text).alias("chars")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


class _Node:
    __slots__ = ("digest", "depth", "chars", "opened", "n", "least", "children", "leaves", "saved", "ends", "cut")

    def __init__(self, digest: bytes, depth: int, chars: int, opened: bool):
        self.digest, self.depth, self.chars, self.opened = digest, depth, chars, opened
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.cut = None, [], False


class _Sweep:
    """One range's walk; rows that it puts out gather in ``out``."""

    def __init__(self, last: bool):
        self.last, self.stack, self.seq, self.out = last, [], None, []

    def _open(self, seq: bytes, chars: list[int], opened: bool) -> None:
        for i in range(len(self.stack) - 1, len(chars)):
            above = self.stack[-1]
            above.children += opened
            self.stack.append(_Node(hashlib.sha256(above.digest + seq[i * WIDTH : (i + 1) * WIDTH]).digest(), i + 1, chars[i], opened))

    def carried(self, seq: bytes, chars: list[int]) -> None:
        """The open stack of the range before."""
        self.stack, self.seq = [_Node(ROOT, 0, 0, False)], seq
        self._open(seq, chars, False)

    def row(self, seq: bytes, chars: list[int], conv) -> None:
        if self.seq is None:
            self.stack = [_Node(ROOT, 0, 0, True)]
        elif seq != self.seq:
            common, most = 0, min(len(seq), len(self.seq))
            while common < most and seq[common : common + WIDTH] == self.seq[common : common + WIDTH]:
                common += WIDTH
            if common < len(self.seq):
                self.stack[-1].leaves += 1  # nothing that sorts later can be longer
                while len(self.stack) - 1 > common // WIDTH:
                    self._close(True)
        self.seq = seq
        self._open(seq, chars, True)
        top = self.stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(conv, top.least)
        top.ends.append(conv)
        if len(top.ends) == PIECE:
            self._cut(top)

    def _cut(self, node: _Node) -> None:
        if node.ends:
            self.out.append((ENDS, node.digest, None, None, None, node.ends[0], None, None, None, ",".join(map(str, node.ends))))
            node.ends, node.cut = [], True

    def _close(self, whole: bool) -> None:
        node = self.stack.pop()
        saved = node.saved + node.n * node.chars - (node.chars if node.opened else 0)
        whole = whole and node.opened
        if not whole or node.cut:
            self._cut(node)
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if whole and not node.cut else None
        parent = self.stack[-1] if self.stack else None
        self.out.append((COMPLETE if whole else PART, node.digest, parent.digest if parent else None, node.depth, node.n, node.least, node.children, node.leaves, saved, ends))
        if parent:
            parent.n, parent.leaves, parent.saved = parent.n + node.n, parent.leaves + node.leaves, parent.saved + saved
            if node.least is not None:
                parent.least = node.least if parent.least is None else min(node.least, parent.least)

    def end(self) -> None:
        if self.last and self.stack:
            self.stack[-1].leaves += 1
        while self.stack:
            self._close(self.last)


def _flagged(arrays: DataFrame, parts: int) -> DataFrame:
    """Arrays by range, sorted, with the number of their range and whether they are its last row; written."""
    packed = arrays.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("seq"), F.transform("turns", lambda t: t["chars"]).alias("chars"), "conv_id"
    )
    packed = materialise(packed, "arrays")  # the cuts of the ranges are sampled from it first
    ranged = packed.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")

    def run(batches):
        held, part = None, TaskContext.get().partitionId()

        def numbered(batch, last):
            flags = [False] * batch.num_rows
            flags[-1] = last
            return pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), pa.array(flags), *batch.columns], names=["part", "last", *batch.schema.names])

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield numbered(held, False)
                held = batch
        if held is not None:
            yield numbered(held, True)

    kind = arrays.schema["conv_id"].dataType.simpleString()
    return materialise(ranged.mapInArrow(lean(run), f"part int, last boolean, seq binary, chars array<int>, conv_id {kind}"), "ranges")


def _swept(flagged: DataFrame) -> DataFrame:
    """What the sweeps of all ranges put out; written."""
    ends = flagged.where("last").select("part", "seq", "chars", "conv_id")  # a row a range
    final = ends.agg(F.max("part")).first()[0]
    carry = ends.withColumn("part", F.lead("part").over(Window.orderBy("part"))).where("part IS NOT NULL")
    rows = flagged.select("part", F.lit(1).alias("kind"), "seq", "chars", "conv_id").unionByName(carry.withColumn("kind", F.lit(0)))
    dealt = rows.repartitionById((final or 0) + 1, F.col("part")).sortWithinPartitions("part", "kind", "seq", "conv_id")
    ids = flagged.schema["conv_id"].dataType.simpleString()
    schema = f"kind int, digest binary, parent binary, depth long, n long, least {ids}, children long, leaves long, saved long, ends string"

    def put_out(out: list[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        if out:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)
            out.clear()

    def run(batches):
        part, sweep, kinds = None, None, None
        for batch in batches:
            if kinds is None:
                long, text, blob = pa.int64(), pa.string(), pa.binary()
                of = dict(kind=pa.int32(), digest=blob, parent=blob, depth=long, n=long, least=batch.schema.field("conv_id").type, children=long, leaves=long, saved=long, ends=text)
                kinds = pa.schema(list(of.items()))
            for at, kind, seq, chars, conv in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if at != part:
                    if sweep:
                        sweep.end()
                        yield from put_out(sweep.out, kinds)
                    part, sweep = at, _Sweep(at == final)
                if kind:
                    sweep.row(seq, chars, conv)
                else:
                    sweep.carried(seq, chars)
                if len(sweep.out) >= 4096:
                    yield from put_out(sweep.out, kinds)
        if sweep:
            sweep.end()
            yield from put_out(sweep.out, kinds)

    return materialise(dealt.mapInArrow(lean(run), schema), "swept")


def _ends(pieces: DataFrame) -> DataFrame:
    """(e_digest, e_ends): the hash of each node's pieces in order, which a task reads one after the other."""

    def run(batches):
        digest, sha = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node != digest:
                    if sha:
                        done.append((digest, sha.hexdigest()))
                    digest, sha = node, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_pydict({"e_digest": pa.array([d for d, _ in done], pa.binary()), "e_ends": [e for _, e in done]})
        if sha:
            yield pa.RecordBatch.from_pydict({"e_digest": pa.array([digest], pa.binary()), "e_ends": [sha.hexdigest()]})

    ordered = pieces.select("digest", "least", "ends").repartition("digest").sortWithinPartitions("digest", "least")
    return ordered.mapInArrow(run, "e_digest binary, e_ends string")


def prefix_trie(arrays: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per node of the trie of (conv_id, turns), ``turns`` an array of structs with digest and chars.

    A node is a distinct sequence of first turns; the root has none. conv_id is its least member, parent_conv_id its parent's (null
    for the root), digest names the node; n_convs counts the conversations that begin with it, n_children its children, n_leaves
    the nodes without children in its subtree (itself, if it has none), saved_tokens the code points that its subtree would save
    if each node's last text were stored once, ends_sha256 is the hash of the ids that end there (in order, comma-joined). An id
    whose turns are empty is a member of the root. Rows that repeat an id are members of their own. Without conversations there
    are no nodes. ``parts`` is the number of ranges; the result doesn't depend on it.
    """
    spark = arrays.sparkSession
    swept = _swept(_flagged(arrays, parts or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keys = ["digest", "parent", "depth"]
    part = swept.where(F.col("kind") == PART).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    whole = swept.where(F.col("kind") == COMPLETE).drop("kind")
    some = part.withColumn("ends", F.lit(None).cast("string")).unionByName(whole.where("ends IS NULL"))
    hashed = _ends(swept.where(F.col("kind") == ENDS))
    some = some.join(hashed, F.col("digest") == F.col("e_digest"), "left").withColumn("ends", F.coalesce("e_ends", F.lit(EMPTY))).drop("e_digest", "e_ends")
    nodes = materialise(whole.where("ends IS NOT NULL").unionByName(some), "nodes")
    parents = nodes.where("children > 0").select(F.col("digest").alias("p_digest"), F.col("least").alias("parent_conv_id"))
    joined = nodes.join(parents, F.col("parent") == F.col("p_digest"), "left")
    return joined.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"), "digest",
    )


def rebuilt(arrays: DataFrame) -> DataFrame:
    """Conversations that begin like the first of their hundred: h turns of it (h from the id's CRC), then their own after the first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    own = arrays.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h"), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1))).alias("rest"))
    heads = arrays.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    first = F.when(F.col("head").isNull(), F.slice("rest", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return own.join(heads, "base", "left").select("conv_id", F.concat(first, F.col("rest")).alias("turns"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt(turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet")))).drop("digest")


SQL = """
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 6 AS h FROM t),
r AS (SELECT h.conv_id AS c, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT c, d, turns[1:d] AS p, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(n.p[d].text) ELSE 0 END AS own FROM n LEFT JOIN k ON n.p = k.p),
u AS (SELECT p[1:a] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, f.ends_sha256
FROM f JOIN u ON f.p = u.p LEFT JOIN n q ON f.d > 0 AND q.p = f.p[1:f.d - 1]
"""
