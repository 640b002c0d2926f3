"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Method: the distinct words of a block of documents are laid out as one array of symbols with links to their neighbours. An
inverted index maps each mergeable pair (by the rank of what it merges to) to the positions where it stands; a heap hands
out ranks in order, each merge is applied at all its positions at once, and only the pairs beside a merged position are
looked up again and filed. The result equals merging each word by itself, lowest rank first and leftmost first, as merges of
different words don't touch. Words are numbered, so a document is a list of word numbers whose tokens are gathered.

Blocks are bounded in bytes, and so is the table of words that a task keeps; a word that was dropped is replayed again. No
row leaves its task: there is no shuffle, and a lost executor costs its own tasks only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import lean, send

BLOCK_BYTES = 4 << 20  # text handled at once in a task
MAX_WORDS = 400_000  # distinct words that a task keeps between blocks


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 of a token's bytes and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeTable:
    """Pairs of tokens and the token that they merge to, as sorted arrays; and which tokens can open an earlier merge."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        left, right = self.keys // self.size, self.keys % self.size
        self.early = np.unique(np.concatenate([left[left > self.merged], right[right > self.merged]]))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it doesn't merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], -1) if len(self.keys) else np.full(len(key), -1)


def replay(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after another, and how many each word has. Words must not be empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbol = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    word = np.repeat(np.arange(len(words)), lengths)
    following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(lengths) - 1
    following[ends] = -1
    previous[ends[:-1] + 1] = -1
    pair = np.full(n, -1, dtype=np.int64)
    inner = np.flatnonzero(following >= 0)
    pair[inner] = table.rank(symbol[inner], symbol[inner + 1])

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file(positions: np.ndarray) -> None:
        ranks = pair[positions]
        positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        heads = ranks[np.concatenate([[0], cuts])].tolist()
        for rank, some in zip(heads, np.split(positions, cuts), strict=True):
            if rank in index:
                index[rank].append(some)
            else:
                index[rank] = [some]
                heapq.heappush(heap, rank)

    file(inner)
    early = set(table.early.tolist())
    while heap:
        rank = heapq.heappop(heap)
        found = index.pop(rank)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[pair[at] == rank]
        if not len(at):
            continue
        if len(found) == 1 and len(at) > 1 and (np.diff(at) <= 0).any():
            at = np.unique(at)
        if rank in early:  # what it makes may have to merge before its next occurrence: one at a time in a word
            first = np.concatenate([[True], np.diff(word[at]) > 0])
            at, rest = at[first], at[~first]
        else:
            rest = at[:0]
            overlap = np.concatenate([[False], following[at[:-1]] == at[1:]])
            if overlap.any():  # of a chain of overlapping occurrences every other one merges, from the left
                begin = np.maximum.accumulate(np.where(overlap, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
        right = following[at]
        after = following[right]
        symbol[at], symbol[right], pair[right] = rank, -1, -1
        following[at] = after
        has_after = after >= 0
        previous[after[has_after]] = at[has_after]
        before = previous[at]
        before = before[before >= 0]
        pair[at] = -1
        inner = at[has_after]
        pair[inner] = table.rank(symbol[inner], symbol[after[has_after]])
        pair[before] = table.rank(symbol[before], symbol[following[before]])
        file(np.unique(np.concatenate([before, inner])))
        if len(rest):
            file(rest)
    alive = symbol >= 0
    return symbol[alive], np.bincount(word[alive], minlength=len(words))


class WordTable:
    """Words seen, each with a number; the tokens of word i are ``tokens[start[i]:start[i] + count[i]]``."""

    def __init__(self, ranks: dict[bytes, int], table: MergeTable):
        self.ranks, self.table = ranks, table
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens = self.start = self.count = np.zeros(0, dtype=np.int64)

    def add(self, words: set[str]) -> None:
        """File words that are new: whole vocabulary entries as they are, the rest by replay."""
        new = sorted(words - self.number.keys())
        if not new:
            return
        raw = [w.encode() for w in new]
        whole = np.fromiter((self.ranks.get(w, -1) for w in raw), np.int64, len(raw))
        rest = np.flatnonzero(whole < 0).tolist()
        ids, counts = replay([raw[i] for i in rest], self.table) if rest else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        count = np.ones(len(raw), dtype=np.int64)
        count[rest] = counts
        start = np.cumsum(count) - count
        tokens = np.empty(int(count.sum()), dtype=np.int64)
        tokens[start[whole >= 0]] = whole[whole >= 0]
        tokens[np.repeat(whole < 0, count)] = ids
        base = len(self.number)
        self.number.update(zip(new, range(base, base + len(new)), strict=True))
        self.start = np.concatenate([self.start, start + len(self.tokens)])
        self.count = np.concatenate([self.count, count])
        self.tokens = np.concatenate([self.tokens, tokens.astype(np.int32)]) if len(self.tokens) else tokens.astype(np.int32)

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The tokens of a list of words."""
        counts = self.count[numbers]
        shift = np.cumsum(counts) - counts
        return self.tokens[np.repeat(self.start[numbers] - shift, counts) + np.arange(int(counts.sum()))]


def blocks(column: pa.Array, limit: int):
    """(begin, texts) of runs of rows with about ``limit`` characters at most, one row at least; null is empty."""
    begin, texts, size = 0, [], 0
    for i, text in enumerate(column):
        text = text.as_py() or ""
        if texts and size + len(text) > limit:
            yield begin, texts
            begin, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield begin, texts


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, ids (array<int>).

    Null and empty text have no tokens. Rows are independent: repeated rows and ids each give their row, a null id stays
    null. ``ranks_path`` is read on the driver and travels with the job (a vocabulary file, of some MB at any input size).
    """
    import regex

    ranks = load_ranks(ranks_path)
    sent = send(docs.sparkSession, (ranks, MergeTable(ranks)))
    compiled = regex.compile(pattern)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    )

    def run(batches):
        table = WordTable(*sent())
        for batch in batches:
            for begin, texts in blocks(batch.column(1), BLOCK_BYTES):
                split = [compiled.findall(text) for text in texts]
                if len(table.number) > MAX_WORDS:
                    table.clear()
                table.add(set(chain.from_iterable(split)))
                per_doc = np.fromiter(map(len, split), np.int64, len(split))
                total = int(per_doc.sum())
                numbers = np.fromiter(map(table.number.__getitem__, chain.from_iterable(split)), np.int64, total)
                del split
                word_ends = np.concatenate([[0], np.cumsum(table.count[numbers])])
                offsets = word_ends[np.concatenate([[0], np.cumsum(per_doc)])]
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(table.gather(numbers), pa.int32()))
                own = batch.column(0).slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(offsets), pa.int64()), ids], names=["doc_id", "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def _by_id(values: dict[int, object]) -> np.ndarray:
    """An object array that has each id's value at that id."""
    out = np.full(max(values) + 1, None, dtype=object)
    for i, value in values.items():
        out[i] = value
    return out


def _lists(column: pa.ListArray, by_id: np.ndarray):
    """Per row the list of its ids' values, for some rows at a time."""
    for i in range(0, len(column), 256):
        part = column.slice(i, 256)
        offsets = part.offsets.to_numpy()
        found = by_id[part.values.to_numpy()[offsets[0] : offsets[-1]]].tolist()
        ends = (offsets - offsets[0]).tolist()
        yield from (found[j:k] for j, k in zip(ends, ends[1:], strict=False))


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows of ``tokens`` with ``decoded`` (binary): the bytes of their ids. Null ids give null."""
    sent = tokens.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(ranks_path).items()})
    schema = T.StructType([f for f in tokens.schema if f.name != "decoded"] + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        by_id = _by_id(sent.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            known = column.is_valid().to_pylist()
            decoded = [b"".join(found) if ok else None for found, ok in zip(_lists(column, by_id), known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    return tokens.drop("decoded").mapInArrow(lean(run), schema)


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Per row of ``encode``: doc_id, n_tokens, and the digests of its ids and of the bytes that decode from them."""
    sent = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(ranks_path).items()})
    kind = encoded.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField("n_tokens", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    )

    def run(batches):
        token, text = _by_id(sent.value), _by_id({rank: str(rank) for rank in sent.value})
        for batch in batches:
            said = [hashlib.sha256(",".join(found).encode()).hexdigest() for found in _lists(batch.column(2), text)]
            back = [hashlib.sha256(b"".join(found)).hexdigest() for found in _lists(batch.column(2), token)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(back, pa.string())], names=schema.names
            )

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(lean(run), schema)


def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public.PATTERN), path)
