"""Benchmark decontamination with a distributed positional inverted index.

Method: the training words become a positional index of segments of documents, written once: a segment has its terms, each with
its ascending positions, and a directory (term, segment, number of positions) comes with it. Terms are those of the benchmark
(postings of other terms can match nothing; a bitmap of fixed size tells them, so what a task holds doesn't grow with the
benchmark). The test phrases are the distinct runs of ``window`` words of the items, a table too. Of each phrase the terms are
ranked by how often the corpus has them. An equality join of the rarest term with the directory tells the segments that a phrase
can be in, and there the positions are intersected: those of the rarest term, less its offset, are the candidate starts, the
offset-adjusted ones of the other terms are looked up from the second rarest on, and a start that all lists have is an exact
match. With ``slop`` a list also has the starts up to that many words from its own (proximity match).

Phrases and segments only meet by key, and a task holds one segment and some phrases at a time.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import lean, materialise, send
from .rows import named, without

WINDOW = 13  # words of a test phrase
SEGMENT_BYTES = 1 << 20  # text of a segment of the index; a longer document makes one by itself
STARTS = 1 << 20  # candidate starts that are looked up at once, about
FILTER_BITS = 20  # the bitmap of the benchmark's terms has 2^FILTER_BITS bits
SHARE = 20  # a document is contaminated if 1 / SHARE of its words are hit
#: ASCII digits, a-z and all bytes of other scripts make words; A-Z are lower-cased first.
_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    return (text or "").encode().translate(_KEEP).split()


def _bit(word: bytes) -> int:
    return zlib.crc32(word) >> (32 - FILTER_BITS)


class _Terms(dict):
    """Word -> number of the term, or -1 for words whose bit isn't set; filled as words are asked for."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.words = bits, []

    def __missing__(self, word: bytes) -> int:
        bit = _bit(word)
        number = len(self.words) if self.bits[bit >> 3] >> (bit & 7) & 1 else -1
        if number >= 0:
            self.words.append(word.decode())
        self[word] = number
        return number


def item_words(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, words): the items that have words, ids as strings, a null one as the empty string."""

    def run(batches):
        for batch in batches:
            words = [[w.decode() for w in words_of(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["item", "words"])

    named_items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_col)
    return named_items.mapInArrow(lean(run), "item string, words array<string>").where("size(words) > 0")


def term_bits(items: DataFrame) -> np.ndarray:
    """The bitmap of the terms of all items."""
    words = items.select(F.explode("words").alias("word"))
    found = words.select(F.shiftright(F.crc32(F.encode("word", "UTF-8")), 32 - FILTER_BITS).alias("bit")).distinct().toArrow()  # 2^FILTER_BITS rows at most
    bits = np.zeros(1 << FILTER_BITS, dtype=np.uint8)
    bits[found.column(0).to_numpy()] = 1
    return np.packbits(bits, bitorder="little")


def segments(rows: DataFrame, row: str, text_col: str, bits: np.ndarray, gap: int) -> DataFrame:
    """The index: segment (a name), rows, n_words (of each), terms, sizes (positions of each term), places (32-bit positions, term
    by term). Positions go on over the rows of a segment, ``gap`` parts these."""
    sent = send(rows.sparkSession, bits)
    schema = T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("rows", T.ArrayType(rows.schema[row].dataType, False)),
            T.StructField("n_words", T.ArrayType(T.IntegerType(), False)),
            T.StructField("terms", T.ArrayType(T.StringType(), False)),
            T.StructField("sizes", T.ArrayType(T.IntegerType(), False)),
            T.StructField("places", T.BinaryType()),
        ]
    )

    def segment(keys: pa.Array, texts: list[str | None], bits: np.ndarray) -> pa.RecordBatch:
        terms = _Terms(bits)
        known = []
        for text in texts:
            words = words_of(text)
            known.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
        n_words = np.fromiter(map(len, known), np.int64, len(known))
        term = np.concatenate(known)
        place = np.arange(len(term)) + np.repeat(np.arange(len(texts)) * gap, n_words)
        here = np.flatnonzero(term >= 0)
        term, place = term[here], place[here]
        order = np.argsort(term, kind="stable")  # positions stay ascending
        sizes = np.bincount(term, minlength=len(terms.words)).astype(np.int32)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        first = keys[0].as_py()
        columns = [
            pa.array([f"{first['file']}:{first['at']}"]),
            one(keys),
            one(pa.array(n_words.astype(np.int32))),
            one(pa.array(terms.words, pa.string())),
            one(pa.array(sizes)),
            pa.array([place[order].astype(np.int32).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches):
        bits = sent()
        for batch in batches:
            begin, texts, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= SEGMENT_BYTES:
                    yield segment(batch.column(0).slice(begin, len(texts)), texts, bits)
                    begin, texts, size = i + 1, [], 0
            if texts:
                yield segment(batch.column(0).slice(begin, len(texts)), texts, bits)

    return rows.select(row, text_col).mapInArrow(lean(run), schema)


def phrases(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(phrase, items, n, ranked): distinct runs of ``window`` words (whole items if shorter) whose terms the corpus all has; the
    phrase is its words, ``ranked`` its terms, rarest first, with their offsets."""
    n = F.least(F.lit(window), F.size("words"))
    runs = items.withColumn("n", n).select("item", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"))
    runs = runs.select("item", "n", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("phrase"))
    runs = materialise(runs.groupBy("phrase", "n").agg(F.array_sort(F.collect_set("item")).alias("items")), "phrases")
    each = runs.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term")).join(counts, "term")
    ranked = each.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("count", "offset", "term"))).alias("ranked"))
    return runs.join(ranked, "phrase").where(F.size("ranked") == F.col("n"))


class Segment:
    """One segment of the index, for lookups."""

    def __init__(self, rows: pa.Array, n_words: np.ndarray, terms: list[str], sizes: np.ndarray, places: np.ndarray, gap: int):
        self.rows, self.places = rows, places.astype(np.int64)
        self.number = {t: i for i, t in enumerate(terms)}
        self.sizes, self.ends = sizes.astype(np.int64), np.cumsum(sizes, dtype=np.int64)
        self.begin = np.cumsum(n_words + gap) - (n_words + gap)
        self.size = int((n_words + gap).sum()) + 1
        self.keys = np.repeat(np.arange(len(terms)), sizes) * self.size + self.places  # ascending

    def lookup(self, tests: list[tuple[str, list[int]]], slop: int) -> tuple[np.ndarray, ...]:
        """(test, row, start) of the matches of tests: phrases and the offsets of their words, rarest word first."""
        numbers = []
        for phrase, offsets in tests:
            words = phrase.split(" ")
            numbers.append([self.number.get(words[o], -1) for o in offsets])
        possible = [i for i, found in enumerate(numbers) if min(found) >= 0]
        parts, at = [], 0
        while at < len(possible):
            some, n = [], 0
            while at < len(possible) and (not some or n < STARTS):
                some.append(possible[at])
                n += int(self.sizes[numbers[possible[at]][0]])
                at += 1
            parts.append(self._intersected(some, numbers, tests, slop))
        return tuple(np.concatenate(x) if parts else np.zeros(0, dtype=np.int64) for x in (zip(*parts, strict=True) if parts else ((), (), ())))

    def _intersected(self, some: list[int], numbers: list[list[int]], tests: list, slop: int) -> tuple[np.ndarray, ...]:
        longest = max(len(numbers[i]) for i in some)
        number = np.array([numbers[i] + [-1] * (longest - len(numbers[i])) for i in some], dtype=np.int64)
        offset = np.array([list(tests[i][1]) + [0] * (longest - len(numbers[i])) for i in some], dtype=np.int64)
        rarest = number[:, 0]
        test = np.repeat(np.arange(len(some)), self.sizes[rarest])
        within = np.arange(len(test)) - np.repeat(np.cumsum(self.sizes[rarest]) - self.sizes[rarest], self.sizes[rarest])
        anchor = self.places[(self.ends[rarest] - self.sizes[rarest])[test] + within]
        start = anchor - offset[test, 0]
        for r in range(1, longest):
            term = number[test, r]
            low = np.maximum(start + offset[test, r] - slop, 0)
            high = np.minimum(start + offset[test, r] + slop, self.size - 1)
            at = np.searchsorted(self.keys, term * self.size + low)
            there = self.keys[np.minimum(at, len(self.keys) - 1)]
            keep = (term < 0) | ((low <= high) & (at < len(self.keys)) & (there <= term * self.size + high))
            test, anchor, start = test[keep], anchor[keep], start[keep]
        row = np.searchsorted(self.begin, anchor, side="right") - 1
        start = start - self.begin[row]
        fine = (start >= 0) | (slop > 0)
        return np.array(some, dtype=np.int64)[test[fine]], row[fine], np.maximum(start[fine], 0)


def phrase_hits(index: DataFrame, tests: DataFrame, gap: int, slop: int = 0) -> DataFrame:
    """(phrase, row, start): all matches of ``tests`` (phrase, n, ranked) in the ``index`` of segments."""
    directory = index.select("segment", F.explode("terms").alias("term"))
    rarest = tests.select(F.col("ranked")[0]["term"].alias("term"), "phrase", F.col("ranked.offset").alias("offsets"))
    wanted = directory.join(materialise(rarest.select("term").distinct(), "rarest"), "term", "left_semi")
    asked = wanted.join(rarest, "term").select("segment", F.lit(1).alias("kind"), "phrase", "offsets")
    held = ("rows", "n_words", "terms", "sizes", "places")
    met = asked.unionByName(index.select("segment", F.lit(0).alias("kind"), *held), allowMissingColumns=True)
    met = met.repartition("segment").sortWithinPartitions("segment", "kind").select("kind", "phrase", "offsets", *held)
    row = index.schema["rows"].dataType.elementType
    schema = T.StructType([T.StructField("phrase", T.StringType()), T.StructField("row", row), T.StructField("start", T.IntegerType())])

    def run(batches):
        here = None
        for batch in batches:
            kinds = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1], [True]])).tolist() if len(kinds) else []
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if not kinds[begin]:  # of segments that no phrase follows only the last may be asked
                    rows, n_words, terms, sizes, places = (batch.column(i)[end - 1] for i in range(3, 8))
                    lists = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (n_words, sizes))
                    n_words, sizes = lists
                    here = Segment(rows.values, n_words, terms.as_py(), sizes, np.frombuffer(places.as_py(), np.int32), gap)
                    continue
                phrases, offsets = batch.column(1).slice(begin, end - begin).to_pylist(), batch.column(2).slice(begin, end - begin).to_pylist()
                test, row, start = here.lookup(list(zip(phrases, offsets, strict=True)), slop)
                if len(test):
                    columns = [pa.array(phrases, pa.string()).take(pa.array(test)), here.rows.take(pa.array(row)), pa.array(start.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return materialise(met.mapInArrow(lean(run), schema).distinct(), "found")


def _matches(rows: DataFrame, row: str, benchmark: DataFrame, window: int, slop: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(row, n_words, n_hit, begins, lengths, items) of ``rows``, one for each."""
    items = materialise(item_words(benchmark, item_col, item_text_col), "items")
    gap = window + slop
    index = materialise(segments(rows, row, text_col, term_bits(items), gap), "index")
    counts = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("count"))
    tests = materialise(phrases(items, materialise(counts, "counts"), window), "tests")
    hits = phrase_hits(index, tests, gap, slop)
    sizes = index.select(F.explode(F.arrays_zip("rows", "n_words")).alias("r")).select(F.col("r.rows").alias("row"), F.col("r.n_words").cast("long").alias("n_words"))
    # a phrase that is matched with slop may reach beyond its text
    spans = hits.join(tests.select("phrase", "n"), "phrase").join(sizes, "row").select("row", "start", F.least(F.col("start") + F.col("n"), "n_words").alias("end")).distinct()
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("nth", F.sum("fresh").over(order))
    spans = spans.groupBy("row", "nth").agg(F.min("start").cast("long").alias("begin"), F.max("end").cast("long").alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", (F.col("end") - F.col("begin")).alias("length")))).alias("spans"))
    held = hits.select("row", "phrase").distinct().join(tests.select("phrase", F.explode("items").alias("item")), "phrase")
    held = held.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = materialise(spans.join(held, "row"), "spans")
    longs, texts = (F.expr(f"cast(array() as array<{kind}>)") for kind in ("bigint", "string"))
    out = sizes.join(found, "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["length"])
    return out.select(
        "row",
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans.begin", longs).alias("begins"),
        F.coalesce("spans.length", longs).alias("lengths"),
        F.coalesce("items", texts).alias("items"),
    )


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slop: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row: doc_id, n_words, n_hit, begins and lengths (hit runs in words), items (sorted ids as strings).

    Null texts have no words, null items no phrases; an item of fewer than ``window`` words is one phrase, one without words
    none. Matches never cross documents. Rows are told apart by their place: repeated ones give repeated results, whatever their
    ids. Items that share a phrase all count; those without an id count as one with an empty id. With an empty benchmark nothing
    is hit. Only the two named columns of either table are read.
    """
    rows, row = named(docs, F.col(id_col))
    found = _matches(rows, row, benchmark, window, slop, text_col, item_col, item_text_col)
    return found.select(F.col("row.rank0").alias("doc_id"), "n_words", "n_hit", "begins", "lengths", "items")


def judged(matches: DataFrame, share: int = SHARE) -> DataFrame:
    """``matches`` with contaminated: at least one word in ``share`` is hit, and one at least."""
    return matches.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slop: int = 0,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns unchanged; rows are told apart by their place."""
    rows, row = named(docs)
    gone = judged(_matches(rows, row, benchmark, window, slop, text_col, item_col, item_text_col)).where("contaminated").select("row")
    return without(rows, row, gone, docs.columns)


def op9_decontaminate(spark, sf_dir):
    found = judged(find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
r AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT doc_id, i, n, item FROM r JOIN p USING (n, phrase)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND n_hit * {SHARE} >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """(n_words, n_hit, items) by comparing every run of words: for tests."""
    words = words_of(text)
    hit, found = set(), set()
    for item, said in items:
        test = words_of(said)
        n = min(window, len(test))
        runs = {tuple(test[i : i + n]) for i in range(len(test) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in runs:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
