"""Quality classification by importance resampling.

Method: two generative models of hashed n-grams, one of target text (labelled good) and one of the raw corpus, give each n-gram
the ratio ``log p_target - log p_raw``. A document's importance is the mean of it over its n-grams, divided by a temperature.
Adding Gumbel noise to these log weights and taking the top k draws k documents without replacement in proportion to their
weights: clear cases stay or go whatever the noise, those between are drawn.

n-grams are runs of 4 bytes, words and pairs of words, all hashed to the same 2^16 buckets. A word is a run of letters, digits
and bytes beyond ASCII, or of other signs; a word that repeats the last one is read as one mark of repetition, whatever it is.
The raw model counts every document. The target model is fitted on a bounded sample of labelled rows; good means quality 1 and
not toxic. A quarter of the sample, good and bad, is held back: a logistic regression on it turns means into log odds of being
good, which sets the temperature, and k is the number of documents whose odds are worth keeping when losing a good one costs as
much as keeping ``LOST_COST`` bad ones. Counts leave a task as one histogram; documents never move.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import lean, materialise, send
from .rows import unused

BITS = 16
BUCKETS = 1 << BITS
LABELLED = 20_000  # labelled rows that are used, at most: those with the smallest hashes of their ids
SMOOTHING = 4.0  # pseudo-counts a bucket that draw the target model to the raw one
FEW = 8  # n-grams of ratio 0 that are added to every document, so that a few words decide little
LOST_COST = 10.0  # a good document lost counts as so many bad ones kept
SPREAD = 10.0  # standard deviation of the slope's prior, in units of the means' own deviation
SEED = 17
BATCH_BYTES = 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xD1B54A32D192ED03)
_KIND = np.full(256, 2, dtype=np.uint8)  # 0 white space, 1 letters, digits and what isn't ASCII, 2 other signs
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _first, _last in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _KIND[_first : _last + 1] = 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """n-gram buckets of texts."""

    def __init__(self):
        self.powers = np.cumprod(np.full(1 << 12, _STEP, dtype=np.uint64))

    def of(self, text: str | None) -> np.ndarray:
        """The bucket of every n-gram of a text; null and blank ones have none."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        kind = _KIND[raw]
        if not kind.any():
            return np.zeros(0, dtype=np.int64)
        if len(raw) >= len(self.powers):
            self.powers = np.cumprod(np.full(2 * len(raw), _STEP, dtype=np.uint64))
        wide = raw.astype(np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        end = np.concatenate([begin[1:], [len(raw)]])
        begin, end = begin[kind[begin] > 0], end[kind[begin] > 0]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * self.powers[: len(raw)])])
        word = _mix((total[end] - total[begin]) * self.powers[len(raw) - begin])  # of equal words equal, wherever they stand
        letters = np.flatnonzero(kind[begin] == 1)
        same = letters[1:][word[letters[1:]] == word[letters[:-1]]]
        word[same] = _AGAIN
        pair = _mix(word[:-1] * _STEP + word[1:])
        run = _mix(wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)) if len(raw) > 3 else wide[:0]
        return (np.concatenate([word, pair, run]) >> np.uint64(64 - BITS)).astype(np.int64)


def _batches(batches, extra: int):
    """(columns before the text, texts) of about BATCH_BYTES."""
    for batch in batches:
        begin, texts, size = 0, [], 0
        for i, text in enumerate(batch.column(extra)):
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= BATCH_BYTES:
                yield batch.slice(begin, len(texts)), texts
                begin, texts, size = i + 1, [], 0
        if texts:
            yield batch.slice(begin, len(texts)), texts


def labelled_sample(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, good): at most ``limit`` labelled ids. Good: quality 1 and not toxic; an id labelled twice takes the worse label."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
    known = known.agg(((F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("good"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def held_back(doc_id: object) -> bool:
    """Whether a labelled id is left out of the target model, to place temperature and k."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 0


def fit(docs: DataFrame, target_ids: set, id_col: str = "doc_id", text_col: str = "text", smoothing: float = SMOOTHING) -> np.ndarray:
    """Per bucket log p_target - log p_raw. Without target rows the two models are the same and all are 0."""
    sent = docs.sparkSession.sparkContext.broadcast(target_ids)

    def count(batches):
        grams, target = Grams(), sent.value
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for part, texts in _batches(batches, 1):
            for here, text in zip(part.column(0).to_pylist(), texts, strict=True):
                buckets = grams.of(text)
                for counts in (raw, good) if here in target else (raw,):
                    np.add.at(counts, buckets, 1) if len(buckets) < 4096 else np.add(counts, np.bincount(buckets, minlength=BUCKETS), out=counts)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    counted = docs.select(id_col, text_col).mapInArrow(lean(count), "bucket long, raw long, good long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # BUCKETS rows at most
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in rows:
        raw[row.bucket], good[row.bucket] = row.raw, row.good
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    p_good = (good + smoothing * BUCKETS * p_raw) / (good.sum() + smoothing * BUCKETS)
    return np.log(p_good) - np.log(p_raw)


def mean_ratio(docs: DataFrame, ratios: np.ndarray, text_col: str = "text") -> Column:
    """The mean log ratio of a text's n-grams, ``FEW`` zeros among them, as a column of ``docs``."""
    sent = send(docs.sparkSession, (Grams, ratios))

    @F.arrow_udf("double")
    def mean(texts: pa.Array) -> pa.Array:
        kind, weights = sent()
        grams = kind()
        return pa.array([float(weights[g].sum() / (len(g) + FEW)) for g in (grams.of(t.as_py()) for t in texts)], pa.float64())

    return mean(F.col(text_col))


def log_odds(means: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of the logistic regression of ``good`` on the means, by Newton's method; the slope has a normal prior."""
    centre, scale = means.mean(), means.std() or 1.0
    x = np.stack([np.ones(len(means)), (means - centre) / scale], axis=1)
    w, prior = np.zeros(2), np.array([1e-4, 1 / SPREAD**2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(prior), x.T @ (good - p) - prior * w)
        w = w + step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * centre / scale), float(w[1] / scale)


def gumbel(id_col: str, seed: int) -> Column:
    """Gumbel noise from a hash of the id, so the same each time."""
    uniform = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 12) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(table: DataFrame, column: str, k: int, bins: int = 1024, few: int = 4096) -> float | None:
    """The k-th largest value of a column (None: all rows belong), by counting in ever narrower bins: only counts are collected."""
    low, high, n = table.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return None
    if k <= 0:
        return float("inf")
    above = 0
    while True:
        inside = table.where(F.col(column).between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return high
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counted = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in sorted(counted.collect(), key=lambda r: -r.bin):  # ``bins`` rows at most
            if above + row.n >= k:
                break
            above += row.n
        if row.low == row.high:
            return row.low
        if row.n <= few:
            top = table.where(F.col(column).between(row.low, row.high)).orderBy(F.col(column).desc()).limit(k - above).select(column).collect()
            return top[-1][0]
        low, high = row.low, row.high


class Sampler:
    """What decides on a document: the ratios of n-grams, intercept and slope of the log odds, and the least key that is drawn."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, k: int | None, seed: int):
        sample = labelled_sample(labels).collect()  # LABELLED rows at most
        self.id_col, self.text_col, self.seed = id_col, text_col, seed
        self.ratios = fit(docs, {row.doc_id for row in sample if row.good and not held_back(row.doc_id)}, id_col, text_col)
        means = materialise(docs.select(F.col(id_col).alias("doc_id"), mean_ratio(docs, self.ratios, text_col).alias("mean")), "means")
        kinds = T.StructType([T.StructField("doc_id", labels.schema["doc_id"].dataType), T.StructField("good", T.BooleanType())])
        held = docs.sparkSession.createDataFrame([(row.doc_id, row.good) for row in sample if held_back(row.doc_id)], kinds)
        known = means.join(F.broadcast(held), "doc_id").groupBy("doc_id", "good").agg(F.avg("mean").alias("mean")).collect()  # as many
        good = np.array([r.good for r in known], dtype=float)
        both = 0 < good.sum() < len(good)
        self.intercept, self.slope = log_odds(np.array([r.mean for r in known]), good) if both else (0.0, 1.0)
        self.scored = means.select("doc_id", (F.col("mean") * self.slope + self.intercept).alias("log_weight"))
        self.scored = self.scored.withColumn("gumbel_key", F.col("log_weight") + gumbel("doc_id", seed))
        if k is None and both:
            k = self.scored.where(F.col("log_weight") >= -math.log(LOST_COST)).count()
        self.least = None if k is None else kth_largest(self.scored, "gumbel_key", k)

    def drawn(self, key: Column) -> Column:
        return F.lit(True) if self.least is None else key >= self.least


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per row: doc_id, log_weight (log odds of being good), gumbel_key, selected (among the k largest keys; by default k
    is placed by the labels).

    Null and blank texts have a mean ratio of 0. Rows whose keys tie with the k-th are all selected, so repeated rows share their
    fate; rows without an id share their noise. Without held back labels of both kinds and without k everything is selected.
    Only the named columns are read.
    """
    sampler = Sampler(docs, labels, id_col, text_col, k, seed)
    return sampler.scored.withColumn("selected", sampler.drawn(F.col("gumbel_key")))


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = SEED) -> DataFrame:
    """The selected rows of ``docs``, all their columns unchanged. Each row is judged by its own text, so repeated ids are no harm."""
    sampler = Sampler(docs, labels, id_col, text_col, k, seed)
    if sampler.least is None:
        return docs
    mean = unused(docs, "__mean")
    marked = docs.withColumn(mean, mean_ratio(docs, sampler.ratios, text_col))
    key = F.col(mean) * sampler.slope + sampler.intercept + gumbel(id_col, seed)
    return marked.where(sampler.drawn(key)).select(*docs.columns)


def op5_quality(spark, sf_dir):
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
