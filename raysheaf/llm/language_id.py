"""Language identification as inference of a mixture.

Method: a naive n-gram model of each language gives every unit of a document (a run of words) a likelihood per language.
Expectation-maximisation estimates the document's language proportions from these. The language set is chosen by penalised
likelihood: from all languages on, the one with the least share is dropped and the rest fitted again, for as long as that
lowers ``-2 log L + penalty * (languages - 1) * log(units)``. The prediction is the language with the largest share.

The models count every eligible document; counts leave a task as one histogram per language, documents never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import lean

BITS = 14
GRAM = 4  # bytes
UNIT = 6  # words
PENALTY = 4.0
ROUNDS, MORE = 15, 6  # of EM at first and after a language was dropped
BATCH_BYTES = 2 << 20
BLOCK = 1 << 19  # characters of a text that are worked on at once
UNDETERMINED = "und"
#: Everything in ASCII but letters parts words.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


_SPACE = re.compile(r"[\x09-\x0d\x20]")


def _normal(text: str) -> Iterator[np.ndarray]:
    """Bytes of the lower-cased words, single spaces between and before them, in overlapping blocks: each begins with the last
    ``GRAM - 1`` bytes of the one before, so that every run of ``GRAM`` bytes is in one of them. A text of any length is read in blocks of
    ``BLOCK`` characters or what it takes to reach an ASCII white space."""
    held, begin = b"", 0
    while begin < len(text) or not begin:
        cut = _SPACE.search(text, begin + BLOCK)
        end = cut.start() if cut else len(text)
        words = text[begin:end].lower().encode().translate(_LETTERS).split()
        last = end == len(text)
        if words or last:
            held += (b" " + b" ".join(words) if words or not held else b"") + (b"  " if last else b"")  # two spaces: one letter makes a run too
            yield np.frombuffer(held, np.uint8)
            held = held[1 - GRAM :]
        if last:
            return
        begin = end


def unit_logs(text: str, logs: np.ndarray) -> np.ndarray:
    """The log likelihood by language of each run of ``UNIT`` words, block by block; no rows for a text without byte runs."""
    sums, spaces, open_unit = [], 0, -1
    for raw in _normal(text):
        found = grams(raw)
        if not len(found):
            continue
        before = np.cumsum(raw == 0x20)
        unit = (spaces + before[: len(found)] - 1) // UNIT
        spaces += int(before[len(found) - 1])
        first = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1])
        part = np.add.reduceat(logs[found], first, axis=0)
        if unit[0] == open_unit:  # the unit that the block before ended in goes on
            sums[-1][-1] += part[0]
            part = part[1:]
        if len(part):
            sums.append(part)
        open_unit = unit[-1]
    return np.concatenate(sums) if sums else np.zeros((0, logs.shape[1]), dtype=logs.dtype)


def grams(raw: np.ndarray) -> np.ndarray:
    """Hash buckets of all byte runs."""
    if len(raw) < GRAM:
        return np.zeros(0, dtype=np.int64)
    x = raw.astype(np.uint32)
    runs = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
    return ((runs * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def _batches(batches, text_at: int):
    for batch in batches:
        begin, texts, size = 0, [], 0
        for i, text in enumerate(batch.column(text_at)):
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= BATCH_BYTES:
                yield batch.slice(begin, len(texts)), texts
                begin, texts, size = i + 1, [], 0
        if texts:
            yield batch.slice(begin, len(texts)), texts


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each bucket by language) from rows with text and a language."""

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for part, texts in _batches(batches, 1):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                counts = found.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                for buckets in map(grams, _normal(text)):
                    if len(buckets) < 2048:
                        np.add.at(counts, buckets, 1)
                    else:
                        counts += np.bincount(buckets, minlength=1 << BITS)
        for lang, counts in found.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], names=["lang", "bucket", "n"])

    known = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(lang_col, text_col)
    counted = known.mapInArrow(lean(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row a language, a histogram of 2^BITS counts at most
    packed = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).orderBy("lang").collect()
    langs, logs = [], []
    for row in packed:
        counts = np.full(1 << BITS, 0.5)
        for bucket, n in row.counts:
            counts[bucket] += n
        langs.append(row.lang)
        logs.append(np.log(counts / counts.sum()))
    return langs, np.array(logs, dtype=np.float32).T.reshape(1 << BITS, len(langs))


def _em(likelihood, shares, allowed, begins, doc, units, rounds):
    """Shares after ``rounds`` of EM, and each document's log likelihood. ``likelihood`` is per unit, scaled to a maximum of 1."""
    for _ in range(rounds):
        joint = likelihood * shares[doc]
        total = joint.sum(1, keepdims=True)
        shares = np.add.reduceat(joint / np.maximum(total, 1e-300), begins, axis=0) / units[:, None] * allowed
        shares /= np.maximum(shares.sum(1, keepdims=True), 1e-300)
    total = (likelihood * shares[doc]).sum(1)
    return shares, np.add.reduceat(np.log(np.maximum(total, 1e-300)), begins)


def mixtures(texts: list[str], logs: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language shares of each text (rows of zeros: no letters)."""
    n_langs = logs.shape[1]
    out = np.zeros((len(texts), n_langs))
    units, which, rows = [], [], []
    for i, text in enumerate(texts):
        found = unit_logs(text, logs)
        if len(found) and any(c.isalpha() for c in text):
            rows.append(found)
            units.append(len(found))
            which.append(i)
    if not which or not n_langs:
        return out
    units = np.array(units)
    begins = np.cumsum(units) - units
    doc = np.repeat(np.arange(len(units)), units)
    log_unit = np.concatenate(rows).astype(np.float64) / GRAM  # runs overlap
    likelihood = np.exp(log_unit - log_unit.max(1, keepdims=True))
    allowed = np.ones((len(units), n_langs))
    shares, fit_log = _em(likelihood, allowed / n_langs, allowed, begins, doc, units, ROUNDS)
    price = penalty * np.log(units + 1.0)
    for size in range(n_langs - 1, 0, -1):
        less = allowed.copy()
        less[np.arange(len(units)), np.where(allowed > 0, shares, np.inf).argmin(1)] = 0
        start = (shares + 1e-6) * less
        start /= start.sum(1, keepdims=True)
        tried, tried_log = _em(likelihood, start, less, begins, doc, units, MORE)
        better = (allowed.sum(1) == size + 1) & (2 * (fit_log - tried_log) <= price)
        allowed[better], shares[better], fit_log[better] = less[better], tried[better], tried_log[better]
    out[which] = shares
    return out


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), penalty: float = PENALTY) -> DataFrame:
    """Columns ``keep``, lang_pred, score (its share) and langs (map of the chosen set to shares).

    Null text and text without letters are ``und`` with score 0, as is everything when no language was learned. Of languages with equal
    shares the first by name is predicted. A text is read in blocks, so what it takes grows with its units, not with its bytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast((langs, logs))
    kept = docs.select(*keep).schema.fields
    schema = T.StructType(
        [*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.MapType(T.StringType(), T.DoubleType()))]
    )

    def run(batches):
        names, table = sent.value
        for part, texts in _batches(batches, len(keep)):
            shares = mixtures([t or "" for t in texts], table, penalty)
            best = shares.argmax(1) if len(names) else np.zeros(len(texts), dtype=int)
            sure = shares.max(1) if len(names) else np.zeros(len(texts))
            said = [names[b] if s > 0 else UNDETERMINED for b, s in zip(best.tolist(), sure.tolist(), strict=True)]
            sets = [[(names[j], float(row[j])) for j in np.flatnonzero(row > 0)] for row in shares]
            arrays = [pa.array(said, pa.string()), pa.array(np.clip(sure, 0, 1), pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *arrays], names=schema.names)

    return docs.select(*keep, text_col).mapInArrow(lean(run), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from rows that aren't held out (crc32 of the id as text, mod 4, is 2) and predict all rows.

    Returns doc_id, held_out, lang_pred, score, langs. A null id is neither held out nor learned from. Repeated rows give
    repeated results; an empty table gives an empty result. Only the three named columns are read, the language and the id
    for learning only.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    langs, logs = fit(docs.where(fold != 2), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, langs, logs, keep=("doc_id", "held_out"))


def op10_language_id(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("langs")
