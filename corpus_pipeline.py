"""A training-data pipeline over ``documents``: five stages, each one operator of ``raysheaf.llm`` over all that its
predecessor kept. Every stage is written as Parquet in the shared folder and read again before the next.

Stages decide on rows, not on ids: repeated and null ids are no harm, other columns pass unchanged whatever their names. Null text
is treated as empty text. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raysheaf.llm import byte_bpe, decontaminate, exact_dedup, quality, simhash_similar
from raysheaf.session import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that importance resampling draws. Null and blank texts are judged like a text of average n-grams."""
    return quality.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text, that with the largest id. Null and empty texts are one text; ties leave one row."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of texts linked by a Jaccard similarity of 0.8 or more over runs of five
    words. Texts without words are alike; ties leave one row."""
    return simhash_similar.keep_one(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of whose words fewer than one in twenty lie in passages of the benchmark. Texts without words stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids, and decoded_sha256, the digest of the bytes that the ids decode to. Ids are written
    before they are decoded, so that a task has one Python worker at a time."""
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.decode(materialise(byte_bpe.encode(docs, path, public.PATTERN), "ids"), path)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level bpe", tokens_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
