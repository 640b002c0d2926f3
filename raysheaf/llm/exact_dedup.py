"""Exact deduplication, DataFrame functions only.

Method: copies are first merged inside each task (the map-side half of the aggregate), then per digest and salt, and the
salt winners are merged globally. Every stage groups by the digest *and the whole text*, so equality is decided on content
and a digest collision can't merge two texts. A group that holds a third of all rows leaves each task as at most ``salts``
rows, so no task gathers it. Only the narrow (digest, keep_id, group_size) table is joined back to the documents; that join
is on the digest, one row a digest on one side, which AQE splits when a digest is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .rows import likely, named, without

SALTS = 8


def merge_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest (32 bytes), text, keep_id (largest id) and group_size.

    Null text counts as the empty text. A null id never wins against another id. Extra columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    )
    salted = keyed.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts share a group; the row with the largest id stays. Null text is the empty text and forms a group with it.
    Rows that repeat an id and its text count each in group_size and are all marked kept if theirs is the largest id: they
    are the same document. An id with two texts is in two groups. An empty table gives an empty result; columns other than the two named are ignored.
    """
    classes = materialise(merge_copies(docs, id_col, text_col, salts).select("digest", "keep_id", "group_size"), "exact")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    clash = classes.groupBy("digest").count().where("count > 1").select("digest")
    if clash.isEmpty():
        joined = rows.drop("text").join(classes, "digest")
    else:  # two texts of one digest: they alone are matched by content
        clash = materialise(clash, "clash")
        whole = merge_copies(docs, id_col, text_col, salts).join(clash, "digest", "left_semi")
        by_text = rows.join(clash, "digest", "left_semi").join(whole, ["digest", "text"]).drop("text")
        by_digest = rows.drop("text").join(clash, "digest", "left_anti").join(classes, "digest")
        joined = by_digest.unionByName(by_text)
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _same_digest_other_text(copies: DataFrame, salts: int) -> DataFrame:
    """(digest): those of rows (row, digest, text) that more than one text has. Texts are merged inside each task, by salt and globally."""
    salted = copies.withColumn("salt", F.pmod(F.xxhash64("row.file", "row.at"), F.lit(salts)).cast("int")).groupBy("digest", "salt", "text").agg(F.count("*").alias("n"))
    texts = salted.groupBy("digest", "text").agg(F.sum("n").alias("n"))
    return texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of each distinct text, all its columns unchanged: the one with the largest id, of rows that repeat it one.

    Rows are told apart by their place, so an id with two texts loses neither; a row without an id gives way to any other.
    Narrow rows of a digest and a place tell which rows may be copies. Only the texts of those are moved, and compared whole at every
    stage; should a digest have two texts, its rows are grouped by text instead.
    """
    rows, row = named(docs, F.col(id_col).isNotNull(), F.col(id_col))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    narrow = materialise(rows.select(F.col(row).alias("row"), digest.alias("digest")), "digests")
    groups = narrow.groupBy("digest").agg(F.max("row").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialise(groups, "groups")  # so that both sides of the join come from a shuffle and a hot digest can be split
    members = materialise(narrow.join(groups.hint("merge"), "digest"), "members")
    discard(narrow)
    marked, perhaps = likely(rows, row, members.select("row"))
    copies = marked.where(perhaps).select(F.col(row).alias("row"), digest.alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    clash = materialise(_same_digest_other_text(copies, salts), "clash")
    gone = members.where("row <> keep").select("row", "digest")
    if not clash.isEmpty():
        by_text = exact_groups(copies.join(clash, "digest", "left_semi"), "row", "text", salts).where("not kept").select(F.col("doc_id").alias("row"))
        return without(rows, row, gone.join(clash, "digest", "left_anti").select("row").unionByName(by_text), docs.columns)
    return without(rows, row, gone.select("row"), docs.columns)


def op7_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
