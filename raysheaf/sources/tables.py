"""Adapters: the star-schema test tables read as particles, cells, stars, levels and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_STEP, N_LEVELS = 500_000.0, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as particles on the unit box."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("particle_id"),
        (micros / F.lit(2592000000000.0)).alias("x"),
        ((F.col("user_id") % 100 + 0.5) / 100).alias("y"),
        (F.col("value") / (F.col("value") + 100.0)).alias("z"),
        (0.001 + 0.01 * (F.col("event_id") % 7)).alias("density"),
        (1.0 + F.col("event_id") % 5).alias("volume"),
        (100.0 * (1 + F.col("user_id") % 50)).alias("temperature"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("xhii"),
    )


PARTICLES_SQL = """particles AS (
  SELECT event_id AS particle_id, (epoch_us(ts) - 1704067200000000) / 2592000000000.0 AS x, (user_id % 100 + 0.5) / 100 AS y,
         value / (value + 100.0) AS z, 0.001::DOUBLE + 0.01::DOUBLE * (event_id % 7) AS density, 1.0::DOUBLE + event_id % 5 AS volume,
         100.0::DOUBLE * (1 + user_id % 50) AS temperature, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100.0 AS xhii
  FROM events)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a complete Cartesian grid of 10 x 10 x K cells."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("cell_id"),
        (key % 10).alias("ix"),
        (F.floor(key / 10) % 10).alias("iy"),
        F.floor(key / 100).alias("iz"),
        (F.col("p_size") / 500.0).alias("tau"),
        F.col("p_retailprice").alias("src"),
    )


CELLS_SQL = """cells AS (
  SELECT p_partkey AS cell_id, p_partkey % 10 AS ix, (p_partkey // 10) % 10 AS iy, p_partkey // 100 AS iz,
         p_size / 500.0::DOUBLE AS tau, p_retailprice AS src FROM part)"""


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as point sources on the unit box."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("source_id"),
        ((key * 37 % 101 + 0.5) / 101).alias("x"),
        ((key * 53 % 103 + 0.5) / 103).alias("y"),
        ((key * 71 % 107 + 0.5) / 107).alias("z"),
        (F.col("s_acctbal") + 1000.0).alias("rate"),
    )


STARS_SQL = """stars AS (
  SELECT s_suppkey AS source_id, (s_suppkey * 37 % 101 + 0.5::DOUBLE) / 101 AS x, (s_suppkey * 53 % 103 + 0.5::DOUBLE) / 103 AS y,
         (s_suppkey * 71 % 107 + 0.5::DOUBLE) / 107 AS z, s_acctbal + 1000.0::DOUBLE AS rate FROM supplier)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of the embeddings as points."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), e[2].cast("double").alias("z")
    )


VECTORS_SQL = """vectors AS (
  SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"""
