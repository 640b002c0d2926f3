"""Timestep levels and their schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def level_of(desired: Column, max_step: float, n_levels: int) -> Column:
    """ceil(log2(max / desired)) in [0, n - 1]; a desired step of 0 has the last level, one beyond the maximum the first."""
    raw = F.ceil(F.log2(F.lit(max_step) / F.nullif(desired, F.lit(0.0))))
    return F.greatest(F.least(F.coalesce(raw, F.lit(n_levels - 1)), F.lit(n_levels - 1)), F.lit(0)).cast("int")


def step_of(level: Column, max_step: float) -> Column:
    return F.lit(max_step) * F.pow(F.lit(0.5), level)


def floored(level: Column, lowest_allowed: int) -> Column:
    return F.greatest(level, F.lit(lowest_allowed))


def active(cells: DataFrame, level: int) -> DataFrame:
    return cells.where(F.col("level") >= level)


def active_per_level(cells: DataFrame, n_levels: int) -> DataFrame:
    """(level, n, active): cells of a level and of it and all above; empty levels have a row."""
    spark = cells.sparkSession
    counts = cells.groupBy("level").agg(F.count("*").alias("n"))
    every = spark.range(n_levels).select(F.col("id").cast("int").alias("level")).join(counts, "level", "left").fillna(0, ["n"])
    above = Window.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # n_levels rows
    return every.withColumn("active", F.sum("n").over(above))


def neighbour_levels(faces: DataFrame, cells: DataFrame) -> DataFrame:
    """Each interior face with the level of the cell across."""
    return faces.where("kind = 'interior'").join(cells.select(F.col("cell_id").alias("neighbour_id"), F.col("level").alias("neighbour_level")), "neighbour_id")


def schedule(n_levels: int, floor: int = 0) -> list[int]:
    """Levels in the order they are swept in one round: sub-cycle i has level floor + (m - 1 - trailing zeros of i)."""
    m = n_levels - floor
    return [floor + (m - 1 - ((i & -i).bit_length() - 1 if i else m - 1)) for i in range(1 << (m - 1))]


def schedule_frame(spark: SparkSession, n_levels: int, floor: int = 0) -> DataFrame:
    """(i, level) of the same."""
    m = n_levels - floor
    i = F.col("id")
    zeros = F.when(i == 0, m - 1).otherwise(F.bit_count(i.bitwiseAND(-i) - 1))
    return spark.range(1 << (m - 1)).select(i.alias("i"), (F.lit(floor + m - 1) - zeros).cast("int").alias("level"))


def lowest_allowed(n_levels: int, round_: int) -> int:
    """The lowest level of a round: the first two rounds have the highest level only, each later round one more."""
    return max(0, n_levels - max(1, round_))


def lowest_at(n_levels: int, iteration: Column) -> Column:
    """``lowest_allowed`` for a column of iterations."""
    return F.greatest(F.lit(0), F.lit(n_levels) - F.greatest(F.lit(1), iteration)).cast("int")


def level_at(n_levels: int, iteration: Column) -> Column:
    """The lowest level that is active in an iteration of the hierarchical scheme: all levels in the first one, then as many as the
    iteration's number can be halved."""
    halved = F.bit_count(F.bitwise_not(iteration).bitwiseAND(iteration - 1))
    return (n_levels - 1 - F.when(iteration == 0, n_levels - 1).otherwise(F.least(halved, F.lit(n_levels - 1)))).cast("int")
