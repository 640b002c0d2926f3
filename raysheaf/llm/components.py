"""Connected components of a link table, by alternating star contraction.

Each round hooks nodes to smaller neighbours (large star, then small star), which keeps the components and shortens paths, so
the number of rounds grows with the logarithm of the longest chain. Links live in written tables; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise


def _stars(links: DataFrame, both: bool, written: list[DataFrame]) -> DataFrame:
    """One half round over links (a, b): large star (``both``) or small star; what it writes is added to ``written``."""
    if both:
        sides = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")).withColumnRenamed("a", "node")
    least = materialise(least, "least")  # so that the join reads both sides from a shuffle and AQE can split a hot node
    written.append(least)
    joined = sides.join(least, F.col("a") == F.col("node"))
    if both:  # neighbours above the node go to the least
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:  # the node and its smaller neighbours go to the least
        moved = joined.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("x")).select("x.a", "x.b")
    return moved.where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of a link (a, b) with the smallest node that it reaches. No links: no rows."""
    current = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:  # stars only: each node hangs on its smallest
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
        written = [current]
        following = materialise(_stars(_stars(current, True, written), False, written), "links")
        for table in written:
            discard(table)
        current = following
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
