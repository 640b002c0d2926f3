"""Domain decomposition: cuts of a key space into parts of equal load.

Method: all cuts are searched at once by rounds of histogram refinement. A round deals the keys of each interval that still holds a cut
into ``bins`` bins and adds their loads up in the tasks; only sums and bounds of bins leave them. The bin in which a cut's share of the
load is passed is the next round's interval, shrunk to the keys that it holds, so gaps and clusters of any scale cost no
rounds. A bin with one key is the cut. Keys are two columns compared one after the other (a 126-bit curve key, or a number
and a constant), loads are whole numbers, so cuts are exact and the same whatever the partitions are.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 256
MOST_BINS = 1 << 17  # of all intervals of a round together: what a round sends to the driver
BRANCHES = 64  # cuts that are compared in an expression; more are searched in the tasks


class Cuts(NamedTuple):
    keys: list[tuple]  # (hi, lo) of the first key of parts 1, 2, ...
    rounds: int  # passes over the rows


class _Span(NamedTuple):
    top: int  # its bin of the first round
    bounds: tuple  # least and greatest hi, least and greatest lo (lo counts where hi is one value)
    base: int  # load of all keys before it
    wanted: list[int]  # the cuts in it


def _bin(low_hi: Column, high_hi: Column, low_lo: Column, high_lo: Column, bins: int) -> Column:
    """0 to bins - 1, never less for a greater key of the interval: each step of the arithmetic is monotone."""
    share = lambda c, low, high: F.least(F.floor((c - low).cast("double") / (high - low).cast("double") * bins), F.lit(bins - 1))
    return F.when(low_hi < high_hi, share(F.col("hi"), low_hi, high_hi)).when(low_lo < high_lo, share(F.col("lo"), low_lo, high_lo)).otherwise(0).cast("int")


def load_cuts(df: DataFrame, hi: Column, lo: Column, load: Column, parts: int, bins: int = BINS, strict: bool = True) -> Cuts:
    """The ``parts - 1`` cuts: cut i is the least key up to which, itself included, the load is more than i / parts of the whole.

    Not ``strict``: at least that share, as a discrete quantile. Rows without a key don't count, a null load is 0; loads are whole
    numbers and not negative, keys are finite. Without any load there are no cuts. A key that outweighs a part is several cuts.
    ``df`` is read once a round: write it before if that is dear. Rounds are few: each divides what is left by ``bins``.
    """
    keyed = df.select(hi.alias("hi"), lo.alias("lo"), F.coalesce(load, F.lit(0)).cast("decimal(38,0)").alias("load")).where("hi IS NOT NULL AND lo IS NOT NULL")
    ends = [f(c) for c in ("hi", "lo") for f in (F.min, F.max)]
    whole = keyed.agg(F.sum("load").alias("load"), *(c.alias(f"b{i}") for i, c in enumerate(ends))).first()
    if parts < 2 or not whole["load"]:
        return Cuts([], 1)
    total, bounds = int(whole["load"]), tuple(whole[f"b{i}"] for i in range(4))
    found: dict[int, tuple] = {}
    spans, rounds = [_Span(0, bounds, 0, list(range(1, parts)))], 1
    first, first_bins = _bin(*(F.lit(b) for b in bounds), bins), bins
    kinds = [keyed.schema[c].dataType for c in ("hi", "hi", "lo", "lo")]
    table = T.StructType([T.StructField("top", T.IntegerType()), T.StructField("span", T.IntegerType()), *(T.StructField(f"s{i}", k) for i, k in enumerate(kinds))])
    while spans:
        if rounds == 1:
            rows = keyed.select(F.lit(0).alias("span"), first.alias("bin"), "hi", "lo", "load")
        else:  # a row for each cut at most is sent to the tasks
            sent = keyed.sparkSession.createDataFrame([(s.top, i, *s.bounds) for i, s in enumerate(spans)], table)
            s0, s1, s2, s3 = (F.col(f"s{i}") for i in range(4))
            bins = max(8, min(first_bins, MOST_BINS // len(spans)))
            within = F.col("hi").between(s0, s1) & ((s0 < s1) | F.col("lo").between(s2, s3))
            rows = keyed.withColumn("top", first).join(F.broadcast(sent), "top").where(within).select("span", _bin(s0, s1, s2, s3, bins).alias("bin"), "hi", "lo", "load")
        sums = rows.groupBy("span", "bin").agg(F.sum("load").alias("load"), *(c.alias(f"b{i}") for i, c in enumerate(ends))).toArrow().sort_by([("span", "ascending"), ("bin", "ascending")])
        rounds += 1  # bins stay columns on the driver: as rows of Python they would take many times that
        starts = np.searchsorted(sums["span"].to_numpy(), np.arange(len(spans) + 1)).tolist()
        following = []
        for i, span in enumerate(spans):
            before, wanted, own = span.base, list(span.wanted), sums.slice(starts[i], starts[i + 1] - starts[i])
            for at, load in enumerate(own["load"].to_pylist()):
                after = before + int(load)
                here = []
                while wanted and (after * parts > wanted[0] * total if strict else after * parts >= wanted[0] * total):
                    here.append(wanted.pop(0))
                if here:
                    bounds = tuple(own[f"b{k}"][at].as_py() for k in range(4))
                    if bounds[0] == bounds[1] and bounds[2] == bounds[3]:
                        found.update(dict.fromkeys(here, (bounds[0], bounds[2])))
                    else:
                        following.append(_Span(own["bin"][at].as_py() if rounds == 2 else span.top, bounds, before, here))
                before = after
        spans = following
    return Cuts([found[i] for i in sorted(found)], rounds)


def part_of(hi: Column, lo: Column, cuts: Sequence[tuple]) -> Column:
    """The part of a key: how many cuts are not greater. A tree of comparisons, so a row meets as many as the logarithm of the cuts; beyond
    ``BRANCHES`` cuts the tree would make a plan that the driver can't hold, and they are searched with numpy."""
    if len(cuts) > BRANCHES:
        return _searched(hi, lo, cuts)

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        a, b = (F.lit(v) for v in cuts[middle])
        return F.when((hi < a) | ((hi == a) & (lo < b)), between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(cuts))


def _searched(hi: Column, lo: Column, cuts: Sequence[tuple]) -> Column:
    highs, lows = (np.array([c[i] for c in cuts]) for i in range(2))

    def search(hi: pd.Series, lo: pd.Series) -> pd.Series:
        a, b = hi.to_numpy(), lo.to_numpy()
        begin, end = np.searchsorted(highs, a, "left"), np.searchsorted(highs, a, "right")
        while (open_ := begin < end).any():  # among cuts of the same hi
            middle = np.where(open_, (begin + end) // 2, 0)
            passed = open_ & (lows[middle] <= b)
            begin = np.where(passed, middle + 1, begin)
            end = np.where(open_ & ~passed, middle, end)
        return pd.Series(begin.astype(np.int32))

    known = hi.isNotNull() & lo.isNotNull()  # a null would turn whole numbers into doubles
    a, b = (F.when(known, c).otherwise(F.lit(v)) for c, v in zip((hi, lo), cuts[0], strict=True))
    return F.when(known, F.pandas_udf(search, "int")(a, b))


def decomposed(df: DataFrame, hi: Column, lo: Column, load: Column, parts: int, name: str = "part") -> DataFrame:
    """``df`` with the part of each row; parts carry about equal loads and are ranges of the key. Rows without a key go to part 0."""
    cuts = load_cuts(df, hi, lo, load, parts).keys
    return df.withColumn(name, F.when(hi.isNotNull() & lo.isNotNull(), part_of(hi, lo, cuts)).otherwise(0))


def part_loads(owned: DataFrame, load: Column, parts: int, name: str = "part") -> DataFrame:
    """(part, load, n) of every part, also of one without rows."""
    found = owned.groupBy(F.col(name).cast("long").alias(name)).agg(F.sum(F.coalesce(load, F.lit(0))).cast("long").alias("load"), F.count("*").alias("n"))
    return owned.sparkSession.range(parts).toDF(name).join(found, name, "left").fillna(0, ["load", "n"])


def load_imbalance(loads: DataFrame) -> DataFrame:
    """max_load, min_load and imbalance, (max - min) / max, of ``part_loads``; 0 where nothing has a load."""
    ends = loads.agg(F.max("load").alias("max_load"), F.min("load").alias("min_load"))
    return ends.withColumn("imbalance", F.when(F.col("max_load") > 0, (F.col("max_load") - F.col("min_load")) / F.col("max_load")).otherwise(0.0))
