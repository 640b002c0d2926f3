"""Weighted averages, histograms, statistics, window results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import HUBBLE, Cosmology
from ..sources.scan import in_ranges


def weighted(value, weight) -> Column:
    """sum(w v) / sum(w); 0 for no rows where the weight is there."""
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))


def averages(cells: DataFrame) -> DataFrame:
    """The engine's global averages, one row; averages over columns that aren't there are 0."""
    has = set(cells.columns)
    rate = F.col("photoionization_rate") if "photoionization_rate" in has else F.lit(0.0)
    volume = F.nullif(F.sum("volume"), F.lit(0.0))
    return cells.agg(
        weighted("xhii", "mass").alias("xhii_mass_average"),
        weighted("xhii", "volume").alias("xhii_volume_average"),
        weighted("temperature", "mass").alias("temperature_mass_average"),
        weighted("temperature", "volume").alias("temperature_volume_average"),
        (F.coalesce(F.sum(rate * F.col("volume")), F.lit(0.0)) / volume).alias("rate_volume_average"),
        (F.coalesce(F.sum(rate * F.col("xhii") * F.col("volume")), F.lit(0.0)) / volume).alias("rate_ionized_average"),
    )


def luminosity(sources: DataFrame, rate: str = "rate") -> DataFrame:
    return sources.agg(F.sum(rate).alias("total"), F.count("*").alias("n_sources"))


def limiting_processes(steps: DataFrame, max_step: float) -> DataFrame:
    """(process, n, percent) of rows (process, time) limited below the maximum step, rarest first."""
    counts = steps.where(F.col("time") < max_step).groupBy("process").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).orderBy("n", "process")


def arg_min(candidates: Sequence[tuple[str, Column]]) -> Column:
    """struct(time, process) of the least candidate; of equals the later one, as a candidate stays only if strictly less."""
    name, best = candidates[0]
    current = F.struct(best.alias("time"), F.lit(name).alias("process"))
    for name, time in candidates[1:]:
        other = F.struct(time.alias("time"), F.lit(name).alias("process"))
        current = F.when(current["time"] < time, current).otherwise(other)
    return current


def runtime_statistics(calls: DataFrame, category: str, seconds: str) -> DataFrame:
    return calls.groupBy(category).agg(F.avg(seconds).alias("average"), F.sum(seconds).alias("total"), F.count(seconds).alias("num_calls"))


def relative_change(a: Column, b: Column, threshold: float | None = None) -> Column:
    """|a - b| / |a|, at most 1/eps (which 0/0 gives too); 0 where both are below the threshold."""
    cap = F.lit(1.0 / 2.220446049250313e-16)
    change = F.least(F.abs(F.try_divide(F.abs(a - b), a)), cap)
    return F.when((a < threshold) & (b < threshold), 0.0).otherwise(change) if threshold is not None else change


def first_crossing(history: DataFrame, entity: str, time: str, value: str, above: float = 0.5) -> DataFrame:
    """(entity, time): when the value first was above; null for never."""
    return history.groupBy(entity).agg(F.min(F.when(F.col(value) > above, F.col(time))).alias("first_time"))


def monotone_floor(history: DataFrame, entity: str, order: Sequence[str], value: str) -> DataFrame:
    """The running maximum of a value."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return history.withColumn(f"{value}_floor", F.max(value).over(w))


def change_from_previous(history: DataFrame, entity: str, order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(*order)
    return history.withColumn("previous", F.lag(value).over(w)).withColumn("change", relative_change(F.col(value), F.coalesce(F.col("previous"), F.lit(0.0))))


def cyclic_pairs(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each row with the next one's value; the last one's next is the first."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("next", F.coalesce(F.lead(value).over(w), F.first(value).over(w)))


def exclusive_prefix(df: DataFrame, order: str, value: str, rows: int = 1_000_000) -> DataFrame:
    """The sum of the values before each row, in order of a unique key. In two levels: within ranges of about ``rows`` rows, then
    over the ranges' totals, so that no task walks all rows, whatever the keys' values are."""
    ranged = in_ranges(df, order, rows)
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, "__part")
    return out.withColumn("prefix", F.col("__in") + F.col("__shift")).drop("__part", "__in", "__shift")


def attenuated_along(cells: DataFrame, ray: Sequence[str], order: str, tau: str) -> DataFrame:
    """Share of a ray's light that reaches each of its cells: exp(-sum of the optical depths before it)."""
    w = Window.partitionBy(*ray).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("transmission", F.exp(-F.coalesce(F.sum(tau).over(w), F.lit(0.0))))


def halo_fraction(points: DataFrame, is_halo: str) -> DataFrame:
    """Share of halo points; more than 5 % is worth a warning."""
    share = F.sum(F.col(is_halo).cast("int")) / F.nullif(F.count("*"), F.lit(0))
    return points.agg(share.alias("halo_fraction"), F.coalesce(share > 0.05, F.lit(False)).alias("warn"))


def synchronise(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """(key, status): inserted, deleted, updated or unchanged rows between two versions of a table."""
    a = old.select(F.col(key).alias("a_key"), F.col(version).alias("a_v"))
    b = new.select(F.col(key).alias("b_key"), F.col(version).alias("b_v"))
    status = (
        F.when(F.col("a_key").isNull(), "inserted").when(F.col("b_key").isNull(), "deleted").when(F.col("a_v").eqNullSafe(F.col("b_v")), "unchanged").otherwise("updated")
    )
    return a.join(b, F.col("a_key") == F.col("b_key"), "full_outer").select(F.coalesce("a_key", "b_key").alias(key), status.alias("status"))


def extend(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both tables, the new one's where both have a key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def interpolated(table: DataFrame, points: DataFrame, x: str, y: str, xs: Sequence[float], ys: Sequence[float], clamp: float = 1.00001) -> DataFrame:
    """Bilinear interpolation of a small table (i, j, value over bins ``xs`` by ``ys``, parameters of bounded length) at points.

    Points outside are moved inside the outermost bins by the factor ``clamp``.
    """
    def placed(c: str, bins: Sequence[float], name: str) -> DataFrame:
        v = F.greatest(F.least(F.col(c), F.lit(bins[-1] / clamp)), F.lit(bins[0] * clamp))
        at = F.size(F.filter(F.array(*(F.lit(float(b)) for b in bins)), lambda b: b <= v)) - 1
        return {f"__{name}": v, f"__{name}i": F.greatest(F.least(at, F.lit(len(bins) - 2)), F.lit(0))}

    out = points.withColumns({**placed(x, xs, "x"), **placed(y, ys, "y")})
    values = [[0.0] * len(ys) for _ in xs]
    for row in table.collect():  # len(xs) * len(ys) rows
        values[row.i][row.j] = float(row.value)
    flat = F.array(*(F.lit(v) for line in values for v in line))
    pick = lambda i, j: F.element_at(flat, (i * len(ys) + j + 1).cast("int"))
    bin_of = lambda bins, i: F.element_at(F.array(*(F.lit(float(b)) for b in bins)), (i + 1).cast("int"))
    i, j = F.col("__xi"), F.col("__yi")
    fx = (F.col("__x") - bin_of(xs, i)) / (bin_of(xs, i + 1) - bin_of(xs, i))
    fy = (F.col("__y") - bin_of(ys, j)) / (bin_of(ys, j + 1) - bin_of(ys, j))
    low = pick(i, j) + fx * (pick(i + 1, j) - pick(i, j))
    high = pick(i, j + 1) + fx * (pick(i + 1, j + 1) - pick(i, j + 1))
    return out.withColumn("value", low + fy * (high - low)).drop("__x", "__y", "__xi", "__yi")


def age(a: Column, cosmology: Cosmology) -> Column:
    """Seconds since the beginning at scale factor ``a``."""
    ratio = cosmology.omega_lambda / cosmology.omega_0
    return F.asinh(F.sqrt(ratio * a * a * a)) * (2.0 / (3.0 * cosmology.omega_lambda**0.5) / (HUBBLE * cosmology.h))


def stellar_rates(stars: DataFrame, table: DataFrame, ages: Sequence[float], metallicities: Sequence[float], cosmology: Cosmology, escape_fraction: float = 1.0) -> DataFrame:
    """``stars`` (mass, metallicity, formation_a) with ``rate``: the table's photon rate per mass at a star's age (seconds) and
    metallicity, times its mass and the share that escapes. Wind particles (formation_a <= 0) are dropped."""
    formed = stars.where(F.col("formation_a") > 0)
    aged = formed.withColumn("age", F.lit(cosmology.age(cosmology.a)) - age(F.col("formation_a"), cosmology))
    out = interpolated(table, aged, "age", "metallicity", ages, metallicities)
    return out.withColumn("rate", F.col("value") * F.col("mass") * escape_fraction).drop("value")


class Registry:
    """Metrics of a time series by name: functions from the cells to a number, evaluated in the order they were registered."""

    def __init__(self):
        self.metrics: dict[str, Callable[[DataFrame], float | None]] = {}

    def register(self, name: str, metric: Callable[[DataFrame], float | None]) -> None:
        if name in self.metrics:
            raise ValueError(f"metric {name} is registered already")
        self.metrics[name] = metric

    def values(self, cells: DataFrame) -> dict[str, float | None]:
        return {name: metric(cells) for name, metric in self.metrics.items()}
