"""Adaptive integration of temperature and ionized fraction, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import physics as P
from ..functions import units as U

MAX_DEPTH = 100
CAP = 1.0 / np.finfo(np.float64).eps


def _update(value, change, allowed, dt):
    with np.errstate(divide="ignore", invalid="ignore"):
        relative = np.fmin(np.abs(change / value), CAP)
        ok = ~(relative > allowed)
        advice = dt * (allowed / relative)
    return ok, value + change, advice


def integrate(t, x, density, rate, length, volume, a, dt, safety=0.1, prevent_cooling=True):
    """(temperature, fraction, recommended step, limiting process: 0 temperature, 1 fraction) after ``dt`` of each row.

    A step whose relative change exceeds ``safety`` is replaced by two of half its length, to a depth of 100 halvings, depth
    first; the recommendation is the last piece's. A row that doesn't converge keeps its state and is given dt / 10.
    """
    t, x = np.array(t, dtype=np.float64), np.array(x, dtype=np.float64)
    density, rate, length, volume, a, dt = (np.broadcast_to(np.asarray(v, dtype=np.float64), t.shape) for v in (density, rate, length, volume, a, dt))
    n = len(t)
    t_floor = t.copy() if prevent_cooling else np.zeros(n)
    x_floor = x.copy() if prevent_cooling else np.full(n, U.FRACTION_EPSILON)
    advice, process = dt / 10.0, np.zeros(n, dtype=np.int64)
    depth = np.zeros(n, dtype=np.int64)
    second = np.zeros((n, MAX_DEPTH + 2), dtype=bool)  # whether the piece at each depth is a second half
    live = np.arange(n)

    def clamped(fraction, i):
        return np.minimum(np.maximum(fraction, x_floor[i]), 1.0 - U.FRACTION_EPSILON)

    while len(live):
        i = live
        x[i] = clamped(x[i], i)
        t[i] = np.maximum(t[i], t_floor[i])
        step = dt[i] * 0.5 ** depth[i]
        old_t, old_x = t[i], x[i]
        ok, new_t, t_advice = _update(old_t, P.temperature_change(old_t, old_x, density[i], rate[i], length[i], volume[i], a[i], step), safety, step)
        with np.errstate(all="ignore"):
            change = P.fraction_change(new_t, old_x, density[i], rate[i], length[i], volume[i], step)
        x_ok, new_x, x_advice = _update(old_x, change, safety, step)
        ok &= x_ok
        done, failed = i[ok], i[~ok]
        t[done] = np.maximum(new_t[ok], t_floor[done])
        x[done] = clamped(new_x[ok], done)
        by_fraction = x_advice[ok] <= t_advice[ok]
        advice_of = np.where(by_fraction, x_advice[ok], t_advice[ok])
        # the next piece: up while the piece was a second half, then the second half of the one reached
        d = depth[done]
        up = d.copy()
        climbing = np.ones(len(done), dtype=bool)
        while climbing.any():
            climbing &= (up > 0) & second[done, up]
            up[climbing] -= 1
        finished = up == 0
        advice[done[finished]] = advice_of[finished]
        process[done[finished]] = by_fraction[finished]
        going = done[~finished]
        depth[going] = up[~finished]
        second[going, depth[going]] = True
        depth[failed] += 1
        second[failed, np.minimum(depth[failed], MAX_DEPTH + 1)] = False
        lost = failed[depth[failed] > MAX_DEPTH]
        advice[lost], process[lost] = dt[lost] / 10.0, 0
        live = np.concatenate([going, failed[depth[failed] <= MAX_DEPTH]])
    return t, x, advice, process


def evolve(cells: DataFrame, dt: float, a: float = 1.0, safety: float = 0.1, prevent_cooling: bool = True) -> DataFrame:
    """``cells`` (temperature, xhii, density, rate, size, volume) after ``dt``: temperature and xhii are replaced, ``timescale``
    (recommended step) and ``process`` (what limits it) added. Rows are independent."""
    schema = T.StructType([f for f in cells.schema if f.name not in ("timescale", "process")] + [T.StructField("timescale", T.DoubleType()), T.StructField("process", T.StringType())])

    def run(batches):
        for pdf in batches:
            t, x, advice, process = integrate(
                pdf["temperature"].to_numpy(), pdf["xhii"].to_numpy(), pdf["density"].to_numpy(), pdf["rate"].to_numpy(), pdf["size"].to_numpy(), pdf["volume"].to_numpy(), a, dt, safety, prevent_cooling
            )
            names = pd.Series(np.where(process == 1, "ionization_fraction", "temperature"), index=pdf.index)
            yield pdf.assign(temperature=t, xhii=x, timescale=advice, process=names)[[f.name for f in schema]]

    return cells.mapInPandas(run, schema)
