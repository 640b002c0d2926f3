"""Space-filling curve keys.

3-D keys have 42 bits an axis and are returned as (hi, lo), two non-negative longs of 63 bits whose order is the key's.
``with_curve_key`` walks the Peano-Hilbert automaton in the JVM. ``with_key`` gives Hilbert keys by Skilling's transform (AIP Conf.
Proc. 707, 2004), whose curve differs by a rotation, which changes no neighbourhood and no balance. ``morton`` interleaves bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS_3D, BITS_2D = 42, 32


def _transpose(axes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    x = [a.astype(np.uint64).copy() for a in axes]
    one = np.uint64(1)
    n = len(x)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    return [a ^ t for a in x]


def _interleave(parts: list[np.ndarray], high: int, low: int) -> np.ndarray:
    """Bits [low, high) of all axes, highest first."""
    key = np.zeros(len(parts[0]), dtype=np.uint64)
    for bit in range(high - 1, low - 1, -1):
        for p in parts:
            key = (key << np.uint64(1)) | ((p >> np.uint64(bit)) & np.uint64(1))
    return key


def hilbert3(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of unit coordinates in [0, 1)."""
    scale = float(1 << BITS_3D)
    top = (1 << BITS_3D) - 1
    axes = [np.minimum(np.floor(np.clip(v, 0.0, 1.0) * scale), top).astype(np.uint64) for v in (x, y, z)]
    parts = _transpose(axes, BITS_3D)
    half = BITS_3D // 2
    return _interleave(parts, BITS_3D, half).astype(np.int64), _interleave(parts, half, 0).astype(np.int64)


def hilbert2(ix: np.ndarray, iy: np.ndarray, bits: int = BITS_2D) -> np.ndarray:
    """Key of integer coordinates of ``bits`` bits."""
    return _interleave(_transpose([ix, iy], bits), bits, 0)


def hilbert2_inverse(key: np.ndarray, bits: int = BITS_2D) -> tuple[np.ndarray, np.ndarray]:
    key = key.astype(np.uint64)
    one = np.uint64(1)
    x = [np.zeros(len(key), dtype=np.uint64) for _ in range(2)]
    for bit in range(bits - 1, -1, -1):
        for i in range(2):
            x[i] = (x[i] << one) | ((key >> np.uint64(2 * bit + 1 - i)) & one)
    t = x[1] >> one
    x[1] = x[1] ^ x[0]
    x[0] = x[0] ^ t
    for b in range(1, bits):
        q = one << np.uint64(b)
        p = q - one
        for i in (1, 0):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    return x[0], x[1]


def morton(cells: Sequence[Column], bits: int) -> Column:
    """The bits of whole numbers of ``bits`` bits interleaved, the first number's bits lowest; 62 bits in all at most."""
    d = len(cells)
    terms = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(1), d * b + i) for b in range(bits) for i, c in enumerate(cells)]
    return reduce(lambda x, y: x.bitwiseOR(y), terms)


def with_morton_pair(df: DataFrame, axes: Sequence[str], low: Sequence[float], side: float, bits: int, hi: str, lo: str) -> DataFrame:
    """``df`` with a key of 2 x ``bits`` bits an axis in two columns, compared one after the other; what is outside counts to the rim."""
    top, cells = (1 << bits) - 1, {}
    for i, (a, start) in enumerate(zip(axes, low, strict=True)):
        unit = F.least(F.greatest((F.col(a) - start) / side, F.lit(0.0)), F.lit(1.0)) * (1 << bits)
        cells[f"__h{i}"] = F.least(F.floor(unit), F.lit(top))
        cells[f"__l{i}"] = F.least(F.floor((unit - F.floor(unit)) * (1 << bits)), F.lit(top))
    df = df.withColumns(cells)
    pair = {name: morton([F.col(f"__{k}{i}") for i in range(len(axes))], bits) for name, k in ((hi, "h"), (lo, "l"))}
    return df.withColumns(pair).drop(*cells)


# The order in which the curve visits the octants of a cube (4 for the upper half of x, 2 of y, 1 of z), and the same
# for the cubes in its eight octants.
CURVE_ORDER = [0, 7, 1, 6, 3, 4, 2, 5]
CURVE_CHILD_ORDERS = [
    [0, 1, 7, 6, 3, 2, 4, 5],
    [6, 7, 1, 0, 5, 4, 2, 3],
    [0, 3, 1, 2, 7, 4, 6, 5],
    [4, 7, 5, 6, 3, 0, 2, 1],
    [2, 5, 3, 4, 1, 6, 0, 7],
    [2, 5, 3, 4, 1, 6, 0, 7],
    [0, 3, 1, 2, 7, 4, 6, 5],
    [4, 7, 5, 6, 3, 0, 2, 1],
]


def curve_states() -> tuple[list[int], list[int]]:
    """(next state, digit) at 8 * state + octant of the curve's automaton; it starts in state 0.

    A state is the order of a cube. An order is the first one after a turn of the cube, and its octants' orders are the first one's
    octants' orders after the same turn; what can be reached are the cube's 24 turns.
    """
    states, follow, digits = [tuple(CURVE_ORDER)], [], []
    for order in states:
        turn = [CURVE_ORDER.index(digit) for digit in order]
        for octant in range(8):
            child = tuple(CURVE_CHILD_ORDERS[turn[octant]][t] for t in turn)
            if child not in states:
                states.append(child)
            follow.append(states.index(child))
        digits += order
    return follow, digits


def curve_key(x: Column, y: Column, z: Column) -> Column:
    """A struct with hi and lo, of whole coordinates of 42 bits: the automaton walks over the bits, highest first, in the JVM."""
    follow, digits = (F.lit(t) for t in curve_states())
    bit = lambda c, b: F.call_function("shiftright", c, b).bitwiseAND(1).cast("int")

    half = BITS_3D // 2

    def step(acc: Column, b: Column) -> Column:
        at = acc["state"] * 8 + bit(x, b) * 4 + bit(y, b) * 2 + bit(z, b) + 1
        longer = lambda key: acc[key] * 8 + F.element_at(digits, at)
        upper = b >= half
        return F.struct(
            F.element_at(follow, at).alias("state"), F.when(upper, longer("hi")).otherwise(acc["hi"]).alias("hi"), F.when(upper, acc["lo"]).otherwise(longer("lo")).alias("lo")
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))
    return F.aggregate(F.sequence(F.lit(BITS_3D - 1), F.lit(0), F.lit(-1)), start, step)


def with_curve_key(df: DataFrame, low: Sequence[float], high: Sequence[float], axes: Sequence[str] = ("x", "y", "z"), hi: str = "hi", lo: str = "lo") -> DataFrame:
    """``df`` with the curve's key (hi, lo) in a box that is padded by a thousandth of its sides at each end.

    Positions outside count to the rim; a row without a position has no key.
    """
    top, cells = (1 << BITS_3D) - 1, {}
    for a, start, end in zip(axes, low, high, strict=True):
        begin, stop = start - (end - start) * 0.001, end + (end - start) * 0.001
        share = (F.col(a) - begin) / (stop - begin)
        cells[f"__k{a}"] = F.least(F.greatest(F.floor(share * float(1 << BITS_3D)), F.lit(0)), F.lit(top))
    known = F.lit(True)
    for a in axes:
        known = known & F.col(a).isNotNull()
    keyed = df.withColumns(cells).withColumn("__key", F.when(known, curve_key(*(F.col(c) for c in cells))))
    return keyed.withColumns({hi: F.col("__key.hi"), lo: F.col("__key.lo")}).drop("__key", *cells)


def key_midpoint(a: int, b: int) -> int:
    return a // 2 + b // 2


def midpoint(a: Column, b: Column) -> Column:
    """The key between two keys, without overflow."""
    return F.shiftright(a, 1) + F.shiftright(b, 1)


def successor(key: Column, bits: int) -> Column:
    """The next key; the last one of ``bits`` bits is its own."""
    return F.least(key + 1, F.lit((1 << bits) - 1))


def key_successor(key: int, bits: int = 3 * BITS_3D) -> int:
    return min(key + 1, (1 << bits) - 1)


def key_range(low: tuple, high: tuple, box_low: tuple, side: float, padding: float = 1e-3) -> tuple[tuple[int, int], tuple[int, int]]:
    """The least and the greatest key (hi, lo) of a box's corners."""
    start, width = [v - padding * side / 2 for v in box_low], side * (1 + padding)
    ends = np.array([[(high if (n >> i) & 1 else low)[i] for i in range(3)] for n in range(8)], dtype=float)
    hi, lo = hilbert3(*((ends[:, i] - start[i]) / width for i in range(3)))
    keys = sorted(zip(hi.tolist(), lo.tolist(), strict=True))
    return keys[0], keys[-1]


def sorted_by_key(df: DataFrame, low: tuple, side: float, parts: int) -> DataFrame:
    """``df`` with its key, dealt to ``parts`` ranges of it and sorted inside: neighbours in space are near each other."""
    return with_key(df, low, side).repartitionByRange(parts, "hi", "lo").sortWithinPartitions("hi", "lo")


def with_key(df: DataFrame, low: tuple, side: float, padding: float = 1e-3) -> DataFrame:
    """``df`` (x, y, z) with its key (hi, lo) in the box padded by a share of its side."""
    start, width = [v - padding * side / 2 for v in low], side * (1 + padding)
    schema = T.StructType([*df.schema.fields, T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])

    def run(batches):
        for pdf in batches:
            hi, lo = hilbert3(*((pdf[a].to_numpy() - s) / width for a, s in zip("xyz", start, strict=True)))
            yield pdf.assign(hi=pd.Series(hi, index=pdf.index), lo=pd.Series(lo, index=pdf.index))

    return df.mapInPandas(run, schema)
