"""Physical dimensions, units, constants and cosmology."""

from __future__ import annotations

import math
import re
from dataclasses import astuple, dataclass

# SI value of each unit and physical constant.
PARSEC, YEAR, SOLAR_MASS, ELECTRON_VOLT, ERG = 3.0857e16, 3.15576e7, 1.988477e30, 1.602176634e-19, 1e-7
BOLTZMANN, PROTON_MASS, GAMMA = 1.380649e-23, 1.67262192369e-27, 5.0 / 3.0
SIGMA_NUMBER = 2.9580524545305314e-18 * 1e-4  # m^2
SIGMA_ENERGY = 2.7352520425024469e-18 * 1e-4  # m^2
PHOTON_ENERGY, RYDBERG = 18.028356312818811 * ELECTRON_VOLT, 13.65693 * ELECTRON_VOLT
HYDROGEN_MASS_FRACTION, FRACTION_EPSILON = 0.76, 1e-10
HUBBLE = 3.2407789e-18  # h / s


@dataclass(frozen=True)
class Dimension:
    """Exponents of length, time, mass, temperature, little h and scale factor."""

    length: int = 0
    time: int = 0
    mass: int = 0
    temperature: int = 0
    h: int = 0
    a: int = 0

    def __mul__(self, other: Dimension) -> Dimension:
        return Dimension(*(x + y for x, y in zip(astuple(self), astuple(other), strict=True)))

    def __truediv__(self, other: Dimension) -> Dimension:
        return self * other**-1

    def __pow__(self, n: int) -> Dimension:
        return Dimension(*(x * n for x in astuple(self)))

    def metadata(self) -> dict:
        return {"dimension": dict(zip(("length", "time", "mass", "temperature", "h", "a"), astuple(self), strict=True)), "to_si": 1.0}


NONE, LENGTH, TIME, MASS, TEMPERATURE = Dimension(), Dimension(length=1), Dimension(time=1), Dimension(mass=1), Dimension(temperature=1)
ENERGY = MASS * LENGTH**2 / TIME**2
_BASE: dict[str, tuple[float, Dimension]] = {
    "m": (1.0, LENGTH), "cm": (1e-2, LENGTH), "km": (1e3, LENGTH), "pc": (PARSEC, LENGTH), "kpc": (1e3 * PARSEC, LENGTH), "Mpc": (1e6 * PARSEC, LENGTH), "Gpc": (1e9 * PARSEC, LENGTH),
    "s": (1.0, TIME), "yr": (YEAR, TIME), "kyr": (1e3 * YEAR, TIME), "Myr": (1e6 * YEAR, TIME), "Gyr": (1e9 * YEAR, TIME),
    "g": (1e-3, MASS), "kg": (1.0, MASS), "Msol": (SOLAR_MASS, MASS), "K": (1.0, TEMPERATURE),
    "J": (1.0, ENERGY), "erg": (ERG, ENERGY), "eV": (ELECTRON_VOLT, ENERGY), "h": (1.0, Dimension(h=1)), "a": (1.0, Dimension(a=1)),
}


@dataclass(frozen=True)
class Quantity:
    """A value in SI units with its dimension."""

    value: float
    dimension: Dimension

    def physical(self, a: float, h: float) -> Quantity:
        """The quantity without its cosmological factors."""
        d = self.dimension
        return Quantity(self.value * a**d.a * h**d.h, Dimension(d.length, d.time, d.mass, d.temperature))

    def __str__(self) -> str:
        names = zip(("m", "s", "kg", "K", "h", "a"), astuple(self.dimension), strict=True)
        return " ".join([repr(self.value), *(n if e == 1 else f"{n}^{e}" for n, e in names if e)])


def parse_quantity(text: str | float, expect: Dimension | None = None) -> Quantity:
    """``4000 kpc h^-1 a^1``, ``1e-3 g / cm^3``, ``12.5``."""
    if isinstance(text, (int, float)):
        text = repr(text)
    parts = re.findall(r"/|[^\s/*]+", text.strip())
    try:
        value, dimension, sign = float(parts[0]), NONE, 1
    except (IndexError, ValueError):
        raise ValueError(f"no number in quantity {text!r}") from None
    for part in parts[1:]:
        if part == "/":
            sign = -1
            continue
        found = re.fullmatch(r"([A-Za-z]+)(?:\^(-?\d+))?", part)
        if not found or found[1] not in _BASE:
            raise ValueError(f"unknown unit {part!r} in {text!r}")
        factor, base = _BASE[found[1]]
        power = sign * int(found[2] or 1)
        value, dimension = value * factor**power, dimension * base**power
    if expect is not None and dimension != expect:
        raise ValueError(f"{text!r} has dimension {dimension}, expected {expect}")
    return Quantity(value, dimension)


# ---- units of files


def own_factor(attributes: dict, a: float = 1.0, h: float = 1.0) -> tuple[float, Dimension]:
    """Factor to SI and dimension from the attributes that this library's own snapshots carry."""
    d = Dimension(*(int(attributes[f"scaling_{n}"]) for n in ("length", "time", "mass", "temperature", "h", "a")))
    return float(attributes["scale_factor_si"]), d


def external_factor(attributes: dict, a: float, h: float) -> tuple[float, Dimension]:
    """The same from ``to_cgs`` and the scalings of another code's snapshots; a zero ``to_cgs`` without dimensions means 1."""
    length = int(attributes["length_scaling"]) + int(attributes["velocity_scaling"])
    time, mass = -int(attributes["velocity_scaling"]), int(attributes["mass_scaling"])
    to_cgs = float(attributes["to_cgs"])
    if to_cgs == 0.0:
        if length or time or mass:
            raise ValueError("to_cgs is 0 on a dataset with a dimension")
        to_cgs = 1.0
    factor = a ** int(attributes["a_scaling"]) * h ** int(attributes["h_scaling"]) * 0.01**length * 0.001**mass * to_cgs
    return factor, Dimension(length, time, mass)


# ---- cosmology


def redshift(a: float) -> float:
    return 1.0 / a - 1.0


def scale_factor(z: float) -> float:
    return 1.0 / (1.0 + z)


@dataclass(frozen=True)
class Cosmology:
    """A flat universe with a cosmological constant."""

    omega_lambda: float = 0.6911
    omega_0: float = 0.308983
    h: float = 0.6774
    a: float = 1.0

    def __post_init__(self):
        if abs(self.omega_lambda + self.omega_0 - 1.0) > 1e-2:
            raise ValueError("cosmology needs to be flat")

    def age(self, a: float) -> float:
        """Seconds since the beginning at scale factor ``a``."""
        ratio = self.omega_lambda / self.omega_0
        return 2.0 / (3.0 * math.sqrt(self.omega_lambda)) * math.asinh(math.sqrt(ratio * a**3)) / (HUBBLE * self.h)

    def time_between(self, a0: float, a1: float) -> float:
        return self.age(a1) - self.age(a0)

    def after(self, a0: float, seconds: float) -> float:
        """The scale factor that much time after ``a0``, from the closed form's inverse."""
        ratio = self.omega_lambda / self.omega_0
        x = (self.age(a0) + seconds) * HUBBLE * self.h * 1.5 * math.sqrt(self.omega_lambda)
        return (math.sinh(x) ** 2 / ratio) ** (1.0 / 3.0)

    def time_spec(self, seconds: float) -> dict:
        now = self.after(self.a, seconds)
        return {"time_elapsed": seconds, "redshift": redshift(now), "scale_factor": now}
