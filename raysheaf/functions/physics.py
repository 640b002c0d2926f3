"""Hydrogen chemistry and attenuation. Every function takes Columns, numpy arrays or floats alike.

Temperatures are in kelvin, densities in kg/m^3, everything else in SI; the fits' coefficients are in cgs as published.
Derivatives with respect to temperature are written as the value times its logarithmic derivative.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import units as U

CM3, ERG_CM3 = 1e-6, 1e-13  # cm^3/s and erg cm^3/s in SI
RECOMBINATION_LAMBDA = 315614.0  # K
CMB = 2.727  # K


def _is_column(*xs) -> bool:
    return any(isinstance(x, Column) for x in xs)


def sqrt(x):
    return F.sqrt(x) if _is_column(x) else np.sqrt(x)


def exp(x):
    return F.exp(x) if _is_column(x) else np.exp(x)


def power(x, y):
    return F.pow(x, F.lit(y)) if _is_column(x) else np.power(x, y)


def least(x, y):
    return F.least(*(v if isinstance(v, Column) else F.lit(v) for v in (x, y))) if _is_column(x, y) else np.minimum(x, y)


def greatest(x, y):
    return F.greatest(*(v if isinstance(v, Column) else F.lit(v) for v in (x, y))) if _is_column(x, y) else np.maximum(x, y)


# ---- densities


def hydrogen(density):
    return density / U.PROTON_MASS


def ionized(density, x):
    return hydrogen(density) * x


def neutral(density, x):
    return hydrogen(density) * (1.0 - x)


electrons = ionized


def molecular_weight(x):
    return 1.0 / (1.0 + x)


def temperature_of(internal_energy, x):
    return internal_energy * molecular_weight(x) * ((U.GAMMA - 1.0) * U.PROTON_MASS / U.BOLTZMANN)


def internal_energy_of(temperature, x):
    return temperature / (molecular_weight(x) * ((U.GAMMA - 1.0) * U.PROTON_MASS / U.BOLTZMANN))


def clamp_fraction(x, floor=U.FRACTION_EPSILON):
    return greatest(least(x, 1.0 - U.FRACTION_EPSILON), floor)


def fraction_of_electrons(abundance):
    return clamp_fraction(abundance * U.HYDROGEN_MASS_FRACTION)


# ---- rates and their temperature derivatives


def _bend(t):
    return sqrt(t / 1e5)


def collision_fit(t):
    return sqrt(t) / (1.0 + _bend(t)) * exp(-157809.1 / t)


def collision_fit_dt(t):
    s = _bend(t)
    return collision_fit(t) * (0.5 / t - 0.5 * s / (t * (1.0 + s)) + 157809.1 / (t * t))


def recombination(t):
    lam = RECOMBINATION_LAMBDA / t
    return CM3 * 2.753e-14 * power(lam, 1.5) / power(1.0 + power(lam / 2.74, 0.407), 2.242)


def recombination_dt(t):
    y = power(RECOMBINATION_LAMBDA / t / 2.74, 0.407)
    return recombination(t) / t * (2.242 * 0.407 * y / (1.0 + y) - 1.5)


def recombination_cooling(t):
    lam = RECOMBINATION_LAMBDA / t
    return ERG_CM3 * 3.435e-30 * t * power(lam, 1.97) / power(1.0 + power(lam / 2.25, 0.376), 3.72)


def recombination_cooling_dt(t):
    y = power(RECOMBINATION_LAMBDA / t / 2.25, 0.376)
    return recombination_cooling(t) / t * (1.0 - 1.97 + 3.72 * 0.376 * y / (1.0 + y))


def collisional_ionization(t):
    return CM3 * 5.85e-11 * collision_fit(t)


def collisional_ionization_dt(t):
    return CM3 * 5.85e-11 * collision_fit_dt(t)


def collisional_ionization_cooling(t):
    return ERG_CM3 * 1.27e-21 * collision_fit(t)


def collisional_ionization_cooling_dt(t):
    return ERG_CM3 * 1.27e-21 * collision_fit_dt(t)


def collisional_excitation_cooling(t):
    return ERG_CM3 * 7.5e-19 / (1.0 + _bend(t)) * exp(-118348.0 / t)


def collisional_excitation_cooling_dt(t):
    s = _bend(t)
    return collisional_excitation_cooling(t) * (118348.0 / (t * t) - 0.5 * s / (t * (1.0 + s)))


def bremsstrahlung_cooling(t):
    return ERG_CM3 * 1.42e-27 * sqrt(t)


def bremsstrahlung_cooling_dt(t):
    return bremsstrahlung_cooling(t) / (2.0 * t)


def compton_cooling(t, a):
    x = CMB / a
    return U.ERG * 1.017e-37 * x * x * x * x * (t - x)


def compton_cooling_dt(t, a):
    x = CMB / a
    return U.ERG * 1.017e-37 * x * x * x * x


def cooling(t, density, x, a):
    """Energy lost per time and volume."""
    ne = electrons(density, x)
    collisions = (collisional_excitation_cooling(t) + collisional_ionization_cooling(t)) * ne * neutral(density, x)
    return collisions + (recombination_cooling(t) + bremsstrahlung_cooling(t)) * ne * ionized(density, x) + compton_cooling(t, a) * ne


def cooling_dt(t, density, x, a):
    ne = electrons(density, x)
    collisions = (collisional_excitation_cooling_dt(t) + collisional_ionization_cooling_dt(t)) * ne * neutral(density, x)
    return collisions + (recombination_cooling_dt(t) + bremsstrahlung_cooling_dt(t)) * ne * ionized(density, x) + compton_cooling_dt(t, a) * ne


# ---- photons


def transmitted(density, x, size):
    """Share of photons that pass a cell of that size."""
    return exp(-neutral(density, x) * U.SIGMA_NUMBER * size)


def outgoing(rate, density, x, size, threshold=0.0):
    passed = rate * transmitted(density, x, size)
    if _is_column(passed):
        return F.when(F.lit(rate) < threshold if not isinstance(rate, Column) else rate < threshold, 0.0).otherwise(passed)
    return np.where(rate < threshold, 0.0, passed)


def absorbed(rate, density, x, length, dt):
    return dt * rate * (1.0 - transmitted(density, x, length))


def photoheating(rate, density, x, length, volume, dt):
    return absorbed(rate, density, x, length, dt) / volume * (U.PHOTON_ENERGY - U.RYDBERG) / dt


def photoionization(rate, density, x, length, volume, dt):
    return absorbed(rate, density, x, length, dt) / (neutral(density, x) * volume) / dt


# ---- one semi-implicit step


def temperature_change(t, x, density, rate, length, volume, a, dt):
    k = (U.GAMMA - 1.0) * U.PROTON_MASS / (density * U.BOLTZMANN) * molecular_weight(x)
    heating = photoheating(rate, density, x, length, volume, dt) - cooling(t, density, x, a)
    return k * heating * dt / (1.0 + k * cooling_dt(t, density, x, a) * dt)


def fraction_change(t, x, density, rate, length, volume, dt):
    nh, ne = hydrogen(density), electrons(density, x)
    create = collisional_ionization(t) * ne + photoionization(rate, density, x, length, volume, dt)
    destroy = recombination(t) * ne
    heat = ne * t * molecular_weight(x) * U.HYDROGEN_MASS_FRACTION
    create_dx = nh * collisional_ionization(t) - heat * collisional_ionization_dt(t)
    destroy_dx = nh * recombination(t) - heat * recombination_dt(t)
    jacobian = create_dx - (create + destroy) - x * (create_dx + destroy_dx)
    return dt * (create - x * (create + destroy)) / (1.0 - jacobian * dt)


def positive(rate: Column) -> Column:
    """A photon rate, with rounding below zero taken off."""
    return F.greatest(rate, F.lit(0.0))
