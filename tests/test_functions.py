import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raysheaf.functions import geometry as G
from raysheaf.functions import keys as K
from raysheaf.functions import physics as P
from raysheaf.functions import units as U
from raysheaf.operators import levels, solver


def test_quantities():
    assert U.parse_quantity("2 kpc").value == pytest.approx(2e3 * U.PARSEC)
    q = U.parse_quantity("4000 kpc h^-1 a^1")
    assert (q.dimension.h, q.dimension.a) == (-1, 1)
    assert q.physical(a=0.5, h=0.7).value == pytest.approx(4e6 * U.PARSEC * 0.5 / 0.7)
    assert U.parse_quantity("1e-3 g / cm^3").value == pytest.approx(1.0)
    assert str(U.parse_quantity("3 m s^-1")) == "3.0 m s^-1"
    for bad in ("kpc", "3 parsnip", ""):
        with pytest.raises(ValueError):
            U.parse_quantity(bad)
    with pytest.raises(ValueError):
        U.parse_quantity("3 m", U.TIME)


def test_unit_readers():
    own = {"scale_factor_si": 5.0, **{f"scaling_{n}": 0 for n in ("length", "time", "temperature", "h", "a")}, "scaling_mass": 1}
    assert U.own_factor(own) == (5.0, U.MASS)
    other = {"to_cgs": 3.0857e21, "length_scaling": 1, "velocity_scaling": 0, "mass_scaling": 0, "a_scaling": 1, "h_scaling": -1}
    factor, dimension = U.external_factor(other, 0.5, 0.7)
    assert factor == pytest.approx(3.0857e19 * 0.5 / 0.7) and dimension == U.LENGTH
    none = dict.fromkeys(other, 0)
    assert U.external_factor(none, 0.5, 0.7) == (1.0, U.NONE)


def test_cosmology():
    c = U.Cosmology(0.6911, 0.308983, 0.6774)
    assert c.time_between(0.99, 1.0) / (1e9 * U.YEAR) == pytest.approx(0.14473176, abs=1e-5)
    assert c.time_between(0.3, 0.3) == 0
    for a0 in (0.01, 0.1, 0.2, 0.5, 0.9):
        for a1 in (0.01, 0.1, 0.2, 0.5, 0.9):
            assert abs(c.after(a0, c.time_between(a0, a1)) - a1) < 1e-5
    assert U.redshift(U.scale_factor(3.0)) == pytest.approx(3.0)
    with pytest.raises(ValueError):
        U.Cosmology(0.5, 0.1)


@pytest.mark.parametrize("name", ["collision_fit", "recombination", "recombination_cooling", "collisional_ionization", "collisional_ionization_cooling", "collisional_excitation_cooling", "bremsstrahlung_cooling"])
def test_derivatives(name):
    f, df = getattr(P, name), getattr(P, name + "_dt")
    for t in 10.0 ** np.arange(2, 8):
        h = t * 1e-5
        assert df(t) == pytest.approx((f(t + h) - f(t - h)) / (2 * h), rel=1e-4, abs=1e-300)


def test_compton_derivative():
    assert P.compton_cooling_dt(1e4, 0.5) == pytest.approx(P.compton_cooling(1e4 + 1, 0.5) - P.compton_cooling(1e4, 0.5), rel=1e-6)


def test_temperature_round_trip():
    assert P.temperature_of(P.internal_energy_of(1234.0, 0.3), 0.3) == pytest.approx(1234.0)


def reference_step(state, dt, safety, prevent, depth=0):
    """The same integration by plain recursion, for one cell."""
    floor_t, floor_x = state["floor"] if prevent else (0.0, U.FRACTION_EPSILON)

    def clamp():
        state["x"] = min(max(state["x"], floor_x), 1 - U.FRACTION_EPSILON)
        state["t"] = max(state["t"], floor_t)

    clamp()
    if depth > 100:
        raise RecursionError
    before = state["t"], state["x"]
    rho, rate, size, volume = state["rho"], state["rate"], state["size"], state["volume"]
    advice, ok = [], True
    for key, change in (("t", lambda: P.temperature_change(state["t"], state["x"], rho, rate, size, volume, 1.0, dt)), ("x", lambda: P.fraction_change(state["t"], state["x"], rho, rate, size, volume, dt))):
        d = float(change())
        relative = min(abs(d / state[key]), 1 / np.finfo(float).eps)
        if relative > safety:
            ok = False
            break
        state[key] += d
        advice.append(dt * safety / relative if relative else math.inf)
    if ok:
        clamp()
        return min(advice)
    state["t"], state["x"] = before
    reference_step(state, dt / 2, safety, prevent, depth + 1)
    return reference_step(state, dt / 2, safety, prevent, depth + 1)


@pytest.mark.parametrize("prevent", [True, False])
def test_solver_equals_recursion(prevent):
    rng = np.random.default_rng(0)
    n = 25
    t, x = 10 ** rng.uniform(2, 5, n), rng.uniform(1e-3, 0.999, n)
    rho, rate = 10 ** rng.uniform(-24, -21, n), 10 ** rng.uniform(40, 46, n)
    size, volume, dt = np.full(n, 1e18), np.full(n, 1e54), np.full(n, 1e11)
    got = solver.integrate(t, x, rho, rate, size, volume, 1.0, dt, 0.1, prevent)
    for i in range(n):
        state = {"t": t[i], "x": x[i], "floor": (t[i], x[i]), "rho": rho[i], "rate": rate[i], "size": size[i], "volume": volume[i]}
        advice = reference_step(state, dt[i], 0.1, prevent)
        assert got[0][i] == pytest.approx(state["t"], rel=1e-9)
        assert got[1][i] == pytest.approx(state["x"], rel=1e-9)
        assert got[2][i] == pytest.approx(advice, rel=1e-6)


@pytest.mark.parametrize("x", [0.0, 1.0])
def test_solver_extremes(x):
    t, f, advice, _ = solver.integrate([1.79e6], [x], [1e-24], [1e30], [1e18], [1e54], 1.0, [1e6 * U.YEAR], 0.1, False)
    assert np.isfinite(t).all() and 0 < f[0] < 1 and advice[0] > 0


def test_levels():
    cases = {(1, 1.0): 0, (2, 1.0): 0, (1, 0.001): 0, (2, 0.001): 1, (3, 0.001): 2, (2, 0.500001): 1, (2, 0.499999): 1, (3, 0.499999): 2, (5, 100.0): 0, (5, 0.0): 4}
    from raysheaf.session import make_session

    spark = make_session()
    for (n, desired), level in cases.items():
        assert spark.range(1).select(levels.level_of(F.lit(desired), 1.0, n)).first()[0] == level, (n, desired)
    rounds = [[4], [4], [3, 4], [2, 4, 3, 4], [1, 4, 3, 4, 2, 4, 3, 4], [0, 4, 3, 4, 2, 4, 3, 4, 1, 4, 3, 4, 2, 4, 3, 4]]
    for i, want in enumerate(rounds):
        floor = levels.lowest_allowed(5, i)
        assert levels.schedule(5, floor) == want
        assert [r.level for r in levels.schedule_frame(spark, 5, floor).orderBy("i").collect()] == want


def test_geometry(spark):
    lits = lambda *v: [F.lit(float(x)) for x in v]
    one = lambda c: spark.range(1).select(c).first()[0]
    sides = (2.0, 4.0, 6.0)
    assert one(G.periodic_distance(lits(-0.1, 0, 0), lits(0.1, 0, 0), sides)) == pytest.approx(0.2)
    assert one(G.periodic_distance(lits(0, 3.9, 0), lits(0, 0.1, 0), sides)) == pytest.approx(0.2)
    low, high = (-1.0, -2.0, -3.0), (1.0, 2.0, 3.0)
    for point, want in (((2, 0, 0), 1.0), ((-2, -3, 0), 2.0), ((-2, -4, 0), 5.0), ((0.5, 1, 2), 0.0)):
        assert one(G.distance_to_box_squared(lits(*point), low, high)) == pytest.approx(want)
    assert one(G.wrap(F.lit(-0.25), 0.0, 1.0)) == pytest.approx(0.75)
    assert one(G.octant(lits(0, -1, 1), (0, 0, 0))) == 0b101
    assert one(G.length(G.normalised(lits(3, 4, 12)))) == pytest.approx(1.0)
    a, b = lits(1, 2, 3), lits(-2, 0.5, 4)
    assert one(G.dot(a, G.cross(a, b))) == pytest.approx(0.0)
    assert G.images(spark.createDataFrame([(0.1, 0.2, 0.3)], "x double, y double, z double"), sides).count() == 27
    assert G.box_of(3) == ([0.0] * 3, [3.0] * 3) and G.box_of(low=[1, 2], high=[3, 4]) == ([1.0, 2.0], [3.0, 4.0])


def test_keys():
    ix, iy = (a.ravel().astype(np.uint64) for a in np.meshgrid(np.arange(30), np.arange(30)))
    x, y = K.hilbert2_inverse(K.hilbert2(ix, iy))
    assert (x == ix).all() and (y == iy).all()
    n = 8
    grid = np.stack(np.meshgrid(*[(np.arange(n) + 0.5) / n] * 3, indexing="ij"), -1).reshape(-1, 3)
    hi, lo = K.hilbert3(*grid.T)
    path = grid[np.lexsort((lo, hi))] * n
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()  # the curve goes from cell to neighbouring cell
    assert K.key_midpoint(3, 8) == 5 and K.key_successor((1 << 126) - 1) == (1 << 126) - 1


def test_predicates():
    from raysheaf.functions import predicates as Q

    rng = np.random.default_rng(6)
    for d in (2, 3):
        for _ in range(60):
            s, q = rng.random((d + 1, d)), rng.random(d)
            centre = Q.circumcentre(s)
            radius = np.linalg.norm(s - centre, axis=1)
            assert np.allclose(radius, radius[0])
            assert Q.in_sphere(s, q) == (1 if np.linalg.norm(q - centre) < radius[0] else -1)
            weights = np.linalg.solve(np.vstack([s.T, np.ones(d + 1)]), [*q, 1.0])
            assert Q.contains(s, q) == (weights.min() >= 0)
    square = [(0, 0), (1, 0), (1, 1)]
    assert Q.in_sphere(square, (0, 1)) == 0 and Q.in_sphere(square, (0, 1 - 1e-16)) == 1 and Q.in_sphere(square, (0, 1 + 1e-15)) == -1
    assert Q.orientation([(0, 0), (1e-200, 1e-200), (2e-200, 2e-200)]) == 0 and Q.orientation([(0.1, 0.3), (0.2, 0.6), (0.3, 0.9)]) != 0  # in floats 0.3 isn't 3 x 0.1
    assert Q.contains(square, (1, 0.5)) and not Q.contains([(0, 0), (1, 1), (2, 2)], (1, 1))
    assert Q.exact_determinant([[2, 1], [1, 3]]) == 5 and Q.exact_determinant([[0, 1], [1, 0]]) == -1
    with pytest.raises(ValueError):
        Q.solve([[1, 2], [2, 4]], [1, 2])
    tetra = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    assert Q.distance_to_tetrahedron(tetra, np.array([0.1, 0.1, 0.1])) == 0 and Q.distance_to_tetrahedron(tetra, np.array([0.2, 0.2, -2.0])) == pytest.approx(2.0)
    assert Q.distance_to_tetrahedron(tetra, np.array([1.0, 1.0, 1.0])) == pytest.approx(2 / math.sqrt(3))
    assert Q.segment_meets_triangle((0.2, 0.2, -1), (0.2, 0.2, 1), tetra[:3]) == pytest.approx([0.2, 0.2, 0.0])
    assert Q.segment_meets_triangle((2, 2, -1), (2, 2, 1), tetra[:3]) is None and Q.segment_meets_triangle((0, 0, 1), (1, 0, 1), tetra[:3]) is None
