"""The time loop: sweep, chemistry, levels, averages and snapshots over one cells table."""

from __future__ import annotations

import logging
import time as clock
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import physics as P
from ..functions import units as U
from ..operators import grid, levels, metrics, solver, sweep
from ..operators.snapshots import OutputTimer, Performance, TimeSeries, write_snapshot
from ..session import discard, materialise

YEAR = U.YEAR
LOG = logging.getLogger("raysheaf")
STAGES = ("start", "before_round", "after_round", "end")


def derived_outputs(a: float) -> dict[str, Callable[[], Column]]:
    """Name -> column of the optional outputs, each at a fixed step of one year where a step matters."""
    t, x, rho = F.col("temperature"), F.col("xhii"), F.col("density")
    args = (F.col("photon_rate"), rho, x, F.col("size"), F.col("volume"), F.lit(YEAR))
    return {
        "photoionization_rate": lambda: P.photoionization(*args),
        "recombination_rate": lambda: P.recombination(t) * P.electrons(rho, x) * x,
        "collisional_ionization_rate": lambda: P.collisional_ionization(t) * P.electrons(rho, x) * (1.0 - x),
        "heating_rate": lambda: P.photoheating(*args) - P.cooling(t, rho, x, a),
    }


class Hydrogen:
    """The chemistry: a cell's optical depth, and its state after a step under a photon rate. Another one has the same methods."""

    def optical_depth(self) -> Column:
        return sweep.kappa(F.col("density"), F.col("xhii"), F.col("size"))

    def evolve(self, cells: DataFrame, step: float, a: float, safety: float, prevent_cooling: bool) -> DataFrame:
        """``cells`` with new temperature and xhii, and the timescale on which they change."""
        return solver.evolve(cells, step, a, safety, prevent_cooling)


def standard_metrics(n_levels: int) -> metrics.Registry:
    """Luminosity and the number of cells of each level, beside the averages that are always written."""
    registry = metrics.Registry()
    registry.register("luminosity", lambda cells: cells.agg(F.sum("source")).first()[0])
    for level in range(n_levels):
        registry.register(f"cells_level_{level}", lambda cells, level=level: cells.where(F.col("level") == level).count())
    return registry


@dataclass
class Simulation:
    """cells: cell_id, density, volume, size, temperature, xhii, source and whatever else is carried along."""

    cells: DataFrame
    faces: DataFrame
    directions: DataFrame
    max_timestep: float
    n_levels: int = 1
    threshold: float = 0.0
    safety: float = 0.1
    chemistry_safety: float = 0.1
    prevent_cooling: bool = True
    cosmology: U.Cosmology | None = None
    outputs: tuple[str, ...] = ()
    hooks: list[Callable[[Simulation], None]] = field(default_factory=list)  # after every round
    chemistry: Hydrogen = field(default_factory=Hydrogen)
    rotate: bool = False  # turn the directions at random after every round
    seed: int = 0
    check_symmetry: bool = True
    registry: metrics.Registry | None = None

    def __post_init__(self):
        self.time, self.step, self.round = 0.0, 0, 0
        self.performance = Performance()
        start = {
            "level": F.lit(self.n_levels - 1),
            "photon_rate": F.lit(0.0),
            "previous_rate": F.lit(0.0),
            "change_timescale": F.lit(0.0),
            "ionization_time": F.lit(float("inf")),
        }
        self.cells = materialise(self.cells.withColumns({k: v for k, v in start.items() if k not in self.cells.columns}), "cells")
        self.inflow: DataFrame | None = None
        self.rates: DataFrame | None = None  # of the last sweep, per direction and cell
        self.plugins: dict[tuple[str, str], Callable[[Simulation], None]] = {}
        if self.registry is None:
            self.registry = standard_metrics(self.n_levels)
        if self.check_symmetry and not grid.asymmetric_pairs(self.faces).isEmpty():
            raise ValueError("the faces aren't symmetric")
        self.performance.record_number("cells", self.cells.count())
        self.performance.record_number("directions", self.directions.count())

    def add(self, stage: str, name: str, plugin: Callable[[Simulation], None]) -> None:
        """Call ``plugin`` with the simulation at a stage; a name may be added to a stage once."""
        if stage not in STAGES or (stage, name) in self.plugins:
            raise ValueError(f"{name} is added to {stage} already" if stage in STAGES else f"unknown stage {stage}")
        self.plugins[stage, name] = plugin

    def _at(self, stage: str) -> None:
        for (where, _), plugin in self.plugins.items():
            if where == stage:
                plugin(self)

    def turn_directions(self) -> None:
        """Directions turned at random; what cells sent and what waits at periodic faces go to the best aligned new ones."""
        new = G.rotated(self.directions, G.random_rotation(self.seed + self.round))
        new = self.directions.sparkSession.createDataFrame(new.collect(), self.directions.schema)  # the directions' bounded list
        to = F.broadcast(sweep.aligned(self.directions, new))

        def moved(rates: DataFrame, names: list[str]) -> DataFrame:
            sums = rates.join(to, "dir").groupBy(F.col("to").alias("dir"), "cell_id").agg(*(F.sum(c).alias(c) for c in names))
            every = new.select("dir").crossJoin(self.cells.select("cell_id"))
            return materialise(every.join(sums, ["dir", "cell_id"], "left").fillna(0.0, names), "turned")

        if self.rates is not None:
            self.rates, self.inflow = moved(self.rates, ["incoming", "outgoing"]), moved(self.inflow, ["inflow"])
        self.directions = new

    @property
    def a(self) -> float:
        return self.cosmology.time_spec(self.time)["scale_factor"] if self.cosmology else 1.0

    def time_spec(self) -> dict:
        return self.cosmology.time_spec(self.time) if self.cosmology else {"time_elapsed": self.time}

    def sweep_level(self, level: int) -> None:
        """One sweep and chemistry step of the cells at ``level`` and above, each over its own level's step; the others keep
        their state and go on sending the rates of their own last sweep."""
        begin = clock.perf_counter()
        state = self.cells.select("cell_id", self.chemistry.optical_depth().alias("tau"), "source")
        fixed = None
        if self.rates is not None:
            idle = self.cells.where(F.col("level") < level).select("cell_id")
            fixed = self.rates.join(idle, "cell_id", "left_semi").select("dir", "cell_id", F.col("outgoing").alias("fixed"))
        swept = materialise(sweep.sweep(state, self.faces, self.directions, self.threshold, self.inflow, fixed), "sweep")
        inflow = materialise(sweep.periodic_inflow(swept, self.faces, self.directions), "inflow")
        self.rates, self.inflow = swept, inflow
        # the sweep's incoming rates hold what periodic neighbours sent; the source comes on top
        rate = sweep.photon_rate(swept).select("cell_id", P.positive(F.col("rate")).alias("incoming_rate"))
        cells = self.cells.join(rate, "cell_id").withColumn("rate", F.col("incoming_rate") + F.col("source"))
        active = cells.where(F.col("level") >= level)
        parts = []
        for own in range(level, self.n_levels):
            dt = levels.step_of(F.lit(own), self.max_timestep)
            step = self.max_timestep * 0.5**own
            stepped = self.chemistry.evolve(active.where(F.col("level") == own), step, self.a, self.chemistry_safety, self.prevent_cooling)
            change = F.when(F.abs("rate") < abs(self.threshold), 0.0).otherwise(metrics.relative_change(F.col("rate"), F.col("previous_rate")))
            by_rate = F.coalesce(F.try_divide(dt, change), F.lit(float("inf")))
            parts.append(stepped.withColumn("change_timescale", F.least("timescale", by_rate)))
        changed = parts[0]
        for part in parts[1:]:
            changed = changed.unionByName(part)
        changed = changed.withColumns({"photon_rate": F.col("incoming_rate"), "previous_rate": F.col("rate")}).select(*self.cells.columns)
        idle = cells.where(F.col("level") < level).withColumn("photon_rate", F.col("incoming_rate")).select(*self.cells.columns)
        old, self.cells = self.cells, materialise(changed.unionByName(idle), "cells")
        discard(old)
        self.performance.record(f"level {level}", clock.perf_counter() - begin)

    def run_round(self) -> float:
        """One round of the schedule, then new levels for all cells; the time that it covers."""
        begin = clock.perf_counter()
        self._at("before_round")
        floor = levels.lowest_allowed(self.n_levels, self.round)
        counts = {r.level: r.active for r in levels.active_per_level(self.cells, self.n_levels).collect()}
        for level in levels.schedule(self.n_levels, floor):
            if counts.get(level, 0):
                self.sweep_level(level)
        elapsed = self.max_timestep * 0.5**floor
        self.time, self.step, self.round = self.time + elapsed, self.step + 1, self.round + 1
        allowed = levels.lowest_allowed(self.n_levels, self.round)
        desired = levels.level_of(F.col("change_timescale") * self.safety, self.max_timestep, self.n_levels)
        reached = (F.col("xhii") > 0.5) & (F.col("ionization_time") == float("inf"))
        relevelled = {"level": levels.floored(desired, allowed), "ionization_time": F.when(reached, self.time).otherwise(F.col("ionization_time"))}
        old, self.cells = self.cells, materialise(self.cells.withColumns(relevelled), "cells")
        discard(old)
        if self.rotate:
            self.turn_directions()
        for hook in self.hooks:
            hook(self)
        self._at("after_round")
        LOG.info("step %d: %s, %.1f s", self.step, self.time_spec(), clock.perf_counter() - begin)
        return elapsed

    def output(self) -> DataFrame:
        derived = derived_outputs(self.a)
        return self.cells.withColumns({name: derived[name]() for name in self.outputs})

    def averages(self) -> dict[str, float]:
        out = self.output().withColumn("mass", F.col("density") * F.col("volume"))
        return metrics.averages(out).first().asDict()

    def run(self, final_time: float, timer: OutputTimer | None = None, path: str | None = None, series: TimeSeries | None = None, **snapshot) -> None:
        """Until ``final_time``. Initial conditions count as an output time; the last state is written in any case."""
        self._at("start")
        begin = clock.perf_counter()
        while True:
            finished = self.time >= final_time
            if series is not None:
                series.append(self.step, self.time_spec(), self.averages() | self.registry.values(self.cells))
            if timer is not None and path is not None and timer.due(self.time, finished):
                write_snapshot(self.output(), path, timer.fired(), self.time_spec() | {"time": self.time}, key="cell_id", **snapshot)
            if finished:
                self._at("end")
                LOG.info("%d steps in %.1f s", self.step, clock.perf_counter() - begin)
                return
            self.run_round()
