"""A simulation from a parameter file: parameters, particles and sources in, snapshots, time series and performance data out."""

from __future__ import annotations

import logging
import platform
from collections.abc import Sequence

import pyspark
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import physics as P
from ..functions import units as U
from ..operators import grid, spatial, voronoi
from ..operators.snapshots import OutputTimer, TimeSeries, prepare
from ..session import make_session, materialise, write_text
from ..sources import scan
from .params import Parameters, command_line, si
from .simulation import Simulation

RATE = U.NONE / U.TIME


def build_information() -> dict[str, str]:
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "system": platform.platform()}


def cells_and_faces(particles: DataFrame, low: Sequence[float], high: Sequence[float], periodic: bool, grid_spec) -> tuple[DataFrame, DataFrame]:
    """Cells (cell_id, x, y, z, volume, size and the particles' other columns) and FACES: Voronoi cells of the particles, or with
    ``{"cartesian": [nx, ny, nz]}`` a grid whose cells the particles' ids name."""
    if isinstance(grid_spec, dict):
        counts = grid_spec["cartesian"]
        side = (high[0] - low[0]) / counts[0]
        cells = grid.cartesian_cells(particles.sparkSession, counts, side)
        faces = grid.cartesian_faces(cells, counts, side, periodic)
        own = particles.withColumnRenamed("particle_id", "cell_id").drop("x", "y", "z", "volume", "size")
        return cells.drop("ix", "iy", "iz").join(own, "cell_id"), faces
    built = voronoi.periodic_cells(particles, low, high) if periodic else voronoi.voronoi_cells(particles, low, high)
    built = materialise(built, "voronoi-cells")
    own = particles.withColumnRenamed("particle_id", "cell_id").drop("x", "y", "z", "volume", "size")
    return built.drop("faces", "faces_kind", "infinite").join(own, "cell_id"), voronoi.faces_table(built)


def build(params: Parameters, particles: DataFrame, sources: DataFrame | None = None) -> Simulation:
    """The simulation that the sections sweep, postprocess, cosmology and box describe. ``particles``: particle_id, x, y, z, density,
    temperature and, unless the parameters give an initial fraction, xhii; ``sources``: source_id, x, y, z, rate, unless the
    parameters list them."""
    spark = particles.sparkSession
    own, post, told = params.section("sweep"), params.section("postprocess"), params.section("cosmology")
    box = params.section("box")
    length = lambda v: si(v, U.LENGTH, told.a, told.h)
    bounds = [[length(x) for x in v] if isinstance(v, list) else length(v) if v is not None else None for v in (box.size, box.min, box.max)]
    low, high = G.box_of(*bounds)
    if post.initial_fraction_ionized_hydrogen is not None:
        particles = particles.withColumn("xhii", F.lit(float(post.initial_fraction_ionized_hydrogen)))
    cells, faces = cells_and_faces(particles, low, high, own.periodic, post.grid)
    if isinstance(post.sources, list):
        sources = scan.explicit_sources(spark, [([length(x) for x in s["pos"]], si(s["rate"], RATE)) for s in post.sources])
    lit_cells = spatial.sum_at_nearest(sources, cells, "source_id", "cell_id").select("cell_id", (F.col("source") * float(post.escape_fraction)).alias("source"))
    cells = cells.join(lit_cells, "cell_id", "left").fillna(0.0, ["source"]).withColumn("xhii", P.clamp_fraction(F.col("xhii")))
    cosmology = U.Cosmology(**{k: v for k, v in (told.params or {}).items()}, a=told.a) if told.params else None
    return Simulation(
        cells,
        faces,
        grid.directions(spark, own.directions),
        si(own.max_timestep, U.TIME),
        own.num_timestep_levels,
        si(own.significant_rate_threshold, RATE),
        own.timestep_safety_factor,
        own.chemistry_timestep_safety_factor,
        own.prevent_cooling,
        cosmology,
        rotate=own.rotate_directions,
        check_symmetry=own.check_deadlock,
    )


def run(text: str, particles: DataFrame, sources: DataFrame | None = None, overrides: Sequence[str] = ()) -> str:
    """Run what a parameter file says and return its output folder: snapshots, ``time_series``, the parameters in use, performance
    data and build information. Sections that nothing uses raise."""
    spark, params = particles.sparkSession, Parameters(text)
    for spec in overrides:
        params.override(spec)
    sim, out = build(params, particles, sources), params.section("output")
    final = params.section("simulation").final_time
    params.check_unused()
    folder = out.output_dir.rstrip("/")
    prepare(spark, folder, out.handle_existing_output)
    write_text(spark, f"{folder}/{out.used_parameters_filename}", params.as_yaml())
    write_text(spark, f"{folder}/build.yml", yaml.safe_dump(build_information()))
    interval = si(out.time_between_snapshots, U.TIME)
    timer = OutputTimer(interval, si(out.time_first_snapshot, U.TIME) or 0.0)
    end = float("inf") if final is None else si(final, U.TIME)
    sim.run(end, timer, folder, TimeSeries(spark, f"{folder}/time_series"), fields=out.fields, files=out.num_output_files, padding=out.snapshot_padding)
    write_text(spark, f"{folder}/{out.performance_data_filename}", sim.performance.as_yaml())
    return folder


def main(argv: list[str] | None = None) -> None:
    """``raysheaf parameters.yml [section/key:value ...] [-v]``: particles are the Parquet files of input/paths."""
    told = command_line(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(told.verbose, 2)], format="%(asctime)s %(message)s")
    spark = make_session(master=told.master)
    with open(told.parameters, encoding="utf-8") as file:
        text = file.read()
    params = Parameters(text)
    for spec in told.overrides:
        params.override(spec)
    paths = [p for path in params.section("input").paths for p in scan.resolve_paths(spark, path)]
    contents = {k: v for k, v in params.contents.items() if k != "input"}
    run(yaml.safe_dump(contents), spark.read.parquet(*paths))


if __name__ == "__main__":
    main()
