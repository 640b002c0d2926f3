import pytest
from pyspark.sql import functions as F

from raysheaf.functions import units as U
from raysheaf.operators import grid
from raysheaf.operators import snapshots as S
from raysheaf.plans.params import Parameters, command_line, si
from raysheaf.plans.simulation import Simulation
from raysheaf.streaming import metrics as stream


def test_parameters():
    p = Parameters("sweep: {directions: 16, max_timestep: 1 Myr}\noutput: {time_between_snapshots: 2 Myr}\nvisualization: {a: 1}\n")
    p.override("sweep/num_timestep_levels:3")
    sweep = p.section("sweep")
    assert sweep.num_timestep_levels == 3 and sweep.prevent_cooling and p.section("sweep") is sweep
    assert si(sweep.max_timestep, U.TIME) == pytest.approx(1e6 * U.YEAR)
    assert p.unused() == ["output"]
    with pytest.raises(ValueError, match="nothing uses"):
        p.check_unused()
    p.section("output")
    p.check_unused()
    assert "num_timestep_levels: 3" in p.as_yaml()
    for bad in ("sweep/a", "a:b:c"):
        with pytest.raises(ValueError):
            p.override(bad)
    with pytest.raises(ValueError, match="unknown"):
        Parameters("simulation: {finaltime: 3}").section("simulation")
    with pytest.raises(ValueError, match="missing"):
        Parameters("{}").section("sweep")
    with pytest.raises(ValueError, match="already"):
        p.set("sweep", sweep)
    assert command_line(["p.yml", "a/b:1", "-vv"]).verbose == 2


def test_timer():
    timer, fired = S.OutputTimer(2.0, first=1.0), []
    for t in range(7):
        if timer.due(float(t), finished=t == 6):
            fired.append((t, timer.fired()))
    assert fired == [(1, 0), (3, 1), (5, 2), (6, 3)]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "out")
    S.prepare(spark, path)
    df = spark.createDataFrame([(i, i * 0.1, 1.0, 10.0 * i) for i in range(20)], "particle_id long, x double, density double, temperature double")
    for number in (0, 1):
        S.write_snapshot(df.withColumn("temperature", F.col("temperature") + number), path, number, {"time": number * 2.0}, files=2)
    back = S.read_snapshot(spark, path)
    assert back.count() == 20 and back.where("particle_id = 3").first().asDict() == {"particle_id": 3, "temperature": 31.0, "x": pytest.approx(0.3), "density": 1.0}
    assert S.read_attributes(spark, path, 1)["time"] == 2.0
    with pytest.raises(FileExistsError):
        S.prepare(spark, path, "panic")
    with pytest.raises(ValueError):
        S.write_snapshot(df, path, 2, {}, fields=["nope"])
    S.prepare(spark, path, "delete")
    S.prepare(spark, path, "panic")


def test_series_and_performance(spark, tmp_path):
    series = S.TimeSeries(spark, str(tmp_path / "series"))
    for step in range(3):
        series.append(step, {"time_elapsed": step * 1.0}, {"a": step * 2.0, "b": 1.0, "c": None})
    assert series.read().count() == 6 and "val: 4.0" in series.as_yaml("a")
    p = S.Performance()
    p.record("sweep", 1.0)
    p.record("sweep", 3.0)
    p.record_number("cells", 7)
    assert p.summary() == {"sweep": {"average": 2.0, "total": 4.0, "num_calls": 2}, "cells": 7} and "total: 4.0" in p.as_yaml()


@pytest.mark.parametrize("n_levels", [1, 3])
def test_simulation(spark, tmp_path, n_levels):
    side = 3e19
    cells = grid.cartesian_cells(spark, (3, 3), side)
    state = cells.withColumns({"volume": F.lit(side**3), "density": F.lit(2e-25), "temperature": F.lit(1000.0), "xhii": F.lit(1e-6), "source": F.when(F.col("cell_id") == 4, 1e49).otherwise(0.0)})
    faces = grid.cartesian_faces(cells, (3, 3), side)
    seen = []
    sim = Simulation(
        state.select("cell_id", "density", "volume", "size", "temperature", "xhii", "source"), faces, grid.directions(spark, 4, 2), 1e11, n_levels=n_levels, outputs=("photoionization_rate", "heating_rate"), hooks=[lambda s: seen.append(s.step)]
    )
    series = S.TimeSeries(spark, str(tmp_path / "series"))
    sim.run(2.5e11, S.OutputTimer(2e11), str(tmp_path / "snap"), series)
    out = {r.cell_id: r for r in sim.output().collect()}
    assert out[4].xhii == max(r.xhii for r in out.values()) > 1e-6 and out[4].photon_rate == 0.0
    out.pop(4)
    assert all(r.temperature >= 1000.0 and r.xhii >= 1e-6 and r.photon_rate > 0 and r.photoionization_rate > 0 for r in out.values())
    assert seen == list(range(1, sim.step + 1)) and sim.time >= 2.5e11
    assert S.read_snapshot(spark, str(tmp_path / "snap"), key="cell_id").count() == 9
    assert series.read().select("metric").distinct().count() >= 6


def test_simulation_rejects_asymmetric_faces(spark):
    cells = grid.cartesian_cells(spark, (2, 2))
    faces = grid.cartesian_faces(cells, (2, 2)).where("not (cell_id = 0 and neighbour_id = 1)")
    state = cells.withColumns({"density": F.lit(1e-22), "temperature": F.lit(1.0), "xhii": F.lit(0.1), "source": F.lit(0.0)})
    with pytest.raises(ValueError, match="symmetric"):
        Simulation(state, faces, grid.directions(spark, 1), 1.0)


def history(spark, path):
    rows = [(i % 5, t, (t * (i % 5 + 1)) / 40.0, 1.0 + i % 3) for t in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, "cell_id long, t long, xhii double, volume double").withColumn("ts", F.timestamp_seconds("t"))
    for part in range(4):
        df.where((F.col("t") >= part * 5) & (F.col("t") < part * 5 + 5)).coalesce(1).write.mode("append").parquet(path)
    return df


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    df = history(spark, path)
    got = {}

    def keep(name):
        return lambda batch, _: got.setdefault(name, []).extend(tuple(r) for r in batch.collect())

    states = stream.stream_of(spark, path, spark.read.parquet(path).schema)
    stream.run_available(stream.windowed_averages(states, "ts", "5 seconds", "xhii", "volume"), keep("mean"), str(tmp_path / "c1"))
    batch = {tuple(r) for r in stream.windowed_averages(df, "ts", "5 seconds", "xhii", "volume").collect()}
    assert set(got["mean"]) <= batch and len(got["mean"]) >= 3  # the last window is final once later rows come
    stream.run_available(stream.first_crossings(states, "cell_id", "t", "xhii"), keep("first"), str(tmp_path / "c2"))
    want = {r.cell_id: r.t for r in df.where("xhii > 0.5").groupBy("cell_id").agg(F.min("t").alias("t")).collect()}
    assert {k: int(t) for k, t, _ in got["first"]} == want


RUN = """
sweep: {directions: 6, max_timestep: 1 kyr, num_timestep_levels: 2, periodic: true, rotate_directions: true}
output: {time_between_snapshots: 1 kyr, output_dir: %s, fields: [temperature, xhii]}
simulation: {final_time: 2 kyr}
postprocess: {sources: [{pos: [0.5 kpc, 0.5 kpc, 0.5 kpc], rate: 1e49 s^-1}], grid: %s, initial_fraction_ionized_hydrogen: 1e-5}
box: {size: 1 kpc}
visualization: {}
"""


@pytest.mark.parametrize("spec", ["{cartesian: [3, 3, 3]}", "construct"])
def test_run_from_parameters(spark, tmp_path, spec):
    import numpy as np
    import yaml

    from raysheaf.functions import units as U
    from raysheaf.operators.snapshots import read_snapshot
    from raysheaf.plans import run

    kpc = 1e3 * U.PARSEC
    jitter = np.random.default_rng(4).uniform(-0.05, 0.05, (27, 3)) * kpc
    rows = [(i, *(float(((i // 3**a) % 3 + 0.5) / 3 * kpc + jitter[i][a]) for a in range(3)), 1.7e-24, 1e4) for i in range(27)]
    particles = spark.createDataFrame(rows, "particle_id long, x double, y double, z double, density double, temperature double")
    out = run.run(RUN % (tmp_path / "out", spec), particles, overrides=["sweep/num_timestep_levels:1"])
    assert yaml.safe_load((tmp_path / "out" / "parameters.yml").read_text())["sweep"]["num_timestep_levels"] == 1
    assert yaml.safe_load((tmp_path / "out" / "performance.yml").read_text())["cells"] == 27
    last = read_snapshot(spark, out, key="cell_id").collect()
    assert len(last) == 27 and max(r.xhii for r in last) > 1e-4  # the source ionizes
    series = spark.read.parquet(f"{out}/time_series")
    values = {(r.metric, r.step): r.val for r in series.collect()}
    assert values["luminosity", 0] == pytest.approx(1e49) and values["cells_level_0", 2] == 27
    assert values["xhii_mass_average", 2] > values["xhii_mass_average", 0]
    with pytest.raises(ValueError, match="nothing uses"):
        run.run((RUN % (tmp_path / "other", spec)) + "more: {}", particles)


def test_turned_directions_keep_rates(spark):
    from raysheaf.operators import grid
    from raysheaf.plans.simulation import Simulation

    cells = grid.cartesian_cells(spark, (3, 3, 3), 1e18).selectExpr("cell_id", "1e-22D density", "volume", "size", "1e4D temperature", "1e-3D xhii", "if(cell_id = 13, 1e48D, 0D) source")
    faces = grid.cartesian_faces(grid.cartesian_cells(spark, (3, 3, 3), 1e18), (3, 3, 3), 1e18, True)
    sim = Simulation(cells, faces, grid.directions(spark, 7), 1e9)
    sim.run_round()
    sums = lambda: sim.rates.selectExpr("sum(incoming) a", "sum(outgoing) b").first()
    before, old = sums(), sim.directions.collect()
    sim.turn_directions()
    after = sums()
    assert after.a == pytest.approx(before.a) and after.b == pytest.approx(before.b) and sim.rates.count() == 7 * 27 and sim.directions.collect() != old
    calls = []
    sim.add("after_round", "note", lambda s: calls.append(s.step))
    sim.run_round()
    assert calls == [2]
    with pytest.raises(ValueError):
        sim.add("after_round", "note", print)
