"""Photon propagation through the cell graph, one direction at a time.

A cell's outgoing rate is its incoming rate, a share of its source and what periodic neighbours left, attenuated; it goes to the
downwind faces by effective area. Directions don't interact within a sweep. Three strategies give the same rates:

* ``grouped``: a direction's faces in one task, ordered in waves and swept with numpy. For grids that a worker holds.
* ``blocks``: blocks of cells in a task each, rates across their boundaries exchanged in rounds. For grids of any size; rounds are as many
  as blocks in a row, not as cells.
* ``waves``: the same where no blocks are given: they are ranges of cell ids, and waves run on inside of a range. For grids of any size;
  ids that follow the grid (as those of a Cartesian one or along a curve) make few rounds, any others as many as waves at most.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import units as U
from ..session import discard, materialise, scratch_path
from .decomposition import decomposed
from .grid import downwind
from .metrics import exclusive_prefix

GROUPED_FACES = 4_000_000  # faces of a grid that one task holds: about 0.5 GB
BLOCK_CELLS = 100_000  # cells of a block that one task sweeps
MAX_BLOCKS = 64  # blocks that are swept one by one; more are put together in runs as far as they fit into a task
STATE = "dir int, cell_id long, incoming double, outgoing double"


def kappa(density, xhii, size):
    """Optical depth of a cell."""
    return density / U.PROTON_MASS * (1.0 - xhii) * U.SIGMA_NUMBER * size


def _sweep_direction(faces: pd.DataFrame, cells: pd.DataFrame, threshold: float) -> pd.DataFrame:
    ids = np.sort(cells["cell_id"].to_numpy())
    cells = cells.set_index("cell_id").loc[ids]
    n = len(ids)
    inner = faces["kind"].to_numpy() == "interior"
    src = np.searchsorted(ids, faces["cell_id"].to_numpy()[inner])
    dst = np.searchsorted(ids, faces["neighbour_id"].to_numpy()[inner].astype(np.int64))
    share = faces["share"].to_numpy()[inner]
    order = np.argsort(src, kind="stable")
    src, dst, share = src[order], dst[order], share[order]
    begin = np.searchsorted(src, np.arange(n + 1))
    incoming, outgoing = cells["inflow"].to_numpy(dtype=float).copy(), np.zeros(n)
    fixed = cells["fixed"].to_numpy(dtype=float)
    idle = ~np.isnan(fixed)
    outgoing[idle] = fixed[idle]
    from_idle = idle[src]
    np.add.at(incoming, dst[from_idle], outgoing[src[from_idle]] * share[from_idle])
    waiting = np.bincount(dst[~from_idle], minlength=n)
    waiting[idle] = -1  # never swept: theirs is the rate of their own last sweep
    own, passed = cells["own"].to_numpy(dtype=float), np.exp(-cells["tau"].to_numpy(dtype=float))
    ready, swept = np.flatnonzero(waiting == 0), int(idle.sum())
    while len(ready):
        total = incoming[ready] + own[ready]
        outgoing[ready] = np.where(total < threshold, 0.0, total * passed[ready])
        swept += len(ready)
        edges = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in ready]) if len(ready) else np.zeros(0, int)
        np.add.at(incoming, dst[edges], outgoing[src[edges]] * share[edges])
        active = dst[edges][~idle[dst[edges]]]
        np.subtract.at(waiting, active, 1)
        touched = np.unique(active)
        ready = touched[waiting[touched] == 0]
    if swept < n:
        raise ValueError(f"{n - swept} cells wait for each other: the grid has a cycle")
    return pd.DataFrame({"cell_id": ids, "incoming": incoming, "outgoing": outgoing})


def sweep_grouped(cells: DataFrame, wind: DataFrame, dirs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``cells``: cell_id, tau, own (source per direction) and, per direction, dir, inflow and fixed (outgoing rate of a cell that
    isn't swept, null for others); ``wind``: rows of ``downwind``."""

    def run(key, faces, state):
        out = _sweep_direction(faces, state, threshold)
        return out.assign(dir=np.int32(key[0]))[["dir", "cell_id", "incoming", "outgoing"]]

    fresh = lambda df, names: df.select(*(F.col(c).alias(c) for c in names)).groupBy("dir")  # noqa: E731  both may come from one table
    left = fresh(wind, ("dir", "cell_id", "neighbour_id", "kind", "share"))
    return left.cogroup(fresh(cells, ("dir", "cell_id", "tau", "own", "inflow", "fixed"))).applyInPandas(run, STATE)


def _started(cells: DataFrame, wind: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written edges and cells, the cells that aren't swept with their rates, and the others with incoming (what is known at the
    beginning) and waiting (upwind neighbours that are swept). All of these grow with cells and directions, and files of them are much
    smaller than their rows, so their joins merge at every size: Spark would send files of under 10 MB through the driver to all tasks."""
    edges = materialise(wind.where("kind = 'interior'").select("dir", "cell_id", "neighbour_id", "share"), "edges")
    cells = materialise(cells.select("dir", "cell_id", "tau", "own", "inflow", "fixed"), "state")
    idle = cells.where("fixed is not null").select("dir", "cell_id", F.col("fixed").alias("outgoing"))
    to = F.col("neighbour_id").alias("cell_id")
    given = idle.hint("merge").join(edges, ["dir", "cell_id"]).groupBy("dir", to).agg(F.sum(F.col("outgoing") * F.col("share")).alias("given"))
    active = cells.where("fixed is null")
    waiting = edges.join(active.select("dir", "cell_id").hint("merge"), ["dir", "cell_id"], "left_semi").groupBy("dir", to).agg(F.count("*").alias("waiting"))
    state = active.join(waiting.hint("merge"), ["dir", "cell_id"], "left").join(given.hint("merge"), ["dir", "cell_id"], "left").select(
        "dir", "cell_id", "tau", "own", (F.col("inflow") + F.coalesce("given", F.lit(0.0))).alias("incoming"), F.coalesce("waiting", F.lit(0)).alias("waiting")
    )
    return edges, cells, idle, state


def _with_idle(result: DataFrame, edges: DataFrame, cells: DataFrame, idle: DataFrame) -> DataFrame:
    """Swept rates, and those of the cells that weren't swept with what they received."""
    if idle.isEmpty():
        return result
    rates = result.select("dir", "cell_id", "outgoing").unionByName(idle)
    got = rates.hint("merge").join(edges, ["dir", "cell_id"]).groupBy("dir", F.col("neighbour_id").alias("cell_id")).agg(F.sum(F.col("outgoing") * F.col("share")).alias("got"))
    still = cells.where("fixed is not null").join(got.hint("merge"), ["dir", "cell_id"], "left")
    return result.unionByName(still.select("dir", "cell_id", (F.col("inflow") + F.coalesce("got", F.lit(0.0))).alias("incoming"), F.col("fixed").alias("outgoing")))


def blocks_of(points: DataFrame, low, high, capacity: int = BLOCK_CELLS, id_col: str = "cell_id") -> DataFrame:
    """(cell_id, block): cells (with x, y, z) in runs of about ``capacity`` along the space-filling curve."""
    keyed = materialise(K.with_curve_key(points.select(id_col, "x", "y", "z"), low, high).select(id_col, "hi", "lo"), "keys")
    parts = max(1, -(-points.count() // capacity))
    return decomposed(keyed, F.col("hi"), F.col("lo"), F.lit(1), parts, "block").select(id_col, F.col("block").cast("int").alias("block"))


def ranges_of(cells: DataFrame, capacity: int = BLOCK_CELLS) -> DataFrame:
    """(cell_id, block): cells in ranges of ids of about ``capacity``."""
    ids = materialise(cells.select("cell_id"), "keys")
    parts = max(1, -(-ids.count() // capacity))
    return decomposed(ids, F.col("cell_id"), F.lit(0), F.lit(1), parts, "block").select("cell_id", F.col("block").cast("int").alias("block"))


def _in_runs(blocks: DataFrame) -> DataFrame:
    """Blocks as they are or, if there are very many, runs of them that still fit into a task: rounds cost more than cells."""
    sizes = materialise(blocks.groupBy("block").agg(F.count("*").alias("n")), "sizes")
    if sizes.count() <= MAX_BLOCKS:
        return blocks
    before = exclusive_prefix(sizes, "block", "n").select("block", F.floor(F.col("prefix") / BLOCK_CELLS).cast("int").alias("run"))
    return blocks.join(before, "block").select("cell_id", F.col("run").alias("block"))


def _swept_block(rows: pd.DataFrame, sent: pd.DataFrame, threshold: float, now: int) -> pd.DataFrame:
    """What a block (its cells and edges) can sweep with the rates that other blocks have sent, and couldn't in the rounds before: a row
    a cell, and a row for each rate that leaves the block."""
    cells, edges = rows[~rows["edge"]].sort_values("cell_id"), rows[rows["edge"]]
    ids = cells["cell_id"].to_numpy()
    n = len(ids)
    src, share = np.searchsorted(ids, edges["cell_id"].to_numpy()), edges["share"].to_numpy()
    target = edges["target"].to_numpy()
    inner = edges["to_block"].to_numpy() == rows["block"].iloc[0]
    dst = np.where(inner, np.searchsorted(ids, target), -1)
    order = np.argsort(src, kind="stable")
    src, dst, share, target, inner, to_block = src[order], dst[order], share[order], target[order], inner[order], edges["to_block"].to_numpy()[order]
    begin = np.searchsorted(src, np.arange(n + 1))
    incoming, waiting = cells["incoming"].to_numpy(dtype=float).copy(), cells["waiting"].to_numpy(dtype=np.int64).copy()
    own, passed, outgoing, done = cells["own"].to_numpy(dtype=float), np.exp(-cells["tau"].to_numpy(dtype=float)), np.zeros(n), np.full(n, -1)
    sent = sent.sort_values(["round", "cell_id", "source_id"])
    at, rate, when = np.searchsorted(ids, sent["cell_id"].to_numpy()), sent["rate"].to_numpy(dtype=float), sent["round"].to_numpy()
    for stage in (0, 1):  # what was known in the rounds before first, then what is new
        fresh = when < now if stage == 0 else when == now
        np.add.at(incoming, at[fresh], rate[fresh])
        np.subtract.at(waiting, at[fresh], 1)
        if now == 0 and stage == 0:
            continue
        ready = np.flatnonzero((waiting == 0) & (done < 0))
        while len(ready):
            total = incoming[ready] + own[ready]
            outgoing[ready] = np.where(total < threshold, 0.0, total * passed[ready])
            done[ready] = stage
            out = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in ready])
            out = out[inner[out]]
            np.add.at(incoming, dst[out], outgoing[src[out]] * share[out])
            np.subtract.at(waiting, dst[out], 1)
            touched = np.unique(dst[out])
            ready = touched[(waiting[touched] == 0) & (done[touched] < 0)]
    new = done == 1
    leave = np.flatnonzero(~inner & new[src])
    one = pd.DataFrame({"cell_id": ids[new], "incoming": incoming[new], "outgoing": outgoing[new], "to_block": np.int32(-1), "target": np.int64(0), "rate": 0.0})
    two = pd.DataFrame({"cell_id": ids[src[leave]], "incoming": 0.0, "outgoing": 0.0, "to_block": to_block[leave].astype(np.int32), "target": target[leave], "rate": outgoing[src[leave]] * share[leave]})
    return pd.concat([one, two], ignore_index=True)


def _block_task(threshold: float, now: int):
    def run(key, block, sent):
        out = _swept_block(block, sent, threshold, now) if len(block) else pd.DataFrame(columns=["cell_id", "incoming", "outgoing", "to_block", "target", "rate"])
        return out.assign(dir=np.int32(key[0]))[["dir", "cell_id", "incoming", "outgoing", "to_block", "target", "rate"]]

    return run


def sweep_blocks(cells: DataFrame, wind: DataFrame, dirs: DataFrame, blocks: DataFrame, threshold: float = 0.0, max_rounds: int = 100_000) -> DataFrame:
    """The same by blocks (cell_id, block), each of which fits into a task: a round sweeps in every block what can be swept with what
    other blocks have sent so far, and only rates across block boundaries are exchanged. More than ``MAX_BLOCKS`` are put together in
    runs of ``BLOCK_CELLS`` cells by their numbers, which don't change the rates.

    Cells and edges are written once, bucketed by direction and block, and read where they lie; a round reads the blocks that something
    new was sent to. Nothing is carried over but the sent rates: a block repeats what it swept before, so a lost executor costs its
    tasks only. Rounds are as many as the blocks that the longest chain of cells passes.
    """
    spark = cells.sparkSession
    edges, cells, idle, state = _started(cells, wind)
    at = materialise(_in_runs(materialise(blocks.select("cell_id", "block"), "blocks")), "blocks")
    active = materialise(state.join(at.hint("merge"), "cell_id"), "active")
    known = active.select("dir", "cell_id", "block")
    to = known.select("dir", F.col("cell_id").alias("neighbour_id"), F.col("block").alias("to_block"))
    inside = edges.join(known.hint("merge"), ["dir", "cell_id"]).join(to.hint("merge"), ["dir", "neighbour_id"])
    cell = active.withColumns({"edge": F.lit(False), "target": F.lit(0).cast("long"), "to_block": F.lit(-1), "share": F.lit(0.0)})
    edge = inside.withColumnRenamed("neighbour_id", "target").withColumns({"edge": F.lit(True), "waiting": F.lit(0).cast("long"), **{c: F.lit(0.0) for c in ("tau", "own", "incoming")}})
    names = ["dir", "block", "edge", "cell_id", "tau", "own", "incoming", "waiting", "target", "to_block", "share"]
    rows = cell.select(*names).unionByName(edge.select(*names))
    n, table, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"sweep_blocks_{uuid.uuid4().hex}", scratch_path(spark, "swept")
    rows.repartition(n, "dir", "block").write.format("parquet").bucketBy(n, "dir", "block").option("path", f"{path}/blocks").saveAsTable(table)
    stored, left = spark.table(table), active.count()
    total = left
    sent_schema = "dir int, block int, cell_id long, source_id long, rate double, round int"
    swept_schema = "dir int, cell_id long, incoming double, outgoing double, to_block int, target long, rate double"
    try:
        for now in range(max_rounds if left else 0):
            sent = spark.read.schema(sent_schema).parquet(f"{path}/sent") if now else spark.createDataFrame([], sent_schema)
            here = stored
            if now:
                called = sent.where(F.col("round") == now).select("dir", "block").distinct()
                here, sent = stored.join(called, ["dir", "block"], "left_semi"), sent.join(called, ["dir", "block"], "left_semi")

            out = here.groupBy("dir", "block").cogroup(sent.groupBy("dir", "block")).applyInPandas(_block_task(threshold, now), swept_schema)
            out.write.parquet(f"{path}/out/round={now}")
            out = spark.read.schema(swept_schema).parquet(f"{path}/out/round={now}")
            fresh = out.where("to_block < 0").count()
            left -= fresh
            if not left:
                break
            if not fresh:
                raise ValueError(f"{left} cells wait for each other: the grid has a cycle")
            across = out.where("to_block >= 0").select("dir", F.col("to_block").alias("block"), F.col("target").alias("cell_id"), F.col("cell_id").alias("source_id"), "rate", F.lit(now + 1).alias("round"))
            across.write.mode("append").parquet(f"{path}/sent")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    if not total:
        result = idle.limit(0).select("dir", "cell_id", F.lit(0.0).alias("incoming"), "outgoing")
    else:
        result = spark.read.schema(swept_schema).parquet(f"{path}/out").where("to_block < 0").select("dir", "cell_id", "incoming", "outgoing")
    result = _with_idle(result, edges, cells, idle)
    result._rounds = now + 1 if total else 0
    return result


def sweep(cells: DataFrame, faces: DataFrame, dirs: DataFrame, threshold: float = 0.0, inflow: DataFrame | None = None, fixed: DataFrame | None = None, strategy: str | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(dir, cell_id, incoming, outgoing) for cells (cell_id, tau, source), FACES and directions.

    ``inflow`` (dir, cell_id, inflow) is what periodic neighbours sent in the sweep before. Rates below ``threshold`` end.
    ``fixed`` (dir, cell_id, fixed) lists cells that aren't swept now: they go on sending their rates and still receive.
    ``blocks`` (cell_id, block) makes ``blocks`` the strategy, see ``sweep_blocks``.
    """
    n_dirs = dirs.count()
    state = cells.select("cell_id", "tau", (F.col("source") / n_dirs).alias("own")).crossJoin(F.broadcast(dirs.select("dir")))
    if inflow is None:
        state = state.withColumn("inflow", F.lit(0.0))
    else:
        state = state.join(inflow.hint("merge"), ["dir", "cell_id"], "left").fillna(0.0, ["inflow"])
    if fixed is None:
        state = state.withColumn("fixed", F.lit(None).cast("double"))
    else:
        state = state.join(fixed.hint("merge"), ["dir", "cell_id"], "left")
    wind = downwind(faces, dirs)
    if blocks is not None:
        return sweep_blocks(state, wind, dirs, blocks, threshold)
    if strategy is None:
        strategy = "grouped" if faces.count() <= GROUPED_FACES else "waves"
    if strategy == "waves":
        return sweep_blocks(state, wind, dirs, ranges_of(cells), threshold)
    return {"grouped": sweep_grouped}[strategy](state, wind, dirs, threshold)


def periodic_inflow(swept: DataFrame, faces: DataFrame, dirs: DataFrame) -> DataFrame:
    """(dir, cell_id, inflow): what leaves through periodic faces and enters with the next sweep."""
    wind = downwind(faces, dirs).where("kind = 'periodic'")
    sent = swept.join(wind.select("dir", "cell_id", "neighbour_id", "share"), ["dir", "cell_id"])
    return sent.groupBy("dir", F.col("neighbour_id").alias("cell_id")).agg(F.sum(F.col("outgoing") * F.col("share")).alias("inflow"))


def photon_rate(swept: DataFrame) -> DataFrame:
    """(cell_id, rate): incoming rates summed over directions."""
    return swept.groupBy("cell_id").agg(F.sum("incoming").alias("rate"))


def escaped(swept: DataFrame, faces: DataFrame, dirs: DataFrame) -> DataFrame:
    """(dir, escaped): rate through boundary and periodic faces."""
    wind = downwind(faces, dirs).where("kind <> 'interior'").groupBy("dir", "cell_id").agg(F.sum("share").alias("share"))
    return swept.join(wind, ["dir", "cell_id"]).groupBy("dir").agg(F.sum(F.col("outgoing") * F.col("share")).alias("escaped"))


def conservation(swept: DataFrame, cells: DataFrame, faces: DataFrame, dirs: DataFrame) -> DataFrame:
    """(dir, emitted, absorbed, escaped)."""
    n_dirs = dirs.count()
    emitted = cells.select("cell_id", (F.col("source") / n_dirs).alias("own"))
    kept = swept.join(emitted, "cell_id").groupBy("dir").agg(F.sum("own").alias("emitted"), F.sum(F.col("incoming") + F.col("own") - F.col("outgoing")).alias("absorbed"))
    return kept.join(escaped(swept, faces, dirs), "dir")


def rebin(values: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(cell_id, dir, value): values of old directions added up in the best aligned new one."""
    to = aligned(old, new)
    return values.join(F.broadcast(to), "dir").groupBy("cell_id", F.col("to").alias("dir")).agg(F.sum("value").alias("value"))


def aligned(old: DataFrame, new: DataFrame, digits: int | None = None) -> DataFrame:
    """(dir, to): for each old direction the new one with the largest cosine, the last of equals; with ``digits`` cosines that
    agree to so many count as equal."""
    o = old.select("dir", *(F.col(f"d{a}").alias(f"o{a}") for a in "xyz"))
    n = new.select(F.col("dir").alias("to"), *(F.col(f"d{a}").alias(f"n{a}") for a in "xyz"))
    cos = sum((F.col(f"o{a}") * F.col(f"n{a}") for a in "xyz"), F.lit(0.0))
    cos = cos if digits is None else F.round(cos, digits)
    return o.crossJoin(F.broadcast(n)).groupBy("dir").agg(F.max_by("to", F.struct(cos, "to")).alias("to"))
