"""Graphs as tables of edges: naming of cycles, and cyclic arrangement of rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, scratch_path

MAX_ROUNDS = 100_000
MERGED = 8  # rounds of contraction that hold nearly all items, whose joins merge


def _next(old: DataFrame | None, new: DataFrame, name: str) -> DataFrame:
    """``new`` written; ``old``, which it was made of, is deleted."""
    out = materialise(new, name)
    if old is not None:
        discard(old)
    return out


def trimmed(edges: DataFrame, most: int | None = None) -> DataFrame:
    """The edges (dir, a, b) that are left when those are taken away, again and again, whose start nothing leads to or whose end
    leads nowhere: cycles and paths between cycles. Both ends of all paths shrink in one round; with ``most`` rounds longer ones stay."""
    rest = materialise(edges.select("dir", "a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    n = rest.count()
    for _ in range(MAX_ROUNDS if most is None else most):
        into, out_of = rest.select("dir", F.col("b").alias("a")), rest.select("dir", F.col("a").alias("b"))
        rest = _next(rest, rest.join(into, ["dir", "a"], "left_semi").join(out_of, ["dir", "b"], "left_semi").select("dir", "a", "b"), "edges")
        before, n = n, rest.count()
        if n == before:
            return rest
    if most is None:
        raise RuntimeError("trimming didn't settle")
    return rest


def _followed(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each node of ``single`` (dir, node, to: its only way on) ends up: (dir, node, root) for those that reach a node outside, and
    (dir, component, node) for those on cycles of such nodes. Pointers are doubled: as many rounds as the logarithm of the longest way."""
    inside = single.select("dir", F.col("node").alias("to"), F.lit(True).alias("inside"))
    state = single.join(inside, ["dir", "to"], "left").select("dir", "node", "to", F.col("inside").isNull().alias("ended"), F.col("node").alias("least"))
    state = materialise(state, "ways")
    left, roots = state.where("NOT ended").count(), None
    for _ in range(128):
        if not left:
            break
        ahead = state.select("dir", F.col("node").alias("to"), F.col("to").alias("next"), F.col("ended").alias("ends"), F.col("least").alias("more"))
        on = state.where("NOT ended").join(ahead, ["dir", "to"]).select("dir", "node", F.col("next").alias("to"), F.col("ends").alias("ended"), F.least("least", "more").alias("least"))
        if roots is None:
            state = _next(state, state.where("ended").unionByName(on), "ways")
            before, left = left, state.where("NOT ended").count()
            if left == before:  # ways of all lengths up to the longest occur, so what is left leads to cycles
                roots, state, size = state, materialise(state.where("NOT ended"), "ways"), 1
        else:
            state, size = materialise(on, "ways"), size * 2
            if size >= left:
                break
    roots = state if roots is None else roots
    on_cycle = state.where("NOT ended").select("dir", F.col("to").alias("node")).distinct()
    cycles = materialise(state.where("NOT ended").join(on_cycle, ["dir", "node"], "left_semi").select("dir", F.col("least").alias("component"), "node"), "cycles")
    return roots.where("ended").select("dir", "node", F.col("to").alias("root")), cycles


def strong_components(edges: DataFrame) -> DataFrame:
    """(dir, component, node): the nodes that lie on cycles of (dir, a, b), named by the least node of those that reach each other.

    Directions are graphs of their own. Nothing is put out for a graph without cycles; an edge from a node to itself is a cycle.
    Method: nodes with one way on are contracted into the node where their way ends, by doubling pointers, so long chains and tails cost
    the logarithm of their length; then the same backwards, as long as that makes the graph smaller. What is left is named by
    ``_named``. A contracted node belongs to the component of the node it leads to if something of that component leads to it.
    """
    return _components(trimmed(edges, 3), 0)


def _components(rest: DataFrame, vain: int) -> DataFrame:
    out = materialise(rest.groupBy("dir", "a").agg(F.count("*").alias("n"), F.min("b").alias("b")), "degrees")
    counts = out.agg(F.count("*"), F.count(F.when(F.col("n") == 1, 1))).first()
    turned = lambda df: df.select("dir", F.col("b").alias("a"), F.col("a").alias("b"))
    if counts[1] * 20 <= counts[0]:
        return _named(rest) if vain or not counts[0] else _components(materialise(turned(rest), "turned"), vain + 1)
    single = out.where("n = 1").select("dir", F.col("a").alias("node"), F.col("b").alias("to"))
    roots, cycles = _followed(single)
    several = rest.join(out.where("n > 1").select("dir", "a"), ["dir", "a"], "left_semi")
    led = several.join(roots.select("dir", F.col("node").alias("b"), "root"), ["dir", "b"], "left")
    lost = single.join(roots, ["dir", "node"], "left_anti").select("dir", F.col("node").alias("b"))  # they lead to cycles that have no way out
    led = materialise(led.join(lost, ["dir", "b"], "left_anti"), "led")
    core = led.select("dir", "a", F.coalesce("root", "b").alias("b")).distinct()
    inner = materialise(_components(trimmed(turned(core), 3), 0), "inner")
    # contracted nodes that their component leads to, and all on their way
    one, two = (inner.select("dir", F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("a", "root"))
    marked = materialise(led.where("root IS NOT NULL").join(one, ["dir", "a"]).join(two, ["dir", "root"]).where("c_a = c_root").select("dir", F.col("b").alias("node")).distinct(), "marked")
    here = roots.join(inner.select("dir", F.col("node").alias("root")), ["dir", "root"], "left_semi").select("dir", "node")
    jump = materialise(single.join(here, ["dir", "node"], "left_semi").join(here.withColumnRenamed("node", "to"), ["dir", "to"], "left_semi").select("dir", "node", "to"), "jumps")
    for _ in range(64):
        if jump.isEmpty():
            break
        marked = _next(marked, marked.unionByName(marked.join(jump, ["dir", "node"]).select("dir", F.col("to").alias("node"))).distinct(), "marked")
        jump = _next(jump, jump.join(jump.select("dir", F.col("node").alias("to"), F.col("to").alias("next")), ["dir", "to"]).select("dir", "node", F.col("next").alias("to")), "jumps")
    joined = marked.join(roots, ["dir", "node"]).join(inner.select("dir", F.col("node").alias("root"), "component"), ["dir", "root"]).select("dir", "component", "node")
    joined = materialise(inner.unionByName(joined), "joined")
    names = joined.groupBy("dir", "component").agg(F.min("node").alias("name"))
    return cycles.unionByName(joined.join(names, ["dir", "component"]).select("dir", F.col("name").alias("component"), "node"))


def _named(edges: DataFrame) -> DataFrame:
    """``strong_components`` of a graph whose nodes have several ways on and back.

    What can't be on a cycle is trimmed; then each node takes the least name that leads to it, along the edges, and the
    nodes that lead back to their name without leaving it are a component; components are taken away until nothing is left. No
    component is held by one task. Rounds are as many as the longest of the shortest ways inside.
    """
    rest, found = trimmed(edges), None
    for _ in range(MAX_ROUNDS):
        if rest.isEmpty():
            break
        nodes = rest.select("dir", F.col("a").alias("node")).union(rest.select("dir", F.col("b").alias("node"))).distinct()
        names = materialise(nodes.withColumn("name", F.col("node")), "names")
        for _ in range(MAX_ROUNDS):
            came = rest.join(names.select("dir", F.col("node").alias("a"), F.col("name").alias("came")), ["dir", "a"]).groupBy("dir", F.col("b").alias("node")).agg(F.min("came").alias("came"))
            better = F.col("came") < F.col("name")
            moved = names.join(came, ["dir", "node"], "left").select("dir", "node", F.least("name", "came").alias("name"), F.coalesce(better, F.lit(False)).alias("moved"))
            names = _next(names, moved, "names")
            if names.where("moved").isEmpty():
                break
        names = names.drop("moved")
        one, two = (names.select("dir", F.col("node").alias(c), F.col("name").alias(f"name_{c}")) for c in "ab")
        inside = materialise(rest.join(one, ["dir", "a"]).join(two, ["dir", "b"]).where("name_a = name_b").select("dir", "a", "b", F.col("name_a").alias("name")), "inside")
        members = materialise(names.where("node = name").select("dir", "node", "name"), "members")
        fresh = members
        for _ in range(MAX_ROUNDS):
            back = inside.join(fresh.select("dir", F.col("node").alias("b")), ["dir", "b"], "left_semi").select("dir", F.col("a").alias("node"), "name").distinct()
            new = materialise(back.join(members, ["dir", "node"], "left_anti"), "members")
            if new.isEmpty():
                break
            members, fresh = materialise(members.unionByName(new), "members"), new
        sizes = members.groupBy("dir", "name").agg(F.count("*").alias("n"))
        loops = rest.where("a = b").select("dir", F.col("a").alias("name"), F.lit(True).alias("loop"))
        cycles = sizes.join(loops, ["dir", "name"], "left").where("n > 1 OR loop").select("dir", "name")
        part = materialise(members.join(cycles, ["dir", "name"], "left_semi").select("dir", F.col("name").alias("component"), "node"), "cycles")
        found = part if found is None else found.unionByName(part)
        gone = members.select("dir", F.col("node").alias("a"))
        left = rest.join(gone, ["dir", "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), ["dir", "b"], "left_anti")
        rest = trimmed(left)
    if found is None:
        return edges.where("false").select("dir", F.col("a").alias("component"), F.col("a").alias("node"))
    return found


def arranged_in_rings(pairs: DataFrame) -> DataFrame:
    """(ring, rank, n, item, following): items of a symmetric relation (a, b) in which each has two partners, in cyclic order.

    ``ring`` is a ring's least item, which has rank 0; the ring goes on to the smaller one of its partners. A pair may be given one way
    or both. Two items that have only each other are a ring of two. An item with another number of partners is an error.
    Method: list ranking. In each round items whose hash is less than that of both neighbours leave, and their neighbours are linked over
    them by the sum of both ways, so a third of the items leaves a round and all rounds together move some three times what the first
    does; ways are told apart by the side of an item that they leave from. The last item of a ring gets place 0, and round by round, backwards, those
    that left get theirs from a neighbour. No ring is held by one task.
    Rows are exchanged narrow, before they are grouped: an item has few, so grouping them where they come from only makes them wider.
    Joins of what grows with the relation merge at every size: of small files Spark would send all rows, many times as large, to all tasks.
    """
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a").distinct()
    partners = materialise(both.groupBy("a").agg(F.min("b").alias("one"), F.max("b").alias("two"), F.count("*").alias("n")), "partners")
    lone = partners.where("n = 1").select("a", "one")
    duos = lone.join(lone.select(F.col("a").alias("one"), F.col("one").alias("a")), ["a", "one"])
    odd = partners.where("n > 2").select("a").union(lone.select("a").join(duos.select("a"), "a", "left_anti"))
    if not odd.isEmpty():
        raise ValueError(f"{odd.count()} items don't have two partners, {odd.first()[0]} among them")
    ends = partners.where("n = 2").select("a", "one", "two")
    # side 0 of an item is towards the smaller partner; a way is (at: the item there, code: twice its length plus the side there)
    told = ends.select(F.explode(F.array(*(F.struct(F.col(c).alias("item"), F.col("a").alias("at"), F.lit(2 + i).cast("long").alias("code")) for i, c in enumerate(("one", "two"))))).alias("t")).select("t.*").repartition("item")
    sides = told.groupBy("item").agg(F.min("at").alias("at0"), F.min_by("code", "at").alias("code0"), F.max("at").alias("at1"), F.max_by("code", "at").alias("code1"))
    rounds = [materialise(sides.withColumn("leaves", _leaves(0)), "ways")]
    while not rounds[-1].where("leaves").isEmpty():
        rounds.append(materialise(_linked_over(rounds[-1]).withColumn("leaves", _leaves(len(rounds))), "ways"))
    path = scratch_path(pairs.sparkSession, "places")
    last = rounds[-1].select("item", F.col("item").alias("last"), F.lit(1).cast("long").alias("place"))  # twice the place plus the side that leads on
    last.write.parquet(path)
    places = pairs.sparkSession.read.schema(last.schema).parquet(path)
    for k, left in reversed(list(enumerate(rounds[:-1]))):
        near = places.select(F.col("item").alias("at0"), "last", "place")
        near = near.hint("merge") if k < MERGED else near
        after = F.expr("(place & 1) = (code0 & 1)")  # the neighbour's side towards the item leads on
        place = F.when(after, F.expr("((place >> 1) + (code0 >> 1)) * 2 + 1")).otherwise(F.expr("((place >> 1) - (code0 >> 1)) * 2"))
        left.where("leaves").join(near, "at0").select("item", "last", place.alias("place")).write.mode("append").parquet(path)
        places = pairs.sparkSession.read.schema(last.schema).parquet(path)
    for one in rounds:
        discard(one)
    # a ring begins at its least item and goes on by that item's side 0
    least = materialise(places.groupBy("last").agg(F.min("item").alias("item"), F.count("*").alias("n")), "least")
    firsts = materialise(places.join(least, ["last", "item"]).select("last", F.col("item").alias("ring"), "n", F.col("place").alias("first")), "firsts")
    ways = F.expr("CASE WHEN (first & 1) = 0 THEN (place >> 1) - (first >> 1) ELSE (first >> 1) - (place >> 1) END")
    along = F.when(F.expr("(place & 1) = (first & 1)"), F.col("one")).otherwise(F.col("two"))
    ranked = places.join(firsts, "last").join(ends.withColumnRenamed("a", "item").hint("merge"), "item")
    rings = ranked.select("ring", F.pmod(ways, "n").alias("rank"), "n", "item", along.alias("following"))
    two = duos.select(F.least("a", "one").alias("ring"), F.when(F.col("a") < F.col("one"), 0).otherwise(1).cast("long").alias("rank"), F.lit(2).cast("long").alias("n"), F.col("a").alias("item"), F.col("one").alias("following"))
    return materialise(rings.unionByName(two), "rings")


def _leaves(k: int) -> Column:
    """Whether an item leaves in round ``k``: both neighbours have greater hashes (of equal ones, ids). Two neighbours never do."""
    item = F.xxhash64(F.lit(k), "item")
    less = lambda at: (item < F.xxhash64(F.lit(k), at)) | ((item == F.xxhash64(F.lit(k), at)) & (F.col("item") < F.col(at)))
    return less("at0") & less("at1")


def _linked_over(ways: DataFrame) -> DataFrame:
    """The items that stay, linked over those that leave."""
    blank = {c: F.lit(None).cast(ways.schema[c].dataType) for c in ("at1", "code1")}
    stay = ways.where("NOT leaves").select("item", F.lit(None).cast("int").alias("side"), "at0", "code0", "at1", "code1")

    def tell(own: int, other: int) -> Column:
        """To the neighbour on one side, for its ``side`` towards the item: the way to the neighbour on the other."""
        length = F.shiftright("code0", 1) + F.shiftright("code1", 1)
        side = F.col(f"code{own}").bitwiseAND(1).cast("int")
        code = length * 2 + F.col(f"code{other}").bitwiseAND(1)
        return F.struct(F.col(f"at{own}").alias("item"), side.alias("side"), F.col(f"at{other}").alias("at0"), code.alias("code0"), *(v.alias(c) for c, v in blank.items()))

    told = ways.where("leaves").select(F.explode(F.array(tell(0, 1), tell(1, 0))).alias("t")).select("t.*")
    new = lambda c, side: F.max(F.when(F.col("side") == side, F.col(f"{c}0")))
    old = lambda c, side: F.max(F.when(F.col("side").isNull(), F.col(f"{c}{side}")))
    news = [F.coalesce(new(c, side), old(c, side)).alias(f"{c}{side}") for side in (0, 1) for c in ("at", "code")]
    return stay.unionByName(told).repartition("item").groupBy("item").agg(*news)


def ring_areas(rings: DataFrame, corners: DataFrame) -> DataFrame:
    """(ring, n, area): the area of the polygon of each ring's corners (item, x, y), in the order of ``arranged_in_rings``."""
    here = corners.select("item", F.col("x").alias("x0"), F.col("y").alias("y0"))
    there = corners.select(F.col("item").alias("following"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    sides = rings.select("ring", "n", "item", "following").join(here.hint("merge"), "item").join(there.hint("merge"), "following")
    return sides.groupBy("ring", "n").agg((F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))) / 2).alias("area"))
