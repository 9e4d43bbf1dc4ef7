"""Graph operators on edge tables: components, shortest paths, orders, propagation, peeling, smoothing.

Loops are fixed points over tables in shared storage. Trees use an id and a downstream (parent) id.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id. edges: u, v. Every node with label, the least id it can reach.

    Least labels of neighbours, pre-aggregated, then pointer jumping: rounds grow with the logarithm of a component.
    """
    both = edges.select("u", "v").where("u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "graph-edges")
    labels = materialize(nodes.select("id", F.col("id").alias("label")).distinct(), "graph-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = materialize(labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label")), "graph-step")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = materialize(step.join(jump, "label").select("id", "was", F.least("label", "next").alias("label")), "graph-labels")
        labels = new.select("id", "label")
        if new.where("label <> was").isEmpty():
            return labels


def touching_ends(ends: DataFrame, tolerance: float) -> DataFrame:
    """Ends (id, line, x, y) with `dangling`: no end of another line within the tolerance."""
    from .near import near_pairs

    touch = near_pairs(ends.select("id", "x", "y", "line"), ends.select("id", "x", "y", "line"), tolerance).where("a_line <> b_line")
    hit = touch.select(F.col("a_id").alias("id")).distinct().withColumn("t", F.lit(True))
    return ends.join(hit, "id", "left").withColumn("dangling", F.col("t").isNull()).drop("t")


def peel_leaves(edges: DataFrame, keep: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """Remove, again and again, edges (id, u, v) with a node of degree 1; edges whose id is in `keep` stay. Returns the
    edges with `round`: when it went, null if it stays."""
    live = materialize(edges.select("id", "u", "v"), "peel-live")
    kept = keep.select("id").distinct().withColumn("__keep", F.lit(True)) if keep is not None else None
    gone, k = None, 0
    while rounds is None or k < rounds:
        k += 1
        degree = live.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("deg"))
        du, dv = degree.select(F.col("n").alias("u"), F.col("deg").alias("du")), degree.select(F.col("n").alias("v"), F.col("deg").alias("dv"))
        free = live.join(du, "u").join(dv, "v").where("du = 1 or dv = 1").select("id", "u", "v")
        if kept is not None:
            free = free.join(kept, "id", "left_anti")
        free = materialize(free, "peel-free")
        if free.isEmpty():
            break
        live = materialize(live.join(free.select("id"), "id", "left_anti"), "peel-live")
        round_rows = free.select("id", F.lit(k).alias("round"))
        gone = round_rows if gone is None else gone.unionByName(round_rows)
    if gone is None:
        return edges.withColumn("round", F.lit(None).cast("int"))
    return edges.join(gone, "id", "left")


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """edges: u, v, cost (>= 0), directed. sources: id. Returns id, dist, pred, source by iterative relaxation; parallel
    edges count by the cheapest; ties go to the lowest predecessor, then source."""
    step = materialize(edges.groupBy("u", "v").agg(F.min("cost").alias("cost")), "sp-edges")
    best = materialize(sources.select("id", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred"), F.col("id").alias("source")).distinct(), "sp-best")
    front = best
    while not front.isEmpty():
        reach = front.join(step, front["id"] == step["u"]).select(
            F.col("v").alias("id"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("u").alias("pred"), "source"
        )
        offer = reach.groupBy("id").agg(F.min(F.struct("dist", "pred", "source")).alias("m"))
        joined = offer.join(best.select("id", F.col("dist").alias("old")), "id", "left").where("old is null or m.dist < old")
        front = materialize(joined.select("id", "m.dist", "m.pred", "m.source"), "sp-front")
        best = materialize(best.join(front.select("id"), "id", "left_anti").unionByName(front), "sp-best")
    return best


def uphill_cost(length: Column, z_from: Column, z_to: Column, free: float = 0.5, weight: float = 50.0) -> Column:
    """Length plus weight for each metre of drop beyond `free` against the direction of travel."""
    return length + F.lit(weight) * F.greatest(z_from - z_to - F.lit(free), F.lit(0.0))


def doublings(state: DataFrame) -> Iterator[int]:
    """Rounds of pointer doubling that a tree of so many nodes can need; more mean that parents form a ring."""
    yield from range(state.count().bit_length() + 1)
    raise ValueError("the parents form a ring")


def levels(tree: DataFrame) -> DataFrame:
    """id and parent (null at an outlet) with depth: steps to the outlet. Pointer doubling: rounds are the logarithm of the
    longest stem."""
    state = materialize(tree.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "tree-levels")
    for _ in doublings(state):
        if state.where("up is not null").isEmpty():
            break
        far = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = materialize(state.join(far, "up", "left").select("id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "tree-levels")
    return state.select("id", "depth")


def upstream_sum(tree: DataFrame, value: str) -> DataFrame:
    """id, total: the value summed over the node and everything upstream of it. Sums are passed along doubling pointers."""
    state = materialize(tree.select("id", F.col("parent").alias("up"), F.col(value).cast("double").alias("v")), "tree-values")
    total = state.select("id", F.col("v").alias("total"))
    # ancestors at distance 2^k get what lies within 2^k upstream, then pointers double
    for _ in doublings(state):
        if state.where("up is not null").isEmpty():
            break
        passed = total.join(state.select("id", "up"), "id").where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("more"))
        total = materialize(total.join(passed, "id", "left").select("id", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")), "tree-total")
        far = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        state = materialize(state.join(far, "up", "left").select("id", F.col("next").alias("up"), "v"), "tree-values")
    return total


def strahler(tree: DataFrame) -> DataFrame:
    """id, order: 1 at heads; the greatest upstream order, one more if two or more tributaries have it. One round a level,
    from the leaves."""
    depth = materialize(tree.select("id", "parent").join(levels(tree), "id"), "strahler")
    deepest = depth.agg(F.max("depth")).first()[0]
    done = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        here = depth.where(F.col("depth") == d).select("id", "parent")
        if done is None:
            new = here.select("id", "parent", F.lit(1).alias("order"))
        else:
            top = Window.partitionBy("parent")
            up = last.select("parent", "order", F.max("order").over(top).alias("m"))  # noqa: F821
            got = up.groupBy("parent").agg((F.max("m") + F.when(F.sum(F.when(F.col("order") == F.col("m"), 1).otherwise(0)) >= 2, 1).otherwise(0)).alias("o"))
            new = here.join(got.withColumnRenamed("parent", "p"), F.col("id") == F.col("p"), "left").select("id", "parent", F.coalesce("o", F.lit(1)).alias("order"))
        last = materialize(new, "strahler-level")
        done = last if done is None else done.unionByName(last)
    return tree.select("id", F.lit(1).alias("order")).limit(0) if done is None else done.select("id", "order")


def propagate_max(tree: DataFrame, value: str) -> DataFrame:
    """id, top: the greatest value of the node and everything upstream."""
    state = materialize(tree.select("id", F.col("parent").alias("up")), "prop-up")
    top = tree.select("id", F.col(value).alias("top"))
    for _ in doublings(state):
        if state.where("up is not null").isEmpty():
            break
        passed = top.join(state, "id").where("up is not null").groupBy(F.col("up").alias("id")).agg(F.max("top").alias("more"))
        top = materialize(top.join(passed, "id", "left").select("id", F.greatest("top", "more").alias("top")), "prop-top")
        far = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        state = materialize(state.join(far, "up", "left").select("id", F.col("next").alias("up")), "prop-up")
    return top


def main_stem(tree: DataFrame, area: str, least: float, start) -> DataFrame:
    """From the node `start` upstream, always to the tributary with the largest area (ties: the lowest id), while it has at
    least `least`: id, step."""
    key = F.max(F.struct(F.col(area), (-F.col("id")).alias("neg"))).alias("m")
    up = tree.where((F.col(area) >= least) & F.col("parent").isNotNull()).groupBy("parent").agg(key).select("parent", (-F.col("m.neg")).alias("best"))
    up = materialize(up, "stem-up")
    path = materialize(tree.where(F.col("id") == start).select("id", F.lit(0).alias("step")), "stem-path")
    front, k = path, 0
    while not front.isEmpty():
        k += 1
        front = materialize(front.join(up, front["id"] == up["parent"]).select(F.col("best").alias("id"), F.lit(k).alias("step")), "stem-front")
        path = path.unionByName(front)
    return path


def smooth(values: DataFrame, edges: DataFrame, rounds: int, keep: float = 0.5) -> DataFrame:
    """values: id, value, weight. edges: u, v, w. Jacobi steps: keep * own + (1 - keep) * weighted mean of the neighbours."""
    both = materialize(edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")), "smooth-edges")
    state = materialize(values.select("id", F.col("value").cast("double").alias("value"), "weight"), "smooth")
    for _ in range(rounds):
        near = both.join(state.select(F.col("id").alias("v"), "value", "weight"), "v").groupBy(F.col("u").alias("id")).agg(
            F.sum(F.col("w") * F.col("weight") * F.col("value")).alias("s"), F.sum(F.col("w") * F.col("weight")).alias("t")
        )
        mean = F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(F.col("value"))
        state = materialize(state.join(near, "id", "left").select("id", (F.lit(keep) * F.col("value") + F.lit(1 - keep) * mean).alias("value"), "weight"), "smooth")
    return state.select("id", "value")


def snap_nodes(ends: DataFrame, tolerance: float) -> DataFrame:
    """Cluster end points (id, x, y) closer than the tolerance: node (least id), x and y (means of the cluster)."""
    from .near import self_pairs

    edges = self_pairs(ends.select("id", "x", "y"), tolerance).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    label = components(ends, edges)
    centre = ends.join(label, "id").groupBy("label").agg(F.avg("x").alias("node_x"), F.avg("y").alias("node_y"), F.count("*").alias("n_ends"))
    return ends.select("id").join(label, "id").join(centre, "label").select("id", F.col("label").alias("node"), "node_x", "node_y", "n_ends")


def orient(reaches: DataFrame) -> DataFrame:
    """reaches: id, a, b (node keys), area. Direction a to b if the largest other area at b exceeds that at a, b to a if
    less; undecided ones take the direction most decided ones have. Returns id, from_node, to_node, decided."""
    ends = reaches.select("id", "a", "area").withColumnRenamed("a", "n").unionByName(reaches.select("id", F.col("b").alias("n"), "area"))
    # the two largest reaches of a node by two aggregates, so that a hub is no hot spot
    one = F.struct("area", "id")
    m1 = ends.groupBy("n").agg(F.max(one).alias("m1"))
    m2 = ends.join(m1, "n").where(F.col("id") != F.col("m1.id")).groupBy("n").agg(F.max(one).alias("m2"))
    top = m1.join(m2, "n", "left")
    def other(side: str) -> tuple[DataFrame, Column]:
        t = top.select(F.col("n").alias(side), F.col("m1").alias(f"m1_{side}"), F.col("m2").alias(f"m2_{side}"))
        best = F.when(F.col(f"m1_{side}.id") != F.col("id"), F.col(f"m1_{side}.area")).otherwise(F.col(f"m2_{side}.area"))
        return t, best
    ta, best_a = other("a")
    tb, best_b = other("b")
    d = reaches.join(ta, "a").join(tb, "b").withColumns({"oa": F.coalesce(best_a, F.lit(0.0)), "ob": F.coalesce(best_b, F.lit(0.0))})
    forward = F.when(F.col("ob") > F.col("oa"), 1).when(F.col("ob") < F.col("oa"), -1)
    d = d.withColumn("vote", forward)
    total = d.agg(F.coalesce(F.sum("vote"), F.lit(0)).alias("sum_votes"))
    d = d.crossJoin(F.broadcast(total))  # total is one row
    way = F.coalesce("vote", F.when(F.col("sum_votes") >= 0, 1).otherwise(-1))
    return d.select(
        "id", F.when(way > 0, F.col("a")).otherwise(F.col("b")).alias("from_node"), F.when(way > 0, F.col("b")).otherwise(F.col("a")).alias("to_node"),
        F.col("vote").isNotNull().alias("decided"),
    )
