"""Order-dependent choices as fixed-point loops with the result of the sequential greedy.

`independent_set`: taking rows in rank order and dropping their neighbours gives the lexicographically first maximal
independent set; taking in each round every row that outranks all its live neighbours gives the same set in few rounds.
`greedy_match`: taking pairs by cost with each end used once equals taking, in each round, every pair that is the best of
both its ends. Every round's state is written to shared storage, so rounds do not lengthen the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def independent_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id, rank (lower first; ties by id). edges: a, b, unordered. Returns id, chosen boolean, by: the chosen
    neighbour of the lowest rank for the rows that were dropped, the row itself for those chosen."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "mis-edges")
    live = materialize(nodes.select("id", F.struct("rank", "id").alias("key")), "mis-live")
    chosen = None
    while not live.isEmpty():
        from_live = both.join(live.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a").join(live.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b")
        beaten = from_live.where("kb < ka").select(F.col("a").alias("id")).distinct()
        new = materialize(live.join(beaten, "id", "left_anti"), "mis-new")
        gone = both.join(new.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).unionByName(new.select("id")).distinct()
        live = materialize(live.join(gone, "id", "left_anti"), "mis-live")
        chosen = new if chosen is None else chosen.unionByName(new)
    if chosen is None:
        return nodes.select("id", F.lit(True).alias("chosen"), F.col("id").alias("by"))
    heads = both.join(chosen.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b").groupBy(F.col("a").alias("id")).agg(F.min("kb").alias("kb"))
    marked = nodes.select("id").join(chosen.select("id", F.lit(True).alias("c")), "id", "left").join(heads, "id", "left")
    mine = F.coalesce(F.col("c"), F.lit(False))
    return marked.select("id", mine.alias("chosen"), F.when(mine, F.col("id")).otherwise(F.col("kb.id")).alias("by"))


def greedy_match(pairs: DataFrame) -> DataFrame:
    """pairs: u, v, cost. The pairs of the greedy one-to-one matching by (cost, u, v); an end may occur on either side."""
    live = materialize(pairs.where("u <> v").select("u", "v", F.struct("cost", "u", "v").alias("key")), "match-live")
    out = None
    while not live.isEmpty():
        ends = live.select(F.col("u").alias("e"), "key").unionByName(live.select(F.col("v").alias("e"), "key")).groupBy("e").agg(F.min("key").alias("best"))
        ends = materialize(ends, "match-ends")
        a, b = ends.select(F.col("e").alias("u"), F.col("best").alias("bu")), ends.select(F.col("e").alias("v"), F.col("best").alias("bv"))
        taken = materialize(live.join(a, "u").join(b, "v").where("key = bu and key = bv").select("u", "v", "key").distinct(), "match-taken")
        used = taken.select(F.col("u").alias("e")).unionByName(taken.select(F.col("v").alias("e")))
        left = live.join(used.select(F.col("e").alias("u")), "u", "left_anti").join(used.select(F.col("e").alias("v")), "v", "left_anti")
        live = materialize(left.select("u", "v", "key"), "match-live")
        out = taken if out is None else out.unionByName(taken)
    return pairs.select("u", "v", "cost").limit(0) if out is None else out.select("u", "v", F.col("key.cost").alias("cost"))


def sequential_match(rows: list[tuple]) -> list[tuple]:
    """The plain loop over (cost, u, v), for tests and for edge lists of one tile."""
    used, out = set(), []
    for cost, u, v in sorted(rows):
        if u != v and u not in used and v not in used:
            used |= {u, v}
            out.append((u, v, cost))
    return out
