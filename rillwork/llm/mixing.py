"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 63-bit hash. Per source, word counts are summed by the hash's leading bits; the cumulated histogram shows
in which bucket a budget is reached, and only that bucket is summed again by the next bits, until one hash is left. A row
is then taken by comparing its hash with its source's threshold: nothing is sorted by row, reruns agree, and a smaller
budget takes a subset of a larger one (the thresholds nest).

Data that moves: at most 2^BITS sums per source and task, never rows. A hot source is summed before the shuffle.

Rows that agree in all of id, source and text share a hash. Where such a group is the one that reaches the budget, as many of
its rows are taken as come nearest to it, chosen by a second hash of the row's place; which of them does not matter, as
they are equal, so reruns agree in what they return.

Defined cases: null text has size 0; a null source is a source of its own, last in order; empty table: empty result; texts
of any length are counted whole in the JVM; extra columns are ignored, and `mixed_documents` hands them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
BITS = 12
HASH_BITS = 63


def row_hash(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH_BITS)


def place_hash() -> Column:
    """Another hash for each row, by its place in the scan."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)


def ranked_sources(totals: DataFrame) -> DataFrame:
    """Adds `ord`: the source's place by code point, null last. Range-sorted parts are numbered by the counts before them."""
    spark = totals.sparkSession
    parts = materialize(
        totals.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .select("*", F.monotonically_increasing_id().alias("__row")),
        "mix-sources",
    )
    part, within = F.shiftrightunsigned("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in parts.groupBy(part.alias("p")).count().collect())  # one row a partition
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    known = spark.createDataFrame(starts, "p long, start long")
    return parts.join(F.broadcast(known), part == F.col("p")).select(*totals.columns, (F.col("start") + within).alias("ord"))


def targets(totals: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of the whole by weight, stopped at cap times the
    source's size, the excess shared anew by weight until none is above. Each round is one two-number aggregate."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    table = materialize(ranked_sources(totals).select("source", "source_size", w.alias("w")), "mix-weights")
    top = F.col("source_size") * F.lit(float(cap))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = None, None
    while True:
        stopped = F.lit(False) if level is None else F.col("w") * F.lit(level) >= top
        row = table.agg(
            F.sum(F.when(stopped, top)).alias("held"), F.sum(F.when(~stopped, F.col("w"))).alias("w"), F.count(F.when(stopped, 1)).alias("n")
        ).first()
        if not row["w"]:
            break
        if full == row["n"]:
            break
        full, level = row["n"], (total - float(row["held"] or 0)) / row["w"]
    share = F.col("w") * F.lit(float(level or 0))
    return table.select("source", "source_size", F.least(share, top).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, bits: int = BITS) -> DataFrame:
    """Per source the hash below which rows are taken, so that their sizes sum nearest to `budget`.

    sized: source, size, h. budgets: source, budget. Returns source, threshold, edge, room: rows with h < threshold are taken.
    Where the hash that reaches the budget belongs to several rows, it is `edge` and none of them is under the threshold;
    `room` is what is left of the budget before them.
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    state = materialize(
        budgets.select("source", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("double").alias("done"), F.lit(0).cast("long").alias("low")),
        "mix-level",
    )
    settled, left = [], HASH_BITS
    while True:
        step = min(bits, left)
        left -= step
        span = 1 << left
        inside = sized.alias("s").join(state.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        bucket = F.shiftright(F.col("s.h"), left)
        if settled:
            inside = inside.where((F.col("s.h") >= F.col("t.low")) & (F.col("s.h") - F.col("t.low") < F.lit(1 << (left + step))))
        sums = inside.groupBy(F.col("s.source").alias("source"), bucket.alias("bucket")).agg(
            F.sum("s.size").alias("size"), F.min("s.h").alias("h0"), F.max("s.h").alias("h1"), F.count("*").alias("n")
        )
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        runs = sums.select("*", F.sum("size").over(run).alias("upto"))
        a, b = runs.alias("a"), state.alias("b")
        reached = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).where(F.col("done") + F.col("upto") > F.col("budget"))
        first = reached.groupBy(F.col("a.source").alias("source")).agg(
            F.min(F.struct("a.bucket", "a.size", "a.upto", "a.h0", "a.h1", "a.n", "b.budget", "b.done", "b.low")).alias("m")
        )
        found = materialize(first.select("source", "m.*"), "mix-bucket")
        before = F.col("done") + F.col("upto") - F.col("size")
        # one hash left: take it if the sum comes nearer so
        over, under = before + F.col("size") - F.col("budget"), F.col("budget") - before
        single = F.col("h0") == F.col("h1")
        many = F.col("n") > 1
        settled.append(
            found.where(single).select(
                "source", F.when(~many & (over < under), F.col("h0") + 1).otherwise(F.col("h0")).alias("threshold"),
                F.when(many, F.col("h0")).alias("edge"), F.when(many, under).alias("room"),
            )
        )
        state = materialize(
            found.where(~single).select("source", "budget", before.alias("done"), F.shiftleft(F.col("bucket"), left).alias("low")), "mix-level"
        )
        if left == 0 or state.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    # never reached: the budget covers the whole source
    return materialize(
        budgets.alias("a").join(out.alias("b"), same({"source": F.col("a.source")}, {"source": F.col("b.source")}), "left").select(
            "a.source", F.coalesce("b.threshold", F.when(F.col("a.budget") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(0))).alias("threshold"), "b.edge", "b.room"
        ),
        "mix-thresholds",
    )


def plan(sized: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, size, h, place) to one row a source: source, source_size, target, copies (whole), and of the part left:
    threshold, edge, place (rows with the hash `edge` are taken below this place hash)."""
    totals = materialize(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-totals")
    aims = targets(totals, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = materialize(
        aims.select("*", whole.alias("copies")).select("*", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)).alias("budget")),
        "mix-targets",
    )
    marks = thresholds(sized, aims.select("source", "budget"))
    edges = marks.where("edge is not null")
    if edges.isEmpty():
        places = marks.select("source", F.lit(0).cast("long").alias("place"))
    else:
        at_edge = sized.alias("s").join(edges.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.h") == F.col("e.edge")))
        equal = at_edge.select("s.source", "s.size", F.col("s.place").alias("h"))
        places = thresholds(equal, edges.select("source", F.col("room").alias("budget"))).select("source", F.col("threshold").alias("place"))
    a, b, c = aims.alias("a"), marks.alias("b"), places.alias("c")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).join(c, F.col("a.source").eqNullSafe(F.col("c.source")), "left")
    return materialize(joined.select("a.source", "a.source_size", "a.target", "a.copies", "b.threshold", "b.edge", F.coalesce("c.place", F.lit(0)).alias("place")), "mix-plan")


def apply_plan(rows: DataFrame, plan_table: DataFrame, source: str, h: str, place: str) -> DataFrame:
    """Adds __source_size, __target and __copies to rows; the plan has one row a source, and the planner broadcasts it
    only if its measured size allows. A hot source is split by adaptive execution where the join shuffles."""
    a, b = rows.alias("a"), plan_table.alias("b")
    at_edge = F.coalesce(F.col(f"a.`{h}`") == F.col("b.edge"), F.lit(False)) & (F.col(f"a.`{place}`") < F.col("b.place"))
    copies = F.col("b.copies") + F.when((F.col(f"a.`{h}`") < F.col("b.threshold")) | at_edge, 1).otherwise(0)
    return a.join(b, F.col(f"a.`{source}`").eqNullSafe(F.col("b.source"))).select(
        "a.*", F.col("b.source_size").alias("__source_size"), F.col("b.target").alias("__target"), copies.alias("__copies")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words taken, repeats counted)."""
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            row_hash(F.col(id_col), F.col(source), F.col(text)).alias("h"), place_hash().alias("place"),
        ),
        "mix-sized",
    )
    out = apply_plan(sized, plan(sized, weights, cap), "source", "h", "place")
    return out.select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: the input's columns, each row as often as the mix takes it. docs is read twice and should be a stored
    table, so that a row has the same place both times; that matters only among equal rows at the edge of a budget."""
    h = row_hash(F.col(id_col), F.col(source), F.col(text))
    sized = materialize(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), h.alias("h"), place_hash().alias("place")), "mix-sized")
    chosen = apply_plan(docs.withColumns({"__h": h, "__place": place_hash()}), plan(sized, weights, cap), source, "__h", "__place").where("__copies > 0")
    repeated = chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
