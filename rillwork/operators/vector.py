"""Lines and polygons with rasters and other lines: sampling, overlap, footprints, cross-sections, ponds, outlets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from .near import near_pairs


def sample_points(lines: DataFrame, step: float) -> DataFrame:
    """Points every `step` metres along lines (id, line): id unique a point, line_id, k, x, y."""
    p = lines.select(F.col("id").alias("line_id"), F.posexplode(geometry.sample(F.col("line"), step)).alias("k", "p"))
    return p.select(F.concat_ws("_", F.col("line_id").cast("string"), F.col("k").cast("string")).alias("id"), "line_id", "k", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def overlap_share(lines: DataFrame, references: DataFrame, step: float, within: float) -> DataFrame:
    """Share of each line's sample points within a distance of the references' sample points: line_id, share, n."""
    a, b = sample_points(lines, step), sample_points(references, step)
    hit = near_pairs(a.select("id", "x", "y"), b.select("id", "x", "y"), within).select(F.col("a_id").alias("id")).distinct().withColumn("hit", F.lit(1.0))
    return a.join(hit, "id", "left").groupBy("line_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"), F.count("*").alias("n"))


def best_overlap(lines: DataFrame, references: DataFrame, step: float, within: float) -> DataFrame:
    """Per line the reference that is near most of its sample points (ties: the lowest id): line_id, ref_id, share."""
    a, b = sample_points(lines, step), sample_points(references, step)
    p = near_pairs(a.select("id", "x", "y", "line_id"), b.select("id", "x", "y", "line_id"), within).select("a_line_id", "b_line_id", "a_id").distinct()
    n = a.groupBy(F.col("line_id").alias("a_line_id")).agg(F.count("*").alias("n"))
    s = p.groupBy("a_line_id", "b_line_id").agg(F.count("*").alias("hit")).join(n, "a_line_id").withColumn("share", F.col("hit") / F.col("n"))
    m = s.groupBy("a_line_id").agg(F.max(F.struct("share", (-F.col("b_line_id")).alias("neg"))).alias("m"))
    return m.select(F.col("a_line_id").alias("line_id"), (-F.col("m.neg")).alias("ref_id"), F.col("m.share").alias("share"))


def segment_label(share_a: Column, share_b: Column, least: float = 0.6) -> Column:
    """'a' if enough of a line is near references of that kind and more than of the other, else 'b' if enough, else null."""
    return F.when((share_a >= least) & (share_a > share_b), "a").when(share_b >= least, "b")


def raster_along(points: DataFrame, cells: DataFrame, cell: float, value: str = "z") -> DataFrame:
    """Raster value at the cell of each point (line_id, x, y), by an equi-join; mean, least and greatest a line."""
    p = points.withColumns({"row": F.floor(F.col("y") / cell), "col": F.floor(F.col("x") / cell)})
    j = p.join(cells.select("row", "col", value), ["row", "col"], "left")
    return j.groupBy("line_id").agg(F.count(value).alias("n_hit"), F.avg(value).alias("v_mean"), F.min(value).alias("v_min"), F.max(value).alias("v_max"))


def cross_profiles(lines: DataFrame, step: float, offsets: list[float]) -> DataFrame:
    """Points on perpendiculars of two-point lines (id, ax, ay, bx, by) every `step` metres: id, k, offset, x, y."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.sqrt(dx * dx + dy * dy)
    d = lines.withColumns({"len": n, "ux": dx / n, "uy": dy / n}).where("len > 0")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("len") / step).cast("int")))).withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    return d.select("id", "k", "offset", (F.col("ax") + F.col("ux") * F.col("k") * step - F.col("uy") * F.col("offset")).alias("x"), (F.col("ay") + F.col("uy") * F.col("k") * step + F.col("ux") * F.col("offset")).alias("y"))


def profile_contrast(samples: DataFrame, core: float, ring: float) -> DataFrame:
    """samples: id, k, offset, v. Per profile the means of the core and of each side within the ring, and the two-sided
    contrast: the smaller difference where both sides agree in sign, else 0. Per line their medians."""
    o = F.col("offset")
    parts = samples.groupBy("id", "k").agg(
        F.avg(F.when(F.abs(o) <= core, F.col("v"))).alias("c"), F.avg(F.when((o < -core) & (o >= -ring), F.col("v"))).alias("l"), F.avg(F.when((o > core) & (o <= ring), F.col("v"))).alias("r")
    )
    a, b = F.col("c") - F.col("l"), F.col("c") - F.col("r")
    two = F.when(F.signum(a) == F.signum(b), F.signum(a) * F.least(F.abs(a), F.abs(b))).otherwise(F.lit(0.0))
    return parts.withColumn("two", two).groupBy("id").agg(F.percentile("two", 0.5).alias("contrast"), F.count("*").alias("n_profiles"))


def lowest_offset(samples: DataFrame) -> DataFrame:
    """Per profile the offset of the lowest value (ties: nearest to the middle, then left)."""
    m = samples.where("v is not null").groupBy("id", "k").agg(F.min(F.struct("v", F.abs("offset").alias("far"), "offset")).alias("m"))
    return m.select("id", "k", F.col("m.offset").alias("offset"), F.col("m.v").alias("v"))


def run_lengths(cells: DataFrame, flag: str) -> DataFrame:
    """Mask as runs: row, first and last column of each stretch of flagged cells."""
    w = Window.partitionBy("row").orderBy("col")
    own = cells.where(F.col(flag)).withColumn("__g", F.col("col") - F.row_number().over(w))
    return own.groupBy("row", "__g").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col")).drop("__g")


def split_at(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """lines: id, length. cuts: id, at. Pieces between the cuts: id, piece, from_m, to_m."""
    inner = cuts.join(lines.select("id", "length"), "id").where("at > 0 and at < length").select("id", "at").distinct()
    stops = inner.unionByName(lines.select("id", F.lit(0.0).alias("at"))).unionByName(lines.select("id", F.col("length").alias("at")))
    w = Window.partitionBy("id").orderBy("at")
    p = stops.select("id", F.col("at").alias("from_m"), F.lead("at").over(w).alias("to_m"), (F.row_number().over(w) - 1).alias("piece"))
    return p.where("to_m > from_m").select("id", "piece", "from_m", "to_m")


def even_pieces(lines: DataFrame, longest: float) -> DataFrame:
    """Lines cut into equal pieces of at most `longest`: id, piece, from_m, to_m."""
    n = F.greatest(F.ceil(F.col("length") / longest), F.lit(1)).cast("int")
    p = lines.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return p.select("id", "piece", (F.col("length") * F.col("piece") / F.col("n")).alias("from_m"), (F.col("length") * (F.col("piece") + 1) / F.col("n")).alias("to_m"))


def ponds(cells: DataFrame, cell: float, least_depth: float, least_area: float) -> DataFrame:
    """cells: row, col, pond, depth, area (upstream), to_pond (pond of the downstream cell, null none). Per pond its area,
    volume, depth and outlet: the cell with the largest upstream area that drains out of it (ties: row, column)."""
    own = cells.where((F.col("depth") > least_depth) & F.col("pond").isNotNull())
    leaves = ~F.col("pond").eqNullSafe(F.col("to_pond"))
    out = F.max(F.when(leaves, F.struct("area", (-F.col("row")).alias("r"), (-F.col("col")).alias("c")))).alias("m")
    a = own.groupBy("pond").agg(F.count("*").alias("n"), F.sum("depth").alias("d"), F.max("depth").alias("max_depth"), out)
    a = a.select("pond", (F.col("n") * cell * cell).alias("area_m2"), (F.col("d") * cell * cell).alias("volume_m3"), "max_depth", (-F.col("m.r")).alias("outlet_row"), (-F.col("m.c")).alias("outlet_col"), F.col("m.area").alias("outlet_area"))
    return a.where(F.col("area_m2") >= least_area)


def pond_status(outlets: DataFrame, candidates: DataFrame, reach: float) -> DataFrame:
    """closed without an outlet, else by whether a candidate lies within reach of it."""
    known = outlets.where("outlet_row is not null").select(F.col("pond").alias("id"), F.col("outlet_col").cast("double").alias("x"), F.col("outlet_row").cast("double").alias("y"))
    n = near_pairs(known, candidates.select("id", "x", "y"), reach).groupBy(F.col("a_id").alias("pond")).agg(F.count("*").alias("n_candidates"))
    s = outlets.join(n, "pond", "left").fillna({"n_candidates": 0})
    return s.withColumn("status", F.when(F.col("outlet_row").isNull(), "closed").when(F.col("n_candidates") > 0, "inflow_candidate_at_outlet").otherwise("inflow_no_candidate"))


def choose_outlet(kinds: DataFrame, order: tuple[str, ...] = ("coast", "band", "coverage", "lowest")) -> DataFrame:
    """Nodes (id, kind, z) of the first kind in order that occurs; of `lowest` only the lowest node (ties: id)."""
    place = F.lit(len(order))
    for i, k in reversed(list(enumerate(order))):
        place = F.when(F.col("kind") == k, F.lit(i)).otherwise(place)
    d = kinds.withColumn("__p", place).where(F.col("__p") < len(order))
    first = d.agg(F.min("__p").alias("__m"))
    d = d.join(F.broadcast(first), F.col("__p") == F.col("__m")).drop("__p", "__m")  # one row
    lowest = d.where(F.col("kind") == "lowest").orderBy("z", "id").limit(1)
    return d.where(F.col("kind") != "lowest").unionByName(lowest)


def sampled_hausdorff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest distance from a point of either line to the other's nearest point, for pairs of lines with the same key:
    key, x, y on both sides. Lines are bounded point lists, so a key's pairs are too."""
    p = a.select("key", F.col("x").alias("ax"), F.col("y").alias("ay")).join(b.select("key", F.col("x").alias("bx"), F.col("y").alias("by")), "key")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    p = p.withColumn("d", d)
    one = p.groupBy("key", "ax", "ay").agg(F.min("d").alias("m")).groupBy("key").agg(F.max("m").alias("a"))
    two = p.groupBy("key", "bx", "by").agg(F.min("d").alias("m")).groupBy("key").agg(F.max("m").alias("b"))
    return one.join(two, "key").select("key", F.greatest("a", "b").alias("distance"))


def box_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of box a that lies in box b."""
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.when((w > 0) & (h > 0), w * h / ((a["xmax"] - a["xmin"]) * (a["ymax"] - a["ymin"]))).otherwise(F.lit(0.0))
