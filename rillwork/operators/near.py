"""Distance joins between point tables: grid bins turn them into equi-joins, an exact distance test follows.

Tables have columns id, x, y (metres in one plane) and any others. The side `b` is copied to the nine bins around it, so put
the smaller table there. A crowded bin is a hot join key; adaptive execution splits it, since both sides are plain shuffles.
A row with a null or non-finite coordinate has no bin and joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size)))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _around(c: Column, size: float) -> Column:
    k = bin_of(c, size)
    return F.sequence(k - 1, k + 1)


def near_pairs(a: DataFrame, b: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """All pairs within `radius` (inclusive unless strict): columns of a prefixed a_, of b prefixed b_, and dist."""
    left = a.select(*[F.col(f"`{c}`").alias(f"a_{c}") for c in a.columns])
    left = left.withColumns({"__bx": bin_of(F.col("a_x"), radius), "__by": bin_of(F.col("a_y"), radius)})
    right = b.select(*[F.col(f"`{c}`").alias(f"b_{c}") for c in b.columns])
    right = right.withColumn("__bx", F.explode(_around(F.col("b_x"), radius))).withColumn("__by", F.explode(_around(F.col("b_y"), radius)))
    d = distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    joined = left.join(right, ["__bx", "__by"]).drop("__bx", "__by").withColumn("dist", d)
    return joined.where(F.col("dist") < radius if strict else F.col("dist") <= radius)


def self_pairs(a: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Unordered pairs of one table within `radius`, a_id < b_id."""
    return near_pairs(a, a, radius, strict).where("a_id < b_id")


def near_semi(a: DataFrame, b: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Rows of a with any row of b within the radius."""
    hit = near_pairs(a.select("id", "x", "y"), b.select("id", "x", "y"), radius, strict).select(F.col("a_id").alias("id")).distinct()
    return a.join(hit, "id", "left_semi")


def near_anti(a: DataFrame, b: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Rows of a without a row of b within the radius."""
    hit = near_pairs(a.select("id", "x", "y"), b.select("id", "x", "y"), radius, strict).select(F.col("a_id").alias("id")).distinct()
    return a.join(hit, "id", "left_anti")


def nearest(a: DataFrame, b: DataFrame, cap: float, attributes: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Every row of a with its nearest row of b within `cap`: near_id, near_dist and near_<attribute>, null if none.

    Ties go to the lowest id of b. Only the least struct is kept per row, before the shuffle.
    """
    pairs = near_pairs(a.select("id", "x", "y"), b.select("id", "x", "y", *attributes), cap, strict)
    best = pairs.groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct("dist", "b_id", *[f"b_{c}" for c in attributes])).alias("m"))
    named = best.select("id", F.col("m.b_id").alias("near_id"), F.col("m.dist").alias("near_dist"), *[F.col(f"m.b_{c}").alias(f"near_{c}") for c in attributes])
    return a.join(named, "id", "left")


def k_nearest(a: DataFrame, b: DataFrame, cap: float, k: int) -> DataFrame:
    """Pairs of each row of a with its k nearest rows of b within `cap`, with rank from 1."""
    order = Window.partitionBy("a_id").orderBy("dist", "b_id")
    return near_pairs(a, b, cap).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def count_within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Every row of a with the number of rows of b within the radius."""
    n = near_pairs(a.select("id", "x", "y"), b.select("id", "x", "y"), radius).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n_near"))
    return a.join(n, "id", "left").fillna({"n_near": 0})


def disk_stats(a: DataFrame, b: DataFrame, value: str, radius: float) -> DataFrame:
    """Per row of a: greatest, least and mean of b's value within the radius (nulls ignored)."""
    pairs = near_pairs(a.select("id", "x", "y"), b.select("id", "x", "y", value), radius)
    v = F.col(f"b_{value}")
    s = pairs.groupBy(F.col("a_id").alias("id")).agg(F.max(v).alias("v_max"), F.min(v).alias("v_min"), F.avg(v).alias("v_mean"), F.count(v).alias("v_n"))
    return a.join(s, "id", "left").fillna({"v_n": 0})


def facing_pairs(ends: DataFrame, reach: float, least_cos: float) -> DataFrame:
    """Unordered pairs of line ends (id, x, y, dx, dy) that point at each other within `reach`.

    An end faces another if the cosine of its direction with the way to the other is at least `least_cos`; both must.
    """
    p = self_pairs(ends, reach)
    wx, wy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    cos_a = (F.col("a_dx") * wx + F.col("a_dy") * wy) / (F.sqrt(F.col("a_dx") * F.col("a_dx") + F.col("a_dy") * F.col("a_dy")) * F.col("dist"))
    cos_b = -(F.col("b_dx") * wx + F.col("b_dy") * wy) / (F.sqrt(F.col("b_dx") * F.col("b_dx") + F.col("b_dy") * F.col("b_dy")) * F.col("dist"))
    return p.where((F.col("dist") > 0) & (cos_a >= least_cos) & (cos_b >= least_cos)).withColumns({"cos_a": cos_a, "cos_b": cos_b})


def local_axis(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Direction of the main axis of b's points around each row of a, in degrees from 0 to 180, from population moments."""
    p = near_pairs(a.select("id", "x", "y"), b.select("id", "x", "y"), radius)
    m = p.groupBy(F.col("a_id").alias("id")).agg(
        F.covar_pop("b_x", "b_y").alias("cxy"), F.var_pop("b_x").alias("cxx"), F.var_pop("b_y").alias("cyy"), F.count("*").alias("n_axis")
    )
    angle = F.degrees(F.lit(0.5) * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy")))
    return a.join(m.select("id", "n_axis", F.pmod(angle, F.lit(180.0)).alias("axis_deg")), "id", "left")
