"""Moving windows and map algebra on raster cells (row, col, z; optionally a tile key).

A square window is separable: a frame along the columns of each row, then one along the rows of each column. Frames are
range frames on the cell index, so missing cells leave a gap instead of shifting the window. Each pass shuffles by (tile, row)
or (tile, column), so a task holds one line of a tile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells_across(metres: float, cell: float) -> int:
    """A window size in metres as an odd number of cells: rounded half to even, at least 3, even numbers made odd."""
    n = max(round(metres / cell), 3)
    return n + (1 - n % 2)


def _line(keys: list[str], order: str, r: int, r2: int | None = None):
    return Window.partitionBy(*keys).orderBy(order).rangeBetween(-r, r if r2 is None else r2)


def separable(cells: DataFrame, f: Callable[[str], Column], n: int, value: str = "z", out: str = "v", tile: tuple[str, ...] = ()) -> DataFrame:
    """Aggregate f over n x n windows by two one-dimensional passes (least, greatest and sum allow that)."""
    r = n // 2
    once = cells.withColumn("__h", f(value).over(_line([*tile, "row"], "col", r)))
    return once.withColumn(out, f("__h").over(_line([*tile, "col"], "row", r))).drop("__h")


def opening(cells: DataFrame, n: int, value: str = "z", out: str = "v", tile: tuple[str, ...] = ()) -> DataFrame:
    low = separable(cells, F.min, n, value, "__low", tile)
    return separable(low, F.max, n, "__low", out, tile).drop("__low")


def closing(cells: DataFrame, n: int, value: str = "z", out: str = "v", tile: tuple[str, ...] = ()) -> DataFrame:
    high = separable(cells, F.max, n, value, "__high", tile)
    return separable(high, F.min, n, "__high", out, tile).drop("__high")


def white_tophat(cells: DataFrame, n: int, value: str = "z", tile: tuple[str, ...] = ()) -> DataFrame:
    """Height above the opening: raised features narrower than the window."""
    return opening(cells, n, value, "__v", tile).withColumn("white", F.col(value) - F.col("__v")).drop("__v")


def black_tophat(cells: DataFrame, n: int, value: str = "z", tile: tuple[str, ...] = ()) -> DataFrame:
    """Depth below the closing: sunk features narrower than the window."""
    return closing(cells, n, value, "__v", tile).withColumn("black", F.col("__v") - F.col(value)).drop("__v")


def box(cells: DataFrame, n: int, value: str = "z", out: str = "v", tile: tuple[str, ...] = ()) -> DataFrame:
    """Sum and number of the cells in n x n windows, as <out>_sum and <out>_n."""
    a = separable(cells, F.sum, n, value, f"{out}_sum", tile)
    return separable(a.withColumn("__one", F.when(F.col(value).isNotNull(), 1)), F.sum, n, "__one", f"{out}_n", tile).drop("__one")


def ring_contrast(cells: DataFrame, inner: int, outer: int, value: str = "z", tile: tuple[str, ...] = ()) -> DataFrame:
    """The value minus the mean of the square ring between the two windows."""
    a = box(box(cells, inner, value, "__i", tile), outer, value, "__o", tile)
    n = F.col("__o_n") - F.col("__i_n")
    ring = F.when(n > 0, (F.col("__o_sum") - F.col("__i_sum")) / n)
    return a.withColumn("sharp", F.col(value) - ring).drop("__i_sum", "__i_n", "__o_sum", "__o_n")


def neighbours(cells: DataFrame, value: str = "z", tile: tuple[str, ...] = ()) -> DataFrame:
    """The eight neighbours' values as columns n (up), s, w, e, nw, ne, sw, se; null beyond the edge or at a gap."""
    def at(column: str, keys: list[str], order: str, step: int) -> Column:
        return F.max(column).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(step, step))

    rows = [*tile, "row"]
    wide = cells.withColumns({"w": at(value, rows, "col", -1), "e": at(value, rows, "col", 1)})
    cols = [*tile, "col"]
    return wide.withColumns({
        "n": at(value, cols, "row", -1), "s": at(value, cols, "row", 1), "nw": at("w", cols, "row", -1), "ne": at("e", cols, "row", -1),
        "sw": at("w", cols, "row", 1), "se": at("e", cols, "row", 1),
    })


EIGHT = ("n", "ne", "e", "se", "s", "sw", "w", "nw")
STEPS = {"n": (-1, 0), "ne": (-1, 1), "e": (0, 1), "se": (1, 1), "s": (1, 0), "sw": (1, -1), "w": (0, -1), "nw": (-1, -1)}


def boundary(cells: DataFrame, value: str = "z", tile: tuple[str, ...] = ()) -> DataFrame:
    """Valid cells with a missing neighbour: the places where water can leave."""
    around = sum((F.col(k).isNotNull().cast("int") for k in EIGHT), F.lit(0))
    return neighbours(cells, value, tile).withColumn("n_near", around).where(F.col(value).isNotNull()).withColumn("outlet", F.col("n_near") < 8).drop(*EIGHT)


def steepest(cells: DataFrame, value: str = "z", cell: float = 1.0, tile: tuple[str, ...] = ()) -> DataFrame:
    """Steepest-descent neighbour among eight: drow, dcol and drop (per metre); null at a pit. Ties go clockwise from north."""
    wide = neighbours(cells, value, tile)
    offers = []
    for i, k in enumerate(EIGHT):
        dr, dc = STEPS[k]
        far = cell * (2**0.5 if dr and dc else 1.0)
        offers.append(F.struct(((F.col(value) - F.col(k)) / F.lit(far)).alias("drop"), F.lit(-i).alias("order"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")))
    best = F.array_max(F.filter(F.array(*offers), lambda s: s["drop"] > 0))
    return wide.withColumn("__b", best).select(*cells.columns, F.col("__b.dr").alias("drow"), F.col("__b.dc").alias("dcol"), F.col("__b.drop").alias("drop"))


def slope(cells: DataFrame, value: str = "z", cell: float = 1.0, tile: tuple[str, ...] = ()) -> DataFrame:
    """Central differences (one-sided at edges): gx east, gy south, and slope, their length."""
    wide = neighbours(cells, value, tile)
    z = F.col(value)

    def diff(a: str, b: str) -> Column:
        both = (F.col(b) - F.col(a)) / (2 * cell)
        return F.coalesce(both, (F.col(b) - z) / cell, (z - F.col(a)) / cell)

    g = wide.withColumns({"gx": diff("w", "e"), "gy": diff("n", "s")}).drop(*EIGHT)
    return g.withColumn("slope", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def hillshade(cells: DataFrame, value: str = "z", cell: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, tile: tuple[str, ...] = ()) -> DataFrame:
    """Shade from 0 to 1 of a surface lit from azimuth (clockwise from north) and altitude, in degrees."""
    import math

    az, alt = math.radians(azimuth), math.radians(altitude)
    s = slope(cells, value, cell, tile)
    # light vector (east, south, up) times the normal (-gx, -gy, 1)
    lx, ly, lz = math.sin(az) * math.cos(alt), -math.cos(az) * math.cos(alt), math.sin(alt)
    dot = (F.lit(lz) - F.lit(lx) * F.col("gx") - F.lit(ly) * F.col("gy")) / F.sqrt(F.lit(1.0) + F.col("slope") * F.col("slope"))
    return s.withColumn("shade", F.greatest(dot, F.lit(0.0)))


def slope_gate(cells: DataFrame, strong: Column, limit: float, area: Column, least_area: float) -> DataFrame:
    """Keep threshold cells; steep ones only with enough upstream area. Needs the slope column."""
    return cells.withColumn("kept", strong & ((F.col("slope") <= limit) | (area >= least_area)))


def line_likeness(l1: Column, l2: Column) -> Column:
    """From eigenvalues with |l1| the larger: 0 unless l1 < 0, else how one-sided the curvature is, times its strength."""
    share = F.greatest(F.abs(l1) - F.abs(l2), F.lit(0.0)) / (F.abs(l1) + F.abs(l2) + F.lit(1e-12))
    return F.when(l1 < 0, share * F.abs(l1)).otherwise(F.lit(0.0))


def eigenvalues(zxx: Column, zxy: Column, zyy: Column) -> tuple[Column, Column]:
    """Of a symmetric 2 x 2 matrix: the one with the larger absolute value first."""
    half, disc = (zxx + zyy) / 2, F.sqrt((zxx - zyy) * (zxx - zyy) / 4 + zxy * zxy)
    a, b = half + disc, half - disc
    return F.when(F.abs(a) >= F.abs(b), a).otherwise(b), F.when(F.abs(a) >= F.abs(b), b).otherwise(a)


def block_mean(cells: DataFrame, k: int, least_share: float = 0.5, value: str = "z", tile: tuple[str, ...] = ()) -> DataFrame:
    """Mean of valid cells per k x k block, null where fewer than the share are valid; columns brow, bcol."""
    b = cells.groupBy(*tile, F.floor(F.col("row") / k).alias("brow"), F.floor(F.col("col") / k).alias("bcol"))
    return b.agg(F.count(value).alias("n_valid"), F.when(F.count(value) >= least_share * k * k, F.avg(value)).alias("v"))


def block_mode(cells: DataFrame, k: int, value: str, none: int = -1, tile: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent value per block, ties to the smallest, `none` ignored and given where nothing else is there."""
    keys = [*tile, "brow", "bcol"]
    own = cells.withColumns({"brow": F.floor(F.col("row") / k), "bcol": F.floor(F.col("col") / k)})
    counts = own.where((F.col(value) != none) & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(value)).alias("neg"))).alias("m")).select(*keys, (-F.col("m.neg")).alias("v"))
    return own.select(*keys).distinct().join(best, keys, "left").fillna({"v": none})


def block_min_burnt(cells: DataFrame, burns: DataFrame, k: int, value: str = "z") -> DataFrame:
    """Least of (value - deepest burn) per block. burns: row, col, depth; several on a cell count by the deepest."""
    deepest = burns.groupBy("row", "col").agg(F.greatest(F.max("depth"), F.lit(0.0)).alias("burn"))
    low = cells.join(deepest, ["row", "col"], "left").withColumn("__low", F.col(value) - F.coalesce("burn", F.lit(0.0)))
    return low.groupBy(F.floor(F.col("row") / k).alias("brow"), F.floor(F.col("col") / k).alias("bcol")).agg(F.min("__low").alias("v"))


def decimate_any(cells: DataFrame, k: int, flag: str) -> DataFrame:
    """Blocks that hold any flagged cell."""
    hit = cells.groupBy(F.floor(F.col("row") / k).alias("brow"), F.floor(F.col("col") / k).alias("bcol")).agg(F.max(F.col(flag).cast("int")).alias("any"))
    return hit.withColumn("any", F.col("any") == 1)


def bilinear(points: DataFrame, cells: DataFrame, value: str = "z") -> DataFrame:
    """Value at fractional (r, c) from the four cells around; null unless all four have one. points: id, r, c."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    p = points.select("id", "r", "c", corner.alias("k")).select(
        "id", (F.floor("r") + F.col("k.i")).alias("row"), (F.floor("c") + F.col("k.j")).alias("col"),
        (F.abs(1 - F.col("k.i") - (F.col("r") - F.floor("r"))) * F.abs(1 - F.col("k.j") - (F.col("c") - F.floor("c")))).alias("w"),
    )
    got = p.join(cells.select("row", "col", value), ["row", "col"])
    s = got.groupBy("id").agg(F.count(value).alias("n"), F.sum(F.col("w") * F.col(value)).alias("s"))
    return points.join(s, "id", "left").select(*points.columns, F.when(F.col("n") == 4, F.col("s")).alias("v"))


def rem_blocks(channel: DataFrame, k: int, value: str = "z", q: float = 0.25) -> DataFrame:
    """Low quantile of channel elevations per block at the mean position of its cells: x (col), y (row), v."""
    return channel.groupBy(F.floor(F.col("row") / k).alias("brow"), F.floor(F.col("col") / k).alias("bcol")).agg(
        F.percentile(value, q).alias("v"), F.avg("row").alias("y"), F.avg("col").alias("x"), F.count("*").alias("n")
    )


def idw(points: DataFrame, samples: DataFrame, cap: float, k: int = 12, power: float = 1.0) -> DataFrame:
    """Inverse-distance mean of the k nearest samples (id, x, y, v) within cap; a sample at the point itself decides."""
    from .near import k_nearest

    near = k_nearest(points.select("id", "x", "y"), samples.select("id", "x", "y", "v"), cap, k)
    w = F.lit(1.0) / F.pow(F.greatest(F.col("dist"), F.lit(1e-9)), F.lit(power))
    s = near.groupBy(F.col("a_id").alias("id")).agg(
        F.sum(w * F.col("b_v")).alias("sw"), F.sum(w).alias("w"), F.max(F.when(F.col("dist") == 0, F.col("b_v"))).alias("exact"), F.count("*").alias("n_near")
    )
    return points.join(s, "id", "left").select(*points.columns, "n_near", F.coalesce("exact", F.col("sw") / F.col("w")).alias("v"))


def first_wins(cells: DataFrame, rank: str, value: str = "z") -> DataFrame:
    """Overlapping rasters in priority order: each cell's first valid value and the rank it came from (-1: none)."""
    best = cells.groupBy("row", "col").agg(F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(rank).alias("k"), F.col(value).alias("v")))).alias("m"))
    return best.select("row", "col", F.col("m.v").alias(value), F.coalesce(F.col("m.k"), F.lit(-1)).alias("source"))


def taper_blend(windows: DataFrame, size: int) -> DataFrame:
    """Overlapping windows (wid, row, col, i, j, p; i and j inside the window) blended with squared-sine weights."""
    import math

    def weight(c: str) -> Column:
        s = F.sin((F.col(c) + F.lit(0.5)) * F.lit(math.pi / size))
        return s * s

    w = weight("i") * weight("j")
    return windows.groupBy("row", "col").agg((F.sum(w * F.col("p")) / F.sum(w)).alias("p"), F.count("*").alias("n_windows"))


def quantise(p: Column) -> Column:
    """Probability to 0..250, 255 for none."""
    return F.when(p.isNotNull(), F.least(F.greatest(F.bround(p * 250), F.lit(0)), F.lit(250))).otherwise(F.lit(255)).cast("short")


def dequantise(q: Column) -> Column:
    return F.when(q <= 250, q / F.lit(250.0))
