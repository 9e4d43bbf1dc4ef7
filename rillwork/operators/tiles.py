"""Running tile kernels over rasters of any extent.

Cells are dealt to tiles of a fixed number of cells, with a halo of neighbours' cells copied in; a kernel sees a dense array
and returns rows for its core. Tiles are bounded, so a task's memory is too, whatever the raster's size. Tile keys also carry
the raster's own key, so many rasters run side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from . import kernels

Kernel = Callable[[np.ndarray], dict[str, np.ndarray]]


def tile_of(c: str, size: int) -> Column:
    """The tile of a row or column, in whole numbers: a double would put large ones into the wrong tile."""
    return F.expr(f"`{c}` div {size}") - F.when(F.pmod(F.col(c), F.lit(size)) != F.col(c) % size, 1).otherwise(0)


def with_halo(cells: DataFrame, size: int, halo: int) -> DataFrame:
    """Each cell once for its own tile and once for each tile whose halo it lies in: tr, tc, row, col, core and the rest."""
    if halo >= size:
        raise ValueError("the halo must be smaller than the tile")

    def tiles(c: str):
        k, at = tile_of(c, size), F.pmod(F.col(c), F.lit(size))
        return F.filter(F.array(k, F.when(at < halo, k - 1), F.when(at >= size - halo, k + 1)), lambda v: v.isNotNull())

    wide = cells.withColumn("tr", F.explode(tiles("row"))).withColumn("tc", F.explode(tiles("col")))
    core = (tile_of("row", size) == F.col("tr")) & (tile_of("col", size) == F.col("tc"))
    return wide.withColumn("core", core)


def run(cells: DataFrame, kernel: Kernel, outputs: dict[str, str], size: int = 512, halo: int = 32, value: str = "z", key: tuple[str, ...] = ()) -> DataFrame:
    """The kernel's output arrays as columns (name to type) of the core cells."""
    ship_package(cells.sparkSession)
    keys = [*key, "tr", "tc"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        r, c = (pdf["row"] - r0).to_numpy(), (pdf["col"] - c0).to_numpy()
        z = np.full((r.max() + 1, c.max() + 1), np.nan)
        z[r, c] = pdf[value].to_numpy(dtype=float)
        got = kernel(z)
        keep = pdf["core"].to_numpy()
        out = {k: pdf[k][keep] for k in key} | {"row": pdf["row"][keep], "col": pdf["col"][keep]}
        for name in outputs:
            out[name] = got[name][r[keep], c[keep]]
        return pd.DataFrame(out)

    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    ddl = ", ".join([*(f"{k} {types[k]}" for k in key), f"row {types['row']}", f"col {types['col']}", *(f"{n} {t}" for n, t in outputs.items())])
    return with_halo(cells.select(*key, "row", "col", value), size, halo).groupBy(*keys).applyInPandas(work, ddl)


def per_tile(cells: DataFrame, work: Callable[[np.ndarray, int, int], list[dict]], ddl: str, size: int = 512, halo: int = 32, value: str = "z") -> DataFrame:
    """Rows that a kernel makes of a whole tile; it gets the array and the row and column of its corner."""
    ship_package(cells.sparkSession)
    names = [x.strip().split(" ")[0] for x in ddl.split(",")]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        r, c = (pdf["row"] - r0).to_numpy(), (pdf["col"] - c0).to_numpy()
        z = np.full((r.max() + 1, c.max() + 1), np.nan)
        z[r, c] = pdf[value].to_numpy(dtype=float)
        return pd.DataFrame(work(z, r0, c0), columns=names)

    return with_halo(cells.select("row", "col", value), size, halo).groupBy("tr", "tc").applyInPandas(group, ddl)


def distance(cells: DataFrame, cap: int, size: int = 512) -> DataFrame:
    """cells: row, col, hit. Every row with dist, the distance in cells to the nearest cell that is hit, infinite beyond the
    cap. A cell given more than once is hit if one of its rows is, and stays as many rows; one without row or column is far
    from all others. Repeats are counted before the tiles, so a tile stays bounded, and only hit cells are copied to halos."""
    ship_package(cells.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in cells.schema}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = (pdf["row"] - pdf["row"].min()).to_numpy(), (pdf["col"] - pdf["col"].min()).to_numpy()
        mask = np.zeros((r.max() + 1, c.max() + 1), bool)
        mask[r, c] = pdf["hit"].to_numpy(dtype=bool)
        own = pdf["core"].to_numpy(dtype=bool)
        return pd.DataFrame({k: pdf[k][own] for k in ("row", "col", "n")} | {"dist": kernels.nearest(mask, cap)[0][r[own], c[own]]})

    placed = F.col("row").isNotNull() & F.col("col").isNotNull()
    once = cells.where(placed).groupBy("row", "col").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("hit"), F.count("*").cast("int").alias("n"))
    dealt = with_halo(once, size, cap + 1).where("core or hit").groupBy("tr", "tc")
    near = dealt.applyInPandas(work, f"row {types['row']}, col {types['col']}, n int, dist double")
    every = near.select("row", "col", "dist", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("k")).select("row", "col", "dist")
    return every.unionByName(cells.where(~placed).select("row", "col", F.lit(float("inf")).alias("dist")))


def feature_stack(cells: DataFrame, cell: float = 1.0, size: int = 512, halo: int = 48) -> DataFrame:
    """Relief, top-hats, curvature and openness bands; no data is filled from the nearest cell and masked again."""
    from ..config import Terrain
    from .focal import cells_across

    p = Terrain()
    names = [f"relief_{m:g}" for m in p.relief_windows_m] + [f"{k}_{m:g}" for m in p.tophat_windows_m for k in ("white", "black")]
    names += [f"{k}_{m:g}" for m in p.curvature_sigmas_m for k in ("valley", "ridge")] + ["open_up", "open_down"]

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        gone, f = np.isnan(z), kernels.fill_nodata(z)
        out = {f"relief_{m:g}": kernels.median_relief(f, cells_across(m, cell)) for m in p.relief_windows_m}
        for m in p.tophat_windows_m:
            n = cells_across(m, cell)
            out[f"white_{m:g}"], out[f"black_{m:g}"] = kernels.opening_height(f, n), kernels.closing_depth(f, n)
        for m in p.curvature_sigmas_m:
            a, b = kernels.hessian(f, m, cell)
            out[f"valley_{m:g}"], out[f"ridge_{m:g}"] = np.maximum(a, 0), np.maximum(-b, 0)
        out["open_up"], out["open_down"] = kernels.openness(f, p.sky_radius_m, cell, p.sky_rays)
        return {k: np.where(gone, np.nan, v) for k, v in out.items()}

    return run(cells, kernel, dict.fromkeys(names, "double"), size, halo)


def merge_labels(labelled: DataFrame, size: int, eight: bool = True) -> DataFrame:
    """Component ids of whole rasters from labels of halo-free tiles: row, col, tr, tc, label (0 none). Labels of cells that
    touch across a tile edge are joined, and each cell gets the least id of its component."""
    from .graph import components

    own = labelled.where("label > 0").withColumn("id", (F.col("tr") * F.lit(1 << 24) + F.col("tc")) * F.lit(1 << 24) + F.col("label"))
    at = lambda c: F.pmod(F.col(c), F.lit(size))
    border = own.where((at("row") == 0) | (at("row") == size - 1) | (at("col") == 0) | (at("col") == size - 1)).select("row", "col", "id")
    ways = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ways]))
    moved = border.withColumn("k", step).select((F.col("row") + F.col("k.a")).alias("row"), (F.col("col") + F.col("k.b")).alias("col"), F.col("id").alias("u"))
    edges = moved.join(border.select("row", "col", F.col("id").alias("v")), ["row", "col"]).where("u <> v").select("u", "v").distinct()
    names = components(own.select("id").distinct(), edges)
    return own.select("row", "col", "id").join(names, "id").select("row", "col", F.col("label").alias("component"))


def parts(mask: DataFrame, size: int = 512, eight: bool = True) -> DataFrame:
    """mask: row, col, hit. The cells that are hit with the component of the whole raster that each is in."""

    def work(z: np.ndarray, r: int, c: int) -> list[dict]:
        lab = kernels.label(z > 0.5, eight)
        return [{"row": r + int(i), "col": c + int(j), "tr": (r + int(i)) // size, "tc": (c + int(j)) // size, "label": int(lab[i, j])} for i, j in np.argwhere(lab > 0)]

    cells = mask.select("row", "col", F.when(F.col("hit"), 1.0).otherwise(0.0).alias("z"))
    lab = per_tile(cells, work, "row long, col long, tr long, tc long, label long", size, 0)
    return materialize(merge_labels(materialize(lab, "labels"), size, eight), "parts")


def _marked(cells: DataFrame, found: DataFrame, name: str) -> DataFrame:
    hit = found.select("row", "col", F.lit(True).alias(name))
    return cells.select("row", "col").join(hit, ["row", "col"], "left").select("row", "col", F.coalesce(name, F.lit(False)).alias(name))


def hysteresis(cells: DataFrame, weak: str, strong: str, size: int = 512) -> DataFrame:
    """row, col, kept: cells where `weak` holds (SQL tests) in eight-connected parts that hold a strong cell."""
    both = cells.select("row", "col", F.coalesce(F.expr(f"({weak}) or ({strong})"), F.lit(False)).alias("hit"))
    comp = parts(both, size)
    good = comp.join(cells.where(strong).select("row", "col"), ["row", "col"]).select("component").distinct()
    return _marked(cells, comp.join(good, "component", "left_semi"), "kept")


def drop_small(cells: DataFrame, test: str, least: int, size: int = 512, eight: bool = True) -> DataFrame:
    """row, col, kept: cells where the SQL test holds in parts of `least` cells or more."""
    comp = parts(cells.select("row", "col", F.coalesce(F.expr(test), F.lit(False)).alias("hit")), size, eight)
    good = comp.groupBy("component").count().where(F.col("count") >= least)
    return _marked(cells, comp.join(good, "component", "left_semi"), "kept")


def fill(cells: DataFrame, size: int = 512) -> DataFrame:
    """row, col, z, filled: every cell raised to the lowest level at which it drains to the raster's edge or no data (null there).

    Tiles are flooded from their outlets and from the levels that the cells around them have so far; levels only fall, and
    the rounds end when none does, so the surface is that of the whole raster. There are as many rounds as tiles that the
    longest spill path crosses, and one more."""
    ship_package(cells.sparkSession)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = (pdf["row"] - pdf["row"].min()).to_numpy(), (pdf["col"] - pdf["col"].min()).to_numpy()
        shape = r.max() + 1, c.max() + 1
        z, level, core = np.full(shape, np.nan), np.full(shape, np.inf), np.zeros(shape, bool)
        z[r, c], level[r, c], core[r, c] = pdf["z"].to_numpy(dtype=float), pdf["filled"].to_numpy(dtype=float), pdf["core"].to_numpy()
        # a core cell at the array's edge has no neighbours beyond, so it is at the raster's edge
        new = kernels.flood_from(z, np.where(kernels.outlets(z) & core, z, level))
        own = pdf["core"].to_numpy()
        got, before = new[r[own], c[own]], pdf["filled"].to_numpy(dtype=float)[own]
        return pd.DataFrame({"row": pdf["row"][own], "col": pdf["col"][own], "z": pdf["z"][own], "filled": got, "fell": got < before})

    state = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"), F.lit(float("inf")).alias("filled"))
    while True:
        dealt = with_halo(state.select("row", "col", "z", "filled"), size, 1)
        state = materialize(dealt.groupBy("tr", "tc").applyInPandas(work, "row long, col long, z double, filled double, fell boolean"), "fill")
        if state.where("fell").isEmpty():
            return state.select("row", "col", "z", "filled")


def _dense(pdf: pd.DataFrame, **columns: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Places of the rows in an array around them, and the columns as such arrays (name: value where there is no row)."""
    r, c = (pdf["row"] - pdf["row"].min()).to_numpy(), (pdf["col"] - pdf["col"].min()).to_numpy()
    out = []
    for name, empty in columns.items():
        a = np.full((r.max() + 1, c.max() + 1), empty)
        a[r, c] = pdf[name].to_numpy()
        out.append(a)
    return r, c, out


def flat_distances(cells: DataFrame, size: int = 512) -> DataFrame:
    """row, col, z, dist: steps inside its flat from each cell to the nearest one that falls or is an outlet, inf in pits and
    without data. Rounds as in `fill`: as many as tiles that such a way crosses, and one more."""
    ship_package(cells.sparkSession)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, (z, dist, core) = _dense(pdf, z=np.nan, dist=np.inf, core=False)
        start = ((kernels.steepest(z) >= 0) | kernels.outlets(z)) & core
        new = kernels.flat_distance(z, np.where(start, 0.0, dist))
        own = pdf["core"].to_numpy()
        got, before = new[r[own], c[own]], pdf["dist"].to_numpy(dtype=float)[own]
        return pd.DataFrame({"row": pdf["row"][own], "col": pdf["col"][own], "z": pdf["z"][own], "dist": got, "fell": got < before})

    state = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"), F.lit(float("inf")).alias("dist"))
    while True:
        dealt = with_halo(state.select("row", "col", "z", "dist"), size, 1)
        state = materialize(dealt.groupBy("tr", "tc").applyInPandas(work, "row long, col long, z double, dist double, fell boolean"), "flats")
        if state.where("fell").isEmpty():
            return state.select("row", "col", "z", "dist")


def pit_flats(cells: DataFrame, size: int = 512) -> DataFrame:
    """row, col: the first cell of each pit of the whole raster. Touching pit cells have one height, so parts are pits."""
    inside = flat_distances(cells, size).select("row", "col", ((F.col("dist") == float("inf")) & F.col("z").isNotNull() & ~F.isnan("z")).alias("hit"))
    return parts(inside, size).groupBy("component").agg(F.min(F.struct("row", "col")).alias("m")).select("m.row", "m.col")


def directions(filled: DataFrame, size: int = 512) -> DataFrame:
    """filled: row, col, z. row, col, z, direction (index in STEPS, -1 for none) as on the whole raster."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, (z, dist) = _dense(pdf, z=np.nan, dist=np.inf)
        got, own = kernels.along_flats(z, kernels.steepest(z), dist), pdf["core"].to_numpy()
        return pd.DataFrame({"row": pdf["row"][own], "col": pdf["col"][own], "z": pdf["z"][own], "direction": got[r[own], c[own]].astype(int)})

    dealt = with_halo(flat_distances(filled, size), size, 1)
    return materialize(dealt.groupBy("tr", "tc").applyInPandas(work, "row long, col long, z double, direction int"), "directions")


def accumulate(routed: DataFrame, own: float = 1.0, size: int = 512) -> DataFrame:
    """routed: row, col, direction. Adds area: `own` of each cell and of all cells upstream of it in the whole raster.

    Tiles are added up alone first and say which of their edge cells flow out, and through which of them each edge cell
    leaves. The sums of these outflows along their forest, a table of tile edges, are what the tiles then take in."""
    from .graph import upstream_sum

    ship_package(routed.sparkSession)
    steps = np.array(kernels.STEPS)
    tile = [tile_of(c, size).alias(k) for c, k in (("row", "tr"), ("col", "tc"))]

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, (d,) = _dense(pdf, direction=-1)
        row, col, way = pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["direction"].to_numpy()
        place = np.full(d.size, -1)
        place[r * d.shape[1] + c] = np.arange(len(row))
        last = place[kernels.path_ends(d)[r * d.shape[1] + c]]
        to = np.stack([row, col], 1) + np.where((way >= 0)[:, None], steps[way], 0)
        out = (to[:, 0] // size != row // size) | (to[:, 1] // size != col // size)
        rim = np.isin(row % size, (0, size - 1)) | np.isin(col % size, (0, size - 1))
        area = kernels.accumulate(d, np.full(d.shape, own))[r, c]
        return pd.DataFrame({"row": row, "col": col, "area": area, "out": out, "to_row": to[:, 0], "to_col": to[:, 1], "last_row": row[last], "last_col": col[last]})[rim]

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, (d, inflow) = _dense(pdf, direction=-1, inflow=0.0)
        area = kernels.accumulate(d, own + inflow)
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "direction": pdf["direction"], "area": area[r, c]})

    cells = routed.select("row", "col", F.col("direction").cast("int").alias("direction"))
    ddl = "row long, col long, area double, out boolean, to_row long, to_col long, last_row long, last_col long"
    rim = materialize(cells.withColumns({"tr": tile[0], "tc": tile[1]}).groupBy("tr", "tc").applyInPandas(edges, ddl), "tile-edges")
    name = lambda r, c: F.col(r) * F.lit(1 << 31) + F.col(c)
    exits = rim.where("out").select(name("row", "col").alias("id"), "to_row", "to_col", "area")
    leaves = rim.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), name("last_row", "last_col").alias("next"))
    forest = exits.join(leaves, ["to_row", "to_col"]).join(exits.select(F.col("id").alias("next"), F.lit(True).alias("goes_on")), "next", "left")
    forest = materialize(forest.select("id", F.when(F.col("goes_on"), F.col("next")).alias("parent"), "area", "to_row", "to_col"), "tile-flows")
    inflow = forest.join(upstream_sum(forest, "area"), "id").groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("total").alias("inflow"))
    fed = cells.join(inflow, ["row", "col"], "left").withColumns({"inflow": F.coalesce("inflow", F.lit(0.0)), "tr": tile[0], "tc": tile[1]})
    return materialize(fed.groupBy("tr", "tc").applyInPandas(totals, "row long, col long, direction int, area double"), "areas")


def stream_order(areas: DataFrame, least: float, size: int = 512) -> DataFrame:
    """areas: row, col, direction, area. Strahler order of the cells with enough area, 0 elsewhere, as on the whole raster.
    Only these cells take part in the rounds, which end when no order changes."""
    ship_package(areas.sparkSession)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, (d, area, core, before) = _dense(pdf, direction=-1, area=np.nan, core=False, stream_order=0)
        got, own = kernels.strahler_streams(d, area, least, np.where(core, -1, before)), pdf["core"].to_numpy()
        new = got[r[own], c[own]]
        return pd.DataFrame({k: pdf[k][own] for k in ("row", "col", "direction", "area")} | {"stream_order": new, "changed": new != pdf["stream_order"].to_numpy()[own]})

    state = areas.where(F.col("area") >= least).withColumn("stream_order", F.lit(0))
    while True:
        dealt = with_halo(state.select("row", "col", "direction", "area", "stream_order"), size, 1)
        state = materialize(dealt.groupBy("tr", "tc").applyInPandas(work, "row long, col long, direction int, area double, stream_order int, changed boolean"), "orders")
        if state.where("changed").isEmpty():
            return areas.select("row", "col").join(state.select("row", "col", "stream_order"), ["row", "col"], "left").fillna({"stream_order": 0})


def depressions(cells: DataFrame, least: float = 0.02, cell: float = 1.0, size: int = 512) -> DataFrame:
    """One row a filled area deeper than `least`: first_row, first_col, max_depth, area_m2, volume_m3."""
    deep = fill(cells, size).withColumn("depth", F.coalesce(F.nanvl(F.col("filled") - F.col("z"), F.lit(0.0)), F.lit(0.0)))
    comp = parts(deep.select("row", "col", (F.col("depth") > least).alias("hit")), size)
    rows = comp.join(deep.select("row", "col", "depth"), ["row", "col"]).groupBy("component").agg(
        F.min(F.struct("row", "col")).alias("m"), F.max("depth").alias("max_depth"), F.count("*").alias("n"), F.sum("depth").alias("total")
    )
    area = cell * cell
    return rows.select(F.col("m.row").alias("first_row"), F.col("m.col").alias("first_col"), "max_depth", (F.col("n") * area).alias("area_m2"), (F.col("total") * area).alias("volume_m3"))


def floodplain_mask(cells: DataFrame, cell: float = 1.0, max_height: float = 10.0, min_area: float = 1e4, size: int = 512) -> DataFrame:
    """cells: row, col, height (above drainage). Returns row, col, inside: low cells without 4-connected islands under
    min_area, and with enclosed holes under min_area filled; land that runs off the raster's edge is no hole."""
    def chosen(comp: DataFrame, sizes: DataFrame) -> DataFrame:
        return comp.join(sizes.select("component"), "component").select("row", "col", F.lit(True).alias("hit"))

    area = F.count("*") * F.lit(cell * cell)
    low = F.coalesce(F.col("height") <= max_height, F.lit(False))
    islands = parts(cells.select("row", "col", low.alias("hit")), size, False)
    kept = chosen(islands, islands.groupBy("component").agg(area.alias("area")).where(F.col("area") >= min_area))
    mask = materialize(cells.select("row", "col").join(kept, ["row", "col"], "left").select("row", "col", F.coalesce("hit", F.lit(False)).alias("inside")), "mask")
    box = mask.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    land = parts(mask.select("row", "col", (~F.col("inside")).alias("hit")), size, False).crossJoin(F.broadcast(box))
    edge = F.max(F.col("row").isin(F.col("r0"), F.col("r1")) | F.col("col").isin(F.col("c0"), F.col("c1")))
    holes = chosen(land, land.groupBy("component").agg(area.alias("area"), edge.alias("edge")).where((F.col("area") < min_area) & ~F.col("edge")))
    return mask.join(holes, ["row", "col"], "left").select("row", "col", (F.col("inside") | F.coalesce("hit", F.lit(False))).alias("inside"))
