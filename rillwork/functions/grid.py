"""Map-sheet and regular grid ids as column expressions, and bounds of ids.

Sheets are 24 x 36 km, named by two letters for the row (without I and O) and two digits for the column; finer tiles are
numbered inside their sheet by row and column. A point on a shared edge belongs to the tile to the right and below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The national map-sheet grid (letters, sheet size and origin in metres, tiles a side by scale).
LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
SHEET_W, SHEET_H = 24_000, 36_000
ORIGIN_E, ORIGIN_N = 1_012_000, 6_234_000
FIRST_ROW = "AS"
SIDE = {50_000: 1, 10_000: 5, 5_000: 10, 1_000: 50, 500: 100}

_BASE = len(LETTERS)
_FIRST = LETTERS.index(FIRST_ROW[0]) * _BASE + LETTERS.index(FIRST_ROW[1])


def _letter(k: Column) -> Column:
    return F.substring(F.lit(LETTERS), (k + 1).cast("int"), F.lit(1))


def _digits(scale: int) -> int:
    return 3 if SIDE[scale] >= 100 else 2


def sheet_tile(e: Column, n: Column, scale: int) -> Column:
    """Id of the tile that holds a point."""
    col, row = F.floor((e - ORIGIN_E) / SHEET_W), F.floor((ORIGIN_N - n) / SHEET_H)
    k = row + _FIRST
    sheet = F.concat(_letter(F.floor(k / _BASE)), _letter(k % _BASE), F.lpad((col + 1).cast("string"), 2, "0"))
    if SIDE[scale] == 1:
        return sheet
    side, d = SIDE[scale], _digits(scale)
    c = F.least(F.floor((e - (F.lit(ORIGIN_E) + col * SHEET_W)) / (SHEET_W / side)), F.lit(side - 1)) + 1
    r = F.least(F.floor(((F.lit(ORIGIN_N) - row * SHEET_H) - n) / (SHEET_H / side)), F.lit(side - 1)) + 1
    return F.concat(sheet, F.lit(f"_{scale}_"), F.lpad(r.cast("string"), d, "0"), F.lpad(c.cast("string"), d, "0"))


def tile_bounds(tile: Column) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax of a sheet or tile id; null for other text."""
    ok = tile.rlike(r"^[A-HJ-NP-Z]{2}\d{2}(_\d+_\d+)?$")
    place = lambda k: F.instr(F.lit(LETTERS), F.substring(tile, k, 1)) - 1
    row, col = place(1) * _BASE + place(2) - _FIRST, F.substring(tile, 3, 2).cast("int") - 1
    scale = F.coalesce(F.regexp_extract(tile, r"_(\d+)_", 1).try_cast("int"), F.lit(50_000))
    side = F.lit(None).cast("int")
    digits = F.lit(2)
    for s, k in SIDE.items():
        side = F.when(scale == s, k).otherwise(side)
        digits = F.when(scale == s, _digits(s)).otherwise(digits)
    rc = F.regexp_extract(tile, r"_(\d+)$", 1)
    r = F.coalesce(F.substring(rc, F.lit(1), digits).try_cast("int"), F.lit(1))
    c = F.coalesce(F.substring(rc, digits + 1, digits).try_cast("int"), F.lit(1))
    w, h = F.lit(float(SHEET_W)) / side, F.lit(float(SHEET_H)) / side
    x, y = F.lit(float(ORIGIN_E)) + col * SHEET_W + (c - 1) * w, F.lit(float(ORIGIN_N)) - row * SHEET_H - (r - 1) * h
    fits = ok & (r >= 1) & (r <= side) & (c >= 1) & (c <= side)
    return {k: F.when(fits, v) for k, v in {"xmin": x, "ymin": y - h, "xmax": x + w, "ymax": y}.items()}


def quadrant(e: Column, n: Column) -> Column:
    """Id of the 1:10 000 tile's quadrant (NW, NE, SW, SE) that holds a point."""
    tile = sheet_tile(e, n, 10_000)
    b = tile_bounds(tile)
    ns = F.when(n > (b["ymin"] + b["ymax"]) / 2, "N").otherwise("S")
    ew = F.when(e >= (b["xmin"] + b["xmax"]) / 2, "E").otherwise("W")
    return F.concat(tile, F.lit("_"), ns, ew)


def parent_tile(tile: Column, scale: int) -> Column:
    b = tile_bounds(tile)
    return sheet_tile((b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2, scale)


def window_tiles(windows: DataFrame, scale: int) -> DataFrame:
    """One row a tile that a window (xmin, ymin, xmax, ymax) overlaps, top-left first: tile, tile_row, tile_col of the whole grid."""
    w, h = SHEET_W / SIDE[scale], SHEET_H / SIDE[scale]
    c0, c1 = F.floor((F.col("xmin") - ORIGIN_E) / w), F.ceil((F.col("xmax") - ORIGIN_E) / w) - 1
    r0, r1 = F.floor((F.lit(ORIGIN_N) - F.col("ymax")) / h), F.ceil((F.lit(ORIGIN_N) - F.col("ymin")) / h) - 1
    grid = windows.withColumn("tile_row", F.explode(F.sequence(r0, r1))).withColumn("tile_col", F.explode(F.sequence(c0, c1)))
    x, y = F.lit(ORIGIN_E) + (F.col("tile_col") + 0.5) * w, F.lit(ORIGIN_N) - (F.col("tile_row") + 0.5) * h
    return grid.withColumn("tile", sheet_tile(x, y, scale))


def regular_tile(x: Column, y: Column, origin_x: float, origin_y: float, size_x: float, size_y: float, prefix: str = "T") -> Column:
    return F.concat_ws("_", F.lit(prefix), F.floor((x - origin_x) / size_x).cast("string"), F.floor((y - origin_y) / size_y).cast("string"))


@dataclass(frozen=True)
class Frame:
    """A north-up grid of square cells: origin at the top left."""

    x0: float
    y1: float
    cell: float
    height: int
    width: int


def snapped_frame(xmin: float, ymin: float, xmax: float, ymax: float, cell: float) -> Frame:
    """Bounds moved outwards to multiples of the cell size, as a grid."""
    import math

    a, b = math.floor(xmin / cell), math.floor(ymin / cell)
    c, d = math.ceil(xmax / cell), math.ceil(ymax / cell)
    return Frame(a * cell, d * cell, cell, d - b, c - a)
