"""Raster tables: cells for relational work, chunks for storage and kernels, product folders with metadata.

cells: row, col, x, y, z (null for no data). chunks: cr, cc (chunk row and column), h, w, data (array<float>, row by row, NaN
for no data). A product folder has `chunks` as Parquet partitioned by band and one JSON line of metadata.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Frame
from ..session import fresh_path

NODATA = -9999.0


def null_nan(c: Column) -> Column:
    """No data is null: NaN and infinities become null at ingest."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def cells_to_chunks(cells: DataFrame, size: int, value: str = "z") -> DataFrame:
    """Dense chunks of size x size cells; a group is one chunk, so it is bounded. Cells that are absent are NaN."""
    cr, cc = F.floor(F.col("row") / size), F.floor(F.col("col") / size)
    at = (F.pmod(F.col("row"), F.lit(size)) * size + F.pmod(F.col("col"), F.lit(size))).cast("int")
    own = cells.select(cr.alias("cr"), cc.alias("cc"), at.alias("at"), F.col(value).cast("float").alias("v"))
    maps = own.groupBy("cr", "cc").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    data = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(float("nan")).cast("float")))
    return maps.select("cr", "cc", F.lit(size).alias("h"), F.lit(size).alias("w"), data.alias("data"))


def chunks_to_cells(chunks: DataFrame, frame: Frame | None = None) -> DataFrame:
    """Cells with data; with a frame also x and y of their centres."""
    flat = chunks.select("cr", "cc", "h", "w", F.posexplode("data").alias("at", "v"))
    row, col = F.col("cr") * F.col("h") + F.floor(F.col("at") / F.col("w")), F.col("cc") * F.col("w") + F.col("at") % F.col("w")
    cells = flat.select(row.alias("row"), col.alias("col"), null_nan(F.col("v").cast("double")).alias("z")).where("z is not null")
    if frame is None:
        return cells
    return cells.withColumns({"x": F.lit(frame.x0) + (F.col("col") + 0.5) * frame.cell, "y": F.lit(frame.y1) - (F.col("row") + 0.5) * frame.cell})


def read_window(chunks: DataFrame, frame: Frame, xmin: float, ymin: float, xmax: float, ymax: float, buffer: float = 0.0) -> DataFrame:
    """Cells of a window with a buffer; chunk bounds are compared first, so other chunks are not read past their keys."""
    if not all(abs(v) < float("inf") for v in (xmin, ymin, xmax, ymax)) or xmin >= xmax or ymin >= ymax:
        raise ValueError("the window has no extent")
    x0, x1 = xmin - buffer, xmax + buffer
    y0, y1 = ymin - buffer, ymax + buffer
    c0, c1 = int((x0 - frame.x0) // frame.cell), int(-(-(x1 - frame.x0) // frame.cell)) - 1
    r0, r1 = int((frame.y1 - y1) // frame.cell), int(-(-(frame.y1 - y0) // frame.cell)) - 1
    if c1 < 0 or r1 < 0 or c0 >= frame.width or r0 >= frame.height:
        raise ValueError("the window does not meet the raster")
    near = chunks.where((F.col("cr") >= F.floor(F.lit(r0) / F.col("h"))) & (F.col("cr") <= F.floor(F.lit(r1) / F.col("h"))) & (F.col("cc") >= F.floor(F.lit(c0) / F.col("w"))) & (F.col("cc") <= F.floor(F.lit(c1) / F.col("w"))))
    return chunks_to_cells(near, frame).where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def check_frames(frames: list[Frame]) -> None:
    """Rasters that are to be read as one must have one cell size and lie on one pixel grid."""
    first = frames[0]
    for f in frames[1:]:
        if f.cell != first.cell:
            raise ValueError(f"cell sizes differ: {f.cell} and {first.cell}")
        for a, b in ((f.x0, first.x0), (f.y1, first.y1)):
            k = (a - b) / first.cell
            if abs(k - round(k)) > 1e-6:
                raise ValueError("a raster lies off the pixel grid")


def check_crs(name: str, crs: str, bounds: tuple[float, float, float, float], projected: set[str]) -> str:
    """The horizontal part of a CRS name; it must be projected, and bounds that look like degrees are refused."""
    horizontal = crs.split("+")[0].strip()
    if horizontal not in projected:
        raise ValueError(f"{name}: {horizontal} is not a projected CRS in metres")
    if all(abs(v) <= 360 for v in bounds):
        raise ValueError(f"{name}: its bounds look like degrees, not metres")
    return horizontal


def mosaic(rasters: list[DataFrame]) -> DataFrame:
    """Cells of several rasters on one grid; the first with data wins."""
    from ..operators.focal import first_wins

    both = None
    for k, r in enumerate(rasters):
        one = r.select(F.lit(k).alias("k"), "row", "col", "z")
        both = one if both is None else both.unionByName(one)
    return first_wins(both, "k")


def flip(cells: DataFrame, height: int) -> DataFrame:
    """Bottom-up rows to north-up."""
    return cells.withColumn("row", F.lit(height - 1) - F.col("row"))


def resample_mean(cells: DataFrame, k: int, bands: list[str]) -> DataFrame:
    """k x k means of the valid cells of several bands."""
    return cells.groupBy(F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col")).agg(*[F.avg(b).alias(b) for b in bands])


def band_stack(chunks: dict[str, DataFrame]) -> DataFrame:
    """Cells with one column a band; `complete` where all bands have data."""
    out = None
    for name, c in chunks.items():
        one = chunks_to_cells(c).withColumnRenamed("z", name)
        out = one if out is None else out.join(one, ["row", "col"], "full")
    ok = F.lit(True)
    for name in chunks:
        ok = ok & F.col(name).isNotNull()
    return out.withColumn("complete", ok)


def write_product(bands: Mapping[str, DataFrame], path: str, metadata: dict, size: int = 256) -> None:
    """Bands as chunks partitioned by name, and the metadata; the metadata goes last, so that a folder with it is whole."""
    if metadata.get("cell", 0) <= 0:
        raise ValueError("the metadata need a cell size above 0")
    spark = None
    for name, cells in bands.items():
        spark = cells.sparkSession
        cells_to_chunks(cells, size).withColumn("band", F.lit(name)).write.mode("append").partitionBy("band").parquet(f"{path}/chunks")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def read_product(spark: SparkSession, path: str, band: str = "z") -> tuple[DataFrame, dict]:
    """Chunks of a band (partition pruned) and the metadata."""
    meta = json.loads(spark.read.parquet(f"{path}/metadata").first()[0])
    return spark.read.parquet(f"{path}/chunks").where(F.col("band") == band).drop("band"), meta


def write_geotiff_like(cells: DataFrame, path: str, value: str = "z") -> None:
    """Cells with no data as -9999, for readers that know no nulls."""
    cells.select("row", "col", F.coalesce(F.col(value), F.lit(NODATA)).cast("float").alias(value)).write.mode("overwrite").parquet(path)


def analytic_scene(spark: SparkSession, height: int, width: int) -> DataFrame:
    """A valley that falls to the south with a wall across it, and ground truth: row, col, z, wall. Noise comes from hashes,
    so every run makes the same scene."""
    cells = spark.range(height * width).select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"))
    noise = (F.pmod(F.xxhash64("row", "col"), F.lit(1000)) / 1000.0 - 0.5) * 0.01
    across = F.abs(F.col("col") - width / 2.0)
    wall = F.abs(F.col("row") - height // 2) <= 2
    z = F.lit(100.0) - F.col("row") * 0.05 + across * 0.2 + noise
    return cells.select("row", "col", F.when(wall, F.greatest(z, F.lit(102.0) - F.col("row") * 0.05)).otherwise(z).alias("z"), wall.alias("wall"))


def scratch_product(spark: SparkSession) -> str:
    return fresh_path(spark, "product")
