"""The engine's entry points: a terrain chain per tile, ranked candidates, label matching, training and scoring.

Every step is a DataFrame, so callers can stop anywhere; the chain writes its intermediate tables to shared storage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import greedy, kernels, labels, learn, metrics, near, rules, tiles
from ..session import materialize, ship_package


@dataclass
class Engine:
    """cell: size of a raster cell in metres. tile, halo: cells a kernel task sees and copies."""

    spark: SparkSession
    config: Config = field(default_factory=Config)
    cell: float = 1.0
    tile: int = 512
    halo: int = 48

    def __post_init__(self) -> None:
        ship_package(self.spark)

    def hydrology(self, cells: DataFrame) -> DataFrame:
        """row, col, breached, filled, area, stream_order of each cell. Breaching runs inside tiles with halo; the fill, the
        directions, the areas and the orders are those of the whole raster. No data is filled from the nearest cell to route over it."""
        p, cell = self.config.water, self.cell

        def work(z: np.ndarray) -> dict[str, np.ndarray]:
            breached, _ = kernels.breach(kernels.fill_nodata(z), p.dig_reach_m, cell, p.level_step_cost, p.noted_cut_m, p.dig_budget)
            return {"z": breached, "gone": np.isnan(z)}

        cut = materialize(tiles.run(cells, work, {"z": "double", "gone": "boolean"}, self.tile, self.halo), "engine-breached")
        filled = tiles.fill(cut.select("row", "col", "z"), self.tile)
        areas = tiles.accumulate(tiles.directions(filled.select("row", "col", F.col("filled").alias("z")), self.tile), cell * cell, self.tile)
        orders = tiles.stream_order(areas, 50.0 * cell * cell, self.tile)
        rows = cut.join(filled.select("row", "col", "filled"), ["row", "col"]).join(areas.select("row", "col", "area"), ["row", "col"]).join(orders, ["row", "col"])
        there = lambda c: F.when(~F.col("gone"), F.col(c)).otherwise(float("nan"))
        return rows.select("row", "col", there("z").alias("breached"), there("filled").alias("filled"), there("area").alias("area"), "stream_order")

    def channels(self, cells: DataFrame) -> DataFrame:
        """row, col, channel, line: thresholded channels without small parts, and their pruned one-cell lines."""
        p, cell = self.config.valleys, self.cell

        def work(z: np.ndarray) -> dict[str, np.ndarray]:
            f = kernels.fill_nodata(z)
            strong = kernels.drop_small(kernels.strong_channels(f, cell, p.shapes), max(1, round(p.least_part_m2 / cell**2)))
            return {"channel": strong & ~np.isnan(z), "line": kernels.prune(kernels.thin(strong), p.spur_m, cell)}

        return tiles.run(cells, work, {"channel": "boolean", "line": "boolean"}, self.tile, self.halo)

    def barriers(self, cells: DataFrame) -> DataFrame:
        """Candidates where a breach goes through a barrier: id, x, y, height_m, length_m, kept once over tile halos."""
        p, h, cell = self.config.candidates, self.config.water, self.cell

        def work(z: np.ndarray, r: int, c: int) -> list[dict]:
            out = []
            breached, paths = kernels.breach(kernels.fill_nodata(z), h.dig_reach_m, cell, h.level_step_cost, h.noted_cut_m, h.dig_budget)
            for path in paths:
                found = kernels.cut_through(z, path["cells"], np.array([z[q] - breached[q] for q in path["cells"]]), cell)
                if found and found["height_m"] >= p.min_height_m:
                    i, j = found["crest"]
                    out.append({"x": (c + j + 0.5) * cell, "y": (r + i + 0.5) * cell, "height_m": found["height_m"], "length_m": found["length_m"]})
            return out

        rows = tiles.per_tile(cells, work, "x double, y double, height_m double, length_m double", self.tile, self.halo)
        rows = materialize(rows.distinct().withColumn("id", F.xxhash64("x", "y", "height_m")), "engine-barriers")
        pairs = near.self_pairs(rows.select("id", "x", "y"), p.merge_m).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        best = greedy.independent_set(rows.select("id", (-F.col("height_m")).alias("rank")), pairs).where("chosen")
        return rows.join(best.select("id"), "id").select("id", "x", "y", "height_m", "length_m")

    def rank(self, candidates: DataFrame, roads: DataFrame, cap: float = 500.0) -> DataFrame:
        """Candidates with distance to the nearest road point and tier; sources are an array column, testB if there is none."""
        with_road = near.nearest(candidates, roads.select("id", "x", "y"), cap)
        sources = F.col("sources") if "sources" in candidates.columns else F.array(F.lit("testB"))
        road = rules.least_distance(F.col("near_dist"), cap=cap)
        t = rules.tier(sources, F.col("height_m"), F.lit(0.0), road, F.lit(None).cast("double"), F.lit(False), p=self.config.candidates)
        return with_road.withColumns({"road_m": road, "tier": t}).drop("near_id", "near_dist")

    def dataset(self, candidates: DataFrame, known: DataFrame, radius: float = 15.0) -> tuple[DataFrame, DataFrame]:
        """Candidates with label columns, and the labels that no candidate reaches."""
        matched = materialize(labels.match(known, candidates, radius), "engine-matched")
        close = labels.near_positive(candidates, matched, radius).select("id", F.lit(True).alias("near_positive"))
        out = candidates.join(matched, "id", "left").join(close, "id", "left").fillna({"near_positive": False})
        return out, labels.misses(known, candidates, radius)

    def train(self, rows: DataFrame, columns: list[str], y: str, block: str, folds: int = 5) -> DataFrame:
        """Out-of-fold scores."""
        return learn.out_of_fold(rows.where(F.col(y).isNotNull()), columns, y, block, folds)

    def evaluate(self, scored: DataFrame, group: list[str], y: str) -> DataFrame:
        """Average precision and ROC area per group."""
        a = metrics.average_precision(scored, group, "p", y)
        return a.join(metrics.roc_auc(scored, group, "p", y).select(*group, "auc"), group)

    def network(self, cells: DataFrame) -> dict[str, DataFrame]:
        """The whole chain: hydrology, channels and barriers."""
        return {"hydrology": self.hydrology(cells), "channels": self.channels(cells), "barriers": self.barriers(cells)}
