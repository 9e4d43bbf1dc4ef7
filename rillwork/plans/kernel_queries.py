"""Queries that run tile kernels on the raster view, and learned scorers. Rows only: sequential or iterative algorithms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..config import Valleys
from ..operators import kernels, learn, tiles
from .views import Catalogue, cand, over, ras

C = Catalogue()
SIZE, HALO = 128, 16


def _map(name, outputs, kernel, sql=None):
    @C.add(name, sql)
    def query(spark, d):
        return tiles.run(ras(spark, d), kernel, outputs, SIZE, HALO)

    return query


_map("median_relief", {"relief": "double"}, lambda z: {"relief": kernels.median_relief(z, 5)}, over("ras", """, e AS (SELECT max("row") AS mr, max(col) AS mc FROM ras), k AS (SELECT unnest(range(-2, 3)) AS k),
  n AS (SELECT a."row", a.col, a.z, least(greatest(a."row" + i.k, 0), mr) AS r, least(greatest(a.col + j.k, 0), mc) AS c FROM ras a, e, k i, k j)
  SELECT n."row", n.col, n.z - quantile_cont(b.z, 0.5) AS relief FROM n JOIN ras b ON b."row" = n.r AND b.col = n.c GROUP BY n."row", n.col, n.z"""))
_map("gaussian_curvature", {"valley": "double", "ridge": "double"}, lambda z: dict(zip(("valley", "ridge"), kernels.hessian(z, 1.0))))
_map("openness", {"up": "double", "down": "double"}, lambda z: dict(zip(("up", "down"), kernels.openness(z, 5.0))))
_map("fill_from_nearest", {"filled": "double"}, lambda z: {"filled": kernels.fill_nodata(np.where(z > 0.2, np.nan, z))})
_map("breach_surface", {"breached": "double"}, lambda z: {"breached": kernels.breach(z, 10.0)[0]})
_map("thin", {"line": "boolean"}, lambda z: {"line": kernels.thin(z > 0.05)})
_map("threshold_channels", {"strong": "boolean"}, lambda z: {"strong": kernels.strong_channels(z * 10, 1.0, Valleys().shapes)})
_map("prune_spurs", {"line": "boolean"}, lambda z: {"line": kernels.prune(kernels.thin(z > 0.0), 4.0)})


@C.add("distance_to_mask", over("ras", """, k AS (SELECT unnest(range(-15, 16)) AS k),
  o AS (SELECT i.k AS dr, j.k AS dc, i.k * i.k + j.k * j.k AS s FROM k i, k j WHERE i.k * i.k + j.k * j.k <= 225),
  n AS (SELECT m."row" + dr AS "row", m.col + dc AS col, min(s) AS s FROM ras m, o WHERE m.z > 0.25 GROUP BY 1, 2)
  SELECT a."row", a.col, coalesce(sqrt(s), 'Infinity'::DOUBLE) AS dist FROM ras a LEFT JOIN n USING ("row", col)"""))
def distance_to_mask(spark, d):
    return tiles.distance(ras(spark, d).select("row", "col", (F.col("z") > 0.25).alias("hit")), 15, SIZE)


@C.add("feature_stack")
def feature_stack(spark, d):
    return tiles.feature_stack(ras(spark, d), size=128, halo=24)


@C.add("pit_flats")
def pit_flats(spark, d):
    return tiles.pit_flats(ras(spark, d), SIZE)


def _areas(spark, d):
    filled = tiles.fill(ras(spark, d), SIZE).select("row", "col", F.col("filled").alias("z"))
    return tiles.accumulate(tiles.directions(filled, SIZE), 1.0, SIZE)


@C.add("accumulate")
def accumulate(spark, d):
    return _areas(spark, d).select("row", "col", "area")


@C.add("stream_order")
def stream_order(spark, d):
    return tiles.stream_order(_areas(spark, d), 8.0, SIZE)


@C.add("fill_depressions")
def fill_depressions(spark, d):
    return tiles.fill(ras(spark, d), SIZE).select("row", "col", "filled", (F.col("filled") - F.col("z")).alias("depth"))


@C.add("hysteresis")
def hysteresis(spark, d):
    return tiles.hysteresis(ras(spark, d), "z > 0.1", "z > 0.3", SIZE)


@C.add("drop_small")
def drop_small(spark, d):
    return tiles.drop_small(ras(spark, d), "z > 0.1", 4, SIZE)


@C.add("depressions")
def depressions(spark, d):
    return tiles.depressions(ras(spark, d), size=SIZE)


@C.add("breach_paths")
def breach_paths(spark, d):
    def work(z, r, c):
        return [
            {"path": k, "seq": s, "row": r + i, "col": c + j, "max_cut_m": p["max_cut_m"], "length_m": p["length_m"]}
            for k, p in enumerate(kernels.breach(z, 10.0)[1]) for s, (i, j) in enumerate(p["cells"])
        ]

    return tiles.per_tile(ras(spark, d), work, "path long, seq long, row long, col long, max_cut_m double, length_m double", SIZE, 0)


@C.add("barriers")
def barriers(spark, d):
    def work(z, r, c):
        out = []
        new, paths = kernels.breach(z, 10.0)
        for p in paths:
            cut = np.array([z[q] - new[q] for q in p["cells"]])
            b = kernels.cut_through(z, p["cells"], cut)
            if b:
                out.append({"row": r + b["crest"][0], "col": c + b["crest"][1], "height_m": b["height_m"], "length_m": b["length_m"]})
        return out

    return tiles.per_tile(ras(spark, d), work, "row long, col long, height_m double, length_m double", SIZE, 0)


@C.add("skeleton_edges")
def skeleton_edges(spark, d):
    def work(z, r, c):
        lines = kernels.skeleton_edges(kernels.thin(z > 0.0))
        return [{"tile_row": r, "edge": k, "seq": s, "row": r + i, "col": c + j} for k, line in enumerate(lines) for s, (i, j) in enumerate(line)]

    return tiles.per_tile(ras(spark, d), work, "tile_row long, edge long, seq long, row long, col long", SIZE, 0)


@C.add("least_cost_snap")
def least_cost_snap(spark, d):
    def work(z, r, c):
        cost = 0.02 + np.exp(z / 0.15)
        goals = np.zeros(z.shape, bool)
        goals[-1] = True
        line, k = kernels.least_cost(cost, (0, z.shape[1] // 2), goals)
        return [{"tile_row": r, "seq": s, "row": r + i, "col": c + j, "cost": k} for s, (i, j) in enumerate(line)]

    return tiles.per_tile(ras(spark, d), work, "tile_row long, seq long, row long, col long, cost double", SIZE, 0)


@C.add("mask_components")
def mask_components(spark, d):
    """Eight-connected parts of the whole raster; recursive SQL is too slow for it."""
    return _mask_components(ras(spark, d))


def _mask_components(r):
    merged = tiles.parts(r.select("row", "col", (F.col("z") > 0.25).alias("hit")), SIZE)
    first = F.min(F.struct("row", "col")).alias("m")
    return merged.groupBy("component").agg(first, F.count("*").alias("n")).select(F.col("m.row").alias("first_row"), F.col("m.col").alias("first_col"), "n")


@C.add("boosted_scorer")
def boosted_scorer(spark, d):
    c = cand(spark, d).select("id", "tile", "council", "score", "kind", F.when(F.col("score") > 150000, 1).otherwise(0).alias("y"), (F.length("council") % 5).alias("f2"))
    return learn.out_of_fold(c.withColumn("f1", F.col("score") / 1000 + F.col("id") % 37), ["f1", "f2"], "y", "tile", 3)


@C.add("presence_model")
def presence_model(spark, d):
    c = cand(spark, d).where("y is not null").select("id", "tile", "score", F.col("y"), (F.col("id") % 13).cast("double").alias("f1"))
    return learn.out_of_fold(c.withColumn("f2", F.col("y") * 2.0 + F.col("id") % 3), ["f1", "f2"], "y", "tile", 2)


@C.add("scorer_metrics")
def scorer_metrics(spark, d):
    from ..operators import metrics

    scored = boosted_scorer(spark, d)
    return metrics.roc_auc(scored.withColumn("g", F.lit("all")), ["g"], "p", "y").select("g", "n1", "n0", "auc")


@C.add("feature_importance")
def feature_importance(spark, d):
    c = cand(spark, d).select("id", "tile", F.when(F.col("score") > 150000, 1).otherwise(0).alias("y"), (F.col("score") / 1000).alias("f1"), (F.col("id") % 5).cast("double").alias("f2"))
    return learn.importance(c, ["f1", "f2"], "y", 2)
