"""Queries on raster cells: windows, blocks, terrain measures, fills, blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, focal
from ..sources import catalog
from .views import Catalogue, over, ras, table

C = Catalogue()


def _win(f: str, r: int, value: str = "z", source: str = "ras", out: str = "v") -> str:
    """SQL of a separable (2r + 1)-square window as two table expressions, named <out>_h and <out>_t."""
    return f""", {out}_h AS (SELECT *, {f}({value}) OVER (PARTITION BY "row" ORDER BY col RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {out}_1 FROM {source}),
 {out}_t AS (SELECT *, {f}({out}_1) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {out} FROM {out}_h)"""


_OPEN = _win("min", 2, out="lo") + _win("max", 2, "lo", "lo_t", "op")
_CLOSE = _win("max", 2, out="hi") + _win("min", 2, "hi", "hi_t", "cl")


@C.add("window_min", over("ras", _win("min", 2) + ' SELECT "row", col, v FROM v_t'))
def window_min(spark, d):
    return focal.separable(ras(spark, d), F.min, 5).select("row", "col", "v")


@C.add("window_max", over("ras", _win("max", 2) + ' SELECT "row", col, v FROM v_t'))
def window_max(spark, d):
    return focal.separable(ras(spark, d), F.max, 5).select("row", "col", "v")


@C.add("opening", over("ras", _OPEN + ' SELECT "row", col, op AS v FROM op_t'))
def opening(spark, d):
    return focal.opening(ras(spark, d), 5).select("row", "col", "v")


@C.add("closing", over("ras", _CLOSE + ' SELECT "row", col, cl AS v FROM cl_t'))
def closing(spark, d):
    return focal.closing(ras(spark, d), 5).select("row", "col", "v")


@C.add("tophat_white", over("ras", _OPEN + ' SELECT "row", col, z - op AS white FROM op_t'))
def tophat_white(spark, d):
    return focal.white_tophat(ras(spark, d), 5).select("row", "col", "white")


@C.add("tophat_black", over("ras", _CLOSE + ' SELECT "row", col, cl - z AS black FROM cl_t'))
def tophat_black(spark, d):
    return focal.black_tophat(ras(spark, d), 5).select("row", "col", "black")


@C.add("box_mean", over("ras", _win("sum", 2, out="s") + """, n AS (SELECT "row", count(*) OVER () AS x, col, s FROM s_t)
  SELECT a."row", a.col, round_even(s / ((least(a."row" + 2, mr) - greatest(a."row" - 2, 0) + 1) * (least(a.col + 2, mc) - greatest(a.col - 2, 0) + 1)), 6) AS mean
  FROM s_t a, (SELECT max("row") AS mr, max(col) AS mc FROM ras) m"""))
def box_mean(spark, d):
    b = focal.box(ras(spark, d), 5)
    return b.select("row", "col", F.bround(F.col("v_sum") / F.col("v_n"), 6).alias("mean"))


_SHARP = """, m AS (SELECT max("row") AS mr, max(col) AS mc FROM ras)""" + _win("sum", 1, out="i") + _win("sum", 3, "z", "i_t", "o") + """,
 q AS (SELECT a.*, (least("row" + 1, mr) - greatest("row" - 1, 0) + 1) * (least(col + 1, mc) - greatest(col - 1, 0) + 1) AS ni,
  (least("row" + 3, mr) - greatest("row" - 3, 0) + 1) * (least(col + 3, mc) - greatest(col - 3, 0) + 1) AS no FROM o_t a, m)"""


@C.add("sharpness", over("ras", _SHARP + ' SELECT "row", col, round_even(z - (o - i) / (no - ni), 6) AS sharp FROM q'))
def sharpness(spark, d):
    return focal.ring_contrast(ras(spark, d), 3, 7).select("row", "col", F.bround("sharp", 6).alias("sharp"))


_N8 = """, nb AS (SELECT c.*, """ + ", ".join(
    f'{k}.z AS {k}' for k in focal.EIGHT
) + """ FROM ras c """ + " ".join(
    f'LEFT JOIN ras {k} ON {k}."row" = c."row" + {dr} AND {k}.col = c.col + {dc}' for k, (dr, dc) in focal.STEPS.items()
) + ")"


@C.add("neighbour_values", over("ras", _N8 + ' SELECT "row", col, n, e, s, w, ne, se, sw, nw FROM nb'))
def neighbour_values(spark, d):
    return focal.neighbours(ras(spark, d)).select("row", "col", *focal.EIGHT)


@C.add("boundary_cells", over("ras", _N8 + ' SELECT "row", col, (' + " + ".join(f"({k} IS NOT NULL)::INT" for k in focal.EIGHT) + ") < 8 AS outlet FROM nb"))
def boundary_cells(spark, d):
    return focal.boundary(ras(spark, d)).select("row", "col", "outlet")


_DROP = ", o AS (SELECT \"row\", col, unnest([" + ", ".join(
    f"{{'d': (z - {k}) / {'sqrt(2)' if dr and dc else '1.0'}, 'i': {i}, 'r': {dr}, 'c': {dc}}}" for i, (k, (dr, dc)) in enumerate((k, focal.STEPS[k]) for k in focal.EIGHT)
) + """]) AS s FROM nb), b AS (SELECT "row", col, s.r AS drow, s.c AS dcol, s.d AS "drop", row_number() OVER (PARTITION BY "row", col ORDER BY s.d DESC, s.i) AS k FROM o WHERE s.d > 0)"""


@C.add("d8_direction", over("ras", _N8 + _DROP + ' SELECT c."row", c.col, drow, dcol, round_even("drop", 9) AS "drop" FROM ras c LEFT JOIN b ON b."row" = c."row" AND b.col = c.col AND k = 1'))
def d8_direction(spark, d):
    return focal.steepest(ras(spark, d)).select("row", "col", "drow", "dcol", F.bround("drop", 9).alias("drop"))


@C.add("pit_cells", over("ras", _N8 + ' SELECT "row", col, z FROM nb WHERE z < least(' + ", ".join(f"coalesce({k}, 'inf'::DOUBLE)" for k in focal.EIGHT) + ")"))
def pit_cells(spark, d):
    wide = focal.neighbours(ras(spark, d))
    low = F.least(*[F.coalesce(F.col(k), F.lit(float("inf"))) for k in focal.EIGHT])
    return wide.where(F.col("z") < low).select("row", "col", "z")


_SLOPE = _N8 + """, g AS (SELECT "row", col, z, coalesce((e - w) / 2, e - z, z - w) AS gx, coalesce((s - n) / 2, s - z, z - n) AS gy FROM nb)"""


@C.add("gradient_slope", over("ras", _SLOPE + ' SELECT "row", col, gx, gy, sqrt(gx * gx + gy * gy) AS slope FROM g'))
def gradient_slope(spark, d):
    return focal.slope(ras(spark, d)).select("row", "col", "gx", "gy", "slope")


@C.add("slope_gate", over("ras", _SLOPE + ' SELECT "row", col, z > 0.1 AND (sqrt(gx * gx + gy * gy) <= 0.1 OR ("row" * 64 + col) % 7 >= 4) AS kept FROM g'))
def slope_gate(spark, d):
    area = (F.col("row") * 64 + F.col("col")) % 7
    return focal.slope_gate(focal.slope(ras(spark, d)), F.col("z") > 0.1, 0.1, area, 4).select("row", "col", "kept")


@C.add("hillshade", over("ras", _SLOPE + """ SELECT "row", col, round_even(greatest((sin(radians(45)) - sin(radians(315)) * cos(radians(45)) * gx + cos(radians(315)) * cos(radians(45)) * gy)
  / sqrt(1 + gx * gx + gy * gy), 0), 6) AS shade FROM g"""))
def hillshade(spark, d):
    return focal.hillshade(ras(spark, d)).select("row", "col", F.bround("shade", 6).alias("shade"))


@C.add("line_likeness", over("ras", _N8 + """, h AS (SELECT "row", col, coalesce(e, z) + coalesce(w, z) - 2 * z AS xx, coalesce(n, z) + coalesce(s, z) - 2 * z AS yy,
  (coalesce(se, z) + coalesce(nw, z) - coalesce(ne, z) - coalesce(sw, z)) / 4 AS xy FROM nb),
  l AS (SELECT *, (xx + yy) / 2 + sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) AS a, (xx + yy) / 2 - sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) AS b FROM h),
  m AS (SELECT "row", col, CASE WHEN abs(a) >= abs(b) THEN a ELSE b END AS l1, CASE WHEN abs(a) >= abs(b) THEN b ELSE a END AS l2 FROM l)
  SELECT "row", col, round_even(CASE WHEN l1 < 0 THEN greatest(abs(l1) - abs(l2), 0) / (abs(l1) + abs(l2) + 1e-12) * abs(l1) ELSE 0.0 END, 6) AS v FROM m"""))
def line_likeness(spark, d):
    w = focal.neighbours(ras(spark, d))
    z = F.col("z")
    at = {k: F.coalesce(F.col(k), z) for k in focal.EIGHT}
    l1, l2 = focal.eigenvalues(at["e"] + at["w"] - 2 * z, (at["se"] + at["nw"] - at["ne"] - at["sw"]) / 4, at["n"] + at["s"] - 2 * z)
    return w.select("row", "col", F.bround(focal.line_likeness(l1, l2), 6).alias("v"))


@C.add("block_mean_minvalid", over("ras", """, t AS (SELECT "row", col, CASE WHEN z > 0 THEN z END AS z FROM ras)
  SELECT "row" // 4 AS brow, col // 4 AS bcol, count(z) AS n_valid, round_even(CASE WHEN count(z) >= 8 THEN avg(z) END, 6) AS v FROM t GROUP BY 1, 2"""))
def block_mean_minvalid(spark, d):
    t = ras(spark, d).withColumn("z", F.when(F.col("z") > 0, F.col("z")))
    return focal.block_mean(t, 4).select("brow", "bcol", "n_valid", F.bround("v", 6).alias("v"))


_CODE = """, t AS (SELECT "row", col, CASE WHEN z < -0.15 THEN -1 ELSE floor(z * 10)::BIGINT END AS code FROM ras)"""


def _code(spark, d):
    return ras(spark, d).withColumn("code", F.when(F.col("z") < -0.15, F.lit(-1).cast("long")).otherwise(F.floor(F.col("z") * 10)))


@C.add("block_mode", over("ras", _CODE + """, c AS (SELECT "row" // 4 AS brow, col // 4 AS bcol, code, count(*) AS n FROM t WHERE code <> -1 GROUP BY 1, 2, 3),
  b AS (SELECT *, row_number() OVER (PARTITION BY brow, bcol ORDER BY n DESC, code) AS k FROM c), a AS (SELECT DISTINCT "row" // 4 AS brow, col // 4 AS bcol FROM t)
  SELECT a.brow, a.bcol, coalesce(b.code, -1) AS v FROM a LEFT JOIN b ON b.brow = a.brow AND b.bcol = a.bcol AND k = 1"""))
def block_mode(spark, d):
    return focal.block_mode(_code(spark, d), 4, "code").select("brow", "bcol", "v")


@C.add("block_min_burn", over("ras", """, b AS (SELECT "row", col, greatest(max(abs(z)), 0) AS burn FROM ras WHERE col % 3 = 0 GROUP BY 1, 2)
  SELECT r."row" // 5 AS brow, r.col // 5 AS bcol, min(r.z - coalesce(burn, 0)) AS v FROM ras r LEFT JOIN b USING ("row", col) GROUP BY 1, 2"""))
def block_min_burn(spark, d):
    r = ras(spark, d)
    return focal.block_min_burnt(r, r.where("col % 3 = 0").select("row", "col", F.abs("z").alias("depth")), 5).select("brow", "bcol", "v")


@C.add("decimate_any", over("ras", 'SELECT "row" // 8 AS brow, col // 8 AS bcol, bool_or(z > 0.25) AS "any" FROM ras GROUP BY 1, 2'))
def decimate_any(spark, d):
    return focal.decimate_any(ras(spark, d).withColumn("hit", F.col("z") > 0.25), 8, "hit").select("brow", "bcol", "any")


@C.add("rem_samples", over("ras", """SELECT "row" // 16 AS brow, col // 16 AS bcol, quantile_cont(z, 0.25) AS v, avg("row") AS y, avg(col) AS x, count(*) AS n FROM ras WHERE z > 0.1 GROUP BY 1, 2"""))
def rem_samples(spark, d):
    return focal.rem_blocks(ras(spark, d).where("z > 0.1"), 16).select("brow", "bcol", "v", "y", "x", "n")


@C.add("bilinear_sample", over("ras", """, p AS (SELECT "row" * 64 + col AS id, "row" + 0.25 AS r, col + 0.5 AS c FROM ras WHERE col % 7 = 0)
  SELECT id, round_even(a.z * 0.75 * 0.5 + b.z * 0.75 * 0.5 + e.z * 0.25 * 0.5 + f.z * 0.25 * 0.5, 9) AS v FROM p
  LEFT JOIN ras a ON a."row" = floor(r) AND a.col = floor(c) LEFT JOIN ras b ON b."row" = floor(r) AND b.col = floor(c) + 1
  LEFT JOIN ras e ON e."row" = floor(r) + 1 AND e.col = floor(c) LEFT JOIN ras f ON f."row" = floor(r) + 1 AND f.col = floor(c) + 1"""))
def bilinear_sample(spark, d):
    r = ras(spark, d)
    p = r.where("col % 7 = 0").select((F.col("row") * 64 + F.col("col")).alias("id"), (F.col("row") + 0.25).alias("r"), (F.col("col") + 0.5).alias("c"))
    return focal.bilinear(p, r).select("id", F.bround("v", 9).alias("v"))


_SURVEYS = """, s AS (SELECT 1 AS survey_index, "row", col, CASE WHEN z > 0.1 THEN z END AS z FROM ras UNION ALL SELECT 2, "row", col, CASE WHEN col % 2 = 0 THEN -z END FROM ras
  UNION ALL SELECT 3, "row", col, CASE WHEN "row" % 5 > 0 THEN z + 1 END FROM ras)"""


@C.add("survey_fill", over("ras", _SURVEYS + """, k AS (SELECT "row", col, min(CASE WHEN z IS NOT NULL THEN survey_index END) AS i FROM s GROUP BY 1, 2)
  SELECT k."row", k.col, s.z, coalesce(i, -1) AS survey FROM k LEFT JOIN s ON s."row" = k."row" AND s.col = k.col AND survey_index = i"""))
def survey_fill(spark, d):
    r = ras(spark, d)
    a = r.select(F.lit(1).alias("survey_index"), "row", "col", F.when(F.col("z") > 0.1, F.col("z")).alias("z"))
    b = r.select(F.lit(2).alias("survey_index"), "row", "col", F.when(F.col("col") % 2 == 0, -F.col("z")).alias("z"))
    c = r.select(F.lit(3).alias("survey_index"), "row", "col", F.when(F.col("row") % 5 > 0, F.col("z") + 1).alias("z"))
    return catalog.fill(a.unionByName(b).unionByName(c))


@C.add("mosaic_first_wins", over("ras", """, s AS (SELECT 0 AS k, "row", col, CASE WHEN z > 0 THEN z END AS z FROM ras UNION ALL SELECT 1, "row", col, abs(z) + 1 FROM ras WHERE col < 40)
  SELECT "row", col, arg_min(z, k) FILTER (z IS NOT NULL) AS z, coalesce(min(k) FILTER (z IS NOT NULL), -1) AS source FROM s GROUP BY 1, 2"""))
def mosaic_first_wins(spark, d):
    r = ras(spark, d)
    a = r.select(F.lit(0).alias("k"), "row", "col", F.when(F.col("z") > 0, F.col("z")).alias("z"))
    return focal.first_wins(a.unionByName(r.where("col < 40").select(F.lit(1).alias("k"), "row", "col", (F.abs("z") + 1).alias("z"))), "k")


@C.add("taper_blend", over("ras", """, w AS (SELECT "row", col, col % 16 AS j, "row" % 16 AS i, z AS p FROM ras UNION ALL SELECT "row", col, (col + 8) % 16, ("row" + 8) % 16, z + 1 FROM ras),
  t AS (SELECT *, pow(sin((i + 0.5) * pi() / 16), 2) * pow(sin((j + 0.5) * pi() / 16), 2) AS k FROM w)
  SELECT "row", col, round_even(sum(k * p) / sum(k), 6) AS p, count(*) AS n_windows FROM t GROUP BY 1, 2"""))
def taper_blend(spark, d):
    r = ras(spark, d)
    a = r.select("row", "col", (F.col("row") % 16).alias("i"), (F.col("col") % 16).alias("j"), F.col("z").alias("p"))
    b = r.select("row", "col", ((F.col("row") + 8) % 16).alias("i"), ((F.col("col") + 8) % 16).alias("j"), (F.col("z") + 1).alias("p"))
    return focal.taper_blend(a.unionByName(b), 16).select("row", "col", F.bround("p", 6).alias("p"), "n_windows")


@C.add("quantised_probability", over("ras", """SELECT "row", col, CASE WHEN z < -0.2 THEN 255 ELSE least(greatest(round_even(z * 250, 0), 0), 250) END::SMALLINT AS q FROM ras"""))
def quantised_probability(spark, d):
    r = ras(spark, d).withColumn("p", F.when(F.col("z") >= -0.2, F.col("z")))
    return r.select("row", "col", focal.quantise(F.col("p")).alias("q"))


@C.add("code_transitions", over("ras", """, a AS (SELECT "row", col, floor(z * 5)::BIGINT AS k FROM ras), b AS (SELECT "row", col, floor(z * 5 + 0.3)::BIGINT AS k FROM ras WHERE col < 50)
  SELECT a.k AS code_a, b.k AS code_b, count(*) AS n FROM a JOIN b USING ("row", col) GROUP BY 1, 2"""))
def code_transitions(spark, d):
    r = ras(spark, d)
    a, b = r.withColumn("k", F.floor(F.col("z") * 5)), r.where("col < 50").withColumn("k", F.floor(F.col("z") * 5 + 0.3))
    return compare.transitions(a, b, ["row", "col"], "k")


@C.add("dem_difference", over("ras", """, a AS (SELECT "row", col, z, "row" % 3 AS code FROM ras), b AS (SELECT "row", col, z * 2 AS z FROM ras WHERE col < 50), j AS (SELECT a.code, b.z - a.z AS d FROM a JOIN b USING ("row", col))
  SELECT code, count(*) AS n, round_even(avg(d), 6) AS mean, round_even(quantile_cont(d, 0.05), 9) AS p5, round_even(quantile_cont(d, 0.5), 9) AS median, round_even(quantile_cont(d, 0.95), 9) AS p95, max(abs(d)) AS max_abs FROM j GROUP BY code"""))
def dem_difference(spark, d):
    r = ras(spark, d).withColumn("code", F.col("row") % 3)
    b = r.where("col < 50").withColumn("z", F.col("z") * 2)
    return compare.difference_stats(r, b, ["row", "col"], "z", "code").withColumns({"mean": F.bround("mean", 6), **{c: F.bround(c, 9) for c in ("p5", "median", "p95")}})


@C.add("aoi_crop", over("ras", 'SELECT "row", col, z FROM ras WHERE "row" BETWEEN 10 AND 40 AND col BETWEEN 5 AND 20'))
def aoi_crop(spark, d):
    return ras(spark, d).where(F.col("row").between(10, 40) & F.col("col").between(5, 20))


@C.add("land_mask_gap", over("ras", """SELECT "row" // 50 AS part, count(*) AS n, count(CASE WHEN z > -0.1 THEN 1 END) AS n_land, round_even(1 - count(CASE WHEN z > 0 THEN 1 END) / count(CASE WHEN z > -0.1 THEN 1 END), 6) AS gap
  FROM ras GROUP BY 1"""))
def land_mask_gap(spark, d):
    r = ras(spark, d)
    land, valid = F.count(F.when(F.col("z") > -0.1, 1)), F.count(F.when(F.col("z") > 0, 1))
    return r.groupBy(F.floor(F.col("row") / 50).alias("part")).agg(F.count("*").alias("n"), land.alias("n_land"), F.bround(1 - valid / land, 6).alias("gap"))


@C.add("flip_north_up", over("ras", 'SELECT (SELECT max("row") FROM ras) - "row" AS "row", col, z FROM ras'))
def flip_north_up(spark, d):
    r = ras(spark, d)
    last = F.broadcast(table(spark, d, "embeddings").agg(F.max("vec_id").alias("last")))
    return r.crossJoin(last).select((F.col("last") - F.col("row")).alias("row"), "col", "z")
