"""Queries on line sampling, ponds, evaluation, plans, sinks and completeness."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import focal, near, rules, vector
from ..session import materialize, ship_package
from ..sources import catalog, raster
from .views import Catalogue, cand, lnk, over, pts, ras, table, tree

C = Catalogue()

_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def b6(c):
    return F.bround(c, 6) + F.lit(0.0)


# horizontal lines through points, whole metres long, so that both engines step them alike
_LINES = """, l AS (SELECT id, floor(x) AS x0, floor(y) AS y, 40 + id % 60 AS len, kind FROM pts),
 s AS (SELECT id, kind, y, k, x0 + 10.0 * k AS x FROM (SELECT *, unnest(generate_series(0, len // 10)) AS k FROM l))"""


def _lines(spark, d):
    p = pts(spark, d).select("id", F.floor("x").cast("double").alias("x0"), F.floor("y").cast("double").alias("y"), (F.lit(40) + F.col("id") % 60).cast("double").alias("len"), "kind")
    line = F.array(F.struct(F.col("x0").alias("x"), F.col("y").alias("y")), F.struct((F.col("x0") + F.col("len")).alias("x"), F.col("y").alias("y")))
    return p.withColumn("line", line)


_TWO = _LINES + ", a AS (SELECT * FROM s WHERE kind % 2 = 0), b AS (SELECT * FROM s WHERE kind % 2 = 1)"


@C.add("overlap_share", over("pts", _TWO + f""" SELECT a.id AS line_id, round_even(avg(CASE WHEN EXISTS (SELECT 1 FROM b WHERE {_D} <= 8.5) THEN 1.0 ELSE 0.0 END), 9) AS share, count(*) AS n FROM a GROUP BY a.id"""))
def overlap_share(spark, d):
    l = _lines(spark, d)
    s = vector.overlap_share(l.where("kind % 2 = 0").select("id", "line"), l.where("kind % 2 = 1").select("id", "line"), 10.0, 8.5)
    return s.select("line_id", F.bround("share", 9).alias("share"), "n")


@C.add("best_overlap", over("pts", _TWO + f""", h AS (SELECT a.id, b.id AS r, count(DISTINCT a.k) AS hit FROM a JOIN b ON {_D} <= 20.5 GROUP BY 1, 2), n AS (SELECT id, count(*) AS n FROM a GROUP BY id),
  k AS (SELECT h.id, r, hit / n AS share, row_number() OVER (PARTITION BY h.id ORDER BY hit / n DESC, r) AS k FROM h JOIN n USING (id)) SELECT id AS line_id, r AS ref_id, share FROM k WHERE k = 1"""))
def best_overlap(spark, d):
    l = _lines(spark, d)
    return vector.best_overlap(l.where("kind % 2 = 0").select("id", "line"), l.where("kind % 2 = 1").select("id", "line"), 10.0, 20.5)


@C.add("segment_label", over("pts", """, t AS (SELECT id, (id % 11) / 10.0 AS a, (id % 7) / 6.0 AS b FROM pts) SELECT id, CASE WHEN a >= 0.6 AND a > b THEN 'a' WHEN b >= 0.6 THEN 'b' END AS label FROM t"""))
def segment_label(spark, d):
    return pts(spark, d).select("id", vector.segment_label((F.col("id") % 11) / F.lit(10.0), (F.col("id") % 7) / F.lit(6.0)).alias("label"))


@C.add("raster_along_lines", over("pts ras", _LINES + """, p AS (SELECT id, floor((abs(x) + 0.5) / 10) AS r, floor((abs(y) + 0.5) / 10) AS c FROM s)
  SELECT p.id AS line_id, count(z) AS n_hit, round_even(avg(z), 6) AS v_mean, min(z) AS v_min, max(z) AS v_max FROM p LEFT JOIN ras ON "row" = r AND col = c GROUP BY p.id"""))
def raster_along_lines(spark, d):
    p = vector.sample_points(_lines(spark, d).select("id", "line"), 10.0).select("line_id", (F.abs("y") + 0.5).alias("x"), (F.abs("x") + 0.5).alias("y"))
    r = vector.raster_along(p, ras(spark, d), 10.0)
    return r.select("line_id", "n_hit", F.bround("v_mean", 6).alias("v_mean"), "v_min", "v_max")


@C.add("cross_profiles", over("pts", """, l AS (SELECT id, floor(x) AS ax, floor(y) AS ay, 40 + id % 60 AS len FROM pts), k AS (SELECT *, unnest(generate_series(0, len // 20)) AS k FROM l), o AS (SELECT *, unnest([-5.0, 0.0, 5.0]) AS o FROM k)
  SELECT id, k::INT AS k, o::DOUBLE AS "offset", ax + 20.0 * k AS x, ay + o::DOUBLE AS y FROM o"""))
def cross_profiles(spark, d):
    p = pts(spark, d).select("id", F.floor("x").cast("double").alias("ax"), F.floor("y").cast("double").alias("ay"), (F.lit(40) + F.col("id") % 60).cast("double").alias("len"))
    l = p.select("id", "ax", "ay", (F.col("ax") + F.col("len")).alias("bx"), F.col("ay").alias("by"))
    c = vector.cross_profiles(l, 20.0, [-5.0, 0.0, 5.0])
    return c.select("id", "k", "offset", (F.col("x") + F.lit(0.0)).alias("x"), (F.col("y") + F.lit(0.0)).alias("y"))


_PROFILE = """, q AS (SELECT "row" AS id, col // 16 AS k, (col % 16 - 8)::DOUBLE AS o, z FROM ras)"""


def _profile(spark, d):
    return ras(spark, d).select(F.col("row").alias("id"), F.floor(F.col("col") / 16).alias("k"), (F.col("col") % 16 - 8).cast("double").alias("offset"), F.col("z").alias("v"))


@C.add("profile_contrast", over("ras", _PROFILE + """, p AS (SELECT id, k, avg(z) FILTER (abs(o) <= 2) AS c, avg(z) FILTER (o < -2 AND o >= -6) AS l, avg(z) FILTER (o > 2 AND o <= 6) AS r FROM q GROUP BY 1, 2)
  SELECT id, round_even(quantile_cont(CASE WHEN sign(c - l) = sign(c - r) THEN sign(c - l) * least(abs(c - l), abs(c - r)) ELSE 0 END, 0.5), 6) AS contrast, count(*) AS n_profiles FROM p GROUP BY id"""))
def profile_contrast(spark, d):
    return vector.profile_contrast(_profile(spark, d), 2.0, 6.0).select("id", b6("contrast").alias("contrast"), "n_profiles")


@C.add("lowest_offset", over("ras", _PROFILE + """, m AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY z, abs(o), o) AS n FROM q) SELECT id, k, o AS "offset", z AS v FROM m WHERE n = 1"""))
def lowest_offset(spark, d):
    return vector.lowest_offset(_profile(spark, d))


@C.add("mask_runs", over("ras", """, g AS (SELECT "row", col, col - row_number() OVER (PARTITION BY "row" ORDER BY col) AS g FROM ras WHERE z > 0.1) SELECT "row", min(col) AS first_col, max(col) AS last_col FROM g GROUP BY "row", g"""))
def mask_runs(spark, d):
    return vector.run_lengths(ras(spark, d).withColumn("hit", F.col("z") > 0.1), "hit")


@C.add("dilate_mask")
def dilate_mask(spark, d):
    """Cells within 3 cells of the mask; its SQL is quadratic."""
    r = _mask_cells(spark, d)
    return near.near_semi(r, r.where("z > 0.3"), 3.0).select("row", "col")


def _mask_cells(spark, d):
    return ras(spark, d).select((F.col("row") * 64 + F.col("col")).alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "row", "col", "z")


@C.add("share_in_window", over("ras", """, m AS (SELECT max("row") AS mr, max(col) AS mc FROM ras), f AS (SELECT "row", col, CASE WHEN z > 0.1 THEN 1 ELSE 0 END AS h FROM ras),
  a AS (SELECT *, sum(h) OVER (PARTITION BY "row" ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s1 FROM f), b AS (SELECT *, sum(s1) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM a)
  SELECT "row", col, s / 25 AS share FROM b"""))
def share_in_window(spark, d):
    f = ras(spark, d).withColumn("z", F.when(F.col("z") > 0.1, 1).otherwise(0))
    return focal.box(f, 5).select("row", "col", (F.col("v_sum") / 25).alias("share"))


@C.add("deck_height", over("ras", """, w AS (SELECT "row", col, max(z - 0.1) OVER (PARTITION BY "row" ORDER BY col RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS h FROM ras), v AS (SELECT "row", col, max(h) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS deck FROM w)
  SELECT "row", col, deck FROM v"""))
def deck_height(spark, d):
    r = ras(spark, d).withColumn("rise", F.col("z") - 0.1)
    return focal.separable(r, F.max, 9, "rise", "deck").select("row", "col", "deck")


_CUTS = """, l AS (SELECT id, 40.0::DOUBLE + id % 60 AS length FROM pts), c AS (SELECT DISTINCT id, "at" FROM (SELECT id, (id % 13) * 5.0::DOUBLE AS "at" FROM pts UNION ALL SELECT id, (id % 7) * 9.0::DOUBLE FROM pts) WHERE "at" > 0 AND "at" < 40 + id % 60),
 s AS (SELECT id, "at" FROM c UNION ALL SELECT id, 0 FROM l UNION ALL SELECT id, length FROM l), p AS (SELECT id, "at" AS from_m, lead("at") OVER (PARTITION BY id ORDER BY "at") AS to_m, row_number() OVER (PARTITION BY id ORDER BY "at") - 1 AS piece FROM s)"""


@C.add("split_at_touches", over("pts", _CUTS + " SELECT id, piece, from_m, to_m FROM p WHERE to_m > from_m"))
def split_at_touches(spark, d):
    p = pts(spark, d)
    l = p.select("id", (F.lit(40.0) + F.col("id") % 60).alias("length"))
    c = p.select("id", (F.col("id") % 13 * 5.0).alias("at")).unionByName(p.select("id", (F.col("id") % 7 * 9.0).alias("at")))
    return vector.split_at(l, c).select("id", F.col("piece").cast("long").alias("piece"), "from_m", "to_m")


@C.add("even_pieces", over("pts", """, l AS (SELECT id, 40.0::DOUBLE + id % 60 AS length, ceil((40.0 + id % 60) / 25)::INT AS n FROM pts), k AS (SELECT *, unnest(generate_series(0, n - 1)) AS piece FROM l)
  SELECT id, piece::INT AS piece, round_even(length * piece / n, 9) AS from_m, round_even(length * (piece + 1) / n, 9) AS to_m FROM k"""))
def even_pieces(spark, d):
    p = vector.even_pieces(pts(spark, d).select("id", (F.lit(40.0) + F.col("id") % 60).alias("length")), 25.0)
    return p.select("id", "piece", F.bround("from_m", 9).alias("from_m"), F.bround("to_m", 9).alias("to_m"))


_POND = """, c AS (SELECT "row", col, z AS depth, "row" // 10 * 10 + col // 16 AS pond, ("row" * 64 + col) * 37 % 1009 AS area, CASE WHEN col % 16 = 15 THEN NULL ELSE "row" // 10 * 10 + col // 16 END AS to_pond FROM ras),
 o AS (SELECT *, row_number() OVER (PARTITION BY pond ORDER BY CASE WHEN to_pond IS DISTINCT FROM pond THEN area ELSE -1 END DESC, "row", col) AS k, count(*) FILTER (to_pond IS DISTINCT FROM pond) OVER (PARTITION BY pond) AS n_out FROM c WHERE depth > 0.15),
 p AS (SELECT pond, count(*) * 4.0::DOUBLE AS area_m2, round_even(sum(depth) * 4, 6) AS volume_m3, max(depth) AS max_depth, max("row") FILTER (k = 1 AND n_out > 0) AS outlet_row, max(col) FILTER (k = 1 AND n_out > 0) AS outlet_col FROM o GROUP BY pond)"""


def _ponds(spark, d):
    k = F.floor(F.col("row") / 10) * 10 + F.floor(F.col("col") / 16)
    c = ras(spark, d).select("row", "col", F.col("z").alias("depth"), k.alias("pond"), ((F.col("row") * 64 + F.col("col")) * 37 % 1009).alias("area"), F.when(F.col("col") % 16 != 15, k).alias("to_pond"))
    return vector.ponds(c, 2.0, 0.15, 20.0)


@C.add("pond_table", over("ras", _POND + " SELECT pond, area_m2, volume_m3, max_depth, outlet_row, outlet_col FROM p WHERE area_m2 >= 20"))
def pond_table(spark, d):
    return _ponds(spark, d).select("pond", "area_m2", F.bround("volume_m3", 6).alias("volume_m3"), "max_depth", "outlet_row", "outlet_col")


@C.add("pond_status", over("ras pts", _POND + """, n AS (SELECT pond, count(q.id) AS n FROM p LEFT JOIN (SELECT id, (id * 3 % 64)::DOUBLE AS x, (id * 7 % 500)::DOUBLE AS y FROM pts) q ON sqrt((outlet_col - q.x) * (outlet_col - q.x) + (outlet_row - q.y) * (outlet_row - q.y)) <= 5 GROUP BY pond)
  SELECT pond, n AS n_candidates, CASE WHEN outlet_row IS NULL THEN 'closed' WHEN n > 0 THEN 'inflow_candidate_at_outlet' ELSE 'inflow_no_candidate' END AS status FROM p JOIN n USING (pond) WHERE area_m2 >= 20"""))
def pond_status(spark, d):
    c = pts(spark, d).select("id", (F.col("id") * 3 % 64).cast("double").alias("x"), (F.col("id") * 7 % 500).cast("double").alias("y"))
    return vector.pond_status(materialize(_ponds(spark, d), "ponds"), c, 5.0).select("pond", "n_candidates", "status")


@C.add("outlet_choice", over("tree", "SELECT id, 'band' AS kind, area AS z FROM tree WHERE id % 100 = 7"))
def outlet_choice(spark, d):
    t = tree(spark, d)
    kind = F.when(F.col("id") % 100 == 7, "band").when(F.col("id") % 10 == 3, "coverage").otherwise("lowest")
    return vector.choose_outlet(t.select("id", kind.alias("kind"), F.col("area").alias("z")))


@C.add("lowest_outlet", over("tree", "SELECT id, 'lowest' AS kind, area AS z FROM tree ORDER BY area, id LIMIT 1"))
def lowest_outlet(spark, d):
    return vector.choose_outlet(tree(spark, d).select("id", F.lit("lowest").alias("kind"), F.col("area").alias("z")))


@C.add("top_mouths", over("tree", "SELECT id, area FROM tree ORDER BY area DESC, id LIMIT 5"))
def top_mouths(spark, d):
    return tree(spark, d).orderBy(F.desc("area"), "id").limit(5).select("id", "area")


@C.add("tile_window_share", over("pts", """, b AS (SELECT id, x AS xmin, y AS ymin, x + 40 AS xmax, y + 60 AS ymax FROM pts), c AS (SELECT *, least(xmax, 100) - greatest(xmin, -100) AS w, least(ymax, 100) - greatest(ymin, -100) AS h FROM b)
  SELECT id, round_even(w * h / 2400, 9) AS share FROM c WHERE w > 0 AND h > 0"""))
def tile_window_share(spark, d):
    x, y = F.col("x"), F.col("y")
    a = {"xmin": x, "ymin": y, "xmax": x + 40, "ymax": y + 60}
    box = {"xmin": F.lit(-100.0), "ymin": F.lit(-100.0), "xmax": F.lit(100.0), "ymax": F.lit(100.0)}
    return pts(spark, d).select("id", F.bround(vector.box_share(a, box), 9).alias("share")).where("share > 0")


@C.add("bbox_scan", over("pts", "SELECT id, x, y FROM pts WHERE x <= 100 AND x >= -50 AND y <= 80 AND y >= -80"))
def bbox_scan(spark, d):
    p = pts(spark, d).withColumns({"xmin": F.col("x"), "xmax": F.col("x"), "ymin": F.col("y"), "ymax": F.col("y")})
    return p.where(catalog.meets((-50.0, -80.0, 100.0, 80.0))).select("id", "x", "y")


@C.add("rgb_fill", over("ras", """, s AS (SELECT 1 AS k, "row" // 4 AS r, col // 4 AS c, z AS a, z * 2 AS b FROM ras WHERE col < 32 UNION ALL SELECT 2, "row" // 4, col // 4, z + 1, z + 2 FROM ras), m AS (SELECT k, r, c, round_even(avg(a), 6) AS a, round_even(avg(b), 6) AS b FROM s GROUP BY 1, 2, 3)
  SELECT r AS "row", c AS col, arg_min(a, k) AS red, arg_min(b, k) AS green, min(k) AS survey FROM m GROUP BY 1, 2"""))
def rgb_fill(spark, d):
    r = ras(spark, d)
    one = raster.resample_mean(r.where("col < 32").select("row", "col", F.col("z").alias("red"), (F.col("z") * 2).alias("green")), 4, ["red", "green"]).withColumn("k", F.lit(1))
    two = raster.resample_mean(r.select("row", "col", (F.col("z") + 1).alias("red"), (F.col("z") + 2).alias("green")), 4, ["red", "green"]).withColumn("k", F.lit(2))
    m = one.unionByName(two).groupBy("row", "col").agg(F.min(F.struct("k", "red", "green")).alias("m"))
    return m.select("row", "col", b6("m.red").alias("red"), b6("m.green").alias("green"), F.col("m.k").alias("survey"))


@C.add("chunk_round_trip", over("ras", 'SELECT "row", col, (z::FLOAT)::DOUBLE AS z FROM ras'))
def chunk_round_trip(spark, d):
    return raster.chunks_to_cells(raster.cells_to_chunks(ras(spark, d), 16)).select("row", "col", "z")


@C.add("band_stack", over("ras", 'SELECT "row", col, (z::FLOAT)::DOUBLE AS a, CASE WHEN col < 40 THEN ((z * 2)::FLOAT)::DOUBLE END AS b, col < 40 AS complete FROM ras'))
def band_stack(spark, d):
    r = ras(spark, d)
    return raster.band_stack({"a": raster.cells_to_chunks(r, 16), "b": raster.cells_to_chunks(r.where("col < 40").withColumn("z", F.col("z") * 2), 16)})


@C.add("product_round_trip", over("ras", 'SELECT "row", col, (z::FLOAT)::DOUBLE AS z FROM ras'))
def product_round_trip(spark, d):
    return _product_round_trip(spark, ras(spark, d))


def _product_round_trip(spark, cells):
    path = raster.scratch_product(spark)
    raster.write_product({"z": cells}, path, {"cell": 1.0}, 32)
    return raster.chunks_to_cells(raster.read_product(spark, path)[0]).select("row", "col", "z")


@C.add("chip_statistics", over("ras", 'SELECT "row" // 32 AS cr, col // 32 AS cc, count(z) AS n, round_even(avg(z), 6) AS mean, round_even(sqrt(greatest(avg(z * z) - avg(z) * avg(z), 0)), 6) AS sd FROM ras GROUP BY 1, 2'))
def chip_statistics(spark, d):
    z = F.col("z")
    a = ras(spark, d).groupBy(F.floor(F.col("row") / 32).alias("cr"), F.floor(F.col("col") / 32).alias("cc")).agg(F.count(z).alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("q"))
    mean = F.col("s") / F.col("n")
    return a.select("cr", "cc", "n", b6(mean).alias("mean"), b6(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))).alias("sd"))


@C.add("analytic_scene")
def analytic_scene(spark, d):
    return raster.analytic_scene(spark, 64, 48)


@C.add("inventory_recall", over("pts", f""", c AS (SELECT * FROM pts WHERE kind % 2 = 0), i AS (SELECT * FROM pts WHERE kind % 2 = 1), f AS (SELECT a.id, a.kind, EXISTS (SELECT 1 FROM c b WHERE {_D} <= 15) AS found FROM i a)
  SELECT kind, count(*) AS n, round_even(avg(CASE WHEN found THEN 1.0 ELSE 0.0 END), 9) AS recall FROM f GROUP BY kind"""))
def inventory_recall(spark, d):
    p = pts(spark, d)
    n = near.nearest(p.where("kind % 2 = 1"), p.where("kind % 2 = 0"), 15.0)
    return n.groupBy("kind").agg(F.count("*").alias("n"), F.bround(F.avg(F.col("near_id").isNotNull().cast("double")), 9).alias("recall"))


@C.add("candidate_labels", over("pts", f""", h AS (SELECT a.id, min(CASE WHEN b.kind = 1 THEN 0 WHEN b.kind = 3 THEN 1 ELSE 2 END) AS best FROM pts a JOIN pts b ON a.kind % 2 = 0 AND b.kind % 2 = 1 AND {_D} <= 25 GROUP BY a.id)
  SELECT a.id, CASE best WHEN 0 THEN 'y' WHEN 1 THEN 'unsure' WHEN 2 THEN 'n' END AS label, round_even(log10(1 + greatest(a.w, 0)), 6) AS f FROM pts a LEFT JOIN h USING (id) WHERE a.kind % 2 = 0"""))
def candidate_labels(spark, d):
    p = pts(spark, d)
    hits = near.near_pairs(p.where("kind % 2 = 0").select("id", "x", "y"), p.where("kind % 2 = 1").select("id", "x", "y", "kind"), 25.0)
    best = hits.groupBy(F.col("a_id").alias("id")).agg(F.min(F.when(F.col("b_kind") == 1, 0).when(F.col("b_kind") == 3, 1).otherwise(2)).alias("best"))
    return p.where("kind % 2 = 0").join(best, "id", "left").select("id", rules.lookup(F.col("best"), {0: "y", 1: "unsure", 2: "n"}).alias("label"), b6(F.log10(1 + F.greatest("w", F.lit(0.0)))).alias("f"))


@C.add("topk_label_hits", over("pts", f""", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY w DESC, id) AS k FROM pts WHERE kind % 2 = 0) WHERE k <= 20) SELECT id FROM pts a WHERE kind % 2 = 1 AND EXISTS (SELECT 1 FROM t b WHERE {_D} <= 25)"""))
def topk_label_hits(spark, d):
    from ..operators.windows import top_k

    p = pts(spark, d)
    return near.near_semi(p.where("kind % 2 = 1"), top_k(p.where("kind % 2 = 0"), ["kind"], 20, F.desc("w"), F.col("id")).drop("rank"), 25.0).select("id")


@C.add("class_accuracy", over("pts", f""", a AS (SELECT * FROM pts WHERE id % 2 = 0), b AS (SELECT * FROM pts WHERE id % 2 = 1), n AS (SELECT a.id, a.kind % 3 AS c, b.kind % 3 AS t, abs(a.w) AS len, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS k FROM a JOIN b ON {_D} <= 40)
  SELECT t AS truth, count(*) AS n, round_even(sum(CASE WHEN c = t THEN len ELSE 0 END) / sum(len), 6) AS share FROM n WHERE k = 1 GROUP BY t"""))
def class_accuracy(spark, d):
    p = pts(spark, d)
    n = near.nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 40.0, ("kind",)).where("near_id is not null")
    n = n.select((F.col("kind") % 3).alias("c"), (F.col("near_kind") % 3).alias("truth"), F.abs("w").alias("len"))
    return n.groupBy("truth").agg(F.count("*").alias("n"), b6(F.sum(F.when(F.col("c") == F.col("truth"), F.col("len")).otherwise(0.0)) / F.sum("len")).alias("share"))


@C.add("layer_probe", over("pts", f""", q AS (SELECT * FROM pts WHERE id % 50 = 0), n AS (SELECT a.id, b.kind AS layer, b.id AS near_id, {_D} AS dist, row_number() OVER (PARTITION BY a.id, b.kind ORDER BY {_D}, b.id) AS k FROM q a JOIN pts b ON a.id <> b.id AND {_D} <= 100)
  SELECT id, layer, near_id, dist FROM n WHERE k = 1"""))
def layer_probe(spark, d):
    p = pts(spark, d)
    m = near.near_pairs(p.where("id % 50 = 0").select("id", "x", "y"), p.select("id", "x", "y", "kind"), 100.0).where("a_id <> b_id")
    m = m.groupBy(F.col("a_id").alias("id"), F.col("b_kind").alias("layer")).agg(F.min(F.struct("dist", "b_id")).alias("m"))
    return m.select("id", "layer", F.col("m.b_id").alias("near_id"), F.col("m.dist").alias("dist"))


@C.add("hausdorff_pairs", over("pts", f""", a AS (SELECT kind AS key, x, y FROM pts WHERE id % 2 = 0), b AS (SELECT kind AS key, x, y FROM pts WHERE id % 2 = 1), p AS (SELECT a.key, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, {_D} AS d FROM a JOIN b USING (key)),
  u AS (SELECT key, max(m) AS m FROM (SELECT key, ax, ay, min(d) AS m FROM p GROUP BY 1, 2, 3) GROUP BY key), v AS (SELECT key, max(m) AS m FROM (SELECT key, bx, b_y, min(d) AS m FROM p GROUP BY 1, 2, 3) GROUP BY key)
  SELECT key, round_even(greatest(u.m, v.m), 6) AS distance FROM u JOIN v USING (key)"""))
def hausdorff_pairs(spark, d):
    p = pts(spark, d).select(F.col("kind").alias("key"), "id", "x", "y")
    return vector.sampled_hausdorff(p.where("id % 2 = 0"), p.where("id % 2 = 1")).select("key", b6("distance").alias("distance"))


@C.add("step_plan", """WITH RECURSIVE steps(step, needs) AS (VALUES ('fetch', ''), ('build', 'fetch'), ('features', 'build'), ('train', 'features'), ('score', 'train'), ('report', 'build')),
  lev(step, depth) AS (SELECT step, 0 FROM steps WHERE needs = '' UNION ALL SELECT s.step, l.depth + 1 FROM lev l JOIN steps s ON s.needs = l.step) SELECT step, max(depth) AS depth FROM lev GROUP BY step""")
def step_plan(spark, d):
    """Steps with needs in an order that respects them, by levels of a recursive query."""
    steps = spark.createDataFrame([("fetch", ""), ("build", "fetch"), ("features", "build"), ("train", "features"), ("score", "train"), ("report", "build")], "step string, needs string")
    steps.createOrReplaceTempView("rillwork_steps")
    return spark.sql("""WITH RECURSIVE lev(step, depth) AS (SELECT step, 0 FROM rillwork_steps WHERE needs = '' UNION ALL SELECT s.step, l.depth + 1 FROM lev l JOIN rillwork_steps s ON s.needs = l.step)
      SELECT step, max(depth) AS depth FROM lev GROUP BY step""")


@C.add("completeness_checks", """WITH t AS (SELECT o_custkey % 20 AS tile, count(*) AS n, count(DISTINCT o_orderstatus) AS k, max(o_totalprice) AS top FROM orders GROUP BY 1)
  SELECT tile, concat_ws(';', CASE WHEN n < 60 THEN 'few' END, CASE WHEN k < 3 THEN 'classes' END, CASE WHEN top < 400000 THEN 'low' END) AS issues FROM t""")
def completeness_checks(spark, d):
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("tile")).agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("k"), F.max("o_totalprice").alias("top"))
    return o.select("tile", F.concat_ws(";", F.when(F.col("n") < 60, "few"), F.when(F.col("k") < 3, "classes"), F.when(F.col("top") < 400000, "low")).alias("issues"))


@C.add("provenance_rows", """SELECT o_orderpriority AS layer, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS checksum, count(*) AS n FROM orders GROUP BY 1""")
def provenance_rows(spark, d):
    return _provenance(table(spark, d, "orders"))


def _provenance(orders):
    """Layers are read in key order and hashed as they pass, so no list of a layer's keys is held."""

    def work(batches):
        layer, sha, n, started = None, hashlib.sha256(), 0, False
        for batch in batches:
            out = []
            for own, key in zip(batch.column("layer").to_pylist(), batch.column("key").to_pylist()):
                if n and own != layer:
                    out.append((layer, sha.hexdigest() if started else None, n))
                    sha, n, started = hashlib.sha256(), 0, False
                layer, n = own, n + 1
                if key is not None:
                    sha.update(f",{key}".encode() if started else str(key).encode())
                    started = True
            yield _provenance_batch(out)
        yield _provenance_batch([(layer, sha.hexdigest() if started else None, n)] if n else [])

    ship_package(orders.sparkSession)
    o = orders.select(F.col("o_orderpriority").alias("layer"), F.col("o_orderkey").alias("key"))
    return o.repartition("layer").sortWithinPartitions("layer", "key").mapInArrow(work, "layer string, checksum string, n long")


def _provenance_batch(rows):
    kinds = pa.schema([("layer", pa.string()), ("checksum", pa.string()), ("n", pa.int64())])
    return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)


@C.add("evidence_union", over("cand", "SELECT id, 'cand' AS source, score, NULL::BIGINT AS u FROM cand WHERE tile = 3 UNION ALL SELECT o, 'link', NULL, u FROM (SELECT l_orderkey AS o, l_suppkey AS u FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45)"))
def evidence_union(spark, d):
    a = cand(spark, d).where("tile = 3").select("id", F.lit("cand").alias("source"), "score")
    b = lnk(spark, d).where("ln = 1 and length > 45").select(F.col("o").alias("id"), F.lit("link").alias("source"), "u")
    return a.unionByName(b, allowMissingColumns=True)


@C.add("weighted_class_widths", over("lnk", """, w AS (SELECT u, sum(length * price) / sum(length) AS v, sum(length) AS len FROM lnk WHERE flag = 'N' GROUP BY u HAVING sum(length) >= 100) SELECT u, round_even(v, 4) AS width, len FROM w"""))
def weighted_class_widths(spark, d):
    w = lnk(spark, d).where("flag = 'N'").groupBy("u").agg((F.sum(F.col("length") * F.col("price")) / F.sum("length")).alias("v"), F.sum("length").alias("len")).where("len >= 100")
    return w.select("u", F.bround("v", 4).alias("width"), "len")


@C.add("component_filter", over("lnk", """SELECT u, sum(length) AS len, quantile_cont(rise, 0.5) AS med FROM lnk GROUP BY u HAVING sum(length) >= 50 AND NOT (sum(length) < 1500 AND quantile_cont(rise, 0.5) < 0.05)"""))
def component_filter(spark, d):
    a = lnk(spark, d).groupBy("u").agg(F.sum("length").alias("len"), F.percentile("rise", 0.5).alias("med"))
    return a.where((F.col("len") >= 50) & ~((F.col("len") < 1500) & (F.col("med") < 0.05)))


@C.add("waterway_systems", over("lnk", """, s AS (SELECT u, sum(CASE flag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END * length) AS w, arg_min(v, {'p': price, 'v': v}) AS lowest FROM lnk GROUP BY u) SELECT u, w, lowest FROM s ORDER BY w DESC, u LIMIT 10"""))
def waterway_systems(spark, d):
    rank = rules.lookup(F.col("flag"), {"A": 3, "N": 2}, 1)
    a = lnk(spark, d).groupBy("u").agg(F.sum(rank * F.col("length")).alias("w"), F.min(F.struct("price", "v")).alias("m"))
    return a.orderBy(F.desc("w"), "u").limit(10).select("u", "w", F.col("m.v").alias("lowest"))


@C.add("trim_heads", over("lnk", """, k AS (SELECT u, o, ln, v, prob, row_number() OVER (PARTITION BY u ORDER BY o, ln, v, price, length, rise) AS k FROM lnk), f AS (SELECT u, min(k) AS first FROM k WHERE prob >= 0.6 GROUP BY u)
  SELECT u, first AS kept_from FROM f"""))
def trim_heads(spark, d):
    w = Window.partitionBy("u").orderBy("o", "ln", "v", "price", "length", "rise")
    k = lnk(spark, d).withColumn("k", F.row_number().over(w).cast("long"))
    return k.where("prob >= 0.6").groupBy("u").agg(F.min("k").alias("kept_from"))


@C.add("band_units", """SELECT * FROM (VALUES ('relief_5', 'm', 5.0::DOUBLE), ('white_21', 'm', 21.0), ('open_up', 'deg', NULL), ('valley_2', '1/m', 2.0), ('other', '', NULL)) t(band, unit, scale)""")
def band_units(spark, d):
    b = spark.createDataFrame([(x,) for x in ("relief_5", "white_21", "open_up", "valley_2", "other")], "band string")
    stem = F.regexp_extract("band", r"^([a-z]+)", 1)
    unit = rules.lookup(stem, {"relief": "m", "white": "m", "black": "m", "open": "deg", "valley": "1/m", "ridge": "1/m"}, "")
    return b.select("band", unit.alias("unit"), F.regexp_extract("band", r"_(\d+)$", 1).try_cast("double").alias("scale"))


@C.add("settings_diff", "SELECT 'links.max_m' AS key, '30.0' AS a, '25.0' AS b")
def settings_diff(spark, d):
    from dataclasses import asdict

    from ..config import Config

    a, b = scalars.flatten(asdict(Config())), scalars.flatten(asdict(Config().with_options(links={"max_m": 25.0})))
    rows = [(k, str(a.get(k)), str(b.get(k))) for k in sorted(a | b) if a.get(k) != b.get(k)]
    return spark.createDataFrame(rows, "key string, a string, b string")


@C.add("content_keys", """SELECT p_partkey AS id, substr(sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || p_size || '}'), 1, 16) AS key FROM part""")
def content_keys(spark, d):
    key = scalars.content_key_of({"key": F.col("p_partkey"), "brand": F.col("p_brand"), "size": F.col("p_size")})
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), key.alias("key"))


@C.add("simplified_lines")
def simplified_lines(spark, d):
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    from ..session import ship_package

    ship_package(spark)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [geometry.simplify(np.column_stack([np.arange(len(v)), np.asarray(v, float) * 10]), 1.5).tolist() for v in pdf["embedding"]]
            yield pd.DataFrame({"id": pdf["vec_id"], "kept": kept})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(work, "id long, kept array<int>")
