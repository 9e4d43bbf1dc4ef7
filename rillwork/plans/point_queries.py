"""Queries on points: distance joins, labels, greedy choices, components, grid ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, grid
from ..operators import focal, graph, greedy, labels, near
from .views import Catalogue, over, pts

C = Catalogue()

_A = "a.x IS NOT NULL"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
EVEN, ODD = "kind % 2 = 0", "kind % 2 = 1"


def r6(c):
    return F.bround(c, 6) + F.lit(0.0)


def _two(spark, d):
    p = pts(spark, d)
    return p.where(EVEN), p.where(ODD)


_AB = f", ea AS (SELECT * FROM pts WHERE {EVEN}), ob AS (SELECT * FROM pts WHERE {ODD})\n"


@C.add("radius_join_inner", over("pts", f"{_AB} SELECT a.id AS a_id, b.id AS b_id, {_D} AS dist FROM ea a JOIN ob b ON {_D} <= 30"))
def radius_join_inner(spark, d):
    a, b = _two(spark, d)
    return near.near_pairs(a, b, 30.0).select("a_id", "b_id", "dist")


@C.add("radius_join_strict", over("pts", f"{_AB} SELECT a.id AS a_id, b.id AS b_id FROM ea a JOIN ob b ON {_D} < 30"))
def radius_join_strict(spark, d):
    a, b = _two(spark, d)
    return near.near_pairs(a, b, 30.0, strict=True).select("a_id", "b_id")


@C.add("radius_self_join", over("pts", f" SELECT a.id AS a_id, b.id AS b_id, {_D} AS dist FROM pts a JOIN pts b ON a.id < b.id AND {_D} <= 10"))
def radius_self_join(spark, d):
    return near.self_pairs(pts(spark, d).select("id", "x", "y"), 10.0).select("a_id", "b_id", "dist")


@C.add("radius_semi", over("pts", f"{_AB} SELECT id, x, y FROM ea a WHERE EXISTS (SELECT 1 FROM ob b WHERE {_D} <= 30)"))
def radius_semi(spark, d):
    a, b = _two(spark, d)
    return near.near_semi(a, b, 30.0).select("id", "x", "y")


@C.add("radius_anti", over("pts", f"{_AB} SELECT id, x, y FROM ea a WHERE NOT EXISTS (SELECT 1 FROM ob b WHERE {_D} <= 30)"))
def radius_anti(spark, d):
    a, b = _two(spark, d)
    return near.near_anti(a, b, 30.0).select("id", "x", "y")


_NEAREST = f"""{_AB}, n AS (SELECT a.id, b.id AS near_id, {_D} AS near_dist, b.w AS near_w,
  row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS k FROM ea a JOIN ob b ON {_D} <= 50)"""


@C.add("nearest_capped", over("pts", _NEAREST + " SELECT a.id, near_id, near_dist, near_w FROM ea a LEFT JOIN n ON n.id = a.id AND k = 1"))
def nearest_capped(spark, d):
    a, b = _two(spark, d)
    return near.nearest(a, b, 50.0, ("w",)).select("id", "near_id", "near_dist", "near_w")


@C.add("nearest_default_cap", over("pts", _NEAREST + " SELECT a.id, least(coalesce(near_dist, 500.0), 500.0) AS d FROM ea a LEFT JOIN n ON n.id = a.id AND k = 1"))
def nearest_default_cap(spark, d):
    from ..operators.rules import least_distance

    a, b = _two(spark, d)
    return near.nearest(a, b, 50.0).select("id", least_distance(F.col("near_dist"), F.lit(500.0)).alias("d"))


@C.add("k_nearest", over("pts", _NEAREST + " SELECT id AS a_id, near_id AS b_id, k AS rank FROM n WHERE k <= 3"))
def k_nearest(spark, d):
    a, b = _two(spark, d)
    return near.k_nearest(a, b, 50.0, 3).select("a_id", "b_id", F.col("rank").cast("long").alias("rank"))


@C.add("count_within", over("pts", f"{_AB} SELECT a.id, count(b.id) AS n_near FROM ea a LEFT JOIN ob b ON {_D} <= 50 GROUP BY a.id"))
def count_within(spark, d):
    a, b = _two(spark, d)
    return near.count_within(a, b, 50.0).select("id", "n_near")


@C.add("disk_stats", over("pts", f"""{_AB} SELECT a.id, max(b.w) AS v_max, min(b.w) AS v_min, count(b.w) AS v_n, round_even(avg(b.w), 6) AS v_mean
  FROM ea a LEFT JOIN ob b ON {_D} <= 50 GROUP BY a.id"""))
def disk_stats(spark, d):
    a, b = _two(spark, d)
    return near.disk_stats(a, b, "w", 50.0).select("id", "v_max", "v_min", "v_n", F.bround("v_mean", 6).alias("v_mean"))


@C.add("local_axis", over("pts", f"""{_AB}, m AS (SELECT a.id, covar_pop(b.x, b.y) AS cxy, var_pop(b.x) AS cxx, var_pop(b.y) AS cyy, count(*) AS n_axis
  FROM ea a JOIN ob b ON {_D} <= 60 GROUP BY a.id HAVING count(*) >= 3), g AS (SELECT id, n_axis, degrees(0.5 * atan2(2 * cxy, cxx - cyy)) AS t FROM m)
  SELECT id, n_axis, round_even(t - 180 * floor(t / 180), 4) AS axis_deg FROM g"""))
def local_axis(spark, d):
    a, b = _two(spark, d)
    return near.local_axis(a, b, 60.0).where("n_axis >= 3").select("id", "n_axis", F.bround("axis_deg", 4).alias("axis_deg"))


@C.add("facing_pairs", over("pts", f"""SELECT a.id AS a_id, b.id AS b_id FROM pts a JOIN pts b ON a.id < b.id AND {_D} <= 40 AND {_D} > 0
  AND (a.dx * (b.x - a.x) + a.dy * (b.y - a.y)) / (sqrt(a.dx * a.dx + a.dy * a.dy) * {_D}) >= 0.7
  AND -(b.dx * (b.x - a.x) + b.dy * (b.y - a.y)) / (sqrt(b.dx * b.dx + b.dy * b.dy) * {_D}) >= 0.7"""))
def facing_pairs(spark, d):
    return near.facing_pairs(pts(spark, d), 40.0, 0.7).select("a_id", "b_id")


_LABELS = f""", lab AS (SELECT id, x, y, CASE WHEN kind IN (1, 3) THEN 30.0::DOUBLE ELSE 20.0 END AS radius, kind AS priority, CASE WHEN kind < 6 THEN 1 ELSE 0 END AS value
  FROM pts WHERE {ODD}), can AS (SELECT id, x, y FROM pts WHERE {EVEN}),
 best AS (SELECT a.id AS label_id, b.id, {_D} AS dist, a.priority, a.value, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS k
  FROM lab a JOIN can b ON {_D} <= a.radius),
 own AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, label_id) AS r, count(*) OVER (PARTITION BY id) AS n_labels,
  min(value) OVER (PARTITION BY id) <> max(value) OVER (PARTITION BY id) AS conflict FROM best WHERE k = 1)"""


def _labels(spark, d):
    a, b = _two(spark, d)
    lab = b.select(
        "id", "x", "y", F.when(F.col("kind").isin(1, 3), 30.0).otherwise(20.0).alias("radius"), F.col("kind").alias("priority"), F.when(F.col("kind") < 6, 1).otherwise(0).alias("value")
    )
    return lab, a.select("id", "x", "y")


@C.add("label_match_priority", over("pts", _LABELS + " SELECT id, label_id, value, dist, n_labels FROM own WHERE r = 1"))
def label_match_priority(spark, d):
    lab, can = _labels(spark, d)
    return labels.match(lab, can, 30.0).select("id", "label_id", "value", "dist", "n_labels")


@C.add("label_conflicts", over("pts", _LABELS + " SELECT id, label_id FROM own WHERE r = 1 AND conflict"))
def label_conflicts(spark, d):
    lab, can = _labels(spark, d)
    return labels.match(lab, can, 30.0).where("conflict").select("id", "label_id")


@C.add("label_misses", over("pts", _LABELS + " SELECT id, radius FROM lab WHERE id NOT IN (SELECT label_id FROM best)"))
def label_misses(spark, d):
    lab, can = _labels(spark, d)
    return labels.misses(lab, can, 30.0).select("id", "radius")


@C.add("near_positive", over("pts", _LABELS + f""", p AS (SELECT c.* FROM can c JOIN own o ON o.id = c.id AND r = 1 AND value = 1)
  SELECT id FROM can a WHERE id NOT IN (SELECT id FROM own) AND EXISTS (SELECT 1 FROM p b WHERE {_D} <= 40)"""))
def near_positive(spark, d):
    lab, can = _labels(spark, d)
    return labels.near_positive(can, labels.match(lab, can, 30.0), 40.0).select("id")


@C.add("record_attach", over("pts", f"""{_AB}, n AS (SELECT a.id AS record, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS k FROM ob a JOIN ea b ON {_D} <= 15),
  g AS (SELECT id, string_agg(record::VARCHAR, ';' ORDER BY record) AS record_ids FROM n WHERE k = 1 GROUP BY id)
  SELECT e.id, e.x, e.y, g.id IS NOT NULL AS recorded, record_ids FROM ea e LEFT JOIN g ON g.id = e.id
  UNION ALL SELECT NULL, x, y, TRUE, id::VARCHAR FROM ob WHERE id NOT IN (SELECT record FROM n)"""))
def record_attach(spark, d):
    a, b = _two(spark, d)
    return labels.attach_records(b, a, 15.0)


@C.add("greedy_dedupe")
def greedy_dedupe(spark, d):
    p = pts(spark, d)
    e = near.self_pairs(p.select("id", "x", "y"), 30.0).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return greedy.independent_set(p.select("id", (-F.col("w")).alias("rank")), e)


@C.add("merge_candidates", over("pts", f""", e AS (SELECT a.id AS ai, b.id AS bi FROM pts a JOIN pts b ON a.id <> b.id AND {_D} <= 10)
  SELECT p.id, count(e.bi) AS n_within, coalesce(max(q.w), p.w) > p.w AS beaten FROM pts p LEFT JOIN e ON e.ai = p.id LEFT JOIN pts q ON q.id = e.bi GROUP BY p.id, p.w"""))
def merge_candidates(spark, d):
    p = pts(spark, d).select("id", "x", "y", "w")
    pairs = near.near_pairs(p, p, 10.0).where("a_id <> b_id").groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n_within"), F.max("b_w").alias("top"))
    return p.join(pairs, "id", "left").select("id", F.coalesce("n_within", F.lit(0)).alias("n_within"), (F.coalesce("top", F.col("w")) > F.col("w")).alias("beaten"))


@C.add("greedy_match")
def greedy_match(spark, d):
    return greedy.greedy_match(near.self_pairs(pts(spark, d).select("id", "x", "y"), 30.0).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"), F.col("dist").alias("cost")))


@C.add("two_links_per_end", over("pts", f""", c AS (SELECT a.id AS a_id, b.id AS b_id, {_D} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS k
  FROM pts a JOIN pts b ON a.id <> b.id AND {_D} <= 30), t AS (SELECT least(a_id, b_id) AS u, greatest(a_id, b_id) AS v, min(dist) AS dist FROM c WHERE k <= 2 GROUP BY 1, 2)
  SELECT u, v, dist FROM t"""))
def two_links_per_end(spark, d):
    p = pts(spark, d).select("id", "x", "y")
    from pyspark.sql import Window

    w = Window.partitionBy("a_id").orderBy("dist", "b_id")
    c = near.near_pairs(p, p, 30.0).where("a_id <> b_id").withColumn("k", F.row_number().over(w)).where("k <= 2")
    return c.groupBy(F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v")).agg(F.min("dist").alias("dist"))


def _close(radius: int, k: str = "") -> str:
    return f""", e{k} AS (SELECT a.id AS u, b.id AS v FROM pts a JOIN pts b ON a.id <> b.id AND {_D} <= {radius}),
 walk{k}(id, r) AS (SELECT id, id FROM pts UNION SELECT w.id, e.v FROM walk{k} w JOIN e{k} e ON e.u = w.r), lab{k} AS (SELECT id, min(r) AS label FROM walk{k} GROUP BY id)"""


_CLOSE = _close(25)
_SWEEP = (5, 10, 20)


def _components(spark, d, radius=25.0):
    p = pts(spark, d)
    e = near.self_pairs(p.select("id", "x", "y"), radius).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    return p, graph.components(p.select("id"), e)


@C.add("components", over("pts", _CLOSE + " SELECT id, label FROM lab", recursive=True))
def components(spark, d):
    return _components(spark, d)[1]


@C.add("component_anchor", over("pts", _CLOSE + """ SELECT label, count(*) AS n, max(greatest(abs(p.x), abs(p.y))) AS reach,
  CASE WHEN max(greatest(abs(p.x), abs(p.y))) >= 300 THEN 'edge' WHEN max(CASE WHEN p.kind = 3 THEN 1 ELSE 0 END) = 1 THEN 'river' WHEN max(CASE WHEN p.kind = 5 THEN 1 ELSE 0 END) = 1
  THEN 'pond' END AS anchor FROM lab JOIN pts p USING (id) GROUP BY label""", recursive=True))
def component_anchor(spark, d):
    p, lab = _components(spark, d)
    reach = F.max(F.greatest(F.abs("x"), F.abs("y")))
    a = lab.join(p, "id").groupBy("label").agg(F.count("*").alias("n"), reach.alias("reach"), F.max((F.col("kind") == 3).cast("int")).alias("r"), F.max((F.col("kind") == 5).cast("int")).alias("o"))
    return a.select("label", "n", "reach", F.when(F.col("reach") >= 300, "edge").when(F.col("r") == 1, "river").when(F.col("o") == 1, "pond").alias("anchor"))


@C.add("isolated_components", over("pts", _CLOSE + """, s AS (SELECT label, count(*) AS n FROM lab GROUP BY label)
  SELECT CASE WHEN n < 2 THEN 0 WHEN n < 3 THEN 1 WHEN n < 6 THEN 2 ELSE 3 END AS size_bin, count(*) AS n_components, sum(n)::BIGINT AS n_points FROM s GROUP BY 1""", recursive=True))
def isolated_components(spark, d):
    from ..functions.scalars import ladder

    s = _components(spark, d)[1].groupBy("label").agg(F.count("*").alias("n"))
    return s.groupBy(ladder(F.col("n"), [2, 3, 6]).alias("size_bin")).agg(F.count("*").alias("n_components"), F.sum("n").alias("n_points"))


@C.add("join_sweep", over("pts", "".join(f"{_close(r, str(r))}, n{r} AS (SELECT label, count(*) AS n FROM lab{r} GROUP BY label)" for r in _SWEEP)
  + " UNION ALL ".join(f" SELECT {r}.0::DOUBLE AS radius, count(*) AS n_components, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS isolated_share FROM n{r}" for r in _SWEEP), recursive=True))
def join_sweep(spark, d):
    out = None
    for radius in map(float, _SWEEP):
        lab = _components(spark, d, radius)[1].groupBy("label").agg(F.count("*").alias("n"))
        one = lab.agg(F.count("*").alias("n_components"), F.avg((F.col("n") == 1).cast("double")).alias("isolated_share")).withColumn("radius", F.lit(radius))
        out = one if out is None else out.unionByName(one)
    return out


@C.add("dangling_ends", over("pts", f"SELECT id, kind AS line, NOT EXISTS (SELECT 1 FROM pts b WHERE b.kind <> a.kind AND {_D} <= 20) AS dangling FROM pts a"))
def dangling_ends(spark, d):
    return graph.touching_ends(pts(spark, d).select("id", F.col("kind").alias("line"), "x", "y"), 20.0).select("id", "line", "dangling")


@C.add("snap_nodes", over("pts", _CLOSE + """, c AS (SELECT label, round_even(avg(x), 6) AS node_x, round_even(avg(y), 6) AS node_y, count(*) AS n_ends FROM lab JOIN pts USING (id) GROUP BY label)
  SELECT id, label AS node, node_x, node_y, n_ends FROM lab JOIN c USING (label)""", recursive=True))
def snap_nodes(spark, d):
    return graph.snap_nodes(pts(spark, d).select("id", "x", "y"), 25.0).select("id", "node", F.bround("node_x", 6).alias("node_x"), F.bround("node_y", 6).alias("node_y"), "n_ends")


_GRID = ", g AS (SELECT id, 1600000 + 1000 * x AS e, 5300000 + 1000 * y AS n FROM pts)"
_SHEET = f"""substr('{grid.LETTERS}', floor((floor((6234000 - n) / 36000) + 16) / 24)::BIGINT + 1, 1) || substr('{grid.LETTERS}', ((floor((6234000 - n) / 36000) + 16)::BIGINT % 24) + 1, 1)
  || lpad((floor((e - 1012000) / 24000) + 1)::BIGINT::VARCHAR, 2, '0')"""


def _grid(spark, d):
    p = pts(spark, d)
    return p.select("id", (F.lit(1_600_000) + 1000 * F.col("x")).alias("e"), (F.lit(5_300_000) + 1000 * F.col("y")).alias("n"))


@C.add("sheet_tile_id", over("pts", f"""{_GRID}, s AS (SELECT id, e, n, {_SHEET} AS sheet, floor((e - 1012000) / 24000) AS c, floor((6234000 - n) / 36000) AS r FROM g)
  SELECT id, sheet, sheet || '_5000_' || lpad((least(floor(((6234000 - r * 36000) - n) / 3600.0), 9) + 1)::BIGINT::VARCHAR, 2, '0')
  || lpad((least(floor((e - (1012000 + c * 24000)) / 2400.0), 9) + 1)::BIGINT::VARCHAR, 2, '0') AS tile FROM s"""))
def sheet_tile_id(spark, d):
    g = _grid(spark, d)
    return g.select("id", grid.sheet_tile(F.col("e"), F.col("n"), 50_000).alias("sheet"), grid.sheet_tile(F.col("e"), F.col("n"), 5_000).alias("tile"))


@C.add("tile_bounds", over("pts", f"""{_GRID}, s AS (SELECT DISTINCT {_SHEET} AS tile, floor((e - 1012000) / 24000) AS c, floor((6234000 - n) / 36000) AS r FROM g)
  SELECT tile, 1012000 + c * 24000 AS xmin, 6234000 - r * 36000 - 36000 AS ymin, 1012000 + c * 24000 + 24000 AS xmax, 6234000 - r * 36000 AS ymax FROM s"""))
def tile_bounds(spark, d):
    t = _grid(spark, d).select(grid.sheet_tile(F.col("e"), F.col("n"), 50_000).alias("tile")).distinct()
    b = grid.tile_bounds(F.col("tile"))
    return t.select("tile", *[b[k].alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])


@C.add("parent_tile", over("pts", f"{_GRID} SELECT DISTINCT {_SHEET} AS parent FROM g"))
def parent_tile(spark, d):
    t = _grid(spark, d).select(grid.sheet_tile(F.col("e"), F.col("n"), 1_000).alias("tile")).distinct()
    return t.select(grid.parent_tile(F.col("tile"), 50_000).alias("parent")).distinct()


@C.add("quadrant_id", over("pts", f"""{_GRID}, s AS (SELECT id, e, n, {_SHEET} AS sheet, floor((e - 1012000) / 24000) AS c, floor((6234000 - n) / 36000) AS r FROM g),
  t AS (SELECT *, least(floor((e - (1012000 + c * 24000)) / 4800.0), 4) AS tc, least(floor(((6234000 - r * 36000) - n) / 7200.0), 4) AS tr FROM s)
  SELECT id, sheet || '_10000_' || lpad((tr + 1)::BIGINT::VARCHAR, 2, '0') || lpad((tc + 1)::BIGINT::VARCHAR, 2, '0') || '_'
  || CASE WHEN n > 6234000 - r * 36000 - tr * 7200 - 3600 THEN 'N' ELSE 'S' END || CASE WHEN e >= 1012000 + c * 24000 + tc * 4800 + 2400 THEN 'E' ELSE 'W' END AS quadrant FROM t"""))
def quadrant_id(spark, d):
    return _grid(spark, d).select("id", grid.quadrant(F.col("e"), F.col("n")).alias("quadrant"))


@C.add("window_tiles", over("pts", f"""{_GRID}, b AS (SELECT id, unnest(range(floor((6234000 - (n + 3000)) / 3600)::BIGINT, ceil((6234000 - (n - 3000)) / 3600)::BIGINT)) AS tile_row,
  floor((e - 3000 - 1012000) / 2400)::BIGINT AS c0, ceil((e + 3000 - 1012000) / 2400)::BIGINT AS c1 FROM g), t AS (SELECT id, tile_row, unnest(range(c0, c1)) AS tile_col FROM b),
  m AS (SELECT id, tile_row, tile_col, 1012000 + (tile_col + 0.5::DOUBLE) * 2400 AS e, 6234000 - (tile_row + 0.5::DOUBLE) * 3600 AS n FROM t)
  SELECT id, tile_row, tile_col, {_SHEET} || '_5000_' || lpad((tile_row - 10 * floor(tile_row / 10) + 1)::BIGINT::VARCHAR, 2, '0')
  || lpad((tile_col - 10 * floor(tile_col / 10) + 1)::BIGINT::VARCHAR, 2, '0') AS tile FROM m"""))
def window_tiles(spark, d):
    g = _grid(spark, d).select("id", (F.col("e") - 3000).alias("xmin"), (F.col("n") - 3000).alias("ymin"), (F.col("e") + 3000).alias("xmax"), (F.col("n") + 3000).alias("ymax"))
    return grid.window_tiles(g, 5_000).select("id", "tile_row", "tile_col", "tile")


@C.add("regular_tile_id", over("pts", "SELECT id, 'T_' || floor((x + 1000) / 250)::BIGINT::VARCHAR || '_' || floor((y + 1000) / 250)::BIGINT::VARCHAR AS tile FROM pts"))
def regular_tile_id(spark, d):
    return pts(spark, d).select("id", grid.regular_tile(F.col("x"), F.col("y"), -1000.0, -1000.0, 250.0, 250.0).alias("tile"))


@C.add("idw_surface", over("pts", f""", s AS (SELECT * FROM pts WHERE {ODD}), q AS (SELECT * FROM pts WHERE {EVEN}),
  n AS (SELECT a.id, {_D} AS dist, b.w, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS k FROM q a JOIN s b ON {_D} <= 80),
  t AS (SELECT id, sum(w / greatest(dist, 1e-9)) / sum(1 / greatest(dist, 1e-9)) AS v, count(*) AS n_near FROM n WHERE k <= 12 GROUP BY id)
  SELECT q.id, n_near, round_even(v, 5) AS v FROM q LEFT JOIN t USING (id)"""))
def idw_surface(spark, d):
    a, b = _two(spark, d)
    return focal.idw(a.select("id", "x", "y"), b.select("id", "x", "y", F.col("w").alias("v")), 80.0).select("id", "n_near", F.bround("v", 5).alias("v"))


_LINE = ", l AS (SELECT id, x AS ax, y AS ay, x + dx AS bx, y + dy AS byy FROM pts)"


def _line(spark, d):
    p = pts(spark, d)
    line = F.array(
        F.struct(F.col("x").alias("x"), F.col("y").alias("y")),
        F.struct((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")),
        F.struct((F.col("x") + F.col("dx")).alias("x"), F.col("y").alias("y")),
    )
    return p.select("id", "x", "y", "dx", "dy", "w", line.alias("line"))


@C.add("line_measures", over("pts", """SELECT id, round_even(sqrt(dx * dx + dy * dy) + abs(dy), 6) AS length, round_even(abs(-dx * dy) / 2, 4) AS area,
  least(x, x + dx) AS xmin, greatest(y, y + dy) AS ymax FROM pts"""))
def line_measures(spark, d):
    g = _line(spark, d)
    b = geometry.bounds(F.col("line"))
    return g.select("id", F.bround(geometry.length(F.col("line")), 6).alias("length"), F.bround(F.abs(geometry.ring_area(F.col("line"))), 4).alias("area"), b["xmin"].alias("xmin"), b["ymax"].alias("ymax"))


_LEGS = ", l AS (SELECT id, x, y, dx, dy, sqrt(dx * dx + dy * dy) AS a, abs(dy) AS b FROM pts)"


@C.add("line_sampling", over("pts", f"""{_LEGS}, s AS (SELECT *, unnest(range(0, floor((a + b) / 25)::INT + 1))::INT AS k FROM l),
  t AS (SELECT *, CASE WHEN k * 25 <= a AND a > 0 THEN k * 25 / a ELSE 1 END AS u, CASE WHEN k * 25 > a AND b > 0 THEN least((k * 25 - a) / b, 1) ELSE 0 END AS v FROM s)
  SELECT id, k, round_even(x + u * dx, 6) AS x, round_even(y + (u - v) * dy, 6) AS y FROM t"""))
def line_sampling(spark, d):
    g = _line(spark, d)
    return g.select("id", F.posexplode(geometry.sample(F.col("line"), 25.0)).alias("k", "p")).select("id", "k", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@C.add("line_midpoint", over("pts", f"""{_LEGS}, t AS (SELECT *, CASE WHEN a > 0 THEN (a + b) / 2 / a ELSE 0 END AS u FROM l)
  SELECT id, round_even(x + u * dx, 6) AS x, round_even(y + u * dy, 6) AS y FROM t"""))
def line_midpoint(spark, d):
    return _line(spark, d).select("id", geometry.midpoint(F.col("line")).alias("p")).select("id", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@C.add("point_line_distance", over("pts", """SELECT id, round_even(CASE WHEN x <= 0 AND x + dx >= 0 OR x >= 0 AND x + dx <= 0 THEN abs(y) ELSE sqrt(least(x * x, (x + dx) * (x + dx)) + y * y) END, 6) AS dist FROM pts"""))
def point_line_distance(spark, d):
    p = pts(spark, d)
    line = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct((F.col("x") + F.col("dx")).alias("x"), F.col("y").alias("y")))
    return p.select("id", F.bround(geometry.point_distance(line, F.lit(0.0), F.lit(0.0)), 6).alias("dist"))


@C.add("point_in_ring", over("pts", "SELECT id, (x >= -100 AND x < 100 AND y >= -100 AND y < 100) AS inside FROM pts"))
def point_in_ring(spark, d):
    ring = F.array(*[geometry.point(x, y) for x, y in ((-100, -100), (100, -100), (100, 100), (-100, 100))])
    return pts(spark, d).select("id", geometry.in_ring(ring, F.col("x"), F.col("y")).alias("inside"))


@C.add("segment_crossings", over("pts", """, s AS (SELECT id, x AS ax, y AS ay, x + dx AS bx, y + dy AS b_y FROM pts)
  SELECT id, round_even(ay + (0 - ax) / (bx - ax) * (b_y - ay), 6) AS y FROM s WHERE bx <> ax AND (0 - ax) / (bx - ax) BETWEEN 0 AND 1 AND abs(ay + (0 - ax) / (bx - ax) * (b_y - ay)) <= 5000"""))
def segment_crossings(spark, d):
    p = pts(spark, d)
    z = F.lit(0.0)
    hit = geometry.segment_crossing(F.col("x"), F.col("y"), F.col("x") + F.col("dx"), F.col("y") + F.col("dy"), z, F.lit(-5000.0), z, F.lit(5000.0))
    return p.select("id", hit["hit"].alias("hit"), F.bround(hit["y"], 6).alias("y")).where("hit").select("id", "y")


@C.add("box_clip", over("pts", """, s AS (SELECT id, CASE WHEN dx > 0 THEN (-200 - x) / dx ELSE (200 - x) / dx END AS t0x, CASE WHEN dx > 0 THEN (200 - x) / dx ELSE (-200 - x) / dx END AS t1x,
  CASE WHEN dy > 0 THEN (-200 - y) / dy ELSE (200 - y) / dy END AS t0y, CASE WHEN dy > 0 THEN (200 - y) / dy ELSE (-200 - y) / dy END AS t1y FROM pts WHERE dx <> 0 AND dy <> 0)
  SELECT id, round_even(greatest(0, t0x, t0y), 9) AS t0, round_even(least(1, t1x, t1y), 9) AS t1 FROM s WHERE greatest(0, t0x, t0y) <= least(1, t1x, t1y)"""))
def box_clip(spark, d):
    p = pts(spark, d).where("dx <> 0 and dy <> 0")
    t = geometry.clip_segment(F.col("x"), F.col("y"), F.col("x") + F.col("dx"), F.col("y") + F.col("dy"), -200, -200, 200, 200)
    return p.select("id", F.bround(t["t0"], 9).alias("t0"), F.bround(t["t1"], 9).alias("t1")).where("t0 is not null")
