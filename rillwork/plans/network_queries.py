"""Queries on links, profiles and trees: rules, runs along lines, paths, orders, propagation, smoothing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, rules, windows
from .views import Catalogue, lnk, over, prof, tree

C = Catalogue()


def b6(c):
    return F.bround(c, 6) + F.lit(0.0)


_LINK = """, a AS (SELECT *, length AS len, (length::INT % 5) / 5.0 AS mask, CASE status WHEN 'F' THEN 'high' ELSE 'none' END AS tier FROM lnk),
 p AS (SELECT *, CASE WHEN tier = 'high' THEN 0.8 ELSE 0.0 END AS pt, greatest(prob, mask) AS e FROM a),
 q AS (SELECT *, (road OR rise > 0.3) AND pt > 0 AS is_crossing, (1 - (1 - e) * (1 - exp(-len / 10))) * CASE WHEN road THEN 0.05 ELSE 1 END * exp(-greatest(rise, 0) / 0.3) AS own FROM p),
 s AS (SELECT *, CASE WHEN is_crossing THEN pt ELSE own END AS p_link FROM q)"""


def _links(spark, d):
    a = lnk(spark, d).withColumns({"mask": (F.col("length").cast("int") % 5) / F.lit(5.0), "tier": F.when(F.col("status") == "F", "high").otherwise("none")})
    return a.withColumns(rules.link_probability(F.col("length"), F.col("rise"), F.col("prob"), F.col("mask"), F.col("road"), F.col("tier")))


@C.add("link_probability", over("lnk", _LINK + " SELECT o, ln, u, v, length, round_even(p_link, 6) AS p_link, is_crossing FROM s"))
def link_probability(spark, d):
    return _links(spark, d).select("o", "ln", "u", "v", "length", b6("p_link").alias("p_link"), "is_crossing")


@C.add("link_reason", over("lnk", _LINK + " SELECT reason, count(*) AS n FROM (SELECT CASE WHEN len > 30 THEN 'too_long' WHEN round_even(p_link, 9) < 0.5 THEN 'improbable' ELSE '' END AS reason FROM s) GROUP BY 1"))
def link_reason(spark, d):
    return _links(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@C.add("minor_predicate", over("lnk", """SELECT o, ln, u, length, (ln = 7) OR (flag <> 'A' AND flag <> 'R' AND status <> 'O' AND (CASE WHEN rise = 0 THEN 0 ELSE length / 10 END < 1.5 OR prob < 0.3)) AS minor FROM lnk"""))
def minor_predicate(spark, d):
    a = lnk(spark, d)
    kind = F.when(F.col("flag") == "A", "stream").otherwise("drain")
    osm = F.when(F.col("status") == "O", "canal").otherwise("ditch")
    m = rules.is_minor(kind, F.col("flag") == "R", osm, F.col("ln") == 7, F.when(F.col("rise") > 0, F.col("length") / 10), F.col("prob"))
    return a.select("o", "ln", "u", "length", m.alias("minor"))


_SRC = """, a AS (SELECT *, list_filter([CASE WHEN flag = 'A' THEN 'testA' END, CASE WHEN status = 'F' THEN 'gap' END, CASE WHEN ln % 2 = 0 THEN 'road_x_drain' END], lambda x: x IS NOT NULL) AS src,
  rise * 10 AS h, prob * 0.7 AS veg, length AS road_m, CASE WHEN ln = 1 THEN NULL ELSE length / 10 END AS deck FROM lnk),
 b AS (SELECT *, list_contains(src, 'road_x_drain') AS rs, road_m <= 15 AS near, list_contains(src, 'gap') AS net, len(src) AS n FROM a),
 c AS (SELECT *, 2 * net::INT + (n >= 2)::INT + 2 * near::INT + rs::INT AS score FROM b)"""


@C.add("tier_rules", over("lnk", _SRC + """ SELECT tier, count(*) AS n FROM (SELECT CASE WHEN (rs OR near) AND h < 0.3 AND coalesce(deck >= 2, FALSE) THEN 'bridge' WHEN rs AND h < 0.15 THEN 'bridge_or_open'
  WHEN h >= 0.3 AND veg < 0.5 AND score >= 3 THEN 'high' WHEN h >= 0.3 AND veg < 0.5 AND score >= 2 THEN 'medium' ELSE 'low' END AS tier FROM c) GROUP BY 1"""))
def tier_rules(spark, d):
    a = lnk(spark, d)
    src = F.filter(F.array(F.when(F.col("flag") == "A", "testA"), F.when(F.col("status") == "F", "gap"), F.when(F.col("ln") % 2 == 0, "road_x_drain")), lambda x: x.isNotNull())
    deck = F.when(F.col("ln") != 1, F.col("length") / 10)
    t = rules.tier(src, F.col("rise") * 10, F.col("prob") * 0.7, F.col("length"), deck, F.lit(False))
    return a.select(t.alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@C.add("noisy_or", over("lnk", """SELECT o, ln, u, length, round_even(1 - (1 - 1 / (1 + exp(-(log10(greatest(price, 1)) - 4) / 0.5))) * (1 - least(greatest(prob, 0), 1)) * (1 - least(greatest(rise, 0), 1)), 6) AS p FROM lnk"""))
def noisy_or(spark, d):
    return lnk(spark, d).select("o", "ln", "u", "length", b6(rules.noisy_or([F.col("prob"), F.col("rise")], F.col("price"))).alias("p"))


@C.add("linear_score", over("lnk", """, t AS (SELECT *, 1 / (1 + exp(-(-1.5 + 0.05 * length + 2 * prob))) AS s FROM lnk) SELECT o, ln, u, length, round_even(CASE WHEN flag = 'R' THEN greatest(s, 0.95) ELSE s END, 6) AS p FROM t"""))
def linear_score(spark, d):
    s = rules.linear_score({"length": 0.05, "prob": 2.0}, -1.5, F.col("flag") == "R")
    return lnk(spark, d).select("o", "ln", "u", "length", b6(s).alias("p"))


@C.add("structure_probability", over("lnk", "SELECT o, ln, u, length, CASE WHEN ln < 3 THEN prob WHEN status = 'F' THEN 0.8 ELSE 0.0 END::DOUBLE AS p FROM lnk"))
def structure_probability(spark, d):
    a = lnk(spark, d)
    return a.select("o", "ln", "u", "length", rules.structure_probability(F.when(F.col("ln") < 3, F.col("prob")), F.when(F.col("status") == "F", "high")).alias("p"))


@C.add("order_score", over("lnk", "SELECT o, ln, u, length, ln + u / 10 + (least(greatest(rise * 100 - 5, -5), 5) + 5) / 1000 AS s FROM lnk"))
def order_score(spark, d):
    return lnk(spark, d).select("o", "ln", "u", "length", rules.order_score(F.col("ln"), F.col("u"), F.col("rise") * 100 - 5).alias("s"))


@C.add("robust_scale", over("lnk", """, q AS (SELECT quantile_cont(length, 0.25) AS a, quantile_cont(length, 0.5) AS b, quantile_cont(length, 0.75) AS c FROM lnk)
  SELECT o, ln, u, length, least(greatest((length - b) / CASE WHEN c > a THEN c - a ELSE 1 END, -20), 20) AS length_scaled FROM lnk, q"""))
def robust_scale(spark, d):
    return rules.robust_scale(lnk(spark, d), ["length"]).select("o", "ln", "u", "length", "length_scaled")


@C.add("length_shares", over("lnk", """SELECT flag, status, sum(length) / 1000 AS km, round_even(sum(CASE WHEN prob > 0.4 THEN length ELSE 0 END) / sum(length), 9) AS share FROM lnk GROUP BY 1, 2"""))
def length_shares(spark, d):
    share = F.sum(F.when(F.col("prob") > 0.4, F.col("length")).otherwise(0.0)) / F.sum("length")
    return lnk(spark, d).groupBy("flag", "status").agg((F.sum("length") / 1000).alias("km"), F.bround(share, 9).alias("share"))


@C.add("reach_medians", over("lnk", "SELECT u, count(*) AS n, sum(length) AS length, max(length) AS longest, quantile_cont(price, 0.5) AS median FROM lnk GROUP BY u"))
def reach_medians(spark, d):
    return lnk(spark, d).groupBy("u").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.max("length").alias("longest"), F.percentile("price", 0.5).alias("median"))


@C.add("overlap_vote", over("lnk", """, s AS (SELECT u, flag, sum(length) AS w FROM lnk GROUP BY 1, 2), t AS (SELECT u, flag, w, sum(w) OVER (PARTITION BY u) AS t, row_number() OVER (PARTITION BY u ORDER BY w DESC, flag DESC) AS k FROM s)
  SELECT u, CASE WHEN w >= 0.5 * t THEN flag END AS class FROM t WHERE k = 1"""))
def overlap_vote(spark, d):
    s = lnk(spark, d).groupBy("u", "flag").agg(F.sum("length").alias("w"))
    a = s.groupBy("u").agg(F.max(F.struct("w", "flag")).alias("m"), F.sum("w").alias("t"))
    return a.select("u", F.when(F.col("m.w") >= 0.5 * F.col("t"), F.col("m.flag")).alias("class"))


@C.add("graph_smooth")
def graph_smooth(spark, d):
    """All links with their own nodes and the 20 rounds of G14; SQL would have to unroll them."""
    return _smooth(lnk(spark, d), 20)


def _smooth(links, rounds):
    e = links.where("u <> v").groupBy("u", "v").agg(F.sum("length").alias("w"))
    ids = e.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    v = ids.select("id", ((F.col("id") * 37 % 100) / F.lit(100.0)).alias("value"), F.lit(1.0).alias("weight"))
    return graph.smooth(v, e, rounds).select("id", b6("value").alias("value"))


# profiles along lines

_P = "PARTITION BY line ORDER BY ts, id"


@C.add("bed_bumps", over("prof", f"""SELECT id, z - greatest(min(z) OVER ({_P} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), min(z) OVER ({_P} ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING))
  + CASE WHEN lag(id) OVER ({_P}) IS NULL OR lead(id) OVER ({_P}) IS NULL THEN NULL ELSE 0 END AS bump FROM prof"""))
def bed_bumps(spark, d):
    return windows.bed_bumps(prof(spark, d), ["line"], ["ts", "id"]).select("id", "bump")


@C.add("bump_islands", over("prof", f""", b AS (SELECT line, ts, id, z - greatest(min(z) OVER ({_P} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), min(z) OVER ({_P} ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)) AS h,
  lag(id) OVER ({_P}) IS NULL OR lead(id) OVER ({_P}) IS NULL AS edge, row_number() OVER ({_P}) AS k FROM prof),
  r AS (SELECT *, k - row_number() OVER ({_P}) AS g FROM b WHERE NOT edge AND h >= 30) SELECT line, count(*) AS n_rows, min(k) AS first_at, max(h) AS top FROM r GROUP BY line, g"""))
def bump_islands(spark, d):
    b = windows.bed_bumps(prof(spark, d), ["line"], ["ts", "id"])
    i = windows.islands(b, ["line"], ["ts", "id"], F.col("bump") >= 30, F.max("bump").alias("top"))
    return i.select("line", "n_rows", F.col("first_at").cast("long").alias("first_at"), "top")


@C.add("gap_rise", over("prof", """, p AS (SELECT line, id, z, (id // 100)::DOUBLE AS s FROM prof)
  SELECT id, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN t - greatest(l, r) END AS rise FROM (SELECT id, max(z) OVER (PARTITION BY line ORDER BY s RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS t,
  min(z) OVER (PARTITION BY line ORDER BY s RANGE BETWEEN 15 PRECEDING AND 6 PRECEDING) AS l, min(z) OVER (PARTITION BY line ORDER BY s RANGE BETWEEN 6 FOLLOWING AND 15 FOLLOWING) AS r FROM p)"""))
def gap_rise(spark, d):
    p = prof(spark, d).withColumn("s", F.floor(F.col("id") / 100).cast("double"))
    return windows.gap_rise(p, ["line"], "s").select("id", "rise")


@C.add("end_sixths_rise", over("prof", f""", k AS (SELECT line, z, ntile(6) OVER ({_P}) AS k FROM prof)
  SELECT line, max(z) - greatest(min(CASE WHEN k = 1 THEN z END), min(CASE WHEN k = 6 THEN z END)) AS rise, count(*) AS n_rows FROM k GROUP BY line"""))
def end_sixths_rise(spark, d):
    return windows.end_sixths_rise(prof(spark, d), ["line"], ["ts", "id"])


@C.add("moving_avg7", over("prof", f""", w AS (SELECT line, id, z, row_number() OVER ({_P}) AS k, count(*) OVER (PARTITION BY line) AS n, sum(z) OVER ({_P} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s,
  first_value(z) OVER ({_P}) AS f, last_value(z) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM prof)
  SELECT id, round_even(CASE WHEN k = 1 OR k = n THEN z ELSE (s + greatest(3 - k + 1, 0) * f + greatest(k + 3 - n, 0) * l) / 7 END, 6) AS smooth FROM w"""))
def moving_avg7(spark, d):
    return windows.moving_average(prof(spark, d), ["line"], ["ts", "id"], "z").select("id", b6("smooth").alias("smooth"))


@C.add("running_distance", over("prof", f""", s AS (SELECT line, ts, id, (id % 100)::DOUBLE AS x, z, lag((id % 100)::DOUBLE) OVER ({_P}) AS px, lag(z) OVER ({_P}) AS pz FROM prof),
  t AS (SELECT *, coalesce(sqrt((x - px) * (x - px) + (z - pz) * (z - pz)), 0) AS d FROM s) SELECT id, round_even(sum(d) OVER ({_P} ROWS UNBOUNDED PRECEDING), 5) AS along FROM t"""))
def running_distance(spark, d):
    p = prof(spark, d).select("line", "ts", "id", (F.col("id") % 100).cast("double").alias("x"), F.col("z").alias("y"))
    return windows.running_distance(p, ["line"], ["ts", "id"]).select("id", F.bround("along", 5).alias("along"))


@C.add("evidence_runs", over("prof", f""", c AS (SELECT line, ts, id, kind, row_number() OVER ({_P}) AS k, CASE WHEN kind = lag(kind) OVER ({_P}) THEN 0 ELSE 1 END AS c FROM prof),
  r AS (SELECT *, sum(c) OVER ({_P} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c) SELECT line, run, min(kind) AS kind, count(*) AS n_rows, min(k) AS first_at FROM r GROUP BY line, run"""))
def evidence_runs(spark, d):
    r = windows.value_runs(prof(spark, d), ["line"], ["ts", "id"], "kind")
    return r.select("line", "run", "kind", "n_rows", F.col("first_at").cast("long").alias("first_at"))


@C.add("interpolated_bed", over("prof", f""", k AS (SELECT line, id, z, row_number() OVER ({_P}) - 1 AS k, count(*) OVER (PARTITION BY line) - 1 AS n, first_value(z) OVER ({_P}) AS a,
  last_value(z) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM prof) SELECT id, round_even(least(z, CASE WHEN n = 0 THEN a ELSE a + (b - a) * k / n END), 6) AS bed FROM k"""))
def interpolated_bed(spark, d):
    w, whole = Window.partitionBy("line").orderBy("ts", "id"), Window.partitionBy("line").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = prof(spark, d).withColumns({"k": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("line")) - 1, "a": F.first("z").over(whole), "b": F.last("z").over(whole)})
    line = F.when(F.col("n") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / F.col("n"))
    return p.select("id", b6(F.least("z", line)).alias("bed"))


# trees

_ANC = ", up(id, anc, steps) AS (SELECT id, id, 0::BIGINT FROM tree UNION ALL SELECT u.id, t.parent, u.steps + 1 FROM up u JOIN tree t ON t.id = u.anc WHERE t.parent IS NOT NULL)"


@C.add("tree_levels", over("tree", _ANC + " SELECT id, max(steps) AS depth FROM up GROUP BY id", recursive=True))
def tree_levels(spark, d):
    return graph.levels(tree(spark, d))


@C.add("upstream_sum", over("tree", _ANC + " SELECT anc AS id, round_even(sum(area), 4) AS total FROM up JOIN tree t ON t.id = up.id GROUP BY anc", recursive=True))
def upstream_sum(spark, d):
    return graph.upstream_sum(tree(spark, d), "area").select("id", F.bround("total", 4).alias("total"))


@C.add("propagate_max_class", over("tree", _ANC + " SELECT anc AS id, max(area) AS top FROM up JOIN tree t ON t.id = up.id GROUP BY anc", recursive=True))
def propagate_max_class(spark, d):
    return graph.propagate_max(tree(spark, d), "area")


def _strahler_sql(levels: int) -> str:
    """Orders from the deepest level up; a level's order needs its children's only."""
    out = _ANC + ", lev AS (SELECT t.id, t.parent, max(steps) AS depth FROM up JOIN tree t ON t.id = up.id GROUP BY 1, 2)"
    out += f", s{levels} AS (SELECT id, parent, 1 AS o FROM lev WHERE depth = {levels})"
    for k in range(levels - 1, -1, -1):
        out += f""", c{k} AS (SELECT parent, max(o) AS m FROM s{k + 1} GROUP BY parent),
 g{k} AS (SELECT s.parent, c.m + CASE WHEN count(CASE WHEN s.o = c.m THEN 1 END) >= 2 THEN 1 ELSE 0 END AS o FROM s{k + 1} s JOIN c{k} c ON c.parent = s.parent GROUP BY s.parent, c.m),
 s{k} AS (SELECT l.id, l.parent, coalesce(g.o, 1) AS o FROM lev l LEFT JOIN g{k} g ON g.parent = l.id WHERE depth = {k})"""
    return out + " " + " UNION ALL ".join(f'SELECT id, o::INT AS "order" FROM s{k}' for k in range(levels + 1))


@C.add("strahler", over("tree", _strahler_sql(15), recursive=True))
def strahler(spark, d):
    return graph.strahler(tree(spark, d)).select("id", F.col("order").cast("int").alias("order"))


@C.add("stem_trace", over("tree", """, best AS (SELECT parent, id AS up FROM (SELECT parent, id, row_number() OVER (PARTITION BY parent ORDER BY area DESC, id) AS k FROM tree WHERE parent IS NOT NULL AND area >= 900) WHERE k = 1),
  stem(id, step) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT b.up, s.step + 1 FROM stem s JOIN best b ON b.parent = s.id) SELECT id, step FROM stem""", recursive=True))
def stem_trace(spark, d):
    return graph.main_stem(tree(spark, d), "area", 900.0, 0)


@C.add("multi_source_shortest_path", over("tree", """, sp(id, dist, source) AS (SELECT id, 0::DOUBLE, id FROM tree WHERE id IN (0, 5, 9) UNION ALL SELECT t.id, s.dist + 1 + (t.id % 7), s.source FROM sp s JOIN tree t ON t.parent = s.id),
  b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, source) AS k FROM sp) SELECT id, dist, source FROM b WHERE k = 1""", recursive=True))
def multi_source_shortest_path(spark, d):
    t = tree(spark, d)
    e = t.where("parent is not null").select(F.col("parent").alias("u"), F.col("id").alias("v"), (F.lit(1.0) + F.col("id") % 7).alias("cost"))
    return graph.shortest_paths(e, t.where("id in (0, 5, 9)").select("id")).select("id", "dist", "source")


@C.add("uphill_cost", over("tree", "SELECT t.id, round_even(10 + 50 * greatest(p.area - t.area - 0.5, 0), 4) AS cost FROM tree t JOIN tree p ON p.id = t.parent"))
def uphill_cost(spark, d):
    t = tree(spark, d)
    p = t.select(F.col("id").alias("parent"), F.col("area").alias("z"))
    return t.join(p, "parent").select("id", F.bround(graph.uphill_cost(F.lit(10.0), F.col("z"), F.col("area")), 4).alias("cost"))


@C.add("peel_leaves", over("tree", """, mx AS (SELECT max(id) AS m FROM tree), h AS (SELECT id, parent, area FROM tree WHERE parent IS NOT NULL)
  SELECT id, CASE WHEN 2 * id + 1 > m THEN 1 END AS round FROM h, mx"""))
def peel_leaves(spark, d):
    t = tree(spark, d).where("parent is not null").select("id", F.col("parent").alias("u"), F.col("id").alias("v"))
    return graph.peel_leaves(t, rounds=1).select("id", "round")


@C.add("peel_with_protection")
def peel_with_protection(spark, d):
    t = tree(spark, d).where("parent is not null")
    e = t.select("id", F.col("parent").alias("u"), F.col("id").alias("v"))
    return graph.peel_leaves(e, keep=t.where("area > 1050").select("id")).select("id", "round")


@C.add("minor_sweep", over("lnk", """, g AS (SELECT unnest([1.0, 2.0, 3.0]) AS w), h AS (SELECT unnest([0.2, 0.4]) AS q)
  SELECT w::DOUBLE AS max_width, q::DOUBLE AS max_depth, count(*) AS n, sum(length) / 1000 AS km FROM lnk, g, h WHERE length / 10 < w OR prob < q GROUP BY 1, 2"""))
def minor_sweep(spark, d):
    grid = [(w, q) for w in (1.0, 2.0, 3.0) for q in (0.2, 0.4)]
    a = lnk(spark, d)
    aggs = []
    for i, (w, q) in enumerate(grid):
        hit = (F.col("length") / 10 < w) | (F.col("prob") < q)
        aggs += [F.count(F.when(hit, 1)).alias(f"n{i}"), (F.sum(F.when(hit, F.col("length"))) / 1000).alias(f"k{i}")]
    one = F.array(*[F.struct(F.lit(w).alias("max_width"), F.lit(q).alias("max_depth"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("km")) for i, (w, q) in enumerate(grid)])
    return a.agg(*aggs).select(F.explode(one).alias("s")).select("s.*")


@C.add("orient_reaches", over("tree", """, r AS (SELECT id, CASE WHEN id % 3 = 0 THEN id ELSE parent END AS a, CASE WHEN id % 3 = 0 THEN parent ELSE id END AS b, area FROM tree WHERE parent IS NOT NULL),
  e AS (SELECT id, a AS n, area FROM r UNION ALL SELECT id, b, area FROM r), oa AS (SELECT r.id, max(e.area) AS v FROM r JOIN e ON e.n = r.a AND e.id <> r.id GROUP BY r.id),
  ob AS (SELECT r.id, max(e.area) AS v FROM r JOIN e ON e.n = r.b AND e.id <> r.id GROUP BY r.id),
  t AS (SELECT r.id, a, b, sign(coalesce(ob.v, 0) - coalesce(oa.v, 0)) AS vote FROM r LEFT JOIN oa ON oa.id = r.id LEFT JOIN ob ON ob.id = r.id),
  w AS (SELECT *, CASE WHEN vote <> 0 THEN vote WHEN (SELECT sum(vote) FROM t) >= 0 THEN 1 ELSE -1 END AS way FROM t)
  SELECT id, CASE WHEN way > 0 THEN a ELSE b END AS from_node, CASE WHEN way > 0 THEN b ELSE a END AS to_node, vote <> 0 AS decided FROM w"""))
def orient_reaches(spark, d):
    t = tree(spark, d).where("parent is not null")
    flip = F.col("id") % 3 == 0
    r = t.select("id", F.when(flip, F.col("id")).otherwise(F.col("parent")).alias("a"), F.when(flip, F.col("parent")).otherwise(F.col("id")).alias("b"), "area")
    return graph.orient(r)


@C.add("flow_consistency", over("tree", "SELECT count(*) AS n, count(CASE WHEN p.area >= t.area THEN 1 END) AS n_downstream FROM tree t JOIN tree p ON p.id = t.parent"))
def flow_consistency(spark, d):
    t = tree(spark, d)
    p = t.select(F.col("id").alias("parent"), F.col("area").alias("down"))
    return t.join(p, "parent").agg(F.count("*").alias("n"), F.count(F.when(F.col("down") >= F.col("area"), 1)).alias("n_downstream"))
