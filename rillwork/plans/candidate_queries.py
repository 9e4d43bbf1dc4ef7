"""Queries on ranked candidates: windows, recall, precision, weights, folds, cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import compare, greedy, labels, metrics, rules, windows
from ..sources import catalog
from .views import Catalogue, cand, over

C = Catalogue()


def pos():
    return F.col("y") == 1


def b9(c):
    return F.bround(c, 9)


@C.add("rank_in_tile", over("cand", "SELECT id, tile, row_number() OVER (PARTITION BY tile ORDER BY score DESC, id) - 1 AS rank FROM cand"))
def rank_in_tile(spark, d):
    r = windows.rank_from_zero(cand(spark, d), ["tile"], F.desc("score"), F.col("id"))
    return r.select("id", "tile", F.col("rank").cast("long").alias("rank"))


@C.add("topk_per_tile", over("cand", "SELECT id, tile, score FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY score DESC, id) AS k FROM cand) WHERE k <= 100"))
def topk_per_tile(spark, d):
    return windows.top_k(cand(spark, d), ["tile"], 100, F.desc("score"), F.col("id")).select("id", "tile", "score")


@C.add("first_of_group", over("cand", "SELECT id, tile, kind FROM (SELECT *, row_number() OVER (PARTITION BY tile, kind ORDER BY score DESC, id) AS k FROM cand) WHERE k = 1"))
def first_of_group(spark, d):
    return windows.first_of_group(cand(spark, d), ["tile", "kind"], F.desc("score"), F.col("id")).select("id", "tile", "kind")


@C.add("pct_rank_avg_ties", over("cand", """, t AS (SELECT id, tile, floor(score / 1000) AS s FROM cand)
  SELECT id, (rank() OVER (PARTITION BY tile ORDER BY s) + (count(*) OVER (PARTITION BY tile, s) - 1) / 2) / count(*) OVER (PARTITION BY tile) AS pct FROM t"""))
def pct_rank_avg_ties(spark, d):
    t = cand(spark, d).select("id", "tile", F.floor(F.col("score") / 1000).alias("s"))
    return windows.average_rank_share(t, ["tile"], "s").select("id", "pct")


_REC = """, r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY score DESC, id) AS k FROM cand),
 p AS (SELECT {g} AS g, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::BIGINT AS n_pos, sum(CASE WHEN y = 1 AND k <= 100 THEN 1 ELSE 0 END)::BIGINT AS n_top FROM r GROUP BY 1),
 m AS (SELECT {g} AS g, count(*) AS n_missed FROM cand WHERE y IS NULL GROUP BY 1)"""


def _recall(spark, d, group, with_missed):
    c = cand(spark, d)
    missed = c.where("y is null").select(group) if with_missed else None
    return metrics.recall_at(c, [group], "tile", 100, F.coalesce(pos(), F.lit(False)), missed)


@C.add("recall_at_k", over("cand", _REC.format(g="council") + """ SELECT p.g AS council, n_pos, n_top, coalesce(n_missed, 0) AS n_missed,
  CASE WHEN n_pos + coalesce(n_missed, 0) > 0 THEN n_top / (n_pos + coalesce(n_missed, 0)) END AS recall FROM p LEFT JOIN m USING (g)"""))
def recall_at_k(spark, d):
    return _recall(spark, d, "council", True).select("council", "n_pos", "n_top", "n_missed", "recall")


@C.add("reachable_recall", over("cand", _REC.format(g="council") + " SELECT g AS council, CASE WHEN n_pos > 0 THEN n_top / n_pos END AS reachable FROM p"))
def reachable_recall(spark, d):
    return _recall(spark, d, "council", True).select("council", "reachable")


@C.add("by_kind_recall", over("cand", _REC.format(g="kind") + " SELECT g AS kind, n_pos, n_top, CASE WHEN n_pos > 0 THEN n_top / n_pos END AS recall FROM p"))
def by_kind_recall(spark, d):
    return _recall(spark, d, "kind", False).select("kind", "n_pos", "n_top", "recall")


_STEP = """, s AS (SELECT {g} AS g, {s} AS s, count(*) AS n, sum(y) AS p FROM cand WHERE y IS NOT NULL GROUP BY 1, 2),
 c AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY g) AS tp FROM s WINDOW w AS (PARTITION BY g ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


@C.add("average_precision", over("cand", _STEP.format(g="council", s="score") + " SELECT g AS council, round_even(sum(p / tp * (cp / cn)), 9) AS ap, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_rows FROM c GROUP BY g"))
def average_precision(spark, d):
    a = metrics.average_precision(cand(spark, d), ["council"], "score", "y")
    return a.select("council", b9("ap").alias("ap"), "n_pos", "n_rows")


@C.add("hist_ap", over("cand", _STEP.format(g="council", s="least(greatest(floor(score / 600000 * 1000), 0), 1000)") + " SELECT g AS council, round_even(sum(p / tp * (cp / cn)), 9) AS ap FROM c GROUP BY g"))
def hist_ap(spark, d):
    return metrics.histogram_ap(cand(spark, d), ["council"], F.col("score") / 600000, "y").select("council", b9("ap").alias("ap"))


@C.add("roc_auc", over("cand", """, r AS (SELECT council, y, rank() OVER (PARTITION BY council ORDER BY score) + (count(*) OVER (PARTITION BY council, score) - 1) / 2 AS k FROM cand WHERE y IS NOT NULL),
  a AS (SELECT council, sum(CASE WHEN y = 1 THEN k END) AS s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::BIGINT AS n1, count(*) AS n FROM r GROUP BY 1)
  SELECT council, n1, n - n1 AS n0, round_even((s - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 9) AS auc FROM a"""))
def roc_auc(spark, d):
    return metrics.roc_auc(cand(spark, d), ["council"], "score", "y").select("council", "n1", "n0", b9("auc").alias("auc"))


@C.add("youden", over("cand", """, s AS (SELECT floor(score / 1000) AS s, sum(y) AS p, sum(1 - y) AS n FROM cand WHERE y IS NOT NULL GROUP BY 1),
  c AS (SELECT s, sum(p) OVER w / sum(p) OVER () - sum(n) OVER w / sum(n) OVER () AS j FROM s WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
  SELECT s AS threshold, round_even(j, 9) AS j FROM c ORDER BY c.j DESC, s LIMIT 1"""))
def youden(spark, d):
    c = cand(spark, d).withColumn("score", F.floor(F.col("score") / 1000).cast("double"))
    return metrics.youden(c, "score", "y").select("threshold", b9("j").alias("j"))


@C.add("calibrate_threshold", over("cand", _STEP.format(g="council", s="score") + """, t AS (SELECT g, min(CASE WHEN cp / cn >= 0.7 THEN s END) AS low, arg_max(s, {'p': cp / cn, 's': s}) AS best FROM c GROUP BY g)
  SELECT g AS council, coalesce(low, best) AS threshold, low IS NOT NULL AS reached FROM t"""))
def calibrate_threshold(spark, d):
    return metrics.calibrate(cand(spark, d), ["council"], "score", "y", 0.7)


@C.add("score_summary", over("cand", """, t AS (SELECT kind, (score - 150000) / 1000 AS v FROM cand)
  SELECT kind, round_even(quantile_cont(v, 0.5), 6) AS median, round_even(quantile_cont(v, 0.05), 6) AS p5, round_even(quantile_cont(v, 0.95), 6) AS p95, round_even(avg(v), 6) AS mean, max(abs(v)) AS max_abs,
  round_even(avg(CASE WHEN abs(v) <= 50 THEN 1.0 ELSE 0.0 END), 9) AS share, count(*) AS n FROM t GROUP BY kind"""))
def score_summary(spark, d):
    t = cand(spark, d).select("kind", ((F.col("score") - 150000) / 1000).alias("v"))
    return metrics.summary(t, ["kind"], "v", 50.0).withColumns({**{c: F.bround(c, 6) for c in ("median", "p5", "p95", "mean")}, "share": b9("share")})


@C.add("bootstrap_auc")
def bootstrap_auc(spark, d):
    return metrics.bootstrap_auc(cand(spark, d), "score", "y", 20, 1)


@C.add("threshold_sweep", over("cand", """, t AS (SELECT unnest([100000.0, 150000.0, 200000.0]) AS threshold), x AS (SELECT council, threshold,
  sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::BIGINT AS n_pos, sum(CASE WHEN score >= threshold AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN score >= threshold AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp
  FROM cand CROSS JOIN t WHERE y IS NOT NULL GROUP BY 1, 2)
  SELECT council, threshold::DOUBLE AS threshold, n_pos, tp, fp, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN n_pos > 0 THEN tp / n_pos END AS recall,
  CASE WHEN tp + fp + n_pos > 0 THEN 2 * tp / (tp + fp + n_pos) END AS f1 FROM x"""))
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(cand(spark, d), ["council"], "score", "y", [100000.0, 150000.0, 200000.0])


@C.add("dataset_card", over("cand", """SELECT council, kind, status, GROUPING(council, kind, status) AS gid, count(*) AS n, count(CASE WHEN y = 1 THEN 1 END) AS n_pos, count(DISTINCT tile) AS n_tiles
  FROM cand GROUP BY GROUPING SETS ((council), (kind), (status), (council, status), ())"""))
def dataset_card(spark, d):
    c = cand(spark, d)
    groups = [["council"], ["kind"], ["status"], ["council", "status"], []]
    a = c.select("council", "kind", "status", "y", "tile").groupingSets(groups, "council", "kind", "status")
    return a.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.count(F.when(pos(), 1)).alias("n_pos"), F.countDistinct("tile").alias("n_tiles")).select(
        "council", "kind", "status", "gid", "n", "n_pos", "n_tiles"
    )


@C.add("reason_pivot", over("cand", """SELECT council, kind, count(CASE WHEN status = 'F' THEN 1 END) AS F, count(CASE WHEN status = 'O' THEN 1 END) AS O, count(CASE WHEN status = 'P' THEN 1 END) AS P FROM cand GROUP BY 1, 2"""))
def reason_pivot(spark, d):
    return compare.reason_table(cand(spark, d), ["council", "kind"], "status", ["F", "O", "P"])


@C.add("ab_summary", over("cand", """, t AS (SELECT region, tile, CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END AS run, sum(y) AS h, count(y) AS n FROM cand GROUP BY 1, 2, 3)
  SELECT region, round_even(sum(h) FILTER (run = 'A') / greatest(sum(n) FILTER (run = 'A'), 1), 9) AS A_pooled, round_even(avg(h / nullif(n, 0)) FILTER (run = 'A'), 9) AS A_mean,
  round_even(sum(h) FILTER (run = 'B') / greatest(sum(n) FILTER (run = 'B'), 1), 9) AS B_pooled, round_even(avg(h / nullif(n, 0)) FILTER (run = 'B'), 9) AS B_mean FROM t GROUP BY region"""))
def ab_summary(spark, d):
    c = cand(spark, d).withColumn("run", F.when(F.col("id") % 2 == 0, "A").otherwise("B"))
    s = compare.side_by_side(c, ["region"], "run", ["A", "B"], "y")
    return s.select("region", *[b9(f"{r}_{k}").alias(f"{r}_{k}") for r in "AB" for k in ("pooled", "mean")])


@C.add("value_counts", over("cand", "SELECT council, kind, count(*) AS n, count(DISTINCT tile) AS n_tiles FROM cand GROUP BY 1, 2"))
def value_counts(spark, d):
    return cand(spark, d).groupBy("council", "kind").agg(F.count("*").alias("n"), F.countDistinct("tile").alias("n_tiles"))


@C.add("nested_counts", over("cand", """, c AS (SELECT tile, council, count(*) AS n FROM cand GROUP BY 1, 2)
  SELECT tile, string_agg(council || '=' || n, ';' ORDER BY council) AS label_sources FROM c GROUP BY tile"""))
def nested_counts(spark, d):
    c = cand(spark, d).groupBy("tile", "council").agg(F.count("*").alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("council", "n"))), lambda v: F.concat_ws("=", v["council"], v["n"].cast("string")))
    return c.groupBy("tile").agg(F.array_join(pairs, ";").alias("label_sources"))


_MANIFEST = """, n AS (SELECT council, tile, count(*) AS n FROM cand GROUP BY 1, 2),
 t AS (SELECT *, row_number() OVER (PARTITION BY council ORDER BY n DESC, sha256('s:' || tile)) AS place FROM n WHERE n >= 5),
 o AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY n DESC, council) AS k FROM t WHERE place <= 3)"""


@C.add("manifest_select", over("cand", _MANIFEST + " SELECT council, tile, n FROM o WHERE k = 1"))
def manifest_select(spark, d):
    n = cand(spark, d).groupBy("council", "tile").agg(F.count("*").alias("n"))
    return catalog.select_manifest(n, 5, 3, "s").select("council", "tile", "n")


@C.add("hash_split", over("cand", """, u AS (SELECT DISTINCT tile, ('0x' || substr(sha1(tile::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS u FROM cand)
  SELECT tile, CASE WHEN tile = 3 THEN 'test' WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split FROM u"""))
def hash_split(spark, d):
    t = cand(spark, d).select("tile").distinct()
    return t.select("tile", scalars.hash_split(F.col("tile").cast("string"), [("train", 0.7), ("val", 0.15), ("test", 0.15)], {"3": "test"}).alias("split"))


@C.add("block_folds", over("cand", """, b AS (SELECT tile, min(region) AS s FROM cand GROUP BY 1), f AS (SELECT tile, (row_number() OVER (PARTITION BY s ORDER BY sha256(tile::VARCHAR), tile) - 1) % 5 AS fold FROM b)
  SELECT id, fold::INT AS fold FROM cand JOIN f USING (tile)"""))
def block_folds(spark, d):
    return labels.block_folds(cand(spark, d), "tile", "region", 5).select("id", "fold")


_ROLE = """, r AS (SELECT id, tile, score, y, council, (score > 20000) AS s, (id % 9 = 0) AS near FROM cand),
 q AS (SELECT *, s AND y IS NOT DISTINCT FROM 1 AS positive, s AND y IS NOT DISTINCT FROM 0 AS negative, s AND y IS NULL AND NOT near AS unlabelled FROM r)"""


def _roles(spark, d):
    c = cand(spark, d)
    return c.withColumns(rules.roles(F.col("y"), F.col("id") % 9 == 0, F.col("score") > 20000))


@C.add("roles", over("cand", _ROLE + " SELECT id, positive, negative, unlabelled, NOT (positive OR negative OR unlabelled) AS excluded FROM q"))
def roles(spark, d):
    return _roles(spark, d).select("id", "positive", "negative", "unlabelled", "excluded")


@C.add("pu_weights", over("cand", _ROLE + """, c AS (SELECT *, sum(CASE WHEN positive THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY council) AS np, sum(CASE WHEN unlabelled THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY council) AS nu FROM q)
  SELECT id, CASE WHEN positive OR negative THEN 1.0::DOUBLE WHEN unlabelled THEN 3.0::DOUBLE * np / nu ELSE 0.0::DOUBLE END AS weight FROM c"""))
def pu_weights(spark, d):
    return labels.unlabelled_weights(_roles(spark, d), 3.0, ["council"]).select("id", "weight")


@C.add("review_effort", over("cand", """, c AS (SELECT council, row_number() OVER w AS r, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) OVER w AS c, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY council) AS t
  FROM cand WINDOW w AS (PARTITION BY council ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))
  SELECT council, min(r) AS n_reviewed, min(t)::BIGINT AS n_hits FROM c WHERE t > 0 AND c >= t * 0.8 GROUP BY council"""))
def review_effort(spark, d):
    r = windows.until_share(cand(spark, d), ["council"], F.coalesce(pos(), F.lit(False)), 0.8, F.desc("score"), F.col("id"))
    return r.select("council", F.col("n_reviewed").cast("long").alias("n_reviewed"), "n_hits")


@C.add("seeded_sample", over("cand", "SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY sha256('7:' || id), id) AS k FROM cand) WHERE k <= 40"))
def seeded_sample(spark, d):
    key = F.sha2(F.concat(F.lit("7:"), F.col("id").cast("string")), 256)
    return windows.top_k(cand(spark, d), ["kind"], 40, key, F.col("id")).select("id", "kind")


@C.add("registry_order", over("cand", "SELECT id, made, score FROM cand WHERE kind = '1-URGENT' AND status = 'F' ORDER BY made DESC, id DESC LIMIT 50"))
def registry_order(spark, d):
    return cand(spark, d).where("kind = '1-URGENT' and status = 'F'").orderBy(F.desc("made"), F.desc("id")).limit(50).select("id", "made", "score")


_REG = """, reg AS (SELECT id, substr(sha256(kind || status), 1, 12) AS key, made AS created_at, score / 100 - 2000 AS xmin, score / 100 - 1000 AS ymin, score / 100 + 100 AS xmax, score / 100 + 200 AS ymax FROM cand)"""


def _registry(spark, d):
    s = F.col("score") / 100
    return cand(spark, d).select(
        "id", scalars.digest(F.concat("kind", "status"), 12).alias("key"), F.col("made").alias("created_at"), (s - 2000).alias("xmin"), (s - 1000).alias("ymin"), (s + 100).alias("xmax"), (s + 200).alias("ymax")
    )


@C.add("registry_exact", over("cand", _REG + " SELECT id, key, created_at FROM reg WHERE key = (SELECT min(key) FROM reg) ORDER BY created_at DESC, id DESC LIMIT 1"))
def registry_exact(spark, d):
    import hashlib

    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    r = _registry(spark, d)
    low = r.agg(F.min("key")).first()[0] or hashlib.sha256(kinds[0].encode()).hexdigest()[:12]
    return catalog.registry_lookup(r, low, (0.0, 0.0, 0.0, 0.0)).select("id", "key", "created_at")


@C.add("registry_contains", over("cand", _REG + " SELECT id, created_at FROM reg WHERE xmin <= 500 AND ymin <= 600 AND xmax >= 900 AND ymax >= 800 ORDER BY created_at DESC, id DESC LIMIT 1"))
def registry_contains(spark, d):
    return catalog.registry_lookup(_registry(spark, d), "none", (500.0, 600.0, 900.0, 800.0)).select("id", "created_at")


@C.add("set_containment", over("cand", """, s AS (SELECT council, list_distinct(list(kind)) AS kinds, count(*) AS n FROM cand WHERE score > 200000 GROUP BY council)
  SELECT council, list_has_all(kinds, ['1-URGENT', '5-LOW']) AS has FROM s"""))
def set_containment(spark, d):
    s = cand(spark, d).where("score > 200000").groupBy("council").agg(F.collect_set("kind").alias("kinds"))
    return s.select("council", scalars.contains_all(F.col("kinds"), F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).alias("has"))


@C.add("replace_source", over("cand", "SELECT id, council, score FROM cand WHERE council NOT IN (SELECT council FROM cand WHERE region = 'ASIA') UNION ALL SELECT id, council, score * 2 FROM cand WHERE region = 'ASIA' AND id % 2 = 0"))
def replace_source(spark, d):
    c = cand(spark, d)
    new = c.where("region = 'ASIA' and id % 2 = 0").withColumn("score", F.col("score") * 2)
    return catalog.replace_source(c.select("id", "council", "score"), new.select("id", "council", "score"), "council")


_RUNS = """, a AS (SELECT id, score, kind FROM cand WHERE id % 10 <> 0), b AS (SELECT id, CASE WHEN id % 7 = 0 THEN score + 1 ELSE score END AS score, CASE WHEN id % 11 = 0 THEN 'x' ELSE kind END AS kind FROM cand WHERE id % 10 <> 3)"""


def _runs(spark, d):
    c = cand(spark, d).select("id", "score", "kind")
    b = c.select("id", F.when(F.col("id") % 7 == 0, F.col("score") + 1).otherwise(F.col("score")).alias("score"), F.when(F.col("id") % 11 == 0, "x").otherwise(F.col("kind")).alias("kind"))
    return c.where("id % 10 <> 0"), b.where("id % 10 <> 3")


@C.add("run_diff", over("cand", _RUNS + """ SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.score <> b.score OR a.kind <> b.kind THEN 'changed' ELSE 'same' END AS status,
  CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN concat_ws(',', CASE WHEN a.score <> b.score THEN 'score' END, CASE WHEN a.kind <> b.kind THEN 'kind' END) END AS columns FROM a FULL JOIN b ON a.id = b.id"""))
def run_diff(spark, d):
    return compare.diff_rows(*_runs(spark, d), ["id"], ["score", "kind"])


@C.add("bag_difference", over("cand", _RUNS + ", x AS (SELECT kind, score FROM a), y AS (SELECT kind, score FROM b) SELECT *, 'a' AS side FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT *, 'b' FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)"))
def bag_difference(spark, d):
    a, b = _runs(spark, d)
    return compare.bag_difference(a.select("kind", "score"), b.select("kind", "score"))


@C.add("name_sets", over("cand", """, a AS (SELECT DISTINCT council FROM cand WHERE score > 400000), b AS (SELECT DISTINCT council FROM cand WHERE score < 2000)
  SELECT council, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT council, 'a' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT council, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""))
def name_sets(spark, d):
    c = cand(spark, d)
    a, b = c.where("score > 400000").select("council"), c.where("score < 2000").select("council")
    side = lambda df, s: df.withColumn("side", F.lit(s))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "a")).unionByName(side(b.subtract(a), "b"))


@C.add("work_status", over("cand", """, m AS (SELECT DISTINCT tile AS id FROM cand), l AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'old' ELSE 'p1' END AS params, CASE WHEN id % 5 = 0 THEN 'v0' ELSE 'v1' END AS version FROM m WHERE id % 3 <> 0)
  SELECT m.id, CASE WHEN l.id IS NULL THEN 'todo' WHEN params = 'p1' AND version = 'v1' THEN 'done' ELSE 'stale' END AS status FROM m LEFT JOIN l ON l.id = m.id"""))
def work_status(spark, d):
    m = cand(spark, d).select(F.col("tile").alias("id")).distinct()
    log = m.where("id % 3 <> 0").select("id", F.when(F.col("id") % 4 == 0, "old").otherwise("p1").alias("params"), F.when(F.col("id") % 5 == 0, "v0").otherwise("v1").alias("version"))
    return catalog.work_status(m, log, F.lit("p1"), F.lit("v1")).select("id", "status")


@C.add("source_plan_order", over("cand", """, s AS (SELECT council AS slug, max(made) AS "end", min(made) AS updated, council < 'C' AS national FROM cand GROUP BY council)
  SELECT slug, row_number() OVER (ORDER BY national, CASE slug WHEN 'JAPAN' THEN 0 WHEN 'FRANCE' THEN 1 ELSE 2 END, "end" DESC, updated DESC, slug) AS survey_index FROM s WHERE slug <> 'CHINA'"""))
def source_plan_order(spark, d):
    s = cand(spark, d).groupBy(F.col("council").alias("slug")).agg(F.max("made").alias("end"), F.min("made").alias("updated")).withColumn("national", F.col("slug") < "C")
    return catalog.source_plan(s, ["JAPAN", "FRANCE"], ["CHINA"]).select("slug", F.col("survey_index").cast("long").alias("survey_index"))


@C.add("paired_plan", over("cand", """, s AS (SELECT council AS slug, max(made) AS "end", min(made) AS updated, council < 'C' AS national FROM cand GROUP BY council),
  p AS (SELECT slug, row_number() OVER (ORDER BY national, "end" DESC, updated DESC, slug) AS survey_index FROM s) SELECT slug, survey_index FROM p WHERE slug IN (SELECT council FROM cand WHERE region = 'EUROPE')"""))
def paired_plan(spark, d):
    c = cand(spark, d)
    s = c.groupBy(F.col("council").alias("slug")).agg(F.max("made").alias("end"), F.min("made").alias("updated")).withColumn("national", F.col("slug") < "C")
    dsm = c.where("region = 'EUROPE'").select(F.col("council").alias("slug")).distinct()
    return catalog.paired_plan(dsm, catalog.source_plan(s, [])).select("slug", F.col("survey_index").cast("long").alias("survey_index"))


@C.add("imagery_plan", over("cand", """, s AS (SELECT council AS slug, min(made) AS a, max(made) AS b, lower(council) || ' 0.' || (1 + length(council) % 7) || 'm imagery' AS title FROM cand GROUP BY council),
  f AS (SELECT *, regexp_extract(title, '(\\d+(?:\\.\\d+)?)\\s*m\\b', 1)::DOUBLE AS gsd FROM s WHERE NOT regexp_matches(title, 'an'))
  SELECT slug, gsd, row_number() OVER (ORDER BY abs((epoch(a)::BIGINT + epoch(b)::BIGINT) / 2 - 852076800), slug) AS place FROM f WHERE gsd <= 0.5"""))
def imagery_plan(spark, d):
    c = cand(spark, d).groupBy(F.col("council").alias("slug")).agg(F.min("made").alias("start"), F.max("made").alias("end"))
    title = F.concat(F.lower("slug"), F.lit(" 0."), (1 + F.length("slug") % 7).cast("string"), F.lit("m imagery"))
    p = catalog.imagery_plan(c.withColumn("title", title), "1997-01-01 00:00:00", "an", 0.5)
    return p.select("slug", "gsd", F.col("place").cast("long").alias("place"))


@C.add("field_values", over("cand", "SELECT 'kind' AS field, kind AS value, count(*) AS n FROM cand GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM cand GROUP BY 2"))
def field_values(spark, d):
    return catalog.field_values(cand(spark, d), ["kind", "status", "council"], 10)


@C.add("field_ranges", over("cand", "SELECT 'score' AS field, count(score) AS n, min(score) AS v_min, quantile_cont(score, 0.5) AS v_median, max(score) AS v_max FROM cand UNION ALL SELECT 'tile', count(tile), min(tile), quantile_cont(tile::DOUBLE, 0.5), max(tile) FROM cand"))
def field_ranges(spark, d):
    return catalog.field_ranges(cand(spark, d), ["score", "tile"])


@C.add("coverage_index", over("cand", "SELECT kind, region, council, count(*) AS n_tile, sum(count(*)) OVER (PARTITION BY kind, region)::BIGINT AS n_sheet FROM cand GROUP BY 1, 2, 3"))
def coverage_index(spark, d):
    return catalog.coverage(cand(spark, d), "kind", "region", "council")


@C.add("tile_sources", over("cand", """, t AS (SELECT DISTINCT tile, 's' || tile % 4 AS sheet FROM cand), bt AS (SELECT tile, kind AS source, count(*) AS n FROM cand WHERE y = 1 AND kind < '3' GROUP BY 1, 2),
  bs AS (SELECT 's' || tile % 4 AS sheet, kind AS source, count(*) AS n FROM cand WHERE kind >= '2' GROUP BY 1, 2),
  g AS (SELECT tile, source, n FROM t JOIN bt USING (tile) UNION ALL SELECT tile, source, n FROM t JOIN bs USING (sheet) WHERE source NOT IN (SELECT source FROM bt))
  SELECT t.tile, t.sheet, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources, coalesce(sum(n), 0)::BIGINT AS n FROM t LEFT JOIN g USING (tile) GROUP BY 1, 2"""))
def tile_sources(spark, d):
    c = cand(spark, d).withColumn("sheet", F.concat(F.lit("s"), (F.col("tile") % 4).cast("string"))).withColumn("source", F.col("kind"))
    by_tile = c.where("y = 1 and kind < '3'").groupBy("tile", "source").agg(F.count("*").alias("n"))
    by_sheet = c.where("kind >= '2'").groupBy("sheet", "source").agg(F.count("*").alias("n"))
    return catalog.tile_sources(c.select("tile", "sheet").distinct(), by_tile, by_sheet).select("tile", "sheet", "sources", "n")


@C.add("neighbour_counts", over("cand", """, t AS (SELECT council AS tile, (row_number() OVER (ORDER BY council) - 1) // 5 AS r, (row_number() OVER (ORDER BY council) - 1) % 5 AS c, min(region) AS survey FROM cand GROUP BY council),
  n AS (SELECT a.tile, count(*) AS n_near, count(CASE WHEN a.survey = b.survey THEN 1 END) AS n_same FROM t a JOIN t b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.tile <> b.tile GROUP BY 1)
  SELECT t.tile, coalesce(n_near, 0) AS n_near, coalesce(n_same, 0) AS n_same, coalesce(n_same, 0) < 8 AS survey_edge FROM t LEFT JOIN n USING (tile)"""))
def neighbour_counts(spark, d):
    from pyspark.sql import Window

    c = cand(spark, d).groupBy(F.col("council").alias("tile")).agg(F.min("region").alias("survey"))
    k = (F.row_number().over(Window.orderBy("tile")) - 1).cast("long")  # 25 councils
    t = c.select("tile", "survey", F.floor(k / 5).alias("r"), (k % 5).alias("c"))
    return catalog.neighbour_counts(t).select("tile", "n_near", "n_same", "survey_edge")


@C.add("partition_tiles", over("cand", """, x AS (SELECT DISTINCT kind AS slug, 'AB' || lpad((tile)::VARCHAR, 2, '0') || '_5000_0101' AS tile FROM cand WHERE (length(kind) + tile) % 3 > 0),
  e AS (SELECT slug, tile, '20' || lpad((length(slug))::VARCHAR, 2, '0') AS "end" FROM x), l AS (SELECT tile, max({'e': "end", 's': slug}) AS m, string_agg(slug, ',' ORDER BY slug) AS surveys FROM e GROUP BY tile)
  SELECT tile, m.s AS latest_survey, surveys, split_part(tile, '_', 1) AS sheet, m.s < '3' AS has_dsm, split_part(tile, '_', 1) < 'AB05' AS in_national FROM l"""))
def partition_tiles(spark, d):
    return _partition_tiles(cand(spark, d))


def _partition_tiles(c):
    x = c.select(F.col("kind").alias("slug"), "tile").distinct().where((F.length("slug") + F.col("tile")) % 3 > 0)
    name = F.concat(F.lit("AB"), F.lpad(F.col("tile").cast("string"), 2, "0"), F.lit("_5000_0101"))
    end = F.concat(F.lit("20"), F.lpad(F.length("slug").cast("string"), 2, "0"))
    sets = x.select("slug", name.alias("t"), end.alias("end")).groupBy("slug", "end").agg(F.collect_list("t").alias("items"))
    sets = sets.withColumn("items", F.concat("items", F.array(F.lit("bad id"))))
    national = x.select(F.substring_index(name, "_", 1).alias("sheet")).where("sheet < 'AB05'")
    p = catalog.partition_tiles(sets, sets.where("slug < '3'").select("slug", "items"), national)
    return p.select("tile", "latest_survey", "surveys", "sheet", "has_dsm", "in_national")
