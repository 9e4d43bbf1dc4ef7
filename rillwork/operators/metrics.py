"""Ranking and classification measures as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

from .windows import rank_from_zero


def recall_at(rows: DataFrame, group: list[str], tile: str, k: int, positive: Column, missed: DataFrame | None = None, order: str = "score") -> DataFrame:
    """Per group: positives, those among the k best of their tile, recall (missed positives count below) and reachable
    recall (they do not). missed: group columns, one row a positive that has no candidate."""
    r = rank_from_zero(rows, [tile], F.desc(order), F.col("id"))
    a = r.groupBy(*group).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("n_pos"), F.sum(F.when(positive & (F.col("rank") < k), 1).otherwise(0)).alias("n_top"))
    if missed is not None:
        a = a.join(missed.groupBy(*group).agg(F.count("*").alias("n_missed")), group, "left").fillna({"n_missed": 0})
    else:
        a = a.withColumn("n_missed", F.lit(0).cast("long"))
    return a.withColumns({
        "recall": F.when(F.col("n_pos") + F.col("n_missed") > 0, F.col("n_top") / (F.col("n_pos") + F.col("n_missed"))),
        "reachable": F.when(F.col("n_pos") > 0, F.col("n_top") / F.col("n_pos")),
    })


def average_precision(rows: DataFrame, group: list[str], score: str, y: str) -> DataFrame:
    """Sum over thresholds of the gain in recall times precision; equal scores are one threshold."""
    steps = rows.where(F.col(y).isNotNull()).groupBy(*group, score).agg(F.count("*").alias("__n"), F.sum(y).alias("__p"))
    w = Window.partitionBy(*group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    c = steps.withColumns({"__cn": F.sum("__n").over(w), "__cp": F.sum("__p").over(w), "__tp": F.sum("__p").over(Window.partitionBy(*group))})
    gain = F.when(F.col("__tp") > 0, F.col("__p") / F.col("__tp") * (F.col("__cp") / F.col("__cn")))
    return c.groupBy(*group).agg(F.sum(gain).alias("ap"), F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_rows"))


def running_sums(steps: DataFrame, group: list[str], order: Column, sums: list[str]) -> DataFrame:
    """Adds before_<column> for each of the sums: its total over the rows of the group that come earlier. The rows are dealt
    in order of group and `order`, so that a group is spread over tasks; a part starts from the totals of those before it."""
    dealt = materialize(steps.repartitionByRange(*[F.col(g) for g in group], order).withColumn("__part", F.spark_partition_id()), "running")
    whole = dealt.groupBy(*group, "__part").agg(*[F.sum(c).alias(f"__all_{c}") for c in sums])
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = whole.select(*group, "__part", *[F.coalesce(F.sum(f"__all_{c}").over(earlier), F.lit(0)).alias(f"__start_{c}") for c in sums])
    inside = Window.partitionBy(*group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, "__part"]
    a, b = dealt.withColumns({f"__in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).alias("a"), starts.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in steps.columns], *[(F.col(f"__in_{c}") + F.col(f"__start_{c}")).alias(f"before_{c}") for c in sums])


def roc_auc(rows: DataFrame, group: list[str], score: str, y: str) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half, from average ranks. Rows are summed by score
    first; the ranks are running sums over the distinct scores."""
    steps = rows.where(F.col(y).isNotNull()).groupBy(*group, score).agg(F.count("*").alias("__n"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("__p"))
    ranked = running_sums(steps, group, F.col(score).asc(), ["__n"])
    rank = F.col("before___n") + (F.col("__n") + 1) / 2
    a = ranked.groupBy(*group).agg(F.sum(F.col("__p") * rank).alias("s"), F.sum("__p").alias("n1"), F.sum("__n").alias("n"))
    n0 = F.col("n") - F.col("n1")
    return a.select(*group, "n1", n0.alias("n0"), F.when((F.col("n1") > 0) & (n0 > 0), (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * n0)).alias("auc"))


def histogram_ap(rows: DataFrame, group: list[str], score: Column, y: str, bins: int = 1000) -> DataFrame:
    """Average precision from mergeable histograms of bins + 1 counters (score from 0 to 1)."""
    b = F.least(F.greatest(F.floor(score * bins), F.lit(0)), F.lit(bins)).alias("bin")
    return average_precision(rows.select(*group, b, y), group, "bin", y)


def youden(rows: DataFrame, score: str, y: str) -> DataFrame:
    """The threshold with the largest true minus false positive rate; ties to the lowest threshold. One row."""
    steps = rows.where(F.col(y).isNotNull()).groupBy(score).agg(F.sum(y).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    c = running_sums(steps, [], F.col(score).desc(), ["p", "n"])
    total = steps.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    c = c.crossJoin(F.broadcast(total))  # one row
    j = (F.col("before_p") + F.col("p")) / F.col("tp") - (F.col("before_n") + F.col("n")) / F.col("tn")
    return c.agg(F.max(F.struct(j.alias("j"), (-F.col(score)).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("threshold"), F.col("m.j").alias("j"))


def calibrate(rows: DataFrame, group: list[str], score: str, y: str, precision: float) -> DataFrame:
    """Per group the lowest score at which the rows from the top down to it reach the precision; where none does, the score
    of the best precision (`reached` false; ties to the highest score)."""
    steps = rows.where(F.col(y).isNotNull()).groupBy(*group, score).agg(F.count("*").alias("n"), F.sum(y).alias("p"))
    w = Window.partitionBy(*group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    c = steps.withColumns({"cn": F.sum("n").over(w), "cp": F.sum("p").over(w)}).withColumn("prec", F.col("cp") / F.col("cn"))
    a = c.groupBy(*group).agg(F.min(F.when(F.col("prec") >= precision, F.col(score))).alias("low"), F.max(F.struct(F.col("prec").alias("p"), F.col(score).alias("s"))).alias("m"))
    return a.select(*group, F.coalesce("low", F.col("m.s")).alias("threshold"), F.col("low").isNotNull().alias("reached"))


def summary(rows: DataFrame, group: list[str], value: str, inside: float) -> DataFrame:
    """Median, p5, p95, mean, greatest absolute value and share within +-inside, with linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    a = rows.groupBy(*group).agg(
        q.alias("q"), F.avg(value).alias("mean"), F.max(F.abs(value)).alias("max_abs"), F.avg(F.when(F.abs(value) <= inside, 1.0).otherwise(0.0)).alias("share"), F.count(value).alias("n")
    )
    return a.select(*group, F.col("q")[1].alias("median"), F.col("q")[0].alias("p5"), F.col("q")[2].alias("p95"), "mean", "max_abs", "share", "n")


def bootstrap_auc(rows: DataFrame, score: str, y: str, draws: int, seed: int) -> DataFrame:
    """AUC of `draws` Poisson resamples: each row's weight in a draw comes from a hash of (seed, draw, id), so a rerun is
    the same and no row is gathered."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.col("id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    p, total = 0.36787944117144233, 0.36787944117144233
    weight = F.lit(0)
    for k in range(1, 8):
        weight = weight + F.when(u >= total, 1).otherwise(0)
        p /= k
        total += p
    d = rows.where(F.col(y).isNotNull()).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("wt", weight).where("wt > 0")
    g = d.groupBy("draw", score).agg(F.sum(F.when(F.col(y) == 1, F.col("wt")).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, F.col("wt")).otherwise(0)).alias("n"))
    below = Window.partitionBy("draw").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("lower", F.coalesce(F.sum("n").over(below), F.lit(0)))
    a = g.groupBy("draw").agg(F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2)).alias("u"), F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    return a.select("draw", F.when((F.col("tp") > 0) & (F.col("tn") > 0), F.col("u") / (F.col("tp") * F.col("tn"))).alias("auc"))


def threshold_sweep(rows: DataFrame, group: list[str], score: str, y: str, thresholds: list[float]) -> DataFrame:
    """Counts, precision, recall and F1 per group and threshold in one pass: the thresholds are columns, not a join."""
    yes = F.col(y) == 1
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= t
        aggs += [F.sum(F.when(hit & yes, 1).otherwise(0)).alias(f"tp{i}"), F.sum(F.when(hit & ~yes, 1).otherwise(0)).alias(f"fp{i}")]
    a = rows.where(F.col(y).isNotNull()).groupBy(*group).agg(F.sum(F.when(yes, 1).otherwise(0)).alias("n_pos"), *aggs)
    parts = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)])
    r = a.select(*group, "n_pos", F.explode(parts).alias("s")).select(*group, "n_pos", "s.*")
    precision, recall = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))), F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + (F.col("n_pos") - F.col("tp")) > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos")))
    return r.withColumns({"precision": precision, "recall": recall, "f1": f1})
