"""Comparing two runs, tables or rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_rows(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer join on the key: status added, removed, changed or same, and the names of the changed columns."""
    x = a.select(*key, F.struct(*values).alias("__a"))
    y = b.select(*key, F.struct(*values).alias("__b"))
    j = x.join(y, key, "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"__a.{v}").eqNullSafe(F.col(f"__b.{v}")), F.lit(v)) for v in values]), lambda v: v.isNotNull())
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return j.select(*key, status.alias("status"), F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.array_join(changed, ",")).alias("columns"))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, repeats counted, with side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def transitions(a: DataFrame, b: DataFrame, key: list[str], code: str) -> DataFrame:
    """How many cells went from one code to another, over the cells both have."""
    j = a.select(*key, F.col(code).alias("code_a")).join(b.select(*key, F.col(code).alias("code_b")), key)
    return j.groupBy("code_a", "code_b").agg(F.count("*").alias("n"))


def difference_stats(a: DataFrame, b: DataFrame, key: list[str], value: str, by: str) -> DataFrame:
    """Statistics of b - a by code of a, over cells where both are valid."""
    j = a.select(*key, by, F.col(value).alias("va")).join(b.select(*key, F.col(value).alias("vb")), key)
    j = j.withColumn("d", F.col("vb") - F.col("va")).where("d is not null")
    q = F.percentile("d", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    s = j.groupBy(by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), q.alias("q"), F.max(F.abs("d")).alias("max_abs"))
    return s.select(by, "n", "mean", F.col("q")[0].alias("p5"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), "max_abs")


def side_by_side(rows: DataFrame, group: list[str], run: str, runs: list[str], hit: str) -> DataFrame:
    """Pooled ratio and mean of per-tile ratios (empty tiles ignored) of each run, as columns."""
    per_tile = rows.groupBy(*group, "tile", run).agg(F.sum(hit).alias("h"), F.count(hit).alias("n"))
    a = per_tile.groupBy(*group).pivot(run, runs)
    return a.agg((F.sum("h") / F.greatest(F.sum("n"), F.lit(1))).alias("pooled"), F.avg(F.try_divide(F.col("h"), F.col("n"))).alias("mean"))


def reason_table(rows: DataFrame, group: list[str], reason: str, reasons: list[str]) -> DataFrame:
    """Counts by reason as columns, zero-filled."""
    return rows.groupBy(*group).pivot(reason, reasons).count().na.fill(0, reasons)
