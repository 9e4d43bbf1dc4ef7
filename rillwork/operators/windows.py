"""Window operators along lines and inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_from_zero(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """`rank`: 0 for the first row of each group in the given total order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def top_k(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return rank_from_zero(rows, keys, *order).where(F.col("rank") < k)


def first_of_group(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return top_k(rows, keys, 1, *order).drop("rank")


def average_rank_share(rows: DataFrame, keys: list[str], value: str, out: str = "pct") -> DataFrame:
    """Rank from the bottom over the group size, ties sharing their mean rank."""
    w, ties = Window.partitionBy(*keys), Window.partitionBy(*keys, value)
    mean = F.rank().over(w.orderBy(value)) + (F.count("*").over(ties) - 1) / 2
    return rows.withColumn(out, mean / F.count("*").over(w))


def running_distance(rows: DataFrame, keys: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """`along`: path length from the first row of the line."""
    w = Window.partitionBy(*keys).orderBy(*order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return rows.withColumn("__d", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).withColumn("along", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def moving_average(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int = 7, out: str = "smooth") -> DataFrame:
    """Centred mean of n; beyond the ends the end value is repeated, and the ends themselves stay."""
    r = n // 2
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    at, size = F.row_number().over(w), F.count("*").over(whole)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.sum(value).over(w.rowsBetween(-r, r))
    d = rows.withColumns({"__at": at, "__n": size, "__f": first, "__l": last, "__s": inside})
    before, after = F.greatest(F.lit(r) - F.col("__at") + 1, F.lit(0)), F.greatest(F.col("__at") + r - F.col("__n"), F.lit(0))
    mean = (F.col("__s") + before * F.col("__f") + after * F.col("__l")) / n
    ends = (F.col("__at") == 1) | (F.col("__at") == F.col("__n"))
    return d.withColumn(out, F.when(ends, F.col(value)).otherwise(mean)).drop("__at", "__n", "__f", "__l", "__s")


def bed_bumps(rows: DataFrame, keys: list[str], order: list[str], value: str = "z", reach: int = 15) -> DataFrame:
    """`bump`: height above the higher of the least values within `reach` rows behind and ahead; null at the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    behind, ahead = F.min(value).over(w.rowsBetween(-reach, -1)), F.min(value).over(w.rowsBetween(1, reach))
    return rows.withColumn("bump", F.when(behind.isNotNull() & ahead.isNotNull(), F.col(value) - F.greatest(behind, ahead)))


def islands(rows: DataFrame, keys: list[str], order: list[str], test: Column, *extra: Column) -> DataFrame:
    """Runs of consecutive rows for which `test` holds: island number per group, n_rows, and the extra aggregates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = rows.withColumns({"__all": F.row_number().over(w), "__t": F.coalesce(test, F.lit(False))}).where("__t")
    d = d.withColumn("__run", F.col("__all") - F.row_number().over(w))
    return d.groupBy(*keys, "__run").agg(F.count("*").alias("n_rows"), F.min("__all").alias("first_at"), *extra).drop("__run")


def value_runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encoding: run number, value, n_rows, first_at per group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d = rows.withColumns({"__all": F.row_number().over(w), "__c": change})
    d = d.withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("n_rows"), F.min("__all").alias("first_at"))


def gap_rise(rows: DataFrame, keys: list[str], along: str, value: str = "z", inner: int = 6, outer: int = 15) -> DataFrame:
    """`rise`: greatest value within `inner` of a row minus the higher of the least values beyond, out to `outer`."""
    w = Window.partitionBy(*keys).orderBy(along)
    top = F.max(value).over(w.rangeBetween(-inner, inner))
    left, right = F.min(value).over(w.rangeBetween(-outer, -inner)), F.min(value).over(w.rangeBetween(inner, outer))
    return rows.withColumn("rise", F.when(left.isNotNull() & right.isNotNull(), top - F.greatest(left, right)))


def end_sixths_rise(rows: DataFrame, keys: list[str], order: list[str], value: str = "z") -> DataFrame:
    """Per line: greatest value minus the higher of the least values in its first and last sixth."""
    d = rows.withColumn("__k", F.ntile(6).over(Window.partitionBy(*keys).orderBy(*order)))
    first, last = F.min(F.when(F.col("__k") == 1, F.col(value))), F.min(F.when(F.col("__k") == 6, F.col(value)))
    return d.groupBy(*keys).agg((F.max(value) - F.greatest(first, last)).alias("rise"), F.count("*").alias("n_rows"))


def until_share(rows: DataFrame, keys: list[str], hit: Column, share: float, *order: Column) -> DataFrame:
    """Per group: rows reviewed in the given order until the share of all hits is reached."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = rows.withColumn("__h", F.when(hit, 1).otherwise(0))
    d = d.withColumns({"__c": F.sum("__h").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__r": F.row_number().over(w), "__t": F.sum("__h").over(Window.partitionBy(*keys))})
    return d.where((F.col("__t") > 0) & (F.col("__c") >= F.col("__t") * share)).groupBy(*keys).agg(F.min("__r").alias("n_reviewed"), F.first("__t").alias("n_hits"))
