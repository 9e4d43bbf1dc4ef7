"""Matching label points with candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near import near_pairs


def match(labels: DataFrame, candidates: DataFrame, radius: float) -> DataFrame:
    """labels: id, x, y, radius, priority (lower first), value, and in the order of id. candidates: id, x, y.

    Every label goes to its nearest candidate within its own radius (at most `radius`); of a candidate's labels the best
    priority counts, the first on ties. One row a matched candidate: id, label_id, value, dist, n_labels, conflict (its
    labels differ in value).
    """
    pairs = near_pairs(labels.select("id", "x", "y", "radius", "priority", "value"), candidates.select("id", "x", "y"), radius).where("dist <= a_radius")
    best = pairs.groupBy(F.col("a_id").alias("label_id")).agg(F.min(F.struct("dist", "b_id", "a_priority", "a_value")).alias("m"))
    rows = best.select("label_id", F.col("m.b_id").alias("id"), F.col("m.dist").alias("dist"), F.col("m.a_priority").alias("priority"), F.col("m.a_value").alias("value"))
    a = rows.groupBy("id").agg(
        F.min(F.struct("priority", "label_id", "value", "dist")).alias("m"), F.count("*").alias("n_labels"), (F.min("value") != F.max("value")).alias("conflict")
    )
    return a.select("id", F.col("m.label_id").alias("label_id"), F.col("m.value").alias("value"), F.col("m.dist").alias("dist"), "n_labels", "conflict")


def misses(labels: DataFrame, candidates: DataFrame, radius: float) -> DataFrame:
    """Labels without a candidate within their radius."""
    hit = near_pairs(labels.select("id", "x", "y", "radius"), candidates.select("id", "x", "y"), radius).where("dist <= a_radius").select(F.col("a_id").alias("id")).distinct()
    return labels.join(hit, "id", "left_anti")


def near_positive(candidates: DataFrame, matched: DataFrame, radius: float) -> DataFrame:
    """Candidates that are no match themselves but lie within the radius of a positive one."""
    pos = candidates.join(matched.where("value = 1").select("id"), "id", "left_semi")
    rest = candidates.join(matched.select("id"), "id", "left_anti")
    hit = near_pairs(rest.select("id", "x", "y"), pos.select("id", "x", "y"), radius).select(F.col("a_id").alias("id")).distinct()
    return rest.join(hit, "id", "left_semi")


def attach_records(records: DataFrame, candidates: DataFrame, radius: float) -> DataFrame:
    """Records (id, x, y) join their nearest candidate within the radius: id, x, y, recorded, record_ids (joined by ;).
    Records without one become rows of their own with id null."""
    pairs = near_pairs(records.select("id", "x", "y"), candidates.select("id", "x", "y"), radius)
    own = pairs.groupBy(F.col("a_id").alias("record")).agg(F.min(F.struct("dist", "b_id")).alias("m")).select("record", F.col("m.b_id").alias("id"))
    joined = own.groupBy("id").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_set("record")), lambda v: v.cast("string"))).alias("record_ids"))
    a = candidates.join(joined, "id", "left").select("id", "x", "y", F.col("record_ids").isNotNull().alias("recorded"), "record_ids")
    rest = records.join(own.select(F.col("record").alias("id")), "id", "left_anti")
    return a.unionByName(rest.select(F.lit(None).cast(candidates.schema["id"].dataType).alias("id"), "x", "y", F.lit(True).alias("recorded"), F.col("id").cast("string").alias("record_ids")))


def unlabelled_weights(rows: DataFrame, ratio: float, group: list[str]) -> DataFrame:
    """Weight 1 for labelled rows; unlabelled ones share ratio times the positive weight of their group."""
    w = Window.partitionBy(*group)
    pos = F.sum(F.when(F.col("positive"), 1.0).otherwise(0.0)).over(w)
    unl = F.sum(F.when(F.col("unlabelled"), 1.0).otherwise(0.0)).over(w)
    own = F.when(F.col("positive") | F.col("negative"), F.lit(1.0)).when(F.col("unlabelled"), F.lit(ratio) * pos / unl).otherwise(F.lit(0.0))
    return rows.withColumn("weight", own)


def block_folds(rows: DataFrame, block: str, stratum: str, k: int) -> DataFrame:
    """fold per block: blocks of a stratum in the order of a digest go round the k folds, so all rows of a block stay together
    and strata spread evenly. Blocks in more than one stratum count by their least one."""
    blocks = rows.groupBy(block).agg(F.min(stratum).alias("s"))
    order = F.row_number().over(Window.partitionBy("s").orderBy(F.sha2(F.col(block).cast("string"), 256), block)) - 1
    return rows.join(blocks.select(block, (order % k).cast("int").alias("fold")), block)


def candidate_summary(rows: DataFrame, groups: list[list[str]], *aggs) -> DataFrame:
    """Several groupings in one pass: GROUPING SETS, null where a column is not part of the set, with grouping_id."""
    names = sorted({c for g in groups for c in g})
    ids = [c for c in rows.columns if c in names]
    return rows.groupingSets([[F.col(c) for c in g] for g in groups], *[F.col(c) for c in ids]).agg(F.grouping_id().alias("gid"), *aggs)
