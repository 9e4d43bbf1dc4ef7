"""Learned scorers on candidate tables: gradient boosting with weights, folds by block, importance by shuffling.

Missing features are replaced by the training median and flagged, since the trees take no nulls. Blocks go to folds by a
digest, so all rows of a block are in one fold and reruns agree.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .metrics import average_precision


def fold_of(block: str, k: int):
    return F.conv(F.substring(F.sha2(F.col(block).cast("string"), 256), 1, 8), 16, 10).cast("long") % k


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    one = rows.agg(*[F.percentile(F.col(c).cast("double"), 0.5).alias(c) for c in columns]).first()
    return {c: float(one[c]) if one[c] is not None else 0.0 for c in columns}


def assemble(rows: DataFrame, columns: list[str], fill: dict[str, float]) -> DataFrame:
    wide = rows
    for c in columns:
        wide = wide.withColumn(f"__{c}", F.coalesce(F.col(c).cast("double"), F.lit(fill[c]))).withColumn(f"__na_{c}", F.col(c).isNull().cast("double"))
    inputs = [f"__{c}" for c in columns] + [f"__na_{c}" for c in columns]
    return VectorAssembler(inputCols=inputs, outputCol="__x").transform(wide).drop(*inputs)


def fit(rows: DataFrame, columns: list[str], y: str, weight: str | None = None, rounds: int = 10, depth: int = 3):
    """(model, fill values) of boosted trees."""
    fill = medians(rows, columns)
    table = assemble(rows.withColumn("__y", F.col(y).cast("double")), columns, fill)
    model = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=depth, seed=1, **({"weightCol": weight} if weight else {}))
    return model.fit(table), fill


def predict(rows: DataFrame, model, columns: list[str], fill: dict[str, float], out: str = "p") -> DataFrame:
    scored = model.transform(assemble(rows, columns, fill))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, columns: list[str], y: str, block: str, k: int) -> DataFrame:
    """Every row scored by the model of the fold that held its block out: the input's columns, fold and p."""
    table = materialize(rows.withColumn("fold", fold_of(block, k).cast("int")), "learn-rows")
    out = None
    for f in range(k):
        model, fill = fit(table.where(F.col("fold") != f), columns, y)
        part = predict(table.where(F.col("fold") == f), model, columns, fill)
        out = part if out is None else out.unionByName(part)
    return out


def importance(rows: DataFrame, columns: list[str], y: str, repeats: int, most: int = 20_000) -> DataFrame:
    """Drop in average precision when a feature's values move to other rows, averaged over repeats.

    A report on at most `most` rows, picked by digest. A value moves from one row to the next in digest order inside each of
    64 hash groups, so no task sorts all rows.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    model, fill = fit(rows, columns, y)
    sample = materialize(rows.orderBy(F.sha2(F.col("id").cast("string"), 256)).limit(most), "learn-sample")
    ap = lambda t: average_precision(predict(t, model, columns, fill).withColumn("g", F.lit(0)), ["g"], "p", y).first()["ap"]
    base, out = ap(sample), []
    for c in columns:
        total = 0.0
        for r in range(repeats):
            w = Window.partitionBy(F.pmod(F.xxhash64(F.lit(r), "id"), F.lit(64))).orderBy(F.sha2(F.concat_ws(":", F.lit(str(r)), "id"), 256))
            moved = sample.withColumn(c, F.coalesce(F.lag(c).over(w), F.col(c)))
            total += base - ap(moved)
        out.append((c, total / repeats))
    return spark.createDataFrame(out, "feature string, drop double")
