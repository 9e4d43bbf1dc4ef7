from pyspark.sql import functions as F

from rillwork.plans.engine import Engine
from rillwork.sources.raster import analytic_scene


def test_chain_finds_the_wall(spark):
    e = Engine(spark, tile=128, halo=20)
    cells = analytic_scene(spark, 100, 61)
    got = e.network(cells)
    barriers = got["barriers"].collect()
    assert len(barriers) == 1 and 45 <= barriers[0].y <= 56 and abs(barriers[0].x - 31) <= 4 and barriers[0].height_m > 1
    h = got["hydrology"].cache()
    assert h.count() == 6100 and h.where("filled < breached - 1e-9").count() == 0
    assert h.agg(F.max("area")).first()[0] > 1000 and h.agg(F.max("stream_order")).first()[0] >= 2
    assert got["channels"].count() == 6100
    ranked = e.rank(got["barriers"], spark.createDataFrame([(1, barriers[0].x + 3, barriers[0].y)], "id long, x double, y double")).first()
    assert ranked.road_m == 3.0 and ranked.tier in ("medium", "high")


def test_dataset_and_training(spark):
    can = spark.range(400).select("id", (F.col("id") % 20 * 100.0).alias("x"), (F.floor(F.col("id") / 20) * 100.0).alias("y"), (F.col("id") % 7).cast("double").alias("f"))
    known = can.where("f >= 5").select(F.col("id"), "x", (F.col("y") + 2).alias("y"), F.lit(10.0).alias("radius"), F.lit(1).alias("priority"), F.lit(1).alias("value"))
    known = known.unionByName(spark.createDataFrame([(9999, -500.0, -500.0, 10.0, 1, 1)], known.schema))
    e = Engine(spark)
    rows, missed = e.dataset(can, known)
    assert [r.id for r in missed.collect()] == [9999] and rows.where("value = 1").count() == can.where("f >= 5").count()
    rows = rows.withColumns({"y1": F.coalesce("value", F.lit(0)), "block": F.floor(F.col("id") / 20), "g": F.lit("all")})
    score = e.evaluate(e.train(rows.withColumn("y1", F.col("y1")), ["f"], "y1", "block", 2), ["g"], "y1").first()
    assert score.auc > 0.99 and score.ap > 0.95
