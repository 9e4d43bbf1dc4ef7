"""The driver's tables seen as points, rasters, candidates, profiles, links, trees and registry rows.

Each view exists twice with one meaning: as a DataFrame and as SQL text for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(k: int):
    return F.element_at("embedding", k).cast("double")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (_at(1) * 1000).alias("x"), (_at(2) * 1000).alias("y"), F.col("label").alias("kind"),
        (_at(3) * 1000).alias("dx"), (_at(4) * 1000).alias("dy"), (_at(5) * 100).alias("w"),
    )


def ras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value"),
    ).select(F.col("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("z"))


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    y = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("tile"), F.col("n_name").alias("council"), F.col("r_name").alias("region"),
            F.col("o_totalprice").alias("score"), y.alias("y"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("made"),
            F.col("o_orderstatus").alias("status"),
        )
    )


def prof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("line"), F.col("event_id").alias("id"), F.col("ts"), F.col("value").alias("z"), F.col("event_type").alias("kind"), "props"
    )


def lnk(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(0.0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"),
        F.col("l_quantity").alias("length"), (F.col("l_discount") + z).alias("rise"), (F.col("l_tax") * 10 + z).alias("prob"),
        (F.col("l_returnflag") == "R").alias("road"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k > 0, F.floor((k - 1) / 2)).cast("long").alias("parent"), F.col("p_retailprice").alias("area"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("type"),
    )


SQL: dict[str, str] = {
    "pts": """SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, label AS kind,
        embedding[3]::DOUBLE * 1000 AS dx, embedding[4]::DOUBLE * 1000 AS dy, embedding[5]::DOUBLE * 100 AS w FROM embeddings""",
    "ras": """SELECT vec_id AS "row", (i - 1)::BIGINT AS col, embedding[i]::DOUBLE AS z
        FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""",
    "cand": """SELECT o_orderkey AS id, o_custkey % 20 AS tile, n_name AS council, r_name AS region, o_totalprice AS score,
        CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y, o_orderpriority AS kind, o_orderdate AS made, o_orderstatus AS status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "prof": "SELECT user_id AS line, event_id AS id, ts, value AS z, event_type AS kind, props FROM events",
    "lnk": """SELECT l_orderkey AS o, l_linenumber AS ln, l_suppkey AS u, l_partkey AS v, l_quantity AS length, l_discount + 0.0 AS rise,
        l_tax * 10 + 0.0 AS prob, l_returnflag = 'R' AS road, l_linestatus AS status, l_extendedprice AS price, l_returnflag AS flag FROM lineitem""",
    "tree": """SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent, p_retailprice AS area, p_brand AS brand,
        p_type AS type FROM part""",
}


def over(names: str, body: str, recursive: bool = False) -> str:
    """SQL text with the named views (space separated) as common table expressions before `body`, which may go on with
    more of them after a leading comma."""
    views = ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{body if body.lstrip().startswith(',') else chr(10) + body}"


class Catalogue:
    """Named queries with their oracle text."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            if name in self.queries:
                raise ValueError(f"query {name} is there already")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep
