"""The driver's tables as images and traces.

``px``: rows of the embeddings table are image rows (100 x 64 pixels a plane);
``tr``: events of a user are a trace; ``stk``: planes of ``px`` as frames of one plane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEIGHT, WIDTH = 100, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    z, y, x = F.floor(F.col("vec_id") / HEIGHT) + 1, F.pmod("vec_id", F.lit(HEIGHT)) + 1, F.col("p") + 1
    v = F.floor((F.col("e").cast("double") + 0.6) * 500)
    return rows.select(z.cast("long").alias("z"), y.cast("long").alias("y"), x.cast("long").alias("x"), ((x - 1) * HEIGHT + y).cast("long").alias("ind"), v.cast("long").alias("v"))


def tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cell_id"), F.row_number().over(order).cast("long").alias("t"), F.col("value").alias("f"))


def stk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).select(F.lit(1).cast("long").alias("z"), F.col("z").alias("t"), "y", "x", "ind", "v")


#: The same views for DuckDB.
SQL = {
    "px": "px AS (SELECT vec_id // 100 + 1 AS z, vec_id % 100 + 1 AS y, x, (x - 1) * 100 + vec_id % 100 + 1 AS ind, CAST(floor((CAST(e AS DOUBLE) + 0.6) * 500) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS e, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS x FROM embeddings))",
    "tr": "tr AS (SELECT user_id AS cell_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS f FROM events)",
    "stk": "stk AS (SELECT CAST(1 AS BIGINT) AS z, z AS t, y, x, ind, v FROM px)",
}


def with_views(sql: str, *views: str) -> str:
    """A query that starts with the named views."""
    names = [v for v in ("px", "tr", "stk") if v in views or (v == "px" and "stk" in views)]
    return "WITH RECURSIVE " + ", ".join(SQL[v] for v in names) + (", " + sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else " " + sql)
