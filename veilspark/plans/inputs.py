"""Frames, boxes, lines of text and tensors derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

BOX = """select cast(floor(l_orderkey / 16) as bigint) as frame, cast(l_partkey % 600 as int) as x, cast((l_suppkey * 4) % 400 as int) as y,
 cast(floor(20 + l_quantity) as int) as w, cast(20 + l_linenumber * 10 as int) as h, l_discount * 10 as score, l_orderkey * 10 + l_linenumber as id from lineitem"""
FRAME = """select cast(o_custkey % 50 as int) as media_id, cast(row_number() over (partition by o_custkey % 50 order by o_orderkey) - 1 as bigint) as frame_index,
 cast(case o_orderkey % 4 when 0 then 1920 when 1 then 1280 when 2 then 640 else 320 end as int) as width,
 cast(case o_orderkey % 4 when 0 then 1080 when 1 then 720 when 2 then 480 else 240 end as int) as height, o_orderkey from orders"""
CAMERA = """select user_id as media_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_index, event_id from events"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {name}", "from {t}"), t=read(spark, sf_dir, name))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = view(spark, sf_dir, BOX, "lineitem")
    return b.withColumn("polygon", g.from_bbox(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FRAME, "orders")


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CAMERA, "events")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"), ((F.col("n_chars") % 100) / 100.0).alias("rec_score"))


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 steps of 4 classes for each vector."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice(e["embedding"], t * 4 + 1, 4)).alias("steps"))
