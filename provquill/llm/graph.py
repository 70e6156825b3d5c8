"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, write_shared


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an undirected edge table.

    Each step joins edges to the per-node minimum, so no neighbour list is ever gathered in one task; a hub is
    an ordinary skewed join key; joins sort, as a broadcast of all nodes would pass through the driver.  Every round is written to the shared folder, which cuts the lineage and
    survives lost executors, and the tables of earlier rounds are deleted.  Self links and repeats are harmless.
    """
    spark = edges.sparkSession
    links = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path = write_shared(links, "links")
    before: tuple | None = None
    while True:
        links = spark.read.parquet(path)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").selectExpr("greatest(v, m) AS u", "m AS v").where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = write_shared(small, "links")
        delete(spark, path)
        path = new
        links = spark.read.parquet(path)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
