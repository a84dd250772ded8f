"""Connected components of an edge table, by alternating joins of every vertex with the least label near it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pipeline_io import checkpoint_folder


def cut(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """checkpoint() in the folder that all executors share."""
    checkpoint_folder(spark)
    return frame.checkpoint()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, label) of the vertices of edges (a, b): the least id that can be reached.

    Each round turns the edges into (vertex, least neighbour) stars: a vertex's larger neighbours are linked to its least
    neighbour, then its smaller ones to the least. It ends when no edge changes; the rounds grow with the logarithm of the
    longest chain. Only a count comes to the driver.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        """Of each u: those neighbours v with v > u (or v <= u) are linked to the least of u and its neighbours."""
        if larger:
            both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        else:
            both = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if larger:
            linked = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
        return linked.filter("a <> b").distinct()

    pairs, before = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), None
    while True:
        pairs = cut(spark, star(star(pairs, True), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("label"))
        before = now
