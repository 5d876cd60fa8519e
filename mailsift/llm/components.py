"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.session import scratch_path


def _written(df: DataFrame) -> DataFrame:
    at = scratch_path(df.sparkSession, "stars")
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); the root is the least node of its component.

    Each round is written to the shared folder. It ends when a round changes nothing, which the number of edges and a
    sum over them show; rounds grow with the logarithm of the longest path. A node with very many neighbours only ever
    takes part in aggregates and in plain joins, which Spark splits where they are skewed.
    """
    stars, before = _written(_small(edges.where("a <> b").select("a", "b"))), None
    while True:
        now = tuple(stars.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == before or not now[0]:
            break
        before = now
        stars = _written(_small(_large(stars)))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
