"""Connected components over an edge table, with checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, release


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: link neighbours of each node to the least node of its neighbourhood.

    The large star moves neighbours above the node, the small one those below it. The
    least node is a map-side minimum joined back, so no task holds a hub's neighbours.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, center)`` for each node of ``edges (a, b)`` but the centers: the least node it reaches.

    Alternates large and small stars until a round changes nothing. Each round is a
    table in the shared folder, so a lost executor costs one round, not the run; only
    a count and a checksum reach the driver. No edges: an empty table.
    """
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = state(now)
    while was[0]:
        after = materialize(_stars(_stars(now, True), False), "edges")
        release(spark, now)
        now, before = after, was
        was = state(now)
        if was == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("center"))
