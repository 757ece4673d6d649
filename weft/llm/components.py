"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import drop_table, table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Here every edge has a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    return edges.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has bigint columns a and b.  Returns (node, root), root being the smallest node reachable.

    Alternates large-star and small-star contraction; a round is written to the
    shared folder, and the work ends when a round leaves the edges as they were.
    Self loops vanish: a node without a partner gets no row.
    """
    now = table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if found == mark or not found["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark, before = found, now
        now = table(_small_star(_large_star(now).distinct()).distinct(), "edges")
        drop_table(before)
