"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").filter("b > a AND b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge runs from the smaller a to the larger b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    met = edges.join(least, "b")
    moved = met.filter("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return met.select(F.col("m").alias("x"), F.col("b").alias("y")).union(moved).distinct().toDF("a", "b")


def components(links: DataFrame) -> DataFrame:
    """member and component (its smallest member) for every end of links(a, b); ids that link with nothing aren't listed.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    while (now := edges.agg(mark.alias("m")).first()["m"]) != before:
        before = now
        edges = written(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("b").alias("member"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
