"""Arrangement of motif hits within sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.operators.shared import reused

CENTRE = "(start + `end`) div 2"


def homotypic_cluster(hits: DataFrame, window: int = 100) -> DataFrame:
    """Per sequence the most hits of one factor whose centres lie within `window`."""
    order = W.partitionBy("seq_id", "tf").orderBy("_c").rangeBetween(-window, 0)
    near = hits.selectExpr("seq_id", "tf", f"cast({CENTRE} as long) AS _c").withColumn("_n", F.count(F.lit(1)).over(order))
    return near.groupBy("seq_id").agg(F.max("_n").alias("cluster"))


def distinct_factors(hits: DataFrame) -> DataFrame:
    return hits.groupBy("seq_id").agg(F.countDistinct("tf").alias("factors"))


def heterotypic_pairs(hits: DataFrame, distance: int = 100) -> DataFrame:
    """Per sequence the unordered pairs of hits of different factors with centres at most `distance` apart.

    All hits in reach less those of the same factor, by range frames: no pair is ever formed.
    Hits at one centre are put in order by half steps, so that each pair counts once.
    """
    c = hits.selectExpr("seq_id", "tf", f"cast({CENTRE} as long) AS _c")
    per = c.groupBy("seq_id", "tf", "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("seq_id").orderBy("_c").rangeBetween(-distance, -1)
    same_before = W.partitionBy("seq_id", "tf").orderBy("_c").rangeBetween(-distance, -1)
    here = W.partitionBy("seq_id", "_c")
    zero = F.lit(0)
    per = per.withColumns({
        "_earlier": F.coalesce(F.sum("_n").over(before), zero) - F.coalesce(F.sum("_n").over(same_before), zero),
        "_here": F.sum("_n").over(here) - F.col("_n"),
    })
    # Pairs at one centre are seen from both sides.
    twice = F.sum(F.col("_n") * (2 * F.col("_earlier") + F.col("_here")))
    return per.groupBy("seq_id").agg(F.floor(twice / 2).alias("pairs"))


def centre_distance(hits: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per sequence with hits the mean distance of their centres from the middle."""
    met = hits.select("seq_id", "start", "end").hint("merge").join(sequences.select("seq_id", F.length("seq").alias("_l")), "seq_id")
    return met.groupBy("seq_id").agg(F.avg(F.abs((F.col("start") + F.col("end")) / 2.0 - F.col("_l") / 2.0)).alias("centre_distance"))


def grammar_profile(hits: DataFrame, sequences: DataFrame, window: int = 100, distance: int = 100) -> DataFrame:
    """One row per sequence, those without hits included: cluster, factors, pairs, centre_distance (null without hits), n_hits.

    The hits are found once and dealt by sequence once.
    """
    if window < 1 or distance < 1:
        raise ValueError("distances must be at least 1")
    found = reused(hits.select("seq_id", "tf", "start", "end").repartition("seq_id"))
    n = found.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("tf").alias("factors"))
    out = sequences.select("seq_id")
    for part in (homotypic_cluster(found, window), heterotypic_pairs(found, distance), centre_distance(found, sequences), n):
        out = out.join(part, "seq_id", "left")
    out = out.select("seq_id", "cluster", "factors", "pairs", "centre_distance", "n_hits")
    return out.fillna(0, ["cluster", "factors", "pairs", "n_hits"])


def factor_counts(hits: DataFrame, sequences: DataFrame, factors: DataFrame) -> DataFrame:
    """Hits per (sequence, factor), zeros kept, as statistic `hits:tf`; the list of factors is short."""
    n = hits.groupBy("seq_id", "tf").agg(F.count(F.lit(1)).alias("n"))
    grid = sequences.select("seq_id").crossJoin(F.broadcast(factors.select("tf")))
    out = grid.join(n, ["seq_id", "tf"], "left")
    return out.select("seq_id", F.concat(F.lit("hits:"), F.col("tf")).alias("statistic"), F.coalesce("n", F.lit(0)).alias("value"))
