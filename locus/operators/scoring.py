"""Track predictions and specificity scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER_BUCKET = 100_000


def _signal(tracks: Column, index: Column) -> Column:
    return F.transform(index, lambda i: F.element_at(tracks, i + 1).cast("double"))


def _mean(values: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def mssi(df: DataFrame, panel: dict[str, list[int]], background: list[int]) -> DataFrame:
    """Adds mssi_score = mean(target tracks) - mean(background tracks) and both signals, targets by cell_type."""
    targets = F.create_map(*[x for ct, index in panel.items() for x in (F.lit(ct), F.array(*map(F.lit, index)))])
    out = df.withColumns({
        "target_signal": _signal(F.col("tracks"), F.element_at(targets, F.col("cell_type"))),
        "background_signal": _signal(F.col("tracks"), F.array(*map(F.lit, background))),
    })
    return out.withColumn("mssi_score", _mean(F.col("target_signal")) - _mean(F.col("background_signal")))


def mssi_summary(scores: DataFrame, order: str) -> DataFrame:
    """Adds running_mean in the order of an integer column and mean_mssi; sums run within buckets and over bucket sums."""
    s = scores.withColumn("_b", F.floor(F.col(order) / ORDER_BUCKET))
    per = s.groupBy("_b").agg(F.sum("mssi_score").alias("_s"), F.count("mssi_score").alias("_n"))
    along, every = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = per.select("_b", F.coalesce(F.sum("_s").over(along), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_n0"), (F.sum("_s").over(every) / F.sum("_n").over(every)).alias("mean_mssi"))
    inside = W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = s.withColumns({"_rs": F.sum("mssi_score").over(inside), "_rn": F.count("mssi_score").over(inside)}).join(per, "_b")
    return out.withColumn("running_mean", (F.col("_s0") + F.col("_rs")) / (F.col("_n0") + F.col("_rn"))).drop("_b", "_rs", "_rn", "_s0", "_n0")


def bin_mean(long: DataFrame) -> DataFrame:
    """Mean over output bins per (seq_id, track)."""
    return long.groupBy("seq_id", "track").agg(F.avg("value").alias("mean"))


def attribution_summary(df: DataFrame) -> DataFrame:
    """Per sequence mean and largest absolute attribution, and where it is (the first on ties)."""
    size = F.transform("attribution", lambda a: F.abs(a.cast("double")))
    out = df.withColumn("_a", size)
    return out.select("seq_id", _mean(F.col("_a")).alias("mean_abs"), F.array_max("_a").alias("max_abs"), (F.array_position("_a", F.array_max("_a")) - 1).cast("int").alias("argmax"))


def score_with_locus(sequences: DataFrame, metadata: DataFrame, order: str, validate: bool = True) -> DataFrame:
    """Sequences with chrom, center and cell_type of their metadata; of a repeated id the last in `order` counts."""
    last = metadata.groupBy("seq_id").agg(F.max_by(F.struct("chrom", "start", "end", "cell_type"), order).alias("m"))
    if validate and not sequences.join(last, "seq_id", "left_anti").isEmpty():
        raise ValueError("sequences without metadata")
    met = sequences.join(last, "seq_id")
    return met.select(*sequences.columns, F.col("m.chrom").alias("chrom"), F.floor((F.col("m.start") + F.col("m.end")) / 2).alias("center"), F.col("m.cell_type").alias("cell_type"))


def score_with(df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], column: str = "seq") -> DataFrame:
    """Adds tracks, the track means of a predictor that `load` makes once per task. No model is shipped."""

    @F.pandas_udf("array<float>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predictor = load()
        if predictor is None:
            raise RuntimeError("no model to score with")
        for batch in batches:
            yield pd.Series(list(np.asarray(predictor(list(batch)), np.float32)))

    return df.withColumn("tracks", predict(F.col(column)))


def track_panel_violations(panel: DataFrame, n_tracks: int) -> DataFrame:
    """Problems of panel(cell_type, target, background): empty lists, indices out of range, tracks on both sides."""
    outside = lambda c: F.exists(c, lambda i: (i < 0) | (i >= n_tracks))
    problems = F.array_compact(
        F.array(
            F.when(F.size("target") == 0, "no target"), F.when(F.size("background") == 0, "no background"), F.when(outside("target") | outside("background"), "out of range"),
            F.when(F.size(F.array_intersect("target", "background")) > 0, "overlap"),
        )
    )
    return panel.select("cell_type", F.explode(problems).alias("problem"))
