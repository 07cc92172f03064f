"""Features of sequences and conditions: normalisation statistics, condition vectors, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus.functions.seq import n_fraction


def fit_normalisation(df: DataFrame, features: list[str], method: str = "zscore") -> DataFrame:
    """One row: method, features, center and scale. z-score: mean and population deviation; min-max: minimum and range. A scale of 0 is 1."""
    if method not in ("zscore", "minmax"):
        raise ValueError(f"unknown method {method}")
    center, scale = [], []
    for f in features:
        c = F.avg(f) if method == "zscore" else F.min(f).cast("double")
        s = F.stddev_pop(f) if method == "zscore" else (F.max(f) - F.min(f)).cast("double")
        center.append(c)
        scale.append(F.when(s == 0, 1.0).otherwise(s))
    return df.agg(F.lit(method).alias("method"), F.array(*map(F.lit, features)).alias("features"), F.array(*center).alias("center"), F.array(*scale).alias("scale"))


def condition_vectors(df: DataFrame, stats: DataFrame, types: list[str], features: list[str]) -> DataFrame:
    """Adds condition: one-hot cell type (unknown: zeros) and the normalised features."""
    hot = [(F.coalesce(F.col("cell_type") == t, F.lit(False))).cast("double") for t in types]
    values = [(F.col(f).cast("double") - F.col("center")[i]) / F.col("scale")[i] for i, f in enumerate(features)]
    return df.crossJoin(F.broadcast(stats.select("center", "scale"))).withColumn("condition", F.array(*hot, *values)).drop("center", "scale")


def filter_sequence_length(df: DataFrame, length: int) -> DataFrame:
    return df.filter(F.length("seq") == length)


#: Why a window is dropped.
REASONS = ["missing_contig", "length", "n_fraction"]


def with_qc_reason(df: DataFrame, length: int, max_n: float = 0.05) -> DataFrame:
    """Adds reason: missing_contig (null seq), length, n_fraction, or null for sequences that pass."""
    reason = F.when(F.col("seq").isNull(), "missing_contig").when(F.length("seq") != length, "length").when(n_fraction(F.col("seq")) > max_n, "n_fraction")
    return df.withColumn("reason", reason)


def window_qc(df: DataFrame, length: int, max_n: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The sequences that pass, and the number dropped by reason."""
    marked = with_qc_reason(df, length, max_n)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def align_metadata(sequences: DataFrame, metadata: DataFrame, key: str = "peak_id", validate: bool = True) -> DataFrame:
    """Sequences with their metadata; with `validate`, a sequence without metadata is an error."""
    if validate and not sequences.join(metadata, key, "left_anti").isEmpty():
        raise ValueError("sequences without metadata")
    return sequences.join(metadata, key)
