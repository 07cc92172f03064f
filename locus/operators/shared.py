"""Helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def reused(df: DataFrame) -> DataFrame:
    """df made once for several uses: a checkpoint where the session has a folder for them, else kept by Spark."""
    folder = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    return df.checkpoint() if folder.isDefined() else df.persist()
