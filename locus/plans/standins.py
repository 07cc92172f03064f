"""Genomics tables made from the driver's tables: the same definitions for Spark and as SQL.

Nothing is left out: every row and every whole text takes part.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIMARY = ["chr_view", "chr_click", "chr_purchase"]
#: Seconds over which positions spread, and bases added on each side of a variant.
SPAN, FLANK = 2_592_000, 100
EVENT_TYPES = ["view", "click", "error", "signup", "purchase"]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir; only a local session without it gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='spark-files-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def peaks(spark: SparkSession, d: str) -> DataFrame:
    pos = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
    return table(spark, d, "events").selectExpr(
        "event_id AS peak_id", "concat('chr_', event_type) AS chrom", f"{pos} AS start", f"{pos} + 200 + event_id % 300 AS end", "value AS peak_score", "value / 10 AS fold_enrichment",
        "concat('ct', user_id % 3) AS cell_type", "concat('gsm', user_id % 6) AS gsm", "CASE WHEN event_id % 4 <> 0 THEN event_id % 200 - 1 END AS summit_offset",
    )


PEAKS = """peaks AS (SELECT event_id AS peak_id, 'chr_' || event_type AS chrom, epoch_us(ts) // 1000000 - 1704067200 AS start, epoch_us(ts) // 1000000 - 1704067200 + 200 + event_id % 300 AS "end",
  value AS peak_score, value / 10 AS fold_enrichment, 'ct' || (user_id % 3) AS cell_type, 'gsm' || (user_id % 6) AS gsm, CASE WHEN event_id % 4 <> 0 THEN event_id % 200 - 1 END AS summit_offset FROM events)"""


def variants(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(f"chr_{t}") for t in EVENT_TYPES])
    return table(spark, d, "orders").select(
        F.concat(F.lit("rs"), F.col("o_orderkey")).alias("rs_id"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("chrom"),
        ((F.col("o_orderkey") * 104729 + F.col("o_custkey") * 7919) % SPAN + 1).alias("pos"), F.col("o_orderpriority").alias("functional_class"),
    )


VARIANTS = f"""variants AS (SELECT 'rs' || o_orderkey AS rs_id, {EVENT_TYPES}[(o_orderkey % 5 + 1)::INTEGER] AS t, 'chr_' || t AS chrom,
  (o_orderkey * 104729 + o_custkey * 7919) % {SPAN} + 1 AS pos, o_orderpriority AS functional_class FROM orders)"""


def sequences(spark: SparkSession, d: str, letters: str = "ACGT") -> DataFrame:
    """The given letters of each document's whole text."""
    docs = table(spark, d, "documents")
    seq = F.regexp_replace(F.upper("text"), f"[^{letters}]+", "")
    return docs.select("doc_id", F.concat(F.lit("seq"), F.col("doc_id")).alias("seq_id"), seq.alias("seq"), F.col("lang").alias("cell_type"), "source", "n_chars")


def sequences_sql(letters: str = "ACGT") -> str:
    return f"sequences AS (SELECT doc_id, 'seq' || doc_id AS seq_id, regexp_replace(upper(text), '[^{letters}]', '', 'g') AS seq, lang AS cell_type, source, n_chars FROM documents)"


def tiles(spark: SparkSession, d: str, length: int, letters: str = "ACGT") -> DataFrame:
    """All consecutive pieces of `length` bases of every sequence, a shorter last one included."""
    s = sequences(spark, d, letters).filter(F.length("seq") > 0)
    pieces = F.regexp_extract_all("seq", F.lit(f"(.{{1,{length}}})"), F.lit(1))
    s = s.select("doc_id", "seq_id", F.posexplode(pieces).alias("tile", "seq"), "cell_type", "source", "n_chars")
    return s.select("doc_id", F.concat_ws("_", "seq_id", "tile").alias("seq_id"), "tile", "seq", "cell_type", "source", "n_chars")


def tiles_sql(length: int, letters: str = "ACGT") -> str:
    return sequences_sql(letters) + f""",
tiles AS (SELECT doc_id, seq_id || '_' || tile AS seq_id, tile, substr(seq, tile * {length} + 1, {length}) AS seq, cell_type, source, n_chars
  FROM (SELECT *, unnest(generate_series(0, (length(seq) - 1) // {length}))::INTEGER AS tile FROM sequences WHERE length(seq) > 0))"""


def kmer_linear_standin(k: int = 2) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model, for tests: track i is the count of the i-th k-mer in alphabetical order."""
    from itertools import product

    kmers = ["".join(x) for x in product("ACGT", repeat=k)]

    def predict(seqs: list[str]) -> np.ndarray:
        number = {m: i for i, m in enumerate(kmers)}
        out = np.zeros((len(seqs), len(kmers)))
        for r, s in enumerate(seqs):
            for i in range(len(s) - k + 1):
                j = number.get(s[i : i + k])
                if j is not None:
                    out[r, j] += 1
        return out

    return predict
