"""Writers. Each writes a folder of part files, as every Spark writer does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus.sources.fasta import FastaWithMetadata


def write_bed(windows: DataFrame, path: str) -> None:
    """Headerless tab-separated chrom, start, end, name, peak_score."""
    windows.select("chrom", "start", "end", "name", "peak_score").write.csv(path, sep="\t", header=False)


def write_fasta(df: DataFrame, path: str) -> None:
    """`>seq_id` and the sequence on the next line."""
    df.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), "seq").alias("value")).write.text(path)


def write_metadata(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_fasta_with_metadata(df: DataFrame, path: str) -> None:
    """sequences and metadata below path, aligned: every partition writes its part of both in the same order.

    df has seq_id, seq and the metadata's columns; peak_id is the sequence's id there. Both parts
    of a partition come from one pass over it (see fasta), and appear only when all are written.
    """
    df.sparkSession.dataSource.register(FastaWithMetadata)
    df.write.format("fasta_with_metadata").mode("append").save(path)


def write_report(scores: DataFrame, path: str) -> None:
    """One JSON object per sequence in `sequences`, and a one-row summary in `summary`."""
    scores.write.json(f"{path}/sequences")
    scores.agg(F.count(F.lit(1)).alias("n"), F.avg("mssi_score").alias("mean_mssi")).write.json(f"{path}/summary")


def write_score_report(scores: DataFrame, path: str, page: int = 1000) -> None:
    """A score report in documents of about `page` sequences, one per line; scores has seq_id, mssi_score,
    target_signal, background_signal, cell_type and target_tracks. Pages are dealt by a hash of the id, so
    their number grows with the rows."""
    pages = max(1, -(-scores.count() // page))
    entry = F.struct("mssi_score", "target_signal", "background_signal", "cell_type", "target_tracks")
    dealt = scores.select(F.pmod(F.xxhash64("seq_id"), F.lit(pages)).alias("_page"), F.struct("seq_id", entry.alias("v")).alias("e"))
    dealt.groupBy("_page").agg(F.map_from_entries(F.collect_list("e")).alias("sequences")).select("sequences").write.json(path)


def write_dataset(df: DataFrame, stats: DataFrame, path: str) -> None:
    """Sequences, conditions and cell types as Parquet by cell_type, the normalisation statistics beside them."""
    df.write.partitionBy("cell_type").parquet(f"{path}/data")
    stats.write.parquet(f"{path}/stats")
