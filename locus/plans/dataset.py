"""Composite jobs: the training dataset, Markov generation and evaluation."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from locus.functions import seq as fn
from locus.operators import features as ft
from locus.operators import genome as gn
from locus.operators import intervals as iv
from locus.operators import markov as mk
from locus.operators import motifs as mo
from locus.operators import ranking as rk
from locus.operators import scoring as sc
from locus.operators import seqstats as ss
from locus.operators.shared import reused
from locus.plans.windows import build_windows
from locus.sources import files, sinks

FEATURES = ["peak_score", "fold_enrichment"]


def build_dataset(windows: DataFrame, genome: DataFrame | gn.Genome, types: list[str], length: int, max_n: float, tile: int = gn.TILE) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Windows (from build_windows) with DNA, one-hot tensor and condition vector, the statistics, and
    the number of windows kept and dropped by reason, observed while they were cut."""
    cut = gn.extract_windows(windows.withColumnRenamed("name", "peak_id"), genome, "peak_id", tile)
    seen = Observation("window_qc")
    n = lambda r: F.count_if(F.col("reason") == r).alias(r)
    marked = ft.with_qc_reason(cut, length, max_n).observe(seen, F.count_if(F.col("reason").isNull()).alias("kept"), *[n(r) for r in ft.REASONS])
    passed = reused(marked.filter("reason IS NULL").drop("reason"))
    if not passed.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        passed.count()  # without a checkpoint nothing has run yet
    stats = reused(ft.fit_normalisation(passed, FEATURES))
    out = ft.condition_vectors(passed, stats, types, FEATURES).withColumn("tensor", fn.one_hot(F.col("seq")))
    return out, stats, seen.get


def dataset_job(
    spark: SparkSession, *, pages: str, manifest: str, genome: str, out: str, primary: list[str], types: list[str], flank: int = 100_000, length: int = iv.WINDOW, separation: int = iv.SEPARATION, max_n: float = 0.05, tile: int = gn.TILE,
) -> dict[str, int]:
    """Variant pages, a sample manifest and a genome's FASTA files to a dataset below `out`, in one job.

    Writes loci.bed and windows.bed, the stored genome, sequences.fasta with metadata.csv, the
    dataset (by cell type, with its statistics) and, last of all, manifest: a one-row JSON of the
    counts, whose presence tells that the rest is whole. Returns the counts.
    """
    variants = iv.distinct_variants(files.variants_from_pages(spark, pages, validate=True))
    loci = reused(iv.merge_loci(iv.flank_variants(variants, flank)))
    loci.select("chrom", "start", "end", "name", "score").write.csv(f"{out}/loci.bed", sep="\t")
    peaks = files.scan_samples(spark, files.read_manifest(spark, manifest))
    windows = reused(build_windows(peaks, loci, primary=primary, length=length, separation=separation, exclusive=separation))
    sinks.write_bed(windows, f"{out}/windows.bed")
    name = "genome_" + uuid.uuid4().hex
    stored = gn.store_genome(gn.tile_genome(files.read_genome(spark, genome), tile), name, f"{out}/genome", tile)
    data, stats, counts = build_dataset(windows, stored, types, length, max_n)
    sinks.write_dataset(data, stats, f"{out}/dataset")
    meta = ["chrom", "start", "end", "cell_type", "peak_score", "fold_enrichment", F.col("gsm").alias("source_gsm")]
    sinks.write_fasta_with_metadata(data.select(F.col("peak_id").alias("seq_id"), "seq", *meta), f"{out}/sequences")
    counts = {"loci": loci.count(), "windows": windows.count()} | counts
    spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts)).coalesce(1).write.json(f"{out}/manifest")
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay
    return counts


def markov_generate(sequences: DataFrame, windows: DataFrame, ids: DataFrame, cell_type: str, k: int, length: int, seed: int) -> DataFrame:
    """Samples of a chain fitted to one cell type, named syn_{cell_type}_{sample_id}, each at a host window of that type."""
    own = sequences.filter(F.col("cell_type") == cell_type)
    named = ids.withColumn("sample_id", F.concat_ws("_", F.lit("syn"), F.lit(cell_type), "sample_id"))
    drawn = mk.markov_sample(named, mk.markov_fit(own, k), mk.markov_prefixes(own, k), k, length, seed)
    return rk.assign_hosts(drawn, windows.filter(F.col("cell_type") == cell_type), seed)


def evaluate(kind: str, **tables: DataFrame | Callable | dict | list | str | int) -> DataFrame:
    """`oracle` scores with a predictor, `motif` scans and sums up, `realism` compares generated sequences with
    a reference and a control, `realism_by_pool` every pool of one table with its reference pool."""
    if kind == "oracle":
        return sc.mssi(sc.score_with(tables["sequences"], tables["load"], "context"), tables["panel"], tables["background"])
    if kind == "motif":
        return mo.tf_summary(mo.scan_motifs(tables["sequences"], tables["matrices"]), tables["matrices"].select("tf"))
    if kind == "realism":
        order = tables["order"]
        pools = [tables[n].select("seq", order).withColumn("pool", F.lit(n)) for n in ("generated", "reference", "control")]
        return ss.realism_of_pools(ss.realism_profiles(reduce(DataFrame.unionByName, pools), order, "pool"), "pool", "reference").drop("pool")
    if kind == "realism_by_pool":
        rows = ss.with_control(tables["sequences"], tables["pool"], tables["reference"], tables["seed"])
        return ss.realism_of_pools(ss.realism_profiles(rows, tables["order"], tables["pool"]), tables["pool"], tables["reference"])
    raise ValueError(f"unknown evaluation {kind}")
