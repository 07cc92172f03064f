"""Peaks to uniform, de-duplicated, cell-type-exclusive windows inside loci."""

from __future__ import annotations

from pyspark.sql import DataFrame

from locus.operators import intervals as iv


def build_windows(
    peaks: DataFrame, loci: DataFrame, *, primary: list[str], length: int = iv.WINDOW, separation: int = iv.SEPARATION, exclusive: int = iv.SEPARATION, top_n: int | None = None
) -> DataFrame:
    """chrom, start, end, name, cell_type, gsm, peak_score, fold_enrichment, center_method."""
    centred = iv.summit_position(iv.filter_primary_chromosomes(peaks, primary))
    inside = iv.window_bounds(iv.intersect_with_loci(centred, loci), length)
    kept = iv.drop_shared_windows(iv.collapse_redundant_windows(inside, separation, dedupe=True), exclusive)
    if top_n is not None:
        kept = iv.top_n_per_type(kept, top_n)
    named = iv.window_names(kept, iv.majority_method(centred))
    return named.selectExpr("chrom", "win_start AS start", "win_end AS end", "name", "cell_type", "gsm", "peak_score", "fold_enrichment", "center_method")
