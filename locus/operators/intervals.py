"""Peaks, loci and windows: filters, interval joins, merging and greedy suppression.

Coordinates are 0-based and half-open. Every ranking has explicit tie-breakers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.operators.shared import reused
from locus.operators.spacing import spaced

#: Window length, least distance between windows, and coarse bucket of positions.
WINDOW, SEPARATION, BUCKET = 1000, 500, 100_000
#: Positions per bucket where peaks meet loci.
LOCUS_BUCKET = 4096


def assert_columns(df: DataFrame, needed: list[str]) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def filter_primary_chromosomes(peaks: DataFrame, names: list[str]) -> DataFrame:
    return peaks.filter(F.col("chrom").isin(names))


def summit_position(peaks: DataFrame) -> DataFrame:
    """Adds summit (start + offset, else the midpoint) and center_method."""
    assert_columns(peaks, ["start", "end", "summit_offset"])
    middle = F.expr("(start + `end`) div 2")
    return peaks.withColumns({
        "summit": F.coalesce(F.col("start") + F.col("summit_offset"), middle),
        "center_method": F.when(F.col("summit_offset").isNotNull(), "summit").otherwise("midpoint"),
    })


def resize_to_window(peaks: DataFrame, length: int = WINDOW) -> DataFrame:
    """Adds win_start, win_end and method; a summit outside the peak falls back to the midpoint."""
    offset = F.col("summit_offset")
    inside = F.coalesce((offset >= 0) & (offset <= F.col("end") - F.col("start")), F.lit(False))
    center = F.when(inside, F.col("start") + offset).otherwise(F.expr("(start + `end`) div 2"))
    out = peaks.withColumn("win_start", F.greatest(F.lit(0).cast("long"), center - length // 2))
    return out.withColumns({"win_end": F.col("win_start") + length, "method": F.when(inside, "summit").otherwise("midpoint")})


def window_bounds(peaks: DataFrame, length: int = WINDOW) -> DataFrame:
    """Adds win_start = max(0, summit - half) and win_end; a clipped window keeps its length."""
    out = peaks.withColumn("win_start", F.greatest(F.lit(0).cast("long"), F.col("summit") - length // 2))
    return out.withColumn("win_end", F.col("win_start") + length)


def flank_variants(variants: DataFrame, flank: int) -> DataFrame:
    """1-based pos to the interval [pos - 1 - flank, pos + flank), clipped at 0."""
    return variants.withColumns({"start": F.greatest(F.lit(0).cast("long"), F.col("pos") - 1 - flank), "end": F.col("pos") + flank})


def distinct_variants(variants: DataFrame) -> DataFrame:
    """One row per (rs_id, chrom, pos); the smallest functional_class stands for them."""
    return variants.groupBy("rs_id", "chrom", "pos").agg(F.min("functional_class").alias("functional_class"))


def merge_loci(intervals: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """Merges overlapping or touching (rs_id, chrom, start, end); name holds the first five ids, score the count.

    Starts are cut into buckets, which one shuffle deals out. Each bucket merges its own
    intervals first; what reaches in from earlier buckets, a window over one row per bucket,
    then joins the merged ones, so no chromosome is one task and at most five ids are held of each.
    """
    cut = ["chrom", "_b"]
    rows = intervals.select("rs_id", "chrom", "start", "end", F.floor(F.col("start") / bucket).cast("long").alias("_b")).repartition(*cut)
    order = W.partitionBy(*cut).orderBy("start", "end", "rs_id")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    rows = rows.withColumn("_in", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.when(F.row_number().over(W.partitionBy(*cut, "_in").orderBy("start", "end", "rs_id")) <= 5, F.struct("start", "end", "rs_id"))
    merged = lambda ids, score: [F.min("start").alias("start"), F.max("end").alias("end"), score.alias("score"), F.slice(F.array_sort(ids), 1, 5).alias("_ids")]
    local = reused(rows.withColumn("_first", first).groupBy(*cut, "_in").agg(*merged(F.collect_list("_first"), F.count(F.lit(1)))))
    before = W.partitionBy("chrom").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    reaches = local.groupBy(*cut).agg(F.max("end").alias("_max")).select(*cut, F.max("_max").over(before).alias("_carry"))
    opened = local.join(reaches, cut).withColumn("_new", F.when(F.col("_carry").isNull() | (F.col("start") > F.col("_carry")), 1).otherwise(0))
    begun = opened.groupBy(*cut).agg(F.sum("_new").alias("_n")).select(*cut, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.sum("_new").over(W.partitionBy(*cut).orderBy("_in").rowsBetween(W.unboundedPreceding, 0))
    islands = opened.withColumn("_at", inside).join(begun, cut).withColumn("_island", F.col("_base") + F.col("_at"))
    # an island's five first ids lie in the first intervals it is made of, so at most five of them keep theirs
    nth = F.row_number().over(W.partitionBy("chrom", "_island").orderBy("_b", "_in"))
    islands = islands.withColumn("_ids", F.when(nth <= 5, F.col("_ids")))
    whole = islands.groupBy("chrom", "_island").agg(*merged(F.flatten(F.collect_list("_ids")), F.sum("score")))
    name = F.concat(F.array_join(F.transform("_ids", lambda x: x["rs_id"]), ","), F.when(F.col("score") > 5, "...").otherwise(""))
    return whole.select("chrom", "start", "end", name.alias("name"), "score")


def intersect_with_loci(peaks: DataFrame, loci: DataFrame, *, bucket: int = LOCUS_BUCKET) -> DataFrame:
    """Peaks whose summit lies in the locus of greatest start at or before it (an as-of semi join).

    A locus answers for positions from its start to its end or the next locus's start; those
    stretches are disjoint and cut into buckets of positions, so a peak meets the few pieces of
    its bucket in an equi-join, which Spark broadcasts while the loci are few.
    """
    at = lambda c: F.floor(c / bucket).cast("long")
    ends = loci.groupBy("chrom", "start").agg(F.max("end").alias("end")).withColumn("_b", at(F.col("start")))
    later = W.partitionBy("chrom").orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    heads = ends.groupBy("chrom", "_b").agg(F.min("start").alias("_s")).select("chrom", "_b", F.min("_s").over(later).alias("_later"))
    following = F.coalesce(F.lead("start").over(W.partitionBy("chrom", "_b").orderBy("start")), F.col("_later"))
    stretch = ends.join(heads, ["chrom", "_b"]).select("chrom", F.col("start").alias("_from"), F.least("end", following).alias("_to")).filter("_from < _to")
    pieces = stretch.withColumn("_b", F.explode(F.sequence(at(F.col("_from")), at(F.col("_to") - 1))))
    held = (F.col("p.chrom") == F.col("l.chrom")) & (F.col("p._b") == F.col("l._b")) & (F.col("summit") >= F.col("_from")) & (F.col("summit") < F.col("_to"))
    return peaks.withColumn("_b", at(F.col("summit"))).alias("p").join(pieces.alias("l"), held, "left_semi").drop("_b")


def best_order() -> list[Column]:
    """Of rows with one win_start the first in this order is the best."""
    return [F.desc("peak_score"), F.col("gsm"), F.col("start"), F.col("end")]


def dedupe_best(windows: DataFrame) -> DataFrame:
    """Of each (cell_type, chrom, win_start) the row of highest peak_score, then lowest gsm and start."""
    order = W.partitionBy("cell_type", "chrom", "win_start").orderBy(*best_order())
    return windows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def collapse_redundant_windows(windows: DataFrame, separation: int = SEPARATION, *, bucket: int = BUCKET, dedupe: bool = False) -> DataFrame:
    """Greedy suppression per (cell_type, chrom): by falling score, then win_start, a window stays if it is
    at least `separation` from all that stayed. Below 1 nothing happens.

    Done in parallel rounds over buckets of positions (see spacing). Expects one row per win_start;
    with `dedupe` the rows that dedupe_best would drop are dropped in the same shuffle.
    """
    if separation < 1:
        return dedupe_best(windows) if dedupe else windows
    return spaced(windows, ["cell_type", "chrom"], separation, bucket, best_order() if dedupe else None)


def drop_shared_windows(windows: DataFrame, separation: int = SEPARATION) -> DataFrame:
    """Drops windows nearer than `separation` to one of another cell type on the same chromosome.

    Each start keeps its least and greatest cell type; a range frame over the starts of a bucket,
    and those near its edges, tells whether two types meet. No pairs are made.
    """
    if separation < 1:
        return windows
    width = max(BUCKET, separation)
    at = lambda c: F.floor(c / width).cast("long")
    here = F.col("win_start")
    starts = windows.groupBy("chrom", "win_start").agg(F.min("cell_type").alias("_low"), F.max("cell_type").alias("_high"))
    dealt = starts.withColumn("_b", F.explode(F.array_distinct(F.array(at(here - separation), at(here), at(here + separation)))))
    near = W.partitionBy("chrom", "_b").orderBy("win_start").rangeBetween(1 - separation, separation - 1)
    met = dealt.withColumn("_two", F.min("_low").over(near) != F.max("_high").over(near)).filter((F.col("_b") == at(here)) & F.col("_two"))
    shared = met.select("chrom", "win_start", F.lit(True).alias("_shared"))
    marked = windows.join(shared, ["chrom", "win_start"], "left").filter("_shared IS NULL OR cell_type IS NULL")
    return marked.select(windows.columns)


def top_n_per_type(windows: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("cell_type").orderBy(F.desc("peak_score"), "chrom", "win_start", "gsm")
    return windows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def majority_method(peaks: DataFrame) -> DataFrame:
    """One row: the more frequent center_method, summit on a tie."""
    n = lambda m: F.count(F.when(F.col("center_method") == m, 1))
    return peaks.agg(F.when(n("summit") >= n("midpoint"), "summit").otherwise("midpoint").alias("center_method"))


def window_names(windows: DataFrame, method: DataFrame) -> DataFrame:
    """Adds name `cell_type|chrom:start-end` and the dataset's center_method (one row)."""
    name = F.format_string("%s|%s:%d-%d", "cell_type", "chrom", "win_start", "win_end")
    return windows.drop("center_method").withColumn("name", name).crossJoin(F.broadcast(method))


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def pool_samples(*samples: DataFrame) -> DataFrame:
    out = samples[0]
    for s in samples[1:]:
        out = out.unionByName(s)
    return out

