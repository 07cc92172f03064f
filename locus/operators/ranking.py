"""Ranking, selection, splits and sampling.

Order ties break by id. Numbering a whole table never uses one task: rows are dealt into sorted
parts at sampled splitters, numbered inside them, and offset by the parts' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.functions.rand import shuffle_key, uniform
from locus.operators.shared import reused

#: Rows per part that numbering aims at.
BUCKET_ROWS = 250_000


def numbered(df: DataFrame, order: list[Column], name: str = "row", bucket: str | None = None) -> DataFrame:
    """Adds `name` (from 0, in the given order) and total.

    A sample sort: Spark samples splitters over all columns of the order, so that rows equal in the
    first still split by the ones behind, deals rows into parts of about BUCKET_ROWS and sorts them; a row's
    number is its place in its part plus the rows of the parts before. The parts are made once,
    since other splitters would give other parts. With `bucket`, that column tells a row's part,
    which rises with the order.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    place = F.monotonically_increasing_id()  # the part in the upper bits, the place in it in the lower 33
    rows = reused(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", place))
    mark, inside = bucket or "_bucket", F.col("_place").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumns({mark: F.shiftright("_place", 33), "_in": inside}).drop("_place")
    counts = rows.groupBy(mark).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(mark, (F.sum("_n").over(W.orderBy(mark)) - F.col("_n")).alias("_start"), F.sum("_n").over(W.partitionBy()).alias("total"))
    out = rows.join(F.broadcast(starts), mark)  # a row per part
    return out.withColumn(name, F.col("_start") + F.col("_in")).drop("_in", "_start", *([] if bucket else [mark]))


def select_top_k(scores: DataFrame, metadata: DataFrame, k: int, partition_by: list[str] | None = None, validate: bool = True) -> DataFrame:
    """The k best by mssi_score, over all or per partition (scores compare only within one locus), with their metadata.

    With `validate`, a candidate without a score or one of them without metadata is an error.
    """
    if partition_by:
        order = W.partitionBy(*partition_by).orderBy(F.desc("mssi_score"), "seq_id")
        best = scores.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")
    else:
        best = scores.orderBy(F.desc("mssi_score"), "seq_id").limit(k)
    if validate and not (scores.filter("mssi_score IS NULL").isEmpty() and unmatched_ids(best, metadata, "seq_id").isEmpty()):
        raise ValueError("candidates without scores or metadata")
    return best.join(metadata, "seq_id")


def split_tails(scores: DataFrame, fraction: float, real: str = "real") -> DataFrame:
    """Per locus the int(n * fraction) best (selected) and worst (rejected), the id `real` left out."""
    if not 0 < fraction <= 0.5:
        raise ValueError("fraction must be in (0, 0.5]")
    rows = scores.filter(F.col("seq_id") != real)
    group = W.partitionBy("locus")
    size = F.floor(F.count(F.lit(1)).over(group) * fraction)
    up = F.row_number().over(group.orderBy("mssi_score", "seq_id"))
    down = F.row_number().over(group.orderBy(F.desc("mssi_score"), F.desc("seq_id")))
    marked = rows.withColumns({"_size": size, "_up": up, "_down": down})
    tail = F.when(F.col("_down") <= F.col("_size"), "selected").when(F.col("_up") <= F.col("_size"), "rejected")
    return marked.withColumn("tail", tail).filter("tail IS NOT NULL").drop("_size", "_up", "_down")


def choose_loci(windows: DataFrame, n: int, seed: int, id_col: str = "peak_id", validate: bool = True) -> DataFrame:
    """n windows spread over the peak-score range: one at random in each of n equal strata of the order."""
    if validate and windows.limit(n).count() < n:
        raise ValueError(f"fewer than {n} windows")
    rows = numbered(windows, [F.col("peak_score"), F.col(id_col)])
    stratum = F.least(F.floor((F.col("row") * n + n - 1) / F.col("total")), F.lit(n - 1))  # corrected below by its edges
    first = lambda i: F.floor(i * F.col("total") / n)
    stratum = F.when(F.col("row") < first(stratum), stratum - 1).when(F.col("row") >= first(stratum + 1), stratum + 1).otherwise(stratum)
    rows = rows.withColumn("stratum", stratum.cast("int"))
    picked = first(F.col("stratum")) + F.floor(uniform(seed, F.col("stratum")) * (first(F.col("stratum") + 1) - first(F.col("stratum"))))
    return rows.filter(F.col("row") == picked).drop("row", "total")


def top_bottom_k(df: DataFrame, column: str, top: int, bottom: int, id_col: str = "seq_id", names: tuple[str, str] = ("selected", "rejected")) -> DataFrame:
    """The top rows and the bottom rows by a column, labelled in grp."""
    best = df.orderBy(F.desc(column), F.desc(id_col)).limit(top).withColumn("grp", F.lit(names[0]))
    worst = df.orderBy(column, id_col).limit(bottom).withColumn("grp", F.lit(names[1]))
    return best.unionByName(worst)


def stratified_sample(df: DataFrame, column: str, n_random: int, n_extreme: int, seed: int, id_col: str = "seq_id", validate: bool = True) -> DataFrame:
    """n_extreme from each end of a column and n_random of the rest, as stratum top, bottom or random."""
    if validate and df.limit(n_random + 2 * n_extreme).count() < n_random + 2 * n_extreme:
        raise ValueError("more rows asked for than there are")
    ends = top_bottom_k(df, column, n_extreme, n_extreme, id_col, ("top", "bottom")).withColumnRenamed("grp", "stratum")
    rest = df.join(ends.select(id_col), id_col, "left_anti")
    drawn = rest.orderBy(shuffle_key(seed, F.col(id_col)), id_col).limit(n_random).withColumn("stratum", F.lit("random"))
    return ends.unionByName(drawn)


def train_val_split(df: DataFrame, fraction: float, seed: int, id_col: str = "seq_id") -> DataFrame:
    """Adds is_val for exactly int(n * fraction) rows, chosen by a keyed order."""
    rows = numbered(df, [shuffle_key(seed, F.col(id_col)), F.col(id_col)])
    return rows.withColumn("is_val", F.col("row") < F.floor(F.col("total") * fraction)).drop("row", "total")


def pick_inserts(df: DataFrame, n: int, real: str = "real", validate: bool = True) -> DataFrame:
    """The first n ids in order, `real` left out."""
    out = df.filter(F.col("seq_id") != real).orderBy("seq_id").limit(n)
    if validate and out.count() < n:
        raise ValueError(f"fewer than {n} inserts")
    return out


def unmatched_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of left that right lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def join_scores(candidates: DataFrame, scores: DataFrame, validate: bool = True) -> DataFrame:
    """Candidates with their scores; with `validate`, one unmatched on either side is an error."""
    if validate:
        for a, b, what in ((candidates, scores, "candidates without scores"), (scores, candidates, "scores without candidates")):
            if not unmatched_ids(a, b, "seq_id").isEmpty():
                raise ValueError(what)
    return candidates.join(scores, "seq_id")


def filter_measured(measurements: DataFrame, sequences: DataFrame, validate: bool = True) -> DataFrame:
    out = measurements.join(sequences.select("seq_id"), "seq_id", "left_semi")
    if validate and out.isEmpty():
        raise ValueError("no measurement has a sequence")
    return out


def place_inserts(loci: DataFrame, variants: DataFrame, hosts: DataFrame) -> DataFrame:
    """Every locus that has a host sequence with every variant(variant, insert); id L{nn}_{variant} by locus order.

    The list of variants is short by design; loci without a host are left out.
    """
    rows = numbered(loci, [F.col("peak_id")], "_i").drop("total")
    placed = rows.join(hosts.select("peak_id"), "peak_id", "left_semi")
    return placed.crossJoin(F.broadcast(variants)).withColumn("seq_id", F.concat(F.lit("L"), F.format_string("%02d", F.col("_i")), F.lit("_"), F.col("variant"))).drop("_i")


def assign_hosts(ids: DataFrame, windows: DataFrame, seed: int, locus_id: str | None = None) -> DataFrame:
    """A host window for each sample_id, drawn with replacement, or the one given for all."""
    if locus_id is not None:
        return ids.crossJoin(F.broadcast(windows.filter(F.col("peak_id") == locus_id).limit(1)))
    hosts = numbered(windows, [shuffle_key(seed, F.col("peak_id")), F.col("peak_id")], "_row")
    n = hosts.agg(F.max("total").alias("_n"))
    drawn = ids.crossJoin(F.broadcast(n)).withColumn("_row", F.floor(uniform(seed, "host", F.col("sample_id")) * F.col("_n")))
    return drawn.join(hosts.drop("total"), "_row").drop("_row", "_n")


def fixed_host(variants: DataFrame, metadata: DataFrame, host_id: str) -> DataFrame:
    """All variants with the locus of one metadata row."""
    host = metadata.filter(F.col("peak_id") == host_id).select("chrom", "start", "end").limit(1)
    return variants.crossJoin(F.broadcast(host))


def selection_report(scores: DataFrame, k: int, reference: DataFrame) -> DataFrame:
    """best, worst_kept, pool_mean of the k best, and how many lie above the reference's mean."""
    best = scores.orderBy(F.desc("mssi_score"), "seq_id").limit(k)
    mean = reference.agg(F.avg("mssi_score").alias("_ref"))
    kept = best.crossJoin(F.broadcast(mean)).agg(
        F.max("mssi_score").alias("best"), F.min("mssi_score").alias("worst_kept"), F.count(F.when(F.col("mssi_score") > F.col("_ref"), 1)).alias("n_above")
    )
    return kept.crossJoin(F.broadcast(scores.agg(F.avg("mssi_score").alias("pool_mean"))))
