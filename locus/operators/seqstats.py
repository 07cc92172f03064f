"""Statistics of pooled sequences, and how realistic generated ones are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.functions.seq import cpg_count, longest_run, random_bases
from locus.operators.shared import reused

ORDER_BUCKET = 100_000
#: Bases that are counted together, at least one sequence.
PIECE = 4_000_000


def _count(seq: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(seq, f"[^{letters}]", ""))


def gc_content(df: DataFrame) -> DataFrame:
    seq = F.upper("seq")
    total = F.sum(F.length(seq))
    return df.agg(F.coalesce(F.when(total > 0, F.sum(_count(seq, "GC")) / total), F.lit(0.0)).alias("gc"))


def _windows(texts: list[str], k: int) -> tuple[list[str], np.ndarray]:
    """The distinct k-mers of some strings and how often each occurs; windows don't cross strings."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code) - k + 1
    if n <= 0:
        return [], np.empty(0, np.int64)
    lengths = np.array([len(t) for t in texts])
    whole = np.arange(n) + k <= np.repeat(np.cumsum(lengths), lengths)[:n]
    known = np.unique(code)
    digit, base = np.searchsorted(known, code), len(known)
    if base**k >= 1 << 62:
        grams, counts = np.unique(np.lib.stride_tricks.sliding_window_view(code, k)[whole], axis=0, return_counts=True)
    else:
        number = np.zeros(n, np.int64)
        for i in range(k):
            number = number * base + digit[i : i + n]
        number = number[whole]
        if base**k <= 1 << 22:
            counts = np.bincount(number, minlength=0)
            number = np.flatnonzero(counts)
            counts = counts[number]
        else:
            number, counts = np.unique(number, return_counts=True)
        grams = known[number[:, None] // base ** np.arange(k - 1, -1, -1) % base]
    return [g.tobytes().decode("utf-32-le", "surrogatepass") for g in grams.astype(np.uint32)], counts


def kmer_tables(df: DataFrame, ks: list[int], by: str | None = None) -> DataFrame:
    """k, kmer and n of all overlapping k-mers of the upper-cased seq, for several k (and groups `by`) in one pass.

    Counted inside the task for pieces of a batch, so what is shuffled is bounded by the kinds
    of k-mers a piece holds, not by its bases.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, part in batch.groupby("_g", dropna=False):
                texts = [t.upper() for t in part["seq"] if t]
                ends = np.cumsum([len(t) for t in texts])
                first = 0
                while first < len(texts):
                    last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE, "right")))
                    for k in ks:
                        grams, n = _windows(texts[first:last], k)
                        yield pd.DataFrame({"_g": group, "k": k, "kmer": grams, "n": n})
                    first = last

    group = F.col(by).cast("string") if by else F.lit("")
    counted = df.select(group.alias("_g"), F.col("seq").cast("string").alias("seq")).mapInPandas(count, "_g string, k int, kmer string, n long")
    keys = ["_g", "k", "kmer"] if by else ["k", "kmer"]
    out = counted.groupBy(*keys).agg(F.sum("n").alias("n"))
    return out.withColumnRenamed("_g", by) if by else out


def kmer_counts(df: DataFrame, k: int) -> DataFrame:
    return kmer_tables(df, [k]).select("kmer", "n")


def entropy_of(n: Column) -> Column:
    """Shannon entropy in bits of the counts in an aggregation; 0 without any."""
    # -sum(p log2 p) = log2 N - sum(n log2 n) / N; nulls are left out
    return F.coalesce(F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n), F.lit(0.0))


def kmer_entropy(df: DataFrame, k: int) -> DataFrame:
    """Shannon entropy in bits of all overlapping k-mers; 0 without any."""
    return kmer_counts(df, k).agg(entropy_of(F.col("n")).alias("entropy"))


def _composition(df: DataFrame, order: str) -> DataFrame:
    """Per _pool: n sequences, bases, and how many are G, C and CpG, junctions between sequences included.

    The next sequence's first base comes from a window within buckets of the order and, at a
    bucket's end, from the next bucket's first row, so no task sees more than a bucket, and
    of each sequence only its counts and ends.
    """
    s = df.select("_pool", F.upper("seq").alias("_s"), F.col(order).cast("long").alias("_o"))
    s = s.select("_pool", "_o", F.length("_s").alias("_n"), *[_count(F.col("_s"), b).alias(f"_{b}") for b in "CG"], cpg_count(F.col("_s")).alias("_cg"), F.substring("_s", 1, 1).alias("_first"), F.substring("_s", -1, 1).alias("_last"), longest_run(F.col("_s")).alias("_run"))
    s = reused(s.withColumn("_b", F.floor(F.col("_o") / ORDER_BUCKET)))  # a few numbers of each sequence
    full = s.filter("_n > 0")
    heads = full.groupBy("_pool", "_b").agg(F.min(F.struct("_o", "_first"))["_first"].alias("_head"))
    heads = heads.select("_pool", "_b", F.lead("_head").over(W.partitionBy("_pool").orderBy("_b")).alias("_after"))
    following = F.lead("_first").over(W.partitionBy("_pool", "_b").orderBy("_o", "_first", "_last"))
    joined = full.withColumn("_next", following).join(heads, ["_pool", "_b"], "left")
    meets = ((F.col("_last") == "C") & F.coalesce(F.coalesce("_next", "_after") == "G", F.lit(False))).cast("int")
    sums = joined.groupBy("_pool").agg(F.sum("_n").alias("bases"), F.sum("_C").alias("c"), F.sum("_G").alias("g"), F.sum(F.col("_cg") + meets).alias("cg"))
    runs = s.groupBy("_pool", "_run").agg(F.count(F.lit(1)).alias("_k"))
    upto = runs.withColumns({"_upto": F.sum("_k").over(W.partitionBy("_pool").orderBy("_run")), "n": F.sum("_k").over(W.partitionBy("_pool"))})
    median = upto.filter(F.col("_upto") > F.floor(F.col("n") / 2)).groupBy("_pool").agg(F.min("_run").alias("median_run"), F.first("n").alias("n"))
    return median.join(sums, "_pool", "left")


def _oe() -> Column:
    n, c, g, cg = map(F.col, ("bases", "c", "g", "cg"))
    return F.coalesce(F.when((n > 1) & (c > 0) & (g > 0), (cg / (n - 1)) / ((c / n) * (g / n))), F.lit(0.0))


def cpg_obs_exp_pool(df: DataFrame, order: str) -> DataFrame:
    """CpG observed over expected of all sequences on end in `order` (an integer column), junctions included."""
    found = _composition(df.withColumn("_pool", F.lit("")), order).agg(*[F.max(c).alias(c) for c in ("bases", "c", "g", "cg")])
    return found.select(_oe().alias("cpg_oe"))


def median_longest_run(df: DataFrame) -> DataFrame:
    """The upper median of the sequences' longest runs, from their histogram."""
    runs = df.groupBy(longest_run(F.upper("seq")).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    total = runs.agg(F.sum("n").alias("total"))
    upto = runs.withColumn("upto", F.sum("n").over(W.orderBy("run"))).crossJoin(F.broadcast(total))
    return upto.filter(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("run").alias("median_run"))


def realism_profiles(df: DataFrame, order: str, pool: str) -> DataFrame:
    """Per pool: n, gc, entropy_2, entropy_4, entropy_6, cpg_oe and median_run; all pools share each pass.

    The k-mers of all lengths are counted in one pass; what has a number per sequence is made once
    and summed from those numbers.
    """
    rows = df.select(F.col(pool).cast("string").alias("_pool"), "seq", order)
    tables = kmer_tables(rows, [2, 4, 6], "_pool")
    entropies = tables.groupBy("_pool").agg(*[entropy_of(F.when(F.col("k") == k, F.col("n"))).alias(f"entropy_{k}") for k in (2, 4, 6)])
    gc = F.coalesce(F.when(F.col("bases") > 0, (F.col("c") + F.col("g")) / F.col("bases")), F.lit(0.0))
    sums = _composition(rows, order).select("_pool", "n", gc.alias("gc"), _oe().alias("cpg_oe"), "median_run")
    out = sums.join(entropies, "_pool", "left").fillna(0.0, ["entropy_2", "entropy_4", "entropy_6"])
    return out.select(F.col("_pool").alias(pool), "n", *METRICS)


def realism_profile(df: DataFrame, order: str) -> DataFrame:
    """One row: n, gc, entropy_2, entropy_4, entropy_6, cpg_oe and median_run of all sequences."""
    return realism_profiles(df.withColumn("_all", F.lit("")), order, "_all").drop("_all")


def with_control(df: DataFrame, pool: str, reference: str, seed: int, name: str = "control") -> DataFrame:
    """df and, as one more pool, a random sequence of the same length for each one of the reference pool; one scan."""
    control = F.when(F.col(pool) == reference, F.struct(F.lit(name).alias("p"), random_bases(F.length("seq"), seed, F.col("seq_id")).alias("s")))
    rows = df.withColumn("_v", F.explode(F.array_compact(F.array(F.struct(F.col(pool).cast("string").alias("p"), F.col("seq").alias("s")), control))))
    return rows.withColumns({pool: F.col("_v.p"), "seq": F.col("_v.s")}).drop("_v")


def realism_of_pools(profiles: DataFrame, pool: str, reference: str, control: str = "control") -> DataFrame:
    """realism_compare for every pool of realism_profiles other than the reference and the control."""
    long = profiles.select(F.col(pool), *[F.col(m).cast("double") for m in METRICS]).unpivot([pool], METRICS, "metric", "_v")
    fixed = {n: F.max(F.when(F.col(pool) == p, F.col("_v"))).over(W.partitionBy("metric")) for n, p in (("reference", reference), ("control", control))}
    met = long.withColumns(fixed).filter(~F.col(pool).isin(reference, control)).withColumnRenamed("_v", "generated")
    span = F.col("control") - F.col("reference")
    met = met.filter(F.abs(span) >= 1e-12).withColumn("realism", 1 - (F.col("generated") - F.col("reference")) / span)
    return met.select(pool, "metric", "generated", "reference", "control", "realism")


METRICS = ["gc", "entropy_2", "entropy_4", "entropy_6", "cpg_oe", "median_run"]


def realism_compare(generated: DataFrame, reference: DataFrame, control: DataFrame) -> DataFrame:
    """Per metric 1 - (generated - reference) / (control - reference); metrics where control equals reference are left out."""

    def long(profile: DataFrame, name: str) -> DataFrame:
        return profile.select(*[F.col(m).cast("double") for m in METRICS]).unpivot([], METRICS, "metric", name)

    met = long(generated, "generated").join(long(reference, "reference"), "metric").join(long(control, "control"), "metric")
    span = F.col("control") - F.col("reference")
    return met.filter(F.abs(span) >= 1e-12).withColumn("realism", 1 - (F.col("generated") - F.col("reference")) / span)


def random_control(df: DataFrame, seed: int) -> DataFrame:
    """A random uniform sequence of the same length for each (seq_id, seq)."""
    return df.withColumn("seq", random_bases(F.length("seq"), seed, F.col("seq_id")))
