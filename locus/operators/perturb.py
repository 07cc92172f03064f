"""Perturbation sets: controlled variants of the best candidates, all placed at one host.

Candidates are (seq_id, seq, mssi_score). Each job returns peak_id, parent_id, rank, variant
and seq; place it with ranking.fixed_host().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.functions import seq as fn
from locus.functions.rand import shuffle_key
from locus.operators.ranking import filter_measured, fixed_host, numbered, stratified_sample

#: The swap variants and the dinucleotide that each reverses.
SWAPS = {"cpg_up": "GC", "cpg_down": "CG", "ctl_at": "AT", "ctl_ta": "TA"}


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The k best with rank from 0 and the id prefix c{rank}_{id}_."""
    best = candidates.orderBy(F.desc("mssi_score"), "seq_id").limit(k)
    best = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mssi_score"), "seq_id")) - 1)  # k rows
    return best.select(F.col("seq_id").alias("parent_id"), "seq", "rank", F.concat(F.format_string("c%02d_", "rank"), "seq_id", F.lit("_")).alias("_prefix"))


def _variants(best: DataFrame, variants: Column) -> DataFrame:
    rows = best.select("parent_id", "rank", "_prefix", F.explode(variants).alias("v"))
    return rows.select(F.concat("_prefix", "v.variant").alias("peak_id"), "parent_id", "rank", F.col("v.variant").alias("variant"), F.col("v.seq").alias("seq"))


def _variant(name: Column | str, seq: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("variant"), seq.alias("seq"))


def stack_variants(*sets: DataFrame, **variants: DataFrame) -> DataFrame:
    """Tables of equal columns on top of each other: each under its name in a column `variant`, or, of sets of several variants, under their own."""
    named = [df.withColumn("variant", F.lit(name)) for name, df in variants.items()]
    return reduce(DataFrame.unionByName, [*named, *sets])


def measured_scoring_set(measurements: DataFrame, sequences: DataFrame, metadata: DataFrame, host_id: str, *, column: str, n_random: int, n_extreme: int, seed: int, validate: bool = True) -> DataFrame:
    """Measured elements that have a sequence, n_extreme from each end of `column` and n_random between, all at one host.

    measurements has seq_id and `column`. Returns peak_id (the element), `column`, stratum and the host's chrom, start, end.
    """
    kept = filter_measured(measurements, sequences, validate)
    return fixed_host(stratified_sample(kept, column, n_random, n_extreme, seed).withColumnRenamed("seq_id", "peak_id"), metadata, host_id)


def occlusion_set(candidates: DataFrame, k: int, width: int, seed: int) -> DataFrame:
    """The intact sequence and one variant per tile of `width` bases, replaced by random ones."""
    if width < 1:
        raise ValueError("tile width must be at least 1")
    starts = F.transform(fn.places(F.ceil(F.length("seq") / width)), lambda i: i * width)
    tiles = F.transform(starts, lambda s: _variant(F.concat(F.lit("tile"), s.cast("string")), fn.occlude(F.col("seq"), s, width, seed, F.col("parent_id"))))
    return _variants(ranked(candidates, k), F.concat(F.array(_variant("intact", F.col("seq"))), tiles))


def cpg_swap_set(candidates: DataFrame, k: int, count: int, seed: int) -> DataFrame:
    """Five variants: intact, more and fewer CpG, and two controls of equal composition; with the change in CpG."""
    best = ranked(candidates, k)
    swapped = [_variant(name, fn.swap_dinucleotides(F.col("seq"), word, count, seed, F.col("parent_id"))["seq"]) for name, word in SWAPS.items()]
    out = _variants(best, F.array(_variant("intact", F.col("seq")), *swapped))
    intact = best.select("parent_id", fn.cpg_count(F.col("seq")).alias("_cpg"))
    return out.join(F.broadcast(intact), "parent_id").withColumn("delta_cpg", fn.cpg_count(F.col("seq")) - F.col("_cpg")).drop("_cpg")


def draw_dose(spans: DataFrame, dose: int, seed: int, key: str = "seq_id") -> DataFrame:
    """`dose` spans of each key's (start, end) rows without replacement; 0 draws all. Keys with fewer have none."""
    order = W.partitionBy(key).orderBy(shuffle_key(seed, F.col(key), F.col("start")), "start", "end")
    rows = spans.withColumns({"_n": F.row_number().over(order), "_all": F.count(F.lit(1)).over(W.partitionBy(key))})
    return (rows if dose == 0 else rows.filter((F.col("_all") >= dose) & (F.col("_n") <= dose))).drop("_n", "_all")


def motif_ablation_set(candidates: DataFrame, hits: DataFrame, k: int, doses: list[int], n_controls: int, seed: int) -> DataFrame:
    """Per candidate and dose a variant with that many hits shuffled, and n_controls with as many spans of equal width off all hits.

    hits(seq_id, start, end) are those of the factor in question. Candidates without hits, and
    doses above their number, are left out.
    """
    best = ranked(candidates, k)
    spans = hits.select(F.col("seq_id").alias("parent_id"), "start", "end").distinct()
    per = spans.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_all"))
    out = None
    for dose in doses:
        drawn = draw_dose(spans, dose, seed + dose, "parent_id").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
        rows = best.join(drawn, "parent_id").join(per, "parent_id")
        ablated = _variant(f"d{dose}_ablated", fn.shuffle_spans(F.col("seq"), F.col("_spans"), seed, F.col("parent_id")))
        controls = []
        for c in range(n_controls):
            off = fn.control_spans(F.col("_spans"), F.length("seq"), seed + 1 + c, F.col("parent_id"), off=F.col("_all"))
            controls.append(_variant(f"d{dose}_ctl{c}", fn.shuffle_spans(F.col("seq"), off, seed + 1 + c, F.col("parent_id"))))
        made = _variants(rows, F.array(ablated, *controls))
        out = made if out is None else out.unionByName(made)
    return out


def locus_survey_set(inserts: DataFrame, loci: DataFrame, hosts: DataFrame, swaps: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every locus with every insert (intact, CpG raised, control), and a table of host properties.

    inserts(seq_id, seq) is a short list; loci(peak_id, chrom, start, end, peak_score); hosts(peak_id, seq).
    """
    order = W.orderBy("seq_id")
    listed = inserts.withColumn("_i", F.row_number().over(order) - 1)
    swapped = {"cpg_up": "GC", "ctl": "AT"}
    kinds = F.array(_variant("intact", F.col("seq")), *[_variant(n, fn.swap_dinucleotides(F.col("seq"), w, swaps, seed, F.col("seq_id"))["seq"]) for n, w in swapped.items()])
    variants = listed.select("_i", F.explode(kinds).alias("v")).select(F.concat(F.format_string("i%02d_", "_i"), F.col("v.variant")).alias("variant"), F.col("v.seq").alias("seq"))
    rows = numbered(loci, [F.col("peak_id")], "_i").withColumn("locus", F.format_string("L%02d", "_i")).drop("_i", "total")
    placed = rows.join(hosts.select("peak_id", F.col("seq").alias("_host")), "peak_id")
    records = placed.crossJoin(F.broadcast(variants)).select(F.concat_ws("_", "locus", "variant").alias("seq_id"), "seq", "chrom", "start", "end")
    table = placed.select("locus", "peak_id", "chrom", "start", "peak_score", fn.cpg_obs_exp(F.col("_host")).alias("host_cpg_oe"), fn.gc_fraction(F.col("_host")).alias("host_gc"))
    return records, table
