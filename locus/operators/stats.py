"""Permutation tests and false-discovery control."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from locus.functions.rand import shuffle_key
from locus.operators.ranking import numbered
from locus.operators.shared import reused

#: Distances this much below what was seen still count as equal.
CLOSE = 1e-12


#: Values (units times statistics) that may go to every task, and permutations that are multiplied at once.
HELD, BLOCK = 20_000_000, 64


def permutation_test(long: DataFrame, n: int, seed: int, *, held: int = HELD) -> DataFrame:
    """Two-sided test of the difference of means for long(unit, statistic, grp, value), grp selected or rejected.

    Values that are null or NaN are dropped. The order of units in permutation i is keyed by
    (seed, i, unit), so all statistics share it. Returns statistic, mean_selected,
    mean_rejected, delta and p = (permutations at least as far apart + 1) / (n + 1).

    Up to `held` values the units' matrix goes to every task, permutations are dealt out, and each
    one's keys are drawn once for all statistics; beyond, rows are dealt by statistic and permutation.
    """
    rows = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("value")))
    seen = rows.groupBy("statistic").agg(
        mean("selected").alias("mean_selected"), mean("rejected").alias("mean_rejected"), F.count(F.when(F.col("grp") == "selected", 1)).alias("_na"), F.count(F.lit(1)).alias("_n")
    )
    seen = reused(seen.withColumn("delta", F.col("mean_selected") - F.col("mean_rejected")))
    total = seen.agg(F.sum("_n")).first()[0] or 0
    far = _apart_in_blocks(rows, seen, n, seed) if total <= held else _apart_by_rows(rows, seen, n, seed)
    p = (F.coalesce(F.col("_far"), F.lit(0)) + 1) / (n + 1)
    return seen.join(far, "statistic", "left").select("statistic", "mean_selected", "mean_rejected", "delta", p.alias("p"))


def _apart_by_rows(rows: DataFrame, seen: DataFrame, n: int, seed: int) -> DataFrame:
    """(statistic, _far): permutations at least as far apart as what was seen; a row per unit, statistic and permutation."""
    drawn = rows.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(seen.select("statistic", "_na", "delta"), "statistic")
    rank = F.row_number().over(W.partitionBy("statistic", "perm").orderBy(shuffle_key(seed, F.col("perm"), F.col("unit")), "unit"))
    drawn = drawn.withColumn("_a", rank <= F.col("_na"))
    apart = F.avg(F.when(F.col("_a"), F.col("value"))) - F.avg(F.when(~F.col("_a"), F.col("value")))
    per = drawn.groupBy("statistic", "perm").agg(F.abs(apart).alias("_d"), F.abs(F.first("delta")).alias("_seen"))
    return per.groupBy("statistic").agg(F.count(F.when(F.col("_d") >= F.col("_seen") - CLOSE, 1)).alias("_far"))


def far_apart(perms: Iterable[int], seed: int, units: list[str], classes: list[tuple]) -> list[np.ndarray]:
    """How many of the permutations put each statistic's groups at least as far apart as seen.

    A class (mask, values, selected, deltas) holds the statistics of equal units, one column each. A
    permutation orders units by the hash of (seed, permutation, unit); its first units with a
    value are the selected ones, and one product of bits and values gives all sums.
    """
    out = [np.zeros(c[1].shape[1], np.int64) for c in classes]
    tails = [f":{u}".encode() for u in units]
    perms = list(perms)
    for at in range(0, len(perms), BLOCK):
        block = perms[at : at + BLOCK]
        orders = np.empty((len(block), len(units)), np.int64)
        for i, perm in enumerate(block):
            head = hashlib.md5(f"{seed}:{perm}".encode())
            keys = []
            for tail in tails:
                h = head.copy()
                h.update(tail)
                keys.append(h.digest())
            high, low = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).T
            orders[i] = np.lexsort((low, high))
        for k, (mask, values, selected, deltas) in enumerate(classes):
            has = mask[orders]
            first = has & (np.cumsum(has, axis=1) <= selected)
            bits = np.zeros(orders.shape)
            np.put_along_axis(bits, orders, first.astype(float), axis=1)
            sums, rest = bits @ values, mask.sum() - selected
            with np.errstate(divide="ignore", invalid="ignore"):
                apart = np.abs(sums / selected - (values.sum(axis=0) - sums) / rest)
            out[k] += (apart >= np.abs(deltas) - CLOSE).sum(axis=0)
    return out


def _apart_in_blocks(rows: DataFrame, seen: DataFrame, n: int, seed: int) -> DataFrame:
    """As _apart_by_rows, with the matrix of values (of checked size) in every task and permutations dealt out."""
    spark = rows.sparkSession
    facts = {r["statistic"]: (r["_na"], r["delta"]) for r in seen.collect()}
    held = rows.select(F.col("unit").cast("string").alias("unit"), "statistic", F.col("value").cast("double").alias("value")).toArrow()
    if held["unit"].null_count or held["statistic"].null_count:
        return _apart_by_rows(rows, seen, n, seed)
    units, names = held["unit"].dictionary_encode().combine_chunks(), held["statistic"].dictionary_encode().combine_chunks()
    keys, stats = units.dictionary.to_pylist(), names.dictionary.to_pylist()
    values, mask = np.zeros((len(keys), len(stats))), np.zeros((len(keys), len(stats)), bool)
    at = (units.indices.to_numpy(), names.indices.to_numpy())
    values[at], mask[at] = held["value"].to_numpy(), True
    if mask.sum() < len(held):  # a unit that a statistic has several times
        return _apart_by_rows(rows, seen, n, seed)
    alike: dict[tuple, list[int]] = {}
    for j, name in enumerate(stats):
        alike.setdefault((facts[name][0], mask[:, j].tobytes()), []).append(j)
    classes = [(mask[:, js[0]], values[:, js], na, np.array([np.nan if facts[stats[j]][1] is None else facts[stats[j]][1] for j in js])) for (na, _), js in alike.items()]
    order = [stats[j] for js in alike.values() for j in js]
    shared = spark.sparkContext.broadcast((keys, classes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = far_apart(batch.column(0).to_pylist(), seed, *shared.value)
            yield pa.RecordBatch.from_pydict({"statistic": order, "_k": np.concatenate([np.zeros(0, np.int64), *found])})

    parts = max(1, min(n, spark.sparkContext.defaultParallelism))
    schema = StructType([seen.schema["statistic"], StructField("_k", LongType())])
    return spark.range(0, n, 1, parts).mapInArrow(count, schema).groupBy("statistic").agg(F.sum("_k").alias("_far"))


def bh_fdr(tests: DataFrame, key: str = "statistic") -> DataFrame:
    """Adds q: p * m / rank, made monotone from the largest p down, at most 1.

    Ranks and the least value behind a row come from buckets of p and a table of one row per bucket.
    """
    ranked = numbered(tests, [F.col("p"), F.col(key)], "_rank", bucket="_b")
    ranked = ranked.withColumn("_v", F.col("p") * F.col("total") / (F.col("_rank") + 1))
    later = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    carried = ranked.groupBy("_b").agg(F.min("_v").alias("_min")).select("_b", F.min("_min").over(later).alias("_later"))
    inside = F.min("_v").over(W.partitionBy("_b").orderBy(F.desc("_rank")))
    out = ranked.withColumn("_in", inside).join(F.broadcast(carried), "_b")  # one row per part
    return out.withColumn("q", F.least(F.lit(1.0), "_in", "_later")).drop("_rank", "_b", "_v", "_in", "_later", "total")


def test_floor(tests: DataFrame, n: int, alpha: float = 0.05) -> DataFrame:
    """The smallest p that n permutations can give against the Bonferroni level, and how many tests pass q < alpha."""
    m = F.count(F.lit(1))
    out = tests.agg(F.lit(1 / (n + 1)).alias("p_floor"), (alpha / m).alias("bonferroni"), F.count(F.when(F.col("q") < alpha, 1)).alias("n_significant"))
    return out.withColumn("reachable", F.col("p_floor") <= F.col("bonferroni"))


def selected_vs_rejected(long: DataFrame, n: int, seed: int) -> DataFrame:
    """statistic, means, delta, p and q, by (p, statistic)."""
    return bh_fdr(permutation_test(long, n, seed)).orderBy("p", "statistic")
