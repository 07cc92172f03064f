"""Order-k Markov chains over bases: fitting by aggregation, sampling by keyed uniforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.functions.seq import BASES
from locus.operators.seqstats import kmer_counts

#: The highest order of a chain that is sampled (its table has 4**order rows), and draws that a task holds at once.
ORDER, DRAWS = 10, 1 << 20


def markov_fit(df: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """context, base, n and p = (n + alpha) / (total + 4 alpha), four rows per observed context."""
    counts = kmer_counts(df, k + 1).withColumnRenamed("kmer", "g").filter(~F.col("g").rlike("[^ACGT]"))
    counts = counts.select(F.substring("g", 1, k).alias("context"), F.substring("g", k + 1, 1).alias("base"), "n")
    full = counts.select("context").distinct().select("context", F.explode(F.array(*map(F.lit, BASES))).alias("base"))
    full = full.join(counts, ["context", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.withColumn("p", (F.col("n") + alpha) / (F.sum("n").over(W.partitionBy("context")) + 4 * alpha))


def markov_prefixes(df: DataFrame, k: int) -> DataFrame:
    """prefix and weight: the first k bases of the sequences, where all are A, C, G or T."""
    head = F.substring(F.upper("seq"), 1, k)
    return df.select(head.alias("prefix")).filter((F.length("prefix") == k) & ~F.col("prefix").rlike("[^ACGT]")).groupBy("prefix").agg(F.count(F.lit(1)).alias("weight"))


def model_arrays(transitions: DataFrame, prefixes: DataFrame, k: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The chain as arrays of at most 4**k rows: the first three cumulative probabilities by context number, the prefixes, their cumulative weights."""
    number = {b: i for i, b in enumerate(BASES)}
    p = np.full((4**k, 4), 0.25)
    for context, base, x in transitions.select("context", "base", "p").toLocalIterator():
        p[numbered_context(context), number[base]] = x
    heads = sorted((r["prefix"], r["weight"]) for r in prefixes.select("prefix", "weight").toLocalIterator())
    return np.cumsum(p, axis=1)[:, :3], [h[0] for h in heads], np.cumsum([h[1] for h in heads])


def numbered_context(context: str) -> int:
    out = 0
    for c in context:
        out = out * 4 + BASES.index(c)
    return out


def walk(ids: list[str | None], table: np.ndarray, heads: list[str], upto: np.ndarray, k: int, length: int, seed: int) -> list[str]:
    """A sequence per id; all ids take a step at a time, each with its own uniforms (as rand.uniform keys them)."""
    keys = [hashlib.md5(f"{seed}:{'' if i is None else f'{i}:'}".encode()) for i in ids]
    steps = [b"prefix", *[str(i).encode() for i in range(length - k)]]

    def draws() -> Iterator[bytes]:
        for key in keys:
            for step in steps:
                h = key.copy()
                h.update(step)
                yield h.digest()[:4]

    u = np.frombuffer(b"".join(draws()), ">u4").reshape(len(ids), len(steps)) / 4294967296.0
    first = np.searchsorted(upto, u[:, 0] * upto[-1], "right")
    context = np.array([numbered_context(h) for h in heads])[first]
    bases = np.empty((len(ids), length - k), np.uint8)
    for i in range(length - k):
        bases[:, i] = (table[context] <= u[:, i + 1, None]).sum(axis=1)
        context = (context * 4 + bases[:, i]) % len(table)
    letters = np.frombuffer("".join(BASES).encode(), np.uint8)[bases]
    return [heads[f] + row.tobytes().decode() for f, row in zip(first.tolist(), letters)]


def markov_sample(ids: DataFrame, transitions: DataFrame, prefixes: DataFrame, k: int, length: int, seed: int) -> DataFrame:
    """One sequence per row of ids(sample_id): a prefix by weight, then base after base.

    An unseen context draws uniformly. `length` must be at least k, and k at most ORDER, since the
    chain goes to every task. Without any prefix the sequences are null.
    """
    if length < k:
        raise ValueError(f"length {length} is below the order {k}")
    if k > ORDER:
        raise ValueError(f"order {k} is above {ORDER}")
    table, heads, upto = model_arrays(transitions, prefixes, k)
    if not heads:
        return ids.withColumn("seq", F.lit(None).cast("string"))
    shared = ids.sparkSession.sparkContext.broadcast((table, heads, upto))
    together = max(1, DRAWS // (length + 1))

    @F.pandas_udf("string")
    def drawn(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), together):
                out += walk([None if i is None else str(i) for i in batch.iloc[at : at + together]], *shared.value, k, length, seed)
            yield pd.Series(out, dtype=object)

    return ids.withColumn("seq", drawn(F.col("sample_id").cast("string")))
