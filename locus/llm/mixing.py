"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Source s of size n_s gets the repetition rate  budget * w_s / n_s; each document is
repeated K times, K being the inverse of the Poisson distribution function at a uniform
number hashed from (seed, document id). Copies are exploded and the mix is put in a
global random order by a hash of (seed, document id, copy).

Rates above PART are drawn as sums of independent parts of at most PART, so exp(-rate)
never underflows and no rate is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locus.llm.common import text_bytes, unit_hash

SEED, PART, SALTS = 20240, 256.0, 64


def source_key(col: Column) -> Column:
    """Null is a source of its own, unlike any string."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


def rates(docs: DataFrame, size: Column, source_col: str, weights: dict | None, budget: float | None) -> DataFrame:
    """One row per source: _mkey, rate, _mparts and _mcdf, the distribution function of one part.

    Without weights all sources weigh the same; with them, a source that is not named weighs 0.
    The budget defaults to the total size, so the mix is about as large as the input.
    """
    per = docs.groupBy(source_key(F.col(f"`{source_col}`")).alias("_mkey")).agg(F.sum(size).cast("double").alias("_msize"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_mkey") == source_key(F.lit(name)), F.lit(float(w))).otherwise(weight)
    per = per.withColumn("_mw", weight)
    total = per.agg(F.sum("_msize").alias("_mtotal"), F.sum("_mw").alias("_mws"))
    share = F.col("_mw") / F.col("_mws")
    aim = F.col("_mtotal") if budget is None else F.lit(float(budget))
    per = per.crossJoin(F.broadcast(total))  # one row
    per = per.withColumn("rate", F.when((F.col("_msize") > 0) & (F.col("_mws") > 0), aim * share / F.col("_msize")).otherwise(F.lit(0.0)))
    per = per.withColumn("_mparts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    per = per.withColumn("_mr", F.col("rate") / F.col("_mparts"))
    last = F.ceil(F.col("_mr") + 12 * F.sqrt(F.col("_mr")) + 20).cast("int")
    start = F.struct(F.exp(-F.col("_mr")).alias("p"), F.array(F.exp(-F.col("_mr"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("_mr") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return per.withColumn("_mcdf", F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]).select("_mkey", "rate", "_mparts", "_mcdf")


def poisson_mix(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: dict | None = None, budget: float | None = None, seed: int = SEED,
) -> DataFrame:
    """Documents repeated by their Poisson counts, with copy (int from 0), rate and mix_key, in global order of mix_key.

    Size is UTF-8 bytes of the text plus 8, so empty and null texts count a little.
    Rows with a null source form one source; rows with a null id draw as the id `null`.
    Repeated rows draw the same count each. An empty table gives no rows. Columns of docs
    named copy, rate or mix_key are replaced, all others kept.
    """
    docs = docs.drop("copy", "rate", "mix_key")
    per = rates(docs, text_bytes(F.col(f"`{text_col}`")) + 8, source_col, weights, budget)
    per = per.withColumn("_msalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # splits a hot source
    doc_id = F.col(f"`{id_col}`")

    def drawn(acc: Column, j: Column) -> Column:
        u = unit_hash(seed, doc_id, j)
        return acc + F.size(F.filter(F.col("_mcdf"), lambda c: c <= u))

    one = F.size(F.filter(F.col("_mcdf"), lambda c: c <= F.col("_mu")))
    many = F.aggregate(F.sequence(F.lit(1), F.col("_mparts")), F.lit(0), drawn)
    out = (
        docs.withColumns({"_mkey": source_key(F.col(f"`{source_col}`")), "_mu": unit_hash(seed, doc_id, 1), "_msalt": F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")})
        .join(per, ["_mkey", "_msalt"])
        .withColumn("_mn", F.when(F.col("_mparts") == 1, one).otherwise(many))
        .filter("_mn > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_mn") - 1)))
        .withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.col("copy"))))
        .drop("_mkey", "_msalt", "_mu", "_mn", "_mparts", "_mcdf")
    )
    return out.orderBy("mix_key")


def repeated_documents(docs: DataFrame) -> DataFrame:
    """docs mixed to equal weights of their sources, with its own columns only, whatever their names."""
    taken = {c: f"_own_{c}" for c in ("copy", "rate", "mix_key") if c in docs.columns}
    mixed = poisson_mix(docs.withColumnsRenamed(taken)).drop("copy", "rate", "mix_key")
    return mixed.withColumnsRenamed({v: k for k, v in taken.items()}).select(docs.columns)


def op7_poisson(docs: DataFrame) -> DataFrame:
    out = poisson_mix(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "copy", F.round("rate", 6).alias("rate"), "mix_key")


#: Rates stay below PART on these tables, so one uniform number a document is enough here.
OP7_SQL = f"""
WITH per AS (SELECT source, sum(coalesce(strlen(text), 0) + 8)::DOUBLE AS n FROM documents GROUP BY source),
rate AS (SELECT source, (SELECT sum(n) FROM per) * (1.0 / (SELECT count(*) FROM per)) / n AS rate FROM per),
steps AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
          FROM rate, generate_series(0, 700) t(k)),
u AS (SELECT doc_id, source, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.source, s.rate, count(*) FILTER (s.cdf <= u.u) AS n
      FROM u JOIN steps s ON u.source IS NOT DISTINCT FROM s.source AND s.k <= s.rate + 12 * sqrt(s.rate) + 20 GROUP BY ALL),
c AS (SELECT doc_id, source, round(rate, 6) AS rate, unnest(generate_series(0, n - 1))::INTEGER AS copy FROM n WHERE n > 0)
SELECT doc_id, source, copy, rate, md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS mix_key FROM c
"""
