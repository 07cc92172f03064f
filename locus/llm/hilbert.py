"""Sharding along a Hilbert curve over several metadata dimensions (DataFrame functions only).

Each dimension is quantised into 2**bits levels at its own quantiles, the cell is
numbered along a Hilbert curve, rows are ordered by (curve index, salt, key) and the
order is cut into runs of equal row count. Neighbouring cells share shards, so the
minima and maxima of every dimension stay narrow within a file and prune reads.

No global sort and no single-task window over rows: rows are counted per (cell, salt),
only the at most 2**(bits * dims) cells are ordered in one task, and row numbers are
taken inside (cell, salt) groups, so that a hot cell is split by its salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locus.llm.common import text_bytes, written

BITS, SALTS = 4, 256


def order_code(col: Column, kind: T.DataType) -> Column:
    """What a dimension is ordered by: strings by their bytes, all else as a number; null and NaN are null."""
    if isinstance(kind, T.StringType):
        return col
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def quantiles(df: DataFrame, codes: list[Column], bits: int) -> list[list]:
    """2**bits - 1 cut points or fewer per dimension: a bounded row, computed once so that retries agree.

    Numbers are cut at approximate quantiles. Strings are counted per value; the values are
    dealt in order into as many partitions as Spark shuffles by and cut where the rows before
    them pass each share, so that long common beginnings don't matter.
    """
    kinds = df.select(*[c.alias(f"_{i}") for i, c in enumerate(codes)]).schema
    at = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    numbers = [i for i, f in enumerate(kinds) if not isinstance(f.dataType, T.StringType)]
    row = df.agg(F.lit(0).alias("_"), *[F.percentile_approx(codes[i], at, F.lit(10_000)).alias(f"_{i}") for i in numbers]).first()
    return [list(row[f"_{i}"] or []) if i in numbers else string_cuts(df.select(codes[i].alias("v")), bits) for i in range(len(codes))]


def string_cuts(values: DataFrame, bits: int) -> list[str]:
    """The last value of each share of the rows, in the order of the values."""
    counts = written(values.filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")), "values")
    dealt = written(counts.repartitionByRange("v").withColumn("_p", F.spark_partition_id()), "values-in-order")
    along = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy("_p").agg(F.sum("n").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(along), F.lit(0)).alias("_before"), F.sum("_s").over(W.partitionBy()).alias("_all"))
    upto = F.col("_before") + F.sum("n").over(W.partitionBy("_p").orderBy("v"))
    share = F.floor((F.col("_upto") - F.col("n") / 2) * (1 << bits) / F.col("_all"))
    shares = dealt.join(F.broadcast(before), "_p").withColumn("_upto", upto).groupBy(share.alias("_share")).agg(F.max("v").alias("v"))
    return sorted(r["v"] for r in shares.collect())[:-1]  # 2**bits at most


def level(code: Column, cuts: list) -> Column:
    """How many distinct cut points lie below the code; null is lowest."""
    out = F.lit(0)
    for cut in sorted(set(cuts)):
        out = out + F.coalesce((code > F.lit(cut)).cast("int"), F.lit(0))
    return out


def with_hilbert_index(df: DataFrame, coords: list[str], bits: int, out: str) -> DataFrame:
    """Adds the Hilbert index of integer coordinates (Skilling's transposed form, 2004)."""
    n, tmp = len(coords), [f"_hx{i}" for i in range(len(coords))]
    df = df.withColumns({t: F.col(c) for t, c in zip(tmp, coords)})
    first = F.col(tmp[0])
    for k in range(bits - 1, 0, -1):
        q, low = 1 << k, (1 << k) - 1
        for i, name in enumerate(tmp):
            is_set = F.col(name).bitwiseAND(q) != 0
            if i == 0:
                df = df.withColumn(name, F.when(is_set, F.col(name).bitwiseXOR(F.lit(low))).otherwise(F.col(name)))
            else:
                df = df.withColumn("_ht", first.bitwiseXOR(F.col(name)).bitwiseAND(low))
                df = df.withColumns({
                    tmp[0]: F.when(is_set, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(F.col("_ht"))),
                    name: F.when(is_set, F.col(name)).otherwise(F.col(name).bitwiseXOR(F.col("_ht"))),
                })
    for before, name in zip(tmp, tmp[1:]):
        df = df.withColumn(name, F.col(name).bitwiseXOR(F.col(before)))
    flip = F.lit(0)
    for k in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(tmp[-1]).bitwiseAND(1 << k) != 0, F.lit((1 << k) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_ht", flip)
    df = df.withColumns({t: F.col(t).bitwiseXOR(F.col("_ht")) for t in tmp})
    index = F.lit(0).cast("long")
    for k in range(bits - 1, -1, -1):
        for t in tmp:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(t), k).bitwiseAND(1).cast("long"))
    return df.withColumn(out, index).drop(*tmp, "_ht")


def hilbert_shards(
    df: DataFrame, dims: list[str], n_shards: int, key: str, *, bits: int = BITS, salts: int = SALTS, ties: list[str] | None = None
) -> DataFrame:
    """Adds hilbert (long), shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 in each shard).

    Law: `rows`; shard sizes differ by at most one row. Every row gets a place, repeated
    rows one each; rows equal in key and `ties` may swap places. Nulls in a dimension
    share the lowest level, a null key sorts first. An empty table gives no rows. Columns
    of df named hilbert, shard or slot are replaced; other columns are kept as they are.
    """
    df = df.drop("hilbert", "shard", "slot")
    codes = [order_code(F.col(f"`{d}`"), df.schema[d].dataType) for d in dims]
    cuts = quantiles(df, codes, bits)
    cell = [f"_hq{i}" for i in range(len(dims))]
    group = [*cell, "_hsalt"]
    rows = df.withColumns(
        {c: level(code, x) for c, code, x in zip(cell, codes, cuts)} | {"_hsalt": F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in [key, *(ties or [])]]), F.lit(salts)).cast("int")}
    )
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_hn"))
    cells = with_hilbert_index(counts.groupBy(*cell).agg(F.sum("_hn").alias("_hcell_n")), cell, bits, "hilbert")
    along = W.orderBy("hilbert")  # at most 2**(bits * dims) rows, whatever the input
    cells = cells.withColumns({
        "_hbefore": F.sum("_hcell_n").over(along) - F.col("_hcell_n"),
        "_htotal": F.sum("_hcell_n").over(W.partitionBy()),
    })
    starts = counts.withColumn("_hat", F.sum("_hn").over(W.partitionBy(*cell).orderBy("_hsalt")) - F.col("_hn"))
    starts = starts.join(cells, cell).select(*group, "hilbert", (F.col("_hbefore") + F.col("_hat")).alias("_hstart"), "_htotal")
    order = [F.col(f"`{c}`") for c in [key, *(ties or [])]]
    rows = rows.withColumn("_hrow", F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1)
    at = F.col("_hstart") + F.col("_hrow")
    exact = F.expr(f"(_hat_row * {n_shards}L) div _htotal")
    first = F.expr(f"(shard * _htotal + {n_shards}L - 1L) div {n_shards}L")
    return (
        rows.join(starts, group)
        .withColumn("_hat_row", at)
        .withColumn("shard", exact)
        .withColumn("slot", F.col("_hat_row") - first)
        .withColumn("shard", F.col("shard").cast("int"))
        .drop(*group, "_hrow", "_hstart", "_htotal", "_hat_row")
    )


def shard_documents(docs: DataFrame, n_shards: int) -> DataFrame:
    """Documents with size, text_crc32, law, hilbert, shard, slot and grown_shard, by source, language and length.

    A null text counts as empty. grown_shard is null, as the law is `rows`. Columns of docs with
    these names are replaced, all others kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with_size = docs.withColumns({
        "size": text_bytes(F.col("text")) + 8,
        "text_crc32": F.crc32(F.encode(text, "UTF-8")).cast("long"),
        "law": F.lit("rows"),
    })
    out = hilbert_shards(with_size, ["source", "lang", "size"], n_shards, "doc_id", ties=["text_crc32"])
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


def op1_hilbert(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    narrow = docs.select("doc_id", "text", "lang", "source")
    out = shard_documents(narrow, n_shards)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert")
