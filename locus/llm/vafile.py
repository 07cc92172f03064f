"""Exact top-k inner products by a vector-approximation file.

Every component x is the integer floor(256 * x). The approximation of a vector holds,
per component, a cell of a 256-level grid of the block's quantiles, in a byte. Queries scan
the approximations: a cell's smallest and largest integer bound each product, so each (query, vector) pair gets
a lower and an upper bound of its score. Exact vectors are then read in order of falling
upper bound (rising lower bound of the distance) until the k-th result is certain.

Steps, each a Spark job over written tables:

1. Distinct vectors are dealt into blocks by hash and numbered there. Each block's edges and
   cells become one row of the approximation file, built once. Copies of one vector are
   one entry with its k + 1 smallest ids (more can't be in a result), so copies cost nothing.
2. Query blocks scan approximation blocks, a task for each pair; no exact vector takes part.
   Entries that can be among the k best of their block are listed with their bounds.
3. The k-th largest lower bound over all blocks rules out what lies below it.
4. The k entries of largest upper bound are fetched and scored exactly; then those whose upper
   bound reaches the k-th exact score. Nothing else can be in the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.llm.common import parts_for, written

K, LEVELS, BLOCK, QUERY_BLOCK, SALTS = 5, 256, 8192, 4096, 32
#: Queries whose bounds are held at once in a task.
CHUNK = 128
APPROXIMATION = "vb int, dim int, edges binary, cells binary, ids binary, sole binary"
QUERIES = "qb int, dim int, ids binary, vectors binary"
BOUNDS = "query_id long, vb int, dim int, pos int, low double, high double"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v, the integer components; rows with a null vector or a null or non-finite component go."""
    x = F.col(f"`{vec_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("_x")).filter("vec_id IS NOT NULL AND _x IS NOT NULL")
    bad = F.exists("_x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return rows.filter(~bad).select("vec_id", F.transform("_x", lambda c: F.floor(c.cast("double") * 256)).alias("v"))


def smallest_ids(vectors: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with its k + 1 smallest ids; a vector of many copies is split by a salt first."""
    salted = vectors.withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    few = salted.withColumn("_r", F.row_number().over(W.partitionBy("v", "_s").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    few = few.withColumn("_r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The approximation of a block: cell edges (LEVELS + 1 per component; a cell is [edge, next edge)) and each component's cell."""
    dims = vectors.shape[1]
    if dims == 0:
        return np.zeros((LEVELS + 1, 0)), np.zeros((len(vectors), 0), np.uint8)
    edges = np.quantile(vectors, np.linspace(0, 1, LEVELS + 1), axis=0, method="nearest").astype(np.float64)
    edges[-1] += 1
    cells = np.stack([np.searchsorted(edges[1:-1, j], vectors[:, j], side="right") for j in range(dims)], axis=1)
    return edges, cells.astype(np.uint8)


def bounds(queries: np.ndarray, edges: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products, from cells and edges only; components are integers."""
    dims = np.arange(edges.shape[1])
    low, high = edges[cells, dims], edges[cells.astype(np.int64) + 1, dims] - 1
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def scan(queries: np.ndarray, query_ids: np.ndarray, edges: np.ndarray, cells: np.ndarray, ids: np.ndarray, sole: np.ndarray, k: int) -> list[np.ndarray]:
    """Query number, entry, lower and upper bound of all entries that can be among a query's k best of this block.

    ids holds each entry's first id and sole whether that is its only one: an entry of the query's own row alone is left out.
    """
    parts = []
    for at in range(0, len(queries), CHUNK):
        lower, upper = bounds(queries[at : at + CHUNK], edges, cells)
        slack = 1e-6 + 1e-12 * np.maximum(np.abs(upper), np.abs(lower))
        lower, upper = lower - slack, upper + slack
        own = (query_ids[at : at + CHUNK, None] == ids[None, :]) & sole[None, :]
        lower[own] = upper[own] = -np.inf
        surely = np.partition(lower, len(cells) - k, axis=1)[:, len(cells) - k] if len(cells) > k else np.full(len(lower), -np.inf)
        q, e = np.nonzero((upper >= surely[:, None]) & ~own)
        parts.append((q + at, e, lower[q, e], upper[q, e]))
    return [np.concatenate(x) for x in zip(*parts)]


def approximation_file(entries: DataFrame) -> DataFrame:
    """One row per block of entries(vb, dim, pos, v, ids): edges, cells by pos, first ids, and which entries have one id only."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        edges, cells = approximate(np.stack(pdf["v"].to_numpy()).astype(np.int64))
        ids, sole = pdf["id"].to_numpy(np.int64), pdf["sole"].to_numpy(bool)
        row = (pdf["vb"].iloc[0], pdf["dim"].iloc[0], edges.tobytes(), cells.tobytes(), ids.tobytes(), sole.tobytes())
        return pd.DataFrame([row], columns=["vb", "dim", "edges", "cells", "ids", "sole"])

    rows = entries.select("vb", "dim", "pos", "v", F.col("ids")[0].alias("id"), (F.size("ids") == 1).alias("sole"))
    return rows.groupBy("vb", "dim").applyInPandas(build, APPROXIMATION)


def query_blocks(asked: DataFrame, n_blocks: int) -> DataFrame:
    """One row per block of queries(vec_id, v) of one length."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        row = (pdf["qb"].iloc[0], pdf["dim"].iloc[0], pdf["vec_id"].to_numpy(np.int64).tobytes(), vectors.tobytes())
        return pd.DataFrame([row], columns=["qb", "dim", "ids", "vectors"])

    dealt = asked.withColumns({"qb": F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"), "dim": F.size("v")})
    return dealt.groupBy("qb", "dim").applyInPandas(build, QUERIES)


def scan_blocks(asked: DataFrame, approximation: DataFrame, n_queries: int, n_vectors: int, k: int) -> DataFrame:
    """Bounds of what can be among a query's k best of each block; the stated queries against all blocks."""

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in BOUNDS.split(", ")]
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame(columns=columns)
        q, v = left.iloc[0], right.iloc[0]
        dim, ids = int(v["dim"]), np.frombuffer(q["ids"], np.int64)
        own, sole = np.frombuffer(v["ids"], np.int64), np.frombuffer(v["sole"], bool)
        edges = np.frombuffer(v["edges"], np.float64).reshape(LEVELS + 1, dim)
        cells = np.frombuffer(v["cells"], np.uint8).reshape(len(sole), dim)
        which, pos, low, high = scan(np.frombuffer(q["vectors"], np.int64).reshape(len(ids), dim), ids, edges, cells, own, sole, k)
        return pd.DataFrame({"query_id": ids[which], "vb": v["vb"], "dim": dim, "pos": pos, "low": low, "high": high})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = query_blocks(asked, n_queries).withColumn("vb", every(n_vectors))
    right = approximation.withColumn("qb", every(n_queries))
    key = ["qb", "vb", "dim"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(pair, BOUNDS)


def exact_scores(wanted: DataFrame, asked: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, vec_id and score of wanted(query_id, vb, dim, pos), the query's own id left out."""
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    found = wanted.select("query_id", "vb", "dim", "pos").join(entries, ["vb", "dim", "pos"])
    scored = found.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    rows = scored.select("query_id", product.alias("score"), "ids").select("query_id", F.explode("ids").alias("vec_id"), "score")
    return rows.filter("vec_id <> query_id")


def topk(df: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows, ties to the smaller id.

    queries are rows of the same columns; a query isn't matched with rows of its own id.
    Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without an id or vectors of another length than the query's. Rows that repeat an id and
    vector count once; of a query id with several vectors the smallest vector is asked for.
    Components must be below 2**26 in size, so that scores fit a long. An empty table gives no rows.
    """
    vectors = integer_vectors(df, id_col, vec_col).dropDuplicates()
    asked = written(integer_vectors(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_vectors, n_queries = parts_for(df.count(), block), parts_for(asked.count(), QUERY_BLOCK)
    dealt = smallest_ids(vectors, k).withColumns({"vb": F.pmod(F.xxhash64("v"), F.lit(n_vectors)).cast("int"), "dim": F.size("v")})
    entries = written(dealt.withColumn("pos", F.row_number().over(W.partitionBy("vb", "dim").orderBy("v")) - 1), "vectors")
    approximation = written(approximation_file(entries), "approximation")
    listed = written(scan_blocks(asked, approximation, n_queries, n_vectors, k), "bounds")

    per = W.partitionBy("query_id")
    kth = listed.withColumn("_n", F.row_number().over(per.orderBy(F.desc("low")))).filter(F.col("_n") == k).select("query_id", F.col("low").alias("_least"))
    passed = listed.join(kth, "query_id", "left").filter("_least IS NULL OR high >= _least")
    passed = written(passed.withColumn("_n", F.row_number().over(per.orderBy(F.desc("high"), "vb", "pos"))).drop("_least", "low"), "passed")
    # In bound order: the first k entries, then all that can still be better than their k-th score or tie with it.
    first = written(exact_scores(passed.filter(F.col("_n") <= k), asked, entries), "scores")
    certain = first.withColumn("_r", F.row_number().over(per.orderBy(F.desc("score"), "vec_id"))).filter(F.col("_r") == k).select("query_id", F.col("score").alias("_kth"))
    more = passed.filter(F.col("_n") > k).join(certain, "query_id", "left").filter("_kth IS NULL OR high >= _kth")
    scores = first.unionByName(exact_scores(more, asked, entries)).dropDuplicates()
    ranked = scores.withColumn("rank", F.row_number().over(per.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_vafile(embeddings: DataFrame) -> DataFrame:
    return topk(embeddings, embeddings.filter("vec_id % 50 = 0"))


OP2_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
