"""Position weight matrices and motif hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.operators.shared import reused

BACKGROUND = 0.25
#: Scores and thresholds are rounded to this many places before they are compared.
PLACES = 9
#: Matrices that may go to every task, hits that a task passes on at once, and letters that it scans at once.
MATRICES, HELD, STRETCH = 10_000, 50_000, 1 << 22
#: Columns that a table of scores sums up; what sums of other order may differ by.
COLUMNS, SLACK = 6, 1e-8


def load_matrices(counts: DataFrame, names: list[str] | None, relative: float, validate: bool = True) -> DataFrame:
    """counts(tf, matrix_id, version, pos, a, c, g, t) to log-odds matrices, one row each.

    names picks factors, each by its newest version, under its name; None takes the whole
    collection under `tf|matrix_id`. Pseudocounts per base are sqrt(mean column total) / 4.
    Returns tf, matrix_id, width, logodds (structs a, c, g, t by pos), min, max and threshold =
    min + relative * (max - min).
    """
    if not 0 < relative <= 1:
        raise ValueError("relative threshold must be in (0, 1]")
    if names is not None:
        newest = F.max(F.struct("version", "matrix_id")).over(W.partitionBy("tf"))
        rows = counts.filter(F.col("tf").isin(names)).withColumn("_v", newest).filter((F.col("version") == F.col("_v.version")) & (F.col("matrix_id") == F.col("_v.matrix_id")))
    else:
        rows = counts.withColumn("tf", F.concat_ws("|", "tf", "matrix_id"))
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    rows = rows.withColumn("_ps", F.sqrt(F.avg(total).over(W.partitionBy("tf", "matrix_id"))) / 4)
    odds = {b: F.log2((F.col(b) + F.col("_ps")) / (total + 4 * F.col("_ps")) / BACKGROUND) for b in "acgt"}
    rows = rows.select("tf", "matrix_id", "pos", *[v.alias(b) for b, v in odds.items()])
    worst, best = F.least("a", "c", "g", "t"), F.greatest("a", "c", "g", "t")
    out = rows.groupBy("tf", "matrix_id").agg(
        F.count(F.lit(1)).cast("int").alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "a", "c", "g", "t"))), lambda x: x.dropFields("pos")).alias("logodds"),
        F.sum(worst).alias("min"), F.sum(best).alias("max"),
    )
    out = out.withColumn("threshold", F.col("min") + relative * (F.col("max") - F.col("min")))
    if names is not None and validate:
        out = reused(out)  # a row per factor
        if out.select("tf").distinct().count() < len(set(names)):
            raise ValueError("a factor has no matrix")
    return out


HITS = "seq_id string, tf string, matrix_id string, start int, end int, strand string, match_seq string, score double, relative_score double"


def _score_table(columns: np.ndarray) -> np.ndarray:
    """Summed scores of some columns for every word of bases (first base most significant), and of a word with another letter."""
    table = np.zeros(1)
    for column in columns:
        table = (table[:, None] + column[None, :]).ravel()
    return np.append(table, -np.inf)


def _words(code: np.ndarray, k: int) -> np.ndarray:
    """The number of the word of k bases at each place; 4**k where it has another letter."""
    n = max(len(code) - k + 1, 0)
    word, other = np.zeros(n, np.int32), np.zeros(n, bool)
    for j in range(k):
        word = word * 4 + code[j : j + n]
        other |= code[j : j + n] == 4
    word[other] = 4**k
    return word


def matches(code: np.ndarray, words: dict[int, np.ndarray], matrix: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places where a matrix scores at least the threshold, and the scores.

    The first columns' table is looked up at every place; a place goes on to the next columns only
    while the best that they can add reaches the threshold.
    """
    cuts = range(0, len(matrix), COLUMNS)
    best = [matrix[c:].max(axis=1).sum() for c in [*cuts, len(matrix)]][1:]
    at, score = None, None
    for c, rest in zip(cuts, best):
        k = min(COLUMNS, len(matrix) - c)
        if k not in words:
            words[k] = _words(code, k)
        table = _score_table(matrix[c : c + k])
        if at is None:
            found = table[words[k][: max(len(code) - len(matrix) + 1, 0)]]
        else:
            found = score + table[words[k][at + c]]
        keep = np.flatnonzero(found >= threshold - rest - SLACK)
        at, score = keep if at is None else at[keep], found[keep]
    score = np.round(score, PLACES)
    sure = score >= threshold
    return at[sure], score[sure]


def _stretches(seqs: list[str], overlap: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Sequences on end, parted by blanks, about STRETCH letters at a time: rows of (place in the letters,
    number of the sequence, place in the sequence, how many starts count), and the letters.

    A longer sequence is cut; pieces overlap so that every window lies within one, and starts count once.
    """
    rows, pieces, size = [], [], 0
    for i, seq in enumerate(seqs):
        last = max(len(seq) - overlap - 1, 0) // STRETCH * STRETCH
        for at in range(0, last + 1, STRETCH):
            piece = seq[at : at + STRETCH + overlap]
            rows.append((size, i, at, STRETCH if at < last else len(piece)))
            pieces.append(piece)
            size += len(piece) + 1
            if size >= STRETCH:
                yield np.array(rows), " ".join(pieces).encode("latin-1", "replace")
                rows, pieces, size = [], [], 0
    if pieces:
        yield np.array(rows), " ".join(pieces).encode("latin-1", "replace")


def scan_motifs(df: DataFrame, matrices: DataFrame) -> DataFrame:
    """Hits of all matrices on both strands of (seq_id, seq).

    start and match_seq (in capitals) are on the forward strand, also for hits on the other;
    windows with another letter than A, C, G, T score nothing. The matrices, a collection of
    bounded size, go to every task, which scans its sequences on end.
    """
    models = []
    for r in matrices.limit(MATRICES + 1).collect():
        m = np.array([[x[b] for b in "acgt"] for x in r["logodds"]])
        models.append((r["tf"], r["matrix_id"], m, round(r["threshold"], PLACES), round(r["min"], PLACES), round(r["max"], PLACES)))
    if len(models) > MATRICES:
        raise ValueError(f"more than {MATRICES} matrices")
    overlap = max((len(m[2]) for m in models), default=1) - 1
    names = [c.split()[0] for c in HITS.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(256, 4, np.int8)
        number[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2
        for batch in batches:
            ids, seqs = batch.column(0), batch.column(1).to_pylist()
            for rows, letters in _stretches(seqs, overlap):
                data = np.frombuffer(letters, np.uint8)
                code, words = number[data], {}
                for tf, matrix_id, m, threshold, low, high in models:
                    for strand, scores in (("+", m), ("-", m[::-1, ::-1])):
                        at, score = matches(code, words, scores, threshold)
                        head, which, begin, n = rows[np.searchsorted(rows[:, 0], at, "right") - 1].T
                        once = at - head < n
                        at, score, which, start = at[once], score[once], which[once], (at - head + begin)[once]
                        for a in range(0, len(at), HELD):
                            part = slice(a, a + HELD)
                            yield made(ids, which[part], tf, matrix_id, strand, data, at[part], start[part], score[part], len(m), low, high)

    def made(ids: pa.Array, which: np.ndarray, tf: str, matrix_id: str, strand: str, data: np.ndarray, at: np.ndarray, start: np.ndarray, score: np.ndarray, w: int, low: float, high: float) -> pa.RecordBatch:
        n = len(at)
        relative = np.round((score - low) / (high - low), PLACES) if high > low else np.ones(n)
        capitals = np.lib.stride_tricks.sliding_window_view(data, w)[at] & 0xDF  # only letters of bases are left
        found = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32)), pa.py_buffer(capitals.tobytes()))
        columns = [ids.take(pa.array(which)), *[pa.repeat(pa.scalar(x, pa.string()), n) for x in (tf, matrix_id)], pa.array(start, pa.int32()), pa.array(start + w, pa.int32()), pa.repeat(pa.scalar(strand), n), found, pa.array(score), pa.array(relative)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col("seq_id").cast("string").alias("seq_id"), F.col("seq").cast("string").alias("seq")).filter("seq IS NOT NULL").mapInArrow(scan, HITS)


def tf_summary(hits: DataFrame, factors: DataFrame) -> DataFrame:
    """Hits and mean relative score per factor(tf), zeros kept."""
    per = hits.groupBy("tf").agg(F.count(F.lit(1)).alias("n_hits"), F.avg("relative_score").alias("mean_relative"))
    return factors.select("tf").join(F.broadcast(per), "tf", "left").select("tf", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("mean_relative", F.lit(0.0)).alias("mean_relative"))
