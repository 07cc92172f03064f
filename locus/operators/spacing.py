"""Greedy spacing of windows in parallel rounds.

Greedy choice by falling score accepts a window exactly when no better one within the separation
was accepted. So a window that is best within the separation can be accepted at once, together
with all others like it, and its neighbours go; what is left is dealt with alike until nothing
is. Within a bucket of positions such steps follow each other in memory, and only windows whose
fate hangs on the far side of a bucket's edge wait for the next round, with the windows that were
accepted near edges. Each round at least the best open window is settled; buckets widen from
round to round, so that a chain of falling scores along a contig takes few of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.operators.shared import reused

OPEN, ACCEPTED, GONE = 0, 1, 2
#: How many times the first width buckets may get.
WIDEST = 16


def settle(start: np.ndarray, score: np.ndarray, state: np.ndarray, own: np.ndarray, separation: int) -> np.ndarray:
    """States after all steps that the windows of one bucket (sorted by start) allow; windows that aren't its own stay open."""
    low = np.searchsorted(start, start - separation, "right")
    high = np.searchsorted(start, start + separation, "left")
    out, waits = state.copy(), np.zeros(len(start), bool)
    for i in np.flatnonzero(state == ACCEPTED).tolist():
        out[low[i] : high[i]] = np.where(state[low[i] : high[i]] == ACCEPTED, ACCEPTED, GONE)
    for i in np.lexsort((start, -score)).tolist():
        if out[i] != OPEN:
            continue
        if waits[i] or not own[i]:
            waits[low[i] : high[i]] = True
        else:
            out[low[i] : high[i]] = GONE
            out[i] = ACCEPTED
    return out


def _settled(batches: Iterator[pa.RecordBatch], keys: list[str], separation: int) -> Iterator[pa.RecordBatch]:
    """Own open windows of batches sorted by keys and win_start that are accepted now or stay open, with their state."""

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        column = lambda c, kind: rows[c].cast(kind).to_numpy()
        state, own = column("_state", pa.int32()).copy(), column("_own", pa.bool_())
        after = settle(column("win_start", pa.int64()), column("peak_score", pa.float64()), state, own, separation)
        keep = own & (state == OPEN) & (after != GONE)
        rows = rows.set_column(rows.schema.get_field_index("_state"), rows.schema.field("_state"), pa.array(after, pa.int32()))
        yield from rows.filter(pa.array(keep)).to_batches()

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        turns = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            turns |= pc.fill_null(pc.not_equal(v[1:], v[:-1]), True).to_numpy(zero_copy_only=False) & ~(pc.is_null(v[1:]).to_numpy(zero_copy_only=False) & pc.is_null(v[:-1]).to_numpy(zero_copy_only=False))
        edges = [0, *(np.flatnonzero(turns) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(v[a].as_py() for v in values)
            if held and key != last:
                yield from done(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield from done(held)


def spaced(windows: DataFrame, group: list[str], separation: int, bucket: int, best: list[Column] | None = None) -> DataFrame:
    """Windows that greedy choice by falling peak_score, then win_start, keeps at least `separation` apart per group.

    Each group has one window per win_start; with `best`, an order of columns, the first by that
    order stands for a win_start. All columns are kept. A null score comes last.
    """
    width, here, keys, accepted = max(bucket, separation), F.col("win_start"), [*group, "_b"], []
    rows = windows.withColumn("_state", F.lit(OPEN))
    widest = WIDEST * width
    while True:
        at = lambda c, w=width: F.floor(c / w).cast("long")
        places = F.array_distinct(F.array(at(here - (separation - 1)), at(here), at(here + (separation - 1))))
        dealt = rows.withColumn("_b", F.explode(places)).withColumn("_own", F.col("_b") == at(here)).repartition(*keys)
        if best and not accepted:
            first = F.row_number().over(W.partitionBy(*keys, "win_start").orderBy(*best))
            dealt = dealt.withColumn("_n", first).filter("_n = 1").drop("_n")
        ordered = dealt.sortWithinPartitions(*keys, "win_start")
        round_ = reused(ordered.mapInArrow(lambda batches: _settled(batches, keys, separation), ordered.schema).drop("_b", "_own"))
        accepted.append(round_.filter(F.col("_state") == ACCEPTED))
        left = round_.filter(F.col("_state") == OPEN)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, accepted).drop("_state")
        # of what is settled only this round's windows near its buckets' edges can meet open ones
        rows = left.unionByName(accepted[-1].filter(at(here - (separation - 1)) != at(here + (separation - 1))))
        width = min(2 * width, widest)
