"""Partitions as streams of tuples, for steps that have to see sorted rows one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
}


def in_arrow(spec: str, kinds: dict[str, pa.DataType], make: Callable[[Iterator[tuple]], Iterator[tuple]], columns: list[str], rows_out: int = 2000):
    """A function for mapInArrow: a stream of row tuples (the given columns) in, row tuples out."""
    names = [c.split()[0] for c in spec.split(", ")]
    types = [kinds[c.split()[1]] for c in spec.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                held = b.to_pydict()
                yield from zip(*(held[c] for c in columns))

        out = []
        for row in make(stream()):
            out.append(row)
            if len(out) >= rows_out:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return run


def mapped(df: DataFrame, spec: str, make: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """df's rows, in the order of each partition, through a generator of tuples."""
    return df.mapInArrow(in_arrow(spec, KINDS, make, df.columns), spec)


def runs(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Neighbouring rows of equal first column, as streams; what a user leaves of a run is skipped."""
    return groupby(rows, key=lambda r: r[0])
