"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
#: The letters that are lower-cased before words are compared.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder below the session's checkpoint folder, which all executors share.

    Only a local session without that setting (as in tests) gets one of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jvm_dir.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = jvm_dir.get() if jvm_dir.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder as Parquet and reads it again."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While texts are sent to Python by the jobs inside, a batch holds this much, which bounds the workers' memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release() -> None:
    """Gives what numpy and Arrow have freed back to the system: Python workers outlive their tasks and wait with it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def total_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of a text column: one number, summed on the executors."""
    return int(df.agg(F.coalesce(F.sum(text_bytes(F.col(text_col))), F.lit(0))).first()[0])


def parts_for(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(n_bytes / each))


def unit_hash(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5 over parts joined by colons."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def create_shared(path: str):
    """A new file of any store that pyarrow can write; local folders are made as needed."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "xb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


def open_shared(path: str):
    """A seekable file of any store that pyarrow can open; local paths need no library."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)

