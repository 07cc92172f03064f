"""Token ids packed into rows of fixed length by best-fit decreasing.

Documents are dealt into groups by a hash of doc_id, about GROUP_BYTES of text each, so the
number of groups grows with the input and not their size. A group is tokenised, texts longer
than a row are split losslessly into full rows and a rest, and pieces are placed in falling
length: each goes to the row with the least room that still holds it, found by descending a
segment tree over room sizes. Groups need nothing from each other.

A written row holds the id matrix row (padded), the cumulative segment lengths and the
position ids, which restart at each segment.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus.llm.common import parts_for, shared_dir, total_bytes

LENGTH, GROUP_BYTES, END = 2048, 4 << 20, 50256
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS = (
    "pack_group int, pack_row int, input_ids binary, position_ids binary, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<int>, doc_tokens array<int>"
)


class Rooms:
    """A segment tree over room sizes 0 to `most`: how many rows have each, and the least size of at least n."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the smallest room of at least `least`, taken out; None if there is none."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of piece numbers; no row's lengths exceed `most`. Pieces of equal length keep their order."""
    rooms, rows = Rooms(most), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[piece])
        if found is None:
            found = (most, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(piece)
        rooms.put(room - lengths[piece], row)
    return rows


@lru_cache(1)  # a worker reads the file once
def tiktoken_encoder(path: str = TOKENIZER) -> Callable[[str], list[int]]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def pack_group(pdf: pd.DataFrame, encode: Callable[[str], list[int]], most: int, end: int | None, id_type: str) -> pd.DataFrame:
    pdf = pdf.sort_values(["_id", "text"], na_position="last")
    pieces: list[tuple[int | None, int, np.ndarray]] = []
    for doc_id, is_null, text in zip(pdf["_id"], pdf["_null"], pdf["text"]):
        ids = encode(text) + ([end] if end is not None else [])
        ids = np.array(ids, np.uint32)
        if len(ids) and ids.max() > np.iinfo(id_type).max:
            raise ValueError(f"token id {ids.max()} doesn't fit {id_type}")
        pieces += [(None if is_null else doc_id, at, ids[at : at + most]) for at in range(0, len(ids), most)]
    out = []
    for number, row in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], most)):
        held = [pieces[i] for i in row]
        sizes = [len(p[2]) for p in held]
        pad = most - sum(sizes)
        ids = np.concatenate([p[2] for p in held] + [np.full(pad, end or 0, np.uint32)])
        places = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes] + [np.zeros(pad, np.uint32)])
        out.append((int(pdf["_group"].iloc[0]), number, ids.astype(id_type).tobytes(), places.astype("<u2" if most <= 65536 else "<u4").tobytes(), sum(sizes), np.cumsum([0, *sizes]).tolist(), [p[0] for p in held], [p[1] for p in held], sizes))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])


def pack(docs: DataFrame, *, length: int = LENGTH, tokenizer: str = TOKENIZER, end: int | None = END, group_bytes: int = GROUP_BYTES, id_type: str = "<u2") -> DataFrame:
    """Packed rows of docs(doc_id, text): input_ids (`length` numbers of id_type, padded with
    `end`), position_ids (16-bit; they restart at each segment), n_tokens without padding,
    cu_seqlens, and for each segment its doc_id, start in the document's tokens and token count.

    Each document ends in the id `end`, which an empty or null text consists of. Documents longer
    than a row are split without loss: their segments' starts and counts restore them. Rows of
    equal doc_id are packed one by one; a null doc_id stays null. An empty table gives no rows.
    The tokenizer file has to be readable on every executor.
    """
    n = parts_for(total_bytes(docs) + 1, group_bytes)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("_group"),
    )
    return rows.groupBy("_group").applyInPandas(lambda pdf: pack_group(pdf, tiktoken_encoder(tokenizer), length, end, id_type), ROWS)


def op9_packing(docs: DataFrame) -> DataFrame:
    """Writes the matrices to the shared folder and returns a digest of each row."""
    path = shared_dir(docs.sparkSession, "packed")
    pack(docs.select("doc_id", "text")).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    return rows.select(
        "pack_group", "pack_row", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "doc_starts", "cu_seqlens",
        F.slice("cu_seqlens", 1, F.size("cu_seqlens") - 1).alias("position_resets"), F.sha2("input_ids", 256).alias("ids_sha256"),
    )
