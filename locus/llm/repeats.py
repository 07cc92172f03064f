"""Removal of byte strings that an earlier document holds too (threshold: 50 bytes).

Documents are dealt into blocks by a hash of doc_id. In a block every 50-byte window is
assigned to its anchor, the 24-byte string of least hash in it; equal windows have equal anchors.

1. Blocks send the distinct hashes of their anchors (4 bytes each) to buckets, which answer
   which of them other documents hold as well. Only those anchors go on, so text that nothing
   shares is never moved.
2. Blocks send the stretches around shared anchors (at most 76 bytes) to the buckets, each
   distinct stretch once with its smallest doc_id and its places. A bucket puts all its distinct
   stretches into Burrows-Wheeler transforms, and interval expansion to depth 50 gives for each
   window the smallest document holding it.
3. Places where that document is smaller go back to their block, which cuts the bytes.

Copies are pre-aggregated per block before every shuffle. Blocks and buckets grow in number
with the input, not in size. The three visits of the texts share one shuffle of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus.llm.bwt import least_owners
from locus.llm.common import parts_for, text_bytes, total_bytes
from locus.llm.shingles import MIX, mixed

LEAST, ANCHOR = 50, 24
SPREAD = LEAST - ANCHOR + 1
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Anchors whose stretches begin in the same bytes of this number share a transform; three ranks of its rows fit into 64 bits.
PIECE = 1 << 20
BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)


class Block:
    """The texts of a block on end, and their anchors."""

    def __init__(self, pdf: pd.DataFrame, buckets: int):
        pdf = pdf.assign(_b=[(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]).sort_values(["doc_id", "_b"])
        self.ids = pdf["doc_id"].to_numpy(np.int64)
        self.texts = list(pdf["_b"])
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.buckets = buckets

    def find_anchors(self) -> None:
        """Runs of windows with one anchor: run from `low` to `high` (inclusive), anchor place and hash."""
        data = b"".join(self.texts)
        codes = BYTE[np.frombuffer(data, np.uint8)]
        n = len(codes)
        windows = n - LEAST + 1
        if windows <= 0:
            self.low = self.high = self.place = np.empty(0, np.int64)
            self.hash = np.empty(0, np.uint64)
            self.doc = np.empty(0, np.int64)
            return
        h, width = codes, 1
        while width < 16:
            h = h[:-width] * MIX + h[width:]
            h ^= h >> np.uint64(29)
            width *= 2
            if width == 8:
                eight = h
        full = mixed(h[: n - ANCHOR + 1] * MIX + eight[16 : 16 + n - ANCHOR + 1])
        key = (full & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(full), dtype=np.uint64)
        low, width = key, 1
        while width * 2 <= SPREAD:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:windows], low[SPREAD - width : SPREAD - width + windows])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)[:windows]
        whole = np.arange(windows) + LEAST <= self.ends[owner]
        at = np.flatnonzero(whole)
        place, owner = place[at], owner[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.low, self.high = at[first], at[np.append(first[1:], len(at)) - 1] if len(first) else at[:0]
        self.place, self.doc = place[first], owner[first]
        self.hash = full[self.place]

    def distinct(self) -> None:
        """Distinct anchors in the order (bucket, 32-bit rest), whether two documents here hold them, and each run's."""
        bucket = (self.hash >> np.uint64(40)) % np.uint64(self.buckets)
        key = (bucket << np.uint64(32)) | (self.hash & np.uint64(0xFFFFFFFF))
        self.keys, self.of_run = np.unique(key, return_inverse=True)
        low = np.full(len(self.keys), np.iinfo(np.int64).max)
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        ids = self.ids[self.doc]
        np.minimum.at(low, self.of_run, ids)
        np.maximum.at(high, self.of_run, ids)
        self.several = low < high

    def per_bucket(self) -> list[tuple[int, slice]]:
        of = (self.keys >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        return [(int(of[a]), slice(a, b)) for a, b in zip(first, np.append(first[1:], len(of)))]


ANCHORS = "bucket int, block int, keys binary, several binary"
SHARED = "block int, bucket int, shared binary"
STRETCHES = "bucket int, block int, data binary, length binary, anchor binary, owner binary, n_places binary, doc binary, start binary"
CUTS = "block int, doc binary, start binary, stop binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def send_anchors(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    block = Block(pdf, buckets)
    block.find_anchors()
    block.distinct()
    rows = [(b, int(pdf["block"].iloc[0]), block.keys[s].astype(np.uint32).tobytes(), np.packbits(block.several[s]).tobytes()) for b, s in block.per_bucket()]
    return pd.DataFrame(rows, columns=["bucket", "block", "keys", "several"])


def find_shared(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(pdf["several"], parts)])
    _, of, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = (n > 1) | (np.bincount(of, several) > 0)
    flags = np.split(shared[of], np.cumsum([len(k) for k in parts])[:-1])
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "shared": [np.packbits(f).tobytes() for f in flags]})


def send_stretches(docs: pd.DataFrame, shared: pd.DataFrame, buckets: int) -> pd.DataFrame:
    columns = [c.split()[0] for c in STRETCHES.split(", ")]
    if len(docs) == 0 or len(shared) == 0:
        return pd.DataFrame(columns=columns)
    block = Block(docs, buckets)
    block.find_anchors()
    block.distinct()
    flags = dict(zip(shared["bucket"], shared["shared"]))
    is_shared = np.zeros(len(block.keys), bool)
    for b, s in block.per_bucket():
        is_shared[s] = np.unpackbits(np.frombuffer(flags[b], np.uint8), count=s.stop - s.start)
    runs = np.flatnonzero(is_shared[block.of_run])
    data = b"".join(block.texts)
    low, stop = block.low[runs], block.high[runs] + LEAST
    offset = block.place[runs] - low
    found: dict[tuple[int, int, bytes], list[int]] = {}  # bucket, anchor offset, bytes -> runs, smallest document first
    of_bucket = (block.keys[block.of_run[runs]] >> np.uint64(32)).astype(np.int64)
    for i, (b, a, x, y) in enumerate(zip(of_bucket.tolist(), offset.tolist(), low.tolist(), stop.tolist())):
        found.setdefault((b, a, data[x:y]), []).append(i)
    by_bucket: dict[int, list] = {}
    for (b, a, text), places in found.items():
        by_bucket.setdefault(b, []).append((a, text, places))
    doc = block.doc[runs]
    start = low - block.starts[doc]
    rows = []
    for b, entries in by_bucket.items():
        every = np.array([i for _, _, places in entries for i in places])
        owner = np.array([block.ids[doc[p[0]]] for _, _, p in entries], np.int64)
        n_places = np.array([len(p) for _, _, p in entries], np.uint32)
        later = block.ids[doc[every]] > np.repeat(owner, n_places)
        rows.append((
            b, int(docs["block"].iloc[0]), b"".join(t for _, t, _ in entries), np.array([len(t) for _, t, _ in entries], np.uint8).tobytes(),
            np.array([a for a, _, _ in entries], np.uint8).tobytes(), owner.tobytes(), n_places.tobytes(),
            (doc[every].astype(np.uint32) | later.astype(np.uint32) << np.uint32(31)).tobytes(), start[every].astype(np.uint32).tobytes(),
        ))
    return pd.DataFrame(rows, columns=columns)


def lost_by_owners(texts: list[bytes], anchor: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each stretch's own smallest document must lose of it: number of the stretch, from and to, in that order.

    One transform holds all stretches of its anchors, as equal windows have equal anchors.
    """
    order = np.argsort(anchor, kind="stable")
    sizes = np.array([len(t) + 1 for t in texts])[order]
    begins = np.cumsum(sizes) - sizes
    _, first, of = np.unique(anchor[order], return_index=True, return_inverse=True)
    piece = begins[first][of] // PIECE
    which, low, high = [], [], []
    for numbers in np.split(order, np.flatnonzero(np.diff(piece)) + 1):
        windows, least_id = least_owners([texts[i] for i in numbers.tolist()], owner[numbers], LEAST)
        lost = least_id < np.repeat(owner[numbers], windows)
        ends = np.cumsum(windows)  # a stretch has LEAST bytes at least, so one window
        opens, closes = lost.copy(), lost.copy()
        opens[1:] &= ~lost[:-1]
        closes[:-1] &= ~lost[1:]
        opens[ends[:-1]] = lost[ends[:-1]]
        closes[ends - 1] = lost[ends - 1]
        at = np.flatnonzero(opens)
        stretch = np.searchsorted(ends, at, "right")
        base = ends[stretch] - windows[stretch]
        which.append(numbers[stretch])
        low.append(at - base)
        high.append(np.flatnonzero(closes) - base + LEAST)
    which, low, high = (np.concatenate(x) for x in (which, low, high))
    order = np.argsort(which, kind="stable")
    return which[order], low[order], high[order]


def find_cuts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bytes to cut at the places of a bucket's stretches, by block.

    The transform holds each distinct stretch once, with its smallest document. Where an interval
    has a smaller document than that, its window goes there too; in other documents, all go.
    """
    number: dict[bytes, int] = {}
    anchors: dict[bytes, int] = {}
    of_anchor, of = [], []
    for r in pdf.itertuples():
        at = 0
        for n, a in zip(np.frombuffer(r.length, np.uint8).tolist(), np.frombuffer(r.anchor, np.uint8).tolist()):
            text = r.data[at : at + n]
            at += n
            k = number.setdefault(text, len(number))
            if k == len(of_anchor):
                of_anchor.append(anchors.setdefault(text[a : a + ANCHOR], len(anchors)))
            of.append(k)
    of, owners = np.array(of, np.int64), np.concatenate([np.frombuffer(x, np.int64) for x in pdf["owner"]])
    owner = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(owner, of, owners)
    texts = list(number)
    which, low, high = lost_by_owners(texts, np.array(of_anchor), owner)
    n_lost = np.bincount(which, minlength=len(texts))
    first_lost, length = np.cumsum(n_lost) - n_lost, np.array([len(t) for t in texts])
    rows, at = [], 0
    for r in pdf.itertuples():
        marked = np.frombuffer(r.doc, np.uint32)  # the top bit marks places of other documents than the owner
        doc, start, n_places = marked & np.uint32(0x7FFFFFFF), np.frombuffer(r.start, np.uint32), np.frombuffer(r.n_places, np.uint32)
        k = of[at : at + len(n_places)]
        whole = marked >> np.uint32(31) > 0
        whole |= np.repeat(owners[at : at + len(k)] > owner[k], n_places)
        at += len(k)
        k = np.repeat(k, n_places)
        rest = np.flatnonzero(~whole)
        n = n_lost[k[rest]]
        lost = np.repeat(first_lost[k[rest]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rest = np.repeat(rest, n)
        d = np.concatenate([doc[whole], doc[rest]])
        x = np.concatenate([start[whole], start[rest] + low[lost]])
        y = np.concatenate([start[whole] + length[k[whole]], start[rest] + high[lost]])
        if len(d):
            rows.append((r.block, d.tobytes(), x.astype(np.uint32).tobytes(), y.astype(np.uint32).tobytes()))
    return pd.DataFrame(rows, columns=["block", "doc", "start", "stop"])


def apply_cuts(docs: pd.DataFrame, cuts: pd.DataFrame, kept_text: bool) -> pd.DataFrame:
    columns = [c.split()[0] for c in RESULT.split(", ")]
    if len(docs) == 0:
        return pd.DataFrame(columns=columns)
    block = Block(docs, 1)
    covered = np.zeros(int(block.ends[-1]) + 1, np.int32)
    for d, x, y in zip(cuts["doc"], cuts["start"], cuts["stop"]):
        base = block.starts[np.frombuffer(d, np.uint32)]
        np.add.at(covered, base + np.frombuffer(x, np.uint32), 1)
        np.add.at(covered, base + np.frombuffer(y, np.uint32), -1)
    gone = np.cumsum(covered)[:-1] > 0
    rows = []
    for doc_id, text, x, y in zip(block.ids, block.texts, block.starts, block.ends):
        cut = gone[x:y]
        n = int(cut.sum())
        kept = np.frombuffer(text, np.uint8)[~cut].tobytes() if n else text
        spans = int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1))
        rows.append((int(doc_id), len(text), n, spans, hashlib.sha256(kept).hexdigest(), kept if kept_text else None))
    return pd.DataFrame(rows, columns=columns)


def cut_repeats(docs: DataFrame, *, kept_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes), one row per row of docs.

    A byte goes if a 50-byte string covering it also starts in a document of smaller doc_id.
    Null texts are empty. Texts under 50 bytes stay. Rows of equal doc_id don't cut each other
    but are cut alike by smaller ones. Rows without doc_id stay whole and cut nothing. Cuts may
    split a character, so the rest is bytes. Other columns of docs are not read. An empty table
    gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = total_bytes(rows)
    n_blocks, buckets = parts_for(size, BLOCK_BYTES), parts_for(size, BUCKET_BYTES)
    blocks = rows.filter("doc_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
    anchors = blocks.groupBy("block").applyInPandas(lambda pdf: send_anchors(pdf, buckets), ANCHORS)
    shared = anchors.groupBy("bucket").applyInPandas(find_shared, SHARED)
    by_block = blocks.groupBy("block")
    stretches = by_block.cogroup(shared.groupBy("block")).applyInPandas(lambda a, b: send_stretches(a, b, buckets), STRETCHES)
    cuts = stretches.groupBy("bucket").applyInPandas(find_cuts, CUTS)
    out = by_block.cogroup(cuts.groupBy("block")).applyInPandas(lambda a, b: apply_cuts(a, b, kept_text), RESULT)
    data = F.encode("text", "UTF-8")
    loose = rows.filter("doc_id IS NULL").select(
        "doc_id", text_bytes(F.col("text")).alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(data, 256).alias("kept_sha256"), (data if kept_text else F.lit(None).cast("binary")).alias("kept"),
    )
    return out.unionByName(loose)


def op10_bwt(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs.select("doc_id", "text"), kept_text=False).drop("kept")


OP10_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, j, substr(x, 512 * j + 1, 610) AS y FROM (SELECT doc_id, x, unnest(generate_series(0, (length(x) // 2 - 1) // 256)) AS j FROM h)),
g AS (SELECT doc_id, 256 * j + q AS p, substr(y, 2 * q + 1, 100) AS s FROM (SELECT doc_id, j, y, unnest(generate_series(0, least(255, length(y) // 2 - 50))) AS q FROM k)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS low FROM g) WHERE low < doc_id),
b AS (SELECT doc_id, 256 * j + q AS p, substr(y, 2 * q + 1, 2) AS byte FROM (SELECT doc_id, j, y, unnest(generate_series(0, least(255, length(y) // 2 - 1))) AS q FROM k)),
c AS (SELECT b.doc_id, b.p, byte,
        coalesce(b.p - max(f.p) OVER (PARTITION BY b.doc_id ORDER BY b.p) < 50, false) AS gone FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.p = b.p),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT h.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id)
"""
