"""WARC archives of gzip records, written and read by Spark: the index first, then coalesced range reads.

Writing. Digests and record types follow from thin columns; payloads are shuffled once, to
their archive, where a task writes one file of gzip members, one a record, and returns the
index rows (archive, path, offset, length, URL, digest, type). A file has a name of its own in
every attempt, and only the rows of the attempt that Spark commits are in the index, so a lost
executor leaves at most a file that nothing refers to.

Reading. The index rows that are asked for are sorted by offset and neighbours are
coalesced into byte ranges of about RANGE bytes; each range is one seek and read.

Payload-identical records: the one with the largest page_id is a response, the others
are revisits of it without a payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.llm.common import create_shared, open_shared, parts_for, shared_dir, text_bytes, total_bytes, written

ARCHIVE, RANGE, GAP = 32 << 20, 4 << 20, 64 << 10
#: The digits of conv() in base 32, and those of RFC 4648.
CONV32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The WARC version line, date and revisit profile of the written records.
VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bytes are four groups of 40 bits, eight digits each."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), CONV32, RFC32)


INDEX = "page_id long, url string, archive int, path string, offset long, length long, payload_digest string, record_type string, refers_to long"


def record_bytes(page: int | None, url: str | None, digest: str, kind: str, refers: int | None, payload: bytes) -> bytes:
    """One WARC record; a revisit has the HTTP header of the payload, but not the payload."""

    def name(x: int | None) -> str:
        return f"<urn:page:{'null' if x is None else x}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {url}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers)}"] if kind == "revisit" else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def whole(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def write_warc(pages: DataFrame, root: str, *, url_col: str = "url", body_col: str = "html", archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes pages(page_id, url, html) as archives below root and returns the index.

    Index: page_id, url, archive (int), path, offset, length, payload_digest, record_type,
    refers_to. A null body is an empty payload; a null url leaves its header out, and blanks
    or control characters in a url are written as %20. Every row becomes one record, repeated
    rows too: if the largest page_id of equal payloads is repeated, each of its rows is a
    response. A null page_id counts as smaller than any. An empty table gives an empty index.
    """
    n = parts_for(total_bytes(pages, body_col) + 1, archive_bytes)
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "%20").alias("_url"),
        F.coalesce(F.col(body_col), F.lit("")).alias("_body"),
    ).withColumns({
        "_digest": sha1_base32(F.encode("_body", "UTF-8")),
        "_size": text_bytes(F.col("_body")),
    }).withColumn("_archive", F.pmod(F.xxhash64("page_id", "_digest"), F.lit(n)).cast("int"))
    thin = rows.select("_archive", "page_id", "_digest", "_size")
    first = thin.groupBy("_digest", "_size").agg(F.max("page_id").alias("_last"))
    kind = F.when(F.col("page_id").eqNullSafe(F.col("_last")), F.lit("response")).otherwise(F.lit("revisit"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    none = F.lit(None).cast("string")
    decided = thin.join(first, ["_digest", "_size"]).select(
        "_archive", "page_id", "_digest", none.alias("_url"), kind.alias("_kind"), refers.alias("_refers"), none.alias("_body"), F.lit(0).alias("_late")
    )
    bodies = rows.select("_archive", "page_id", "_digest", "_url", none.alias("_kind"), F.lit(None).cast("long").alias("_refers"), "_body", F.lit(1).alias("_late"))
    # One shuffle of payloads: decisions and rows meet in their archive, decisions first.
    key = ["_archive", "page_id", "_digest"]
    both = decided.dropDuplicates(key).unionByName(bodies).repartition(n, "_archive").sortWithinPartitions(*key, "_late", "_url")
    here = W.partitionBy(*key).orderBy("_late", "_url").rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumns({c: F.first(c).over(here) for c in ("_kind", "_refers")}).filter("_late = 1").drop("_late")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, path, out, at = None, "", None, 0
        try:
            for batch in batches:
                index = []
                for a, page, digest, url, kind, refers, body in zip(*(batch[c] for c in ("_archive", "page_id", "_digest", "_url", "_kind", "_refers", "_body"))):
                    if a != archive:
                        if out is not None:
                            out.close()
                        archive, at = a, 0
                        path = f"{root}/{a:05d}-{uuid.uuid4().hex}.warc.gz"
                        out = create_shared(path)
                    page, refers, url = whole(page), whole(refers), url if isinstance(url, str) else None
                    data = gzip.compress(record_bytes(page, url, digest, kind, refers, body.encode("utf-8", "surrogatepass")), 6, mtime=0)
                    out.write(data)
                    index.append((page, url, a, path, at, len(data), digest, kind, refers))
                    at += len(data)
                table = pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield table.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return written(filled.mapInPandas(write, INDEX), "warc-index")


def byte_ranges(index: DataFrame, *, most: int = RANGE, gap: int = GAP) -> DataFrame:
    """Coalesces index rows into ranges: path, first, last and the sorted (offset, length) list.

    A range ends where the next record starts more than `gap` bytes on or lies in the next
    block of `most` bytes, so that one list is bounded by the bytes of one block.
    """
    order = W.partitionBy("path").orderBy("offset")
    end = F.col("offset") + F.col("length")
    block = F.floor(F.col("offset") / most)
    start = F.coalesce((F.col("offset") - F.lag(end).over(order) > gap) | (block != F.lag(block).over(order)), F.lit(True))
    runs = index.select("path", "offset", "length").distinct().withColumn("_new", start.cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy("path", "_run").agg(
        F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("last"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")
    )


def parse_record(data: bytes) -> tuple:
    """page_id, payload bytes, digest, type, refers_to, payload of one record; a revisit has no payload."""
    data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def page(name: bytes) -> int | None:
        found = re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(name, b""))
        return int(found[1]) if found else None

    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    kind = fields[b"WARC-Type"].decode()
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response":
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"payload of page {page(b'WARC-Record-ID')} has digest {found}, not {digest}")
    return page(b"WARC-Record-ID"), size, digest, kind, page(b"WARC-Refers-To"), payload


def read_warc(index: DataFrame, *, payload: bool = True, most: int = RANGE, gap: int = GAP) -> DataFrame:
    """Reads the records of an index (or of a selection of its rows) from their archives.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for,
    payload (binary; null for revisits). A payload that differs from its digest is an error.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first, last, records in zip(batch["path"], batch["first"], batch["last"], batch["records"]):
                with open_shared(path) as f:
                    f.seek(first)
                    data = f.read(last - first)
                found = [parse_record(data[r["offset"] - first : r["offset"] - first + r["length"]]) for r in records]
                out = pd.DataFrame(found, columns=names)
                out = out.astype({"page_id": "Int64", "refers_to": "Int64"})
                if payload:
                    out["payload"] = out["payload"].where(out["record_type"] == "response", None)
                yield out if payload else out.drop(columns="payload")

    ranges = byte_ranges(index, most=most, gap=gap)
    return ranges.select("path", "first", "last", "records").mapInPandas(read, schema)


def op3_warc(pages: DataFrame) -> DataFrame:
    root = shared_dir(pages.sparkSession, "warc")
    index = write_warc(pages.select("page_id", "url", "html"), root)
    return read_warc(index, payload=False)


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(body) AS n, max(page_id) OVER (PARTITION BY h) AS last, array_to_string(list_transform(generate_series(0, 31),
  lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '') AS digest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM d
"""
