import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locus.llm import vafile, warc
from locus.llm.common import open_shared, shared_dir

PAGES = "page_id long, url string, html string, offset string, archive string"


def pages(spark):
    data = [(i, f"http://h/{i % 9} a\n", f"<p>{i % 13}\r\n\r\n é</p>" * (i % 5), "own", "own") for i in range(120)]
    data += [(200, None, None, "own", "own"), (201, None, "", "own", "own"), (7, "u", "<p>7</p>", "own", "own"), (None, "u", "lost", "own", "own"), (300, "u", "long " * 200_000, "own", "own")]
    return spark.createDataFrame(data, PAGES), data


@pytest.mark.parametrize("archive_bytes", [1 << 20, 2000])
def test_round_trip_and_contract(spark, archive_bytes):
    df, data = pages(spark)
    index = warc.write_warc(df, shared_dir(spark, "warc"), archive_bytes=archive_bytes)
    got = warc.read_warc(index, most=4096).collect()
    last = {}
    for i, _, html, *_ in data:
        body = (html or "").encode()
        last[body] = max(last.get(body, -1), -1 if i is None else i)
    want = []
    for i, _, html, *_ in data:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        top = None if last[body] == -1 else last[body]
        want.append((i, len(body), digest, "response" if i == top else "revisit", None if i == top else top, body if i == top else None))
    key = lambda r: str(r)
    assert sorted(map(lambda r: (*r[:5], bytes(r[5]) if r[5] is not None else None), got), key=key) == sorted(want, key=key)


def test_a_selection_reads_only_its_ranges(spark):
    df, _ = pages(spark)
    index = warc.write_warc(df, shared_dir(spark, "warc"))
    some = index.filter("page_id IN (3, 4, 90)")
    assert sorted(r["page_id"] for r in warc.read_warc(some).collect()) == [3, 4, 90]
    assert warc.byte_ranges(some, gap=0).agg(F.sum(F.col("last") - F.col("first"))).first()[0] == some.agg(F.sum("length")).first()[0]


def test_archives_are_plain_gzip_members(spark):
    df, data = pages(spark)
    index = warc.write_warc(df, shared_dir(spark, "warc"))
    for path in {r["path"] for r in index.select("path").collect()}:
        with open_shared(path) as f:
            assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_empty_pages(spark):
    assert warc.op3_warc(spark.createDataFrame([], PAGES)).count() == 0


def brute(data, queries, k=5):
    def ints(v):
        return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * float(np.float32(x)))) for x in v]

    rows = {(i, tuple(v)) for i, v in ((i, ints(v)) for i, v in data) if i is not None and v is not None}
    out = []
    asked = {}
    for i, v in rows:
        if i in queries and (i not in asked or v < asked[i]):
            asked[i] = v
    for q, qv in asked.items():
        found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q and len(v) == len(qv))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def vectors(n, dim=6, seed=1, copies=0):
    rng = random.Random(seed)
    data = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return data + [(1000 + i, data[3][1]) for i in range(copies)]


@pytest.mark.parametrize("block", [4096, 16])
def test_topk_equals_brute_force(spark, block):
    data = vectors(300, copies=90)
    data += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, [1.0, 2.0]), (505, [2.0, 1.0]), (7, data[7][1]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "own") for i, v in data], "vec_id long, embedding array<float>, score string")
    got = vafile.topk(df, df.filter("vec_id % 50 = 0 OR vec_id = 505"), block=block)
    assert sorted(map(tuple, got.collect())) == brute(data, {i for i, _ in data if i is not None and (i % 50 == 0 or i == 505)})


def test_ties_go_to_the_smaller_id(spark):
    data = [(i, [1.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = vafile.topk(df, df.filter("vec_id IN (0, 39)")).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(0, i) for i in range(1, 6)] + [(39, i) for i in range(5)]


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame(vectors(3), "vec_id long, embedding array<float>")
    assert len(vafile.topk(df, df.filter("vec_id = 0")).collect()) == 2
    assert vafile.op2_vafile(df.limit(0)).count() == 0
    assert vafile.op2_vafile(df.limit(1)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    v, q = rng.integers(-300, 300, (200, 7)), rng.integers(-300, 300, (20, 7))
    low, high = vafile.bounds(q, *vafile.approximate(v))
    assert (low <= q @ v.T).all() and (q @ v.T <= high).all()


def test_query_ids_of_several_vectors_and_negative_ids(spark):
    rng = random.Random(4)
    data = [(i // 4, [rng.gauss(0, 1) for _ in range(5)]) for i in range(400)] + [(-i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(1, 60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    asked = {i for i, _ in data if i % 10 == 0}
    got = sorted(map(tuple, vafile.topk(df, df.filter("vec_id % 10 = 0"), block=64).collect()))
    assert got == brute(data, asked)


def test_vectors_without_components(spark):
    df = spark.createDataFrame([(i, []) for i in range(9)] + [(20, [1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vafile.topk(df, df.filter("vec_id = 3")).collect()))
    assert got == [(3, r + 1, i, 0) for r, i in enumerate([0, 1, 2, 4, 5])]
