import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locus.llm import hilbert, mixing

SCHEMA = "doc_id long, text string, lang string, source string, shard string, copy string"


def rows(spark, n=300):
    data = [(i, "x" * (i % 37) if i % 11 else None, ["en", "de", None][i % 3], "big" if i % 3 else f"s{i % 7}", "own", "own") for i in range(n)]
    data += [(5, "twice", "en", "big", "own", "own")] * 2 + [(None, "lost", None, None, "own", "own")]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_curve_visits_every_cell_once_and_steps_to_neighbours(spark, bits):
    side = 1 << bits
    cells = spark.range(side**3).select(*[(F.floor(F.col("id") / side**i) % side).cast("int").alias(f"c{i}") for i in range(3)])
    got = sorted(hilbert.with_hilbert_index(cells, ["c0", "c1", "c2"], bits, "h").collect(), key=lambda r: r["h"])
    assert [r["h"] for r in got] == list(range(side**3))
    for a, b in zip(got, got[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(3)) == 1


@pytest.mark.parametrize("n_shards", [1, 7, 24, 1000])
def test_shards_are_even_gapless_and_whole(spark, n_shards):
    df = rows(spark)
    got = hilbert.shard_documents(df.drop("copy"), n_shards).collect()
    assert len(got) == 303
    by = Counter(r["shard"] for r in got)
    counts = [by.get(s, 0) for s in range(n_shards)]
    assert set(by) <= set(range(n_shards)) and max(counts) - min(counts) <= 1
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s]))
    for r in got:
        text = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)


def test_shards_do_not_depend_on_partitions(spark):
    df = rows(spark).filter("doc_id <> 5")
    a, b = (sorted(map(tuple, hilbert.op1_hilbert(x).collect()), key=str) for x in (df.repartition(1), df.repartition(7)))
    assert a == b


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hilbert.op1_hilbert(empty).count() == 0
    assert mixing.op7_poisson(empty).count() == 0


def test_equal_values_in_all_dimensions(spark):
    df = spark.createDataFrame([(i, "a", "en", "s", "", "") for i in range(50)], SCHEMA)
    assert sorted(Counter(r["shard"] for r in hilbert.op1_hilbert(df).collect()).values()) == [2] * 22 + [3] * 2


def brute_mix(data, seed=mixing.SEED):
    import hashlib

    size = Counter()
    for i, text, source in data:
        size[source] += len((text or "").encode()) + 8
    total = sum(size.values())

    def u(i, j):
        return int(hashlib.md5(f"{seed}:{'null' if i is None else i}:{j}".encode()).hexdigest()[:13], 16) / 2**52

    out = Counter()
    for i, text, source in data:
        rate = total / len(size) / size[source]
        parts = max(1, math.ceil(rate / mixing.PART))
        n = 0
        for j in range(1, parts + 1):
            p = cdf = math.exp(-rate / parts)
            k = 0
            while cdf <= u(i, j):
                k += 1
                p *= rate / parts / k
                cdf += p
            n += k
        for c in range(n):
            out[(i, source, c)] += 1
    return out


def test_mix_equals_brute_force_and_is_in_order(spark):
    df = rows(spark)
    got = mixing.poisson_mix(df)
    assert set(got.columns) == set(df.columns) | {"rate", "mix_key"}
    found = got.collect()
    assert Counter((r["doc_id"], r["source"], r["copy"]) for r in found) == brute_mix([(r["doc_id"], r["text"], r["source"]) for r in df.collect()])
    assert [r["mix_key"] for r in found] == sorted(r["mix_key"] for r in found)


def test_high_rates_are_not_capped(spark):
    data = [(i, "x" * 100_000, "big") for i in range(20)] + [(100, "", "tiny")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["source"], r["copy"]) for r in mixing.poisson_mix(df).select("doc_id", "source", "copy").collect())
    assert got == brute_mix(data)
    assert sum(1 for k in got if k[1] == "tiny") > 10_000


def test_weights(spark):
    data = [(i, "x" * 92, "a" if i % 10 else "b") for i in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    n = Counter(r["source"] for r in mixing.poisson_mix(df, weights={"a": 1, "b": 3}).collect())
    assert abs(n["b"] / (n["a"] + n["b"]) - 0.75) < 0.03 and abs(sum(n.values()) - 4000) < 300
    assert {r["source"] for r in mixing.poisson_mix(df, weights={"a": 1}).collect()} == {"a"}


def test_strings_with_a_long_common_beginning_are_told_apart(spark):
    names = [f"https://example.org/common_crawl_{y}" for y in range(2015, 2023)]
    df = spark.createDataFrame([(i, "x" * 5, "en", names[i % 8], "", "") for i in range(400)], SCHEMA)
    of = {n: {r["hilbert"] for r in hilbert.shard_documents(df.drop("copy"), 8).collect() if r["source"] == n} for n in names}
    assert all(not of[a] & of[b] for a in names for b in names if a < b)
    shards = {n: {r["shard"] for r in hilbert.shard_documents(df.drop("copy"), 8).collect() if r["source"] == n} for n in names}
    assert all(len(s) == 1 for s in shards.values())  # a reader of one source opens one file of eight


def test_rows_follow_the_curve_within_and_across_shards(spark):
    got = hilbert.shard_documents(rows(spark).drop("copy"), 7).orderBy("shard", "slot").select("hilbert").collect()
    along = [r["hilbert"] for r in got]
    assert along == sorted(along) and len(set(along)) > 20


def test_clashing_columns_of_sharding_are_replaced_and_of_mixing_kept(spark):
    df = spark.createDataFrame([(i, "text", "en", "s", "own", "own", "own", "own") for i in range(60)], "doc_id long, text string, lang string, source string, size string, law string, copy string, rate string")
    assert {(r["size"], r["law"], r["copy"], r["rate"]) for r in hilbert.shard_documents(df, 3).collect()} == {(12, "rows", "own", "own")}
    got = mixing.repeated_documents(df)
    assert got.columns == df.columns and {(r["size"], r["law"], r["copy"], r["rate"]) for r in got.collect()} == {("own",) * 4}
