"""Near-duplicate groups of documents by b-bit MinHash.

1. One pass over the texts gives each document's shingle set, of which are kept: its size,
   a 128-bit key (equal sets have equal keys), 42 band keys over 5 minima each, and the
   packed signature: the low two bits of each of the 210 minima.
2. Documents of equal sets are one class, represented by the smallest doc_id.
3. Classes that share a band key are candidates. Each class is first paired with the smallest
   of its buckets' smallest classes (hubs), then with those hubs that are in another component,
   never all with all.
4. Bit counts of the packed signatures estimate the similarity of a pair, corrected for
   chance agreement of low bits; pairs far below the threshold are left out (4.5 standard
   errors, so a true link is lost with a chance of about 1e-6).
5. The rest is confirmed on full shingle sets, and links are joined into components.
6. Classes of buckets that now hold more than one component are searched once more for links
   between components. Two sets as alike as asked share one of the rarest shingles of each
   (as many as may be missing from the other, and one), so only classes that share such a
   shingle meet: edited copies differ in rare shingles, and pairs below the threshold hardly
   ever do. No such link is lost. Classes of one component don't meet.

At a similarity of exactly 0.75 the bands miss a pair with a chance of 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.llm.common import release, small_batches, written
from locus.llm.components import components
from locus.llm.shingles import MIX, WordHashes, mixed, shingle_set

BANDS, ROWS, BITS, PERCENT, SLACK = 42, 5, 2, 75, 0.17
MINIMA = BANDS * ROWS
PER_LONG = 64 // BITS
#: Sizes within this ratio share a bin where rare shingles are looked up.
SIZE_STEP = 1.03
#: Pairs of one class that are confirmed in one task at most.
PAIRS_PER_SALT = 128
#: Ids that may be broadcast to pick rows, 8 bytes each; above, a shuffled join picks them.
BROADCAST_IDS = 1_000_000


def multipliers(n: int = MINIMA, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray], by: np.ndarray) -> np.ndarray:
    """The MINIMA minima of each non-empty set, taken over all sets of a chunk at once."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = np.concatenate(sets)
    return np.stack([np.minimum.reduceat(every * a, starts) for a in by], axis=1)


def packed(low: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, PER_LONG to a long."""
    bits = (low >> np.uint64(20)) & np.uint64((1 << BITS) - 1)
    longs = -(-low.shape[1] // PER_LONG)
    bits = np.concatenate([bits, np.zeros((len(bits), longs * PER_LONG - low.shape[1]), np.uint64)], axis=1)
    at = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(bits.reshape(len(bits), longs, PER_LONG) << at, axis=2)


def band_keys(low: np.ndarray) -> np.ndarray:
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * MIX, (len(low), BANDS))
    for i in range(ROWS):
        out = mixed(out + low[:, i::ROWS])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, bands and bits; key, bands and bits are null for an empty set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, by = WordHashes(), multipliers()

        def rows(ids: list, sets: list[np.ndarray]) -> pd.DataFrame:
            full = [s for s in sets if len(s)]
            low = minima(full, by) if full else np.empty((0, MINIMA), np.uint64)
            bands, bits = iter(band_keys(low).view(np.int64)), iter(packed(low).view(np.int64))
            return pd.DataFrame({
                "doc_id": pd.array(ids, "Int64"),
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "bands": [next(bands) if len(s) else None for s in sets],
                "bits": [next(bits) if len(s) else None for s in sets],
            })

        for batch in batches:
            ids, sets, n = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                sets.append(shingle_set(text, known))
                n += len(sets[-1])
                if n > 65_536:
                    yield rows(ids, sets)
                    ids, sets, n = [], [], 0
            if ids:
                yield rows(ids, sets)
            ids, sets = [], []
            release()

    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(sign, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n and grams, the sorted distinct shingles, for documents with words."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, known) for t in batch["text"]]
            full = [(int(i), len(s), s.view(np.int64)) for i, s in zip(batch["doc_id"], sets) if len(s)]
            yield pd.DataFrame(full, columns=["doc_id", "n", "grams"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(find, "doc_id long, n long, grams array<long>")


def estimate(x: Column, y: Column, n_minima: int = MINIMA) -> Column:
    """Similarity from two packed signatures: agreeing minima by bit count, less chance agreement."""
    apart = F.lit(0)
    low_of_each = sum(1 << (BITS * i) for i in range(PER_LONG))
    low_of_each = low_of_each - (1 << 64) if low_of_each >= 1 << 63 else low_of_each
    for i in range(-(-n_minima // PER_LONG)):
        diff = x[i].bitwiseXOR(y[i])
        some = diff
        for j in range(1, BITS):
            some = some.bitwiseOR(F.shiftrightunsigned(diff, j))
        apart = apart + F.bit_count(some.bitwiseAND(F.lit(low_of_each)))
    chance = 1 / (1 << BITS)
    return (1 - apart / F.lit(n_minima) - chance) / (1 - chance)


def pick(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids: by broadcast if they are few, else by a shuffled semi join."""
    ids = written(ids.distinct().toDF(key), "ids")
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs(a, b) whose full shingle sets are similar enough, texts read again for these documents only.

    A document of many pairs is dealt over tasks by a salt, its text sent to each.
    """
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    texts = pick(docs.select("doc_id", "text"), ends, "doc_id").withColumn("_h", F.xxhash64("text"))
    texts = texts.repartition("doc_id").dropDuplicates(["doc_id", "_h"]).drop("_h")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_SALT).alias("_n"))
    left = salts.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    dealt = pairs.join(salts, "a").withColumn("_s", F.pmod(F.xxhash64("b"), F.col("_n"))).select("a", "_s", "b")
    right = dealt.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    both = right.join(left.select("a", "_s", "text_a"), ["a", "_s"]).select("a", "b", "text_a", "text_b")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, last, of_last = WordHashes(), None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch["text_a"], batch["text_b"]):
                if text_a != last:  # rows come sorted by a after a merge join
                    last, of_last = text_a, shingle_set(text_a, known)
                other = shingle_set(text_b, known)
                common = len(np.intersect1d(of_last, other, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(of_last) + len(other) - common) > 0)
            yield batch.loc[keep, ["a", "b"]]

    return both.mapInPandas(confirm, "a long, b long")


def plausible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    with_bits = pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    return with_bits.filter(estimate(F.col("bits_a"), F.col("bits_b")) >= PERCENT / 100 - SLACK).select("a", "b").distinct()


def needed(n: Column, m: Column) -> Column:
    """Shingles that sets of n and m must share: at least PERCENT of their union."""
    return F.ceil(F.lit(PERCENT) * (n + m) / (100 + PERCENT) - F.lit(1e-9))


def rare_partners(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets(doc_id, component, n, grams) of different components that may be similar enough.

    A shingle's rank in a set counts those that fewer sets hold, or as many of smaller hash. The
    first shared shingle of a similar pair stands at rank n - needed at most in both. The smaller
    set offers the ranks that hold for a set of its own size, the larger asks for each bin of sizes.
    """
    grams = sets.select("doc_id", "component", "n", F.monotonically_increasing_id().alias("_set"), "grams")
    grams = written(grams, "shingle-sets")
    long = grams.select("_set", F.explode("grams").alias("g"))
    held = written(long.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-shingles")
    shared = long.join(held, "g").groupBy("_set").agg(F.sort_array(F.collect_list(F.struct("df", "g")))["g"].alias("shared"))
    rows = grams.drop("grams").join(shared, "_set").withColumn("m", F.size("shared").cast("long")).filter(100 * F.col("m") >= PERCENT * F.col("n"))
    rows = rows.withColumn("alone", F.col("n") - F.col("m"))
    size_bin = lambda c: F.floor(F.log(c.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
    least = F.ceil(F.lit(PERCENT) * F.col("n") / 100)
    rows = written(rows.drop("_set"), "rare-shingles")

    def ranked(df: DataFrame, last: Column) -> DataFrame:
        """One row per shared shingle at a rank of `last` at most."""
        first = F.slice("shared", F.lit(1), F.greatest(F.lit(0), last - F.col("alone") + 1).cast("int"))
        out = df.select("doc_id", "component", "n", "m", "alone", "bin", F.posexplode(first).alias("_i", "g"))
        return out.select("bin", "g", "doc_id", "component", "n", "m", (F.col("_i") + F.col("alone")).alias("rank"))

    own = rows.withColumn("bin", size_bin(F.col("n")))
    offers = written(ranked(own, F.col("n") - needed(F.col("n"), F.col("n"))), "offers")
    below = rows.withColumn("bin", F.explode(F.sequence(size_bin(least), size_bin(F.col("n")))))
    smallest = F.greatest(least, F.floor(F.pow(F.lit(SIZE_STEP), F.col("bin")) - 1e-6))
    asks = written(ranked(below, F.col("n") - needed(smallest, F.col("n"))), "asks")
    # Where most rows of a key are of one component, they needn't meet each other.
    by = ["bin", "g", "component"]
    count = offers.groupBy(*by).agg(F.count(F.lit(1)).alias("o"), F.lit(0).cast("long").alias("q")).union(asks.groupBy(*by).agg(F.lit(0).cast("long"), F.count(F.lit(1))))
    count = count.groupBy(*by).agg(F.sum("o").alias("o"), F.sum("q").alias("q"))
    keys = count.groupBy("bin", "g").agg(F.max_by("component", F.struct(F.col("o") + F.col("q"), "component")).alias("home"), F.sum("o").alias("o"), F.sum("q").alias("q"), F.min("component").alias("_c"), F.max("component").alias("_d"))
    keys = written(keys.filter("_c <> _d AND o > 0 AND q > 0").select("bin", "g", "home"), "keys")
    offers, asks = (written(df.join(keys, ["bin", "g"]), "met").withColumn("out", F.col("component") != F.col("home")) for df in (offers, asks))
    sides = [(offers.filter("out"), asks), (offers.filter("NOT out"), asks.filter("out"))]
    found = None
    for x, y in ((x.alias("x"), y.alias("y")) for x, y in sides):
        both = needed(F.col("x.n"), F.col("y.n"))
        may = (
            (F.col("x.bin") == F.col("y.bin")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.component") != F.col("y.component"))
            & (F.col("x.n") <= F.col("y.n")) & (F.col("x.rank") <= F.col("x.n") - both) & (F.col("y.rank") <= F.col("y.n") - both) & (F.least("x.m", "y.m") >= both)
        )
        pairs = x.join(y, may).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
        found = pairs if found is None else found.union(pairs)
    return found.distinct()


def place(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The bucket members with their components; a class without links is its own."""
    of = groups.select(F.col("member").alias("doc_id"), "component")
    return members.join(of, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of docs(doc_id, text).

    A text without words, or null, has an empty set and links with nothing. Rows of equal
    doc_id are one document for linking and share a component, each with a row of its own.
    A row without doc_id links with nothing: its component_id is null and it is kept.
    An empty table gives no rows. Other columns of docs are not read.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    sigs = written(signatures(docs), "signatures")
    key = F.coalesce("set_key", F.lit(b""))
    several = sigs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).filter("_a <> _b")
    return _linked(docs, sigs) if several.isEmpty() else _by_rows(docs, sigs)


def _by_rows(docs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Where a doc_id has several texts: rows are linked under numbers of their own, then through their doc_ids."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("_id"), "text").filter("_id IS NOT NULL").withColumn("_row", F.monotonically_increasing_id()), "rows")
    own = rows.select(F.col("_row").alias("doc_id"), "text")
    found = _linked(own, written(signatures(own), "signatures")).select(F.col("doc_id").alias("_row"), "n_shingles", F.col("component_id").alias("_of"))
    found = written(found.join(rows.select("_row", "_id"), "_row"), "row-groups")
    first = found.groupBy("_id").agg(F.min("_row").alias("a"))
    same_id = found.join(first, "_id").select("a", F.col("_row").alias("b"))
    groups = components(found.select(F.col("_of").alias("a"), F.col("_row").alias("b")).union(same_id).filter("a <> b"))
    of = found.join(groups, found["_row"] == groups["member"], "left").withColumn("_group", F.coalesce("component", "_row"))
    least = of.groupBy("_group").agg(F.min("_id").alias("component_id"))
    linked = of.join(least, "_group").select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))
    alone = sigs.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def _linked(docs: DataFrame, sigs: DataFrame) -> DataFrame:
    linked = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    one = linked.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands", "bits")).alias("one"))
    reps = written(one.select("set_key", "one.*"), "classes")
    classes = reps.select("set_key", F.col("doc_id").alias("rep"))
    bits = reps.select("doc_id", "bits")
    keyed = reps.select(F.explode("bands").alias("key"), "doc_id")
    hubs = keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("_far")).filter("hub <> _far").select("key", "hub")
    hubs = written(hubs, "hubs")  # a plain table, so that the join below can split a large bucket
    members = written(keyed.join(hubs, "key"), "buckets")

    # First each class with the smallest of its hubs, then with hubs of other components.
    tried = written(members.filter("hub <> doc_id").groupBy("doc_id").agg(F.min("hub").alias("a")).select("a", F.col("doc_id").alias("b")), "star")
    links = written(confirmed(docs, plausible(tried, bits)), "confirmed")
    groups = components(links)
    placed = written(place(members, groups), "placed")
    of_hub = placed.filter("doc_id = hub").select("key", F.col("component").alias("_of_hub")).distinct()
    star = placed.filter("doc_id <> hub").join(of_hub, "key").filter("component <> _of_hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = written(star.join(tried, ["a", "b"], "left_anti"), "star")
    more = written(confirmed(docs, plausible(star, bits)), "confirmed")
    tried = tried.union(star)
    if not more.isEmpty():
        links = links.union(more)
        groups = components(links)
        placed = written(place(members, groups), "placed")

    mixed_keys = placed.groupBy("key").agg(F.min("component").alias("_c"), F.max("component").alias("_d")).filter("_c <> _d").select("key")
    open_ones = written(placed.join(mixed_keys, "key").select("doc_id", "component").distinct(), "open")
    sets = shingle_sets(pick(docs.select("doc_id", "text"), open_ones.select("doc_id"), "doc_id"))
    rest = written(rare_partners(open_ones.join(sets, "doc_id")).join(tried, ["a", "b"], "left_anti"), "rest")
    more = written(confirmed(docs, plausible(rest, bits)), "confirmed")
    if not more.isEmpty():
        groups = components(links.union(more))

    thin = sigs.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    thin = thin.withColumn("rep", F.least(F.coalesce("rep", "doc_id"), F.col("doc_id")))
    by_id = groups.select(F.col("member").alias("rep"), "component")
    out = thin.join(by_id, "rep", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id; rows without doc_id stay. All columns are kept.

    Of several rows with that doc_id the first in the order of their texts stays.
    """
    keep = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id")).distinct()
    ties = [c for c, kind in docs.dtypes if c != "text" and "map<" not in kind and "variant" not in kind]
    found = docs.join(keep, docs["doc_id"] == F.col("_kept_id"))
    once = found.withColumn("_nth", F.row_number().over(W.partitionBy("_kept_id").orderBy("text", *ties))).filter("_nth = 1")
    return once.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
