"""Fuzzy repeated passages by collinear chaining of shared word seeds.

1. Every document's words (A-Z lower-cased) give seeds: minimizers of K-word runs, the run of
   least hash in each W consecutive ones, so any W + K - 1 equal words share a seed. Of one seed
   over and over, as in a word said many times, the first and last place are kept, and if that
   makes a passage by itself, all places together as one seed of its own.
2. A seed that several documents hold is joined with its first holder (smallest doc_id), so
   copies cost rows in proportion. Copies of a whole text are set aside first and joined with
   their first document.
3. Shared seeds that lie in no passage after that are looked for in runs of LEAST_SEEDS seeds
   with at most SKIP - 1 others between two: such a run is joined with its first holder in each
   of FIRSTS parts of the documents, and if its seeds still lie in no passage, with all earlier
   holders. So no passage is lost because its seeds have different first holders, and phrases
   of fewer seeds, however many documents hold them, meet their first holder only.
4. Matches of a pair of documents are chained: positions rise in both, and gaps cost by their
   length. The best chain ending at each match comes from a Fenwick tree of prefix maxima, in
   O(n log n).
5. Good chains are aligned word by word in a band along the chain. Passages of at least
   LEAST_WORDS words and LEAST_IDENTITY of matching words are returned.

Two texts that share fewer than LEAST_SEEDS seeds share no passage. Texts are read again only
for pairs with a chain. Step 3 drops chains, before their texts are read, that hold no seed
that is still looked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locus.llm.common import parts_for, small_batches, written
from locus.llm.minhash import BROADCAST_IDS, pick
from locus.llm.shingles import WordHashes, window_hashes, words

K, W = 6, 12
LEAST_WORDS, LEAST_IDENTITY = 40, 0.75
GAP, REACH, LEAST_SEEDS = 0.1, 60, 3
#: Marks the seeds that stand for one seed said over and over.
SAID_OVER = 0x5BD1E995
#: Parts of the documents whose first holders of a seed are met before all holders are.
FIRSTS, SKIP = 8, 3
#: Pairs of places of one run that two documents meet at before they are matched in turn.
FEW = 64
#: Of a chain's flanks: words off the diagonal, what an alignment may fall below its best score, words looked at in one piece, and bits that count its matches.
BAND, DROP, FLANK, BITS = 6, 6, 2000, 24
#: Chains of one earlier document that are aligned in one task at most.
CHAINS_PER_SALT = 128


def seeds(hashes: np.ndarray) -> np.ndarray:
    """Places of the minimizers: of each W consecutive K-word runs one of least hash.

    Equal runs fewer than W places apart, as in a word said over and over, are thinned to the
    fewest places that leave one in each W.
    """
    return minimizers(window_hashes(hashes, K))


def minimizers(runs: np.ndarray) -> np.ndarray:
    """seeds() of the hashes of all K-word runs."""
    if len(runs) == 0:
        return np.empty(0, np.int64)
    if len(runs) <= W:
        return np.array([int(runs.argmin())])
    at = np.lib.stride_tricks.sliding_window_view(runs, W).argmin(axis=1) + np.arange(len(runs) - W + 1)
    at = at[np.append(True, at[1:] != at[:-1])]  # they never fall
    ties = (runs[at[1:]] == runs[at[:-1]]) & (np.diff(at) < W)
    if not ties.any():
        return at
    out = []
    for group in np.split(at, np.flatnonzero(~ties) + 1):
        i = 0
        while i < len(group) - 1:
            out.append(group[i])
            i = max(i + 1, int(np.searchsorted(group, group[i] + W, "right")) - 1)
        out.append(group[-1])
    return np.array(out)


class PrefixMax:
    """A Fenwick tree of maxima over prefixes, each with the number of the match that gave it."""

    def __init__(self, n: int):
        self.best = [(-float("inf"), -1)] * (n + 1)

    def update(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def query(self, n: int) -> tuple[float, int]:
        """The best of entries 0 to n - 1."""
        out = (-float("inf"), -1)
        while n > 0:
            if self.best[n] > out:
                out = self.best[n]
            n -= n & -n
        return out


def chain(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Best chains of matches (x, y), each match in one chain at most.

    A match is worth K words; going on from match i to a later j on both axes costs GAP per word
    between them on either axis, a number of j less a number of i. So, visiting matches by x,
    the best predecessor of j is a prefix maximum over smaller y. A chain is cut where a gap is
    longer than REACH words.
    """
    n = len(x)
    if n == 1 or ((x[1:] > x[:-1]).all() and (y[1:] > y[:-1]).all()):
        return _rising(x.tolist(), y.tolist())
    order = np.lexsort((y, x))
    _, at = np.unique(y, return_inverse=True)
    tree = PrefixMax(n)
    score, before = [0.0] * n, [-1] * n
    xs, ys, ranks = x.tolist(), y.tolist(), at.tolist()
    pending: list[int] = []
    for j in order.tolist():
        if pending and xs[j] != xs[pending[-1]]:  # matches of one x do not follow each other
            for i in pending:
                tree.update(ranks[i], (score[i] + GAP * (xs[i] + ys[i]), i))
            pending = []
        best, i = tree.query(ranks[j])
        gain = best - GAP * (xs[j] + ys[j])
        score[j] = float(K)
        if i >= 0 and gain > 0:
            score[j], before[j] = K + gain, i
        pending.append(j)
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda i: -score[i]):
        found = []
        while j >= 0 and not used[j]:
            used[j] = True
            found.append(j)
            j = before[j]
        while found:  # cut where a gap is too long to align
            cut = next((k for k in range(1, len(found)) if max(xs[found[k - 1]] - xs[found[k]], ys[found[k - 1]] - ys[found[k]]) > REACH), len(found))
            out.append(found[:cut][::-1])
            found = found[cut:]
    return out


def _rising(xs: list[int], ys: list[int]) -> list[list[int]]:
    """chain() of matches that rise on both axes: each one's best predecessor is the one before it."""
    out, score = [[0]], float(K)
    for j in range(1, len(xs)):
        dx, dy = xs[j] - xs[j - 1], ys[j] - ys[j - 1]
        gain = score - GAP * (dx + dy)
        score = K + max(gain, 0.0)
        if gain > 0 and max(dx, dy) <= REACH:
            out[-1].append(j)
        else:
            out.append([j])
    return out


def align(a: list[bytes], b: list[bytes], places: list[tuple[int, int]]) -> tuple[int, int, int, int, int]:
    """Extends a chain of matches to both sides and fills its gaps; start and end in a and b, and matching words.

    Between two matches of the chain the words are aligned by edit distance; gaps are at most
    REACH words long, so the band is bounded. Outside, the chain is extended to the best end.
    """
    places = [(x, y) for x, y in places if a[x : x + K] == b[y : y + K]]  # of a doc_id with several texts, or equal hashes
    if not places:
        return 0, 0, 0, 0, 0
    matched, (i, j) = 0, places[0]
    start_a, start_b = i, j
    for x, y in places:
        if x < i or y < j:  # overlaps the part already aligned
            shift = max(i - x, j - y)
            if shift >= K:
                continue
            if (x - i) != (y - j):
                continue
            for s in range(shift, K):
                matched += a[x + s] == b[y + s]
            i, j = x + K, y + K
            continue
        matched += common(a[i:x], b[j:y]) + K
        i, j = x + K, y + K
    for cost in (1, 3):  # a dearer step where the longer flanks would make it no passage
        on_a, on_b, n_on = flank(lambda x, y: (a[i + x : i + x + FLANK], b[j + y : j + y + FLANK]), cost)
        back_a, back_b, n_back = flank(lambda x, y: (before(a, start_a - x), before(b, start_b - y)), cost)
        out = start_a - back_a, i + on_a, start_b - back_b, j + on_b, matched + n_on + n_back
        if out[4] >= LEAST_IDENTITY * max(out[1] - out[0], out[3] - out[2]):
            break
    return out


def before(words: list[bytes], at: int) -> list[bytes]:
    """The FLANK words before a place, last first."""
    return words[max(0, at - FLANK) : at][::-1]


def flank(piece: Callable[[int, int], tuple[list[bytes], list[bytes]]], cost: int) -> tuple[int, int, int]:
    """extend() over pieces of FLANK words, each from where the last one ended."""
    of_a = of_b = matched = 0
    while True:
        x, y, n = extend(*piece(of_a, of_b), cost)
        of_a, of_b, matched = of_a + x, of_b + y, matched + n
        if x == y == 0 or max(x, y) < FLANK - BAND - DROP:  # else the piece may have ended it
            return of_a, of_b, matched


def extend(a: list[bytes], b: list[bytes], cost: int) -> tuple[int, int, int]:
    """How many words of a and b belong to a passage that begins with them, and how many of them match.

    Alignment within BAND words of the diagonal: a match is worth 1, a word changed or left out
    costs `cost`. The furthest of the best ends counts, and what falls DROP below it is given up.
    """
    n, short = 0, min(len(a), len(b))
    while n < short and a[n] == b[n]:
        n += 1
    if n == short:
        return n, n, n
    # A cell is its score and, in the lowest BITS, its matches; only higher scores replace a cell.
    matches, hit, down = (1 << BITS) - 1, (1 << BITS) + 1, cost << BITS
    floor, best = n << BITS, (n, n, n)  # words of a, words of b, matches
    lost = (-len(a) * cost - DROP) << BITS
    row = [lost] * BAND + [((n - cost * k) << BITS) + n for k in range(BAND + 1)] + [lost]
    for i in range(n + 1, len(a) + 1):
        word, left = a[i - 1], lost
        low, high = max(0, BAND - i), min(2 * BAND, len(b) - i + BAND)
        now = [lost] * low
        for k in range(low, high + 1):
            j = i + k - BAND
            here = lost if j == 0 else row[k] + hit if word == b[j - 1] else row[k] - down
            above, left = row[k + 1] - down, left - down
            if above > here | matches:
                here = above
            if left > here | matches:
                here = left
            now.append(here)
            left = here
            if here >= floor:
                floor, best = here & ~matches, (i, j, here & matches)
        if not now or max(now) < floor - (DROP << BITS):
            break
        row = now + [lost] * (2 * BAND + 2 - len(now))
    return best


def common(a: list[bytes], b: list[bytes]) -> int:
    """Words in the longest common subsequence of two short gaps."""
    if a == b:
        return len(a)
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], max(row[j], row[j - 1], left + 1 if x == y else 0)
    return row[-1]


def seed_table(docs: DataFrame) -> DataFrame:
    """doc_id, seed, pos and at: the places of a seed said over LEAST_WORDS words or more, else null."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        known = WordHashes()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = words(text)
                hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
                runs_of = window_hashes(hashes, K)
                at = minimizers(runs_of)
                if len(at) == 0:
                    continue
                of = runs_of[at].view(np.int64)
                same = np.append(False, of[1:] == of[:-1])
                ends = ~same | ~np.append(same[1:], False)
                yield int(doc_id), of[ends], at[ends], [None] * int(ends.sum())
                if not ends.all():
                    starts = np.flatnonzero(~same)
                    runs = [(i, j) for i, j in zip(starts.tolist(), np.append(starts[1:], len(at)).tolist()) if at[j - 1] + K - at[i] >= LEAST_WORDS]
                    if runs:
                        begins = np.array([i for i, _ in runs])
                        yield int(doc_id), of[begins] ^ SAID_OVER, at[begins], [at[i:j].tolist() for i, j in runs]

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for part in find(batches):
            held.append(part)
            n += len(part[1])
            if n > 50_000:
                yield frame(held)
                held, n = [], 0
        if held:
            yield frame(held)

    def frame(held: list[tuple[int, np.ndarray, np.ndarray, list]]) -> pd.DataFrame:
        ids, of, pos, at = zip(*held)
        doc_id = np.repeat(np.array(ids, np.int64), [len(x) for x in of])
        return pd.DataFrame({"doc_id": doc_id, "seed": np.concatenate(of), "pos": np.concatenate(pos).astype(np.int32), "at": pd.Series([x for part in at for x in part], dtype=object)})

    return docs.mapInPandas(together, "doc_id long, seed long, pos int, at array<int>")


def first_matches(held: DataFrame) -> DataFrame:
    """The matches of each shared seed with its first holder. Places of seeds said over and over are matched in turn, from both ends."""
    met = held.filter("doc_id <> first_id")
    n, m = F.size("at"), F.size("first_at")
    forth = F.transform("at", lambda x, i: F.struct(x.alias("pos"), F.get("first_at", i % m).alias("first_pos")))
    back = F.transform("at", lambda x, i: F.struct(x.alias("pos"), F.get("first_at", m - 1 - (n - 1 - i) % m).alias("first_pos")))
    places = F.when(F.col("at").isNull(), F.array(F.struct("pos", "first_pos"))).otherwise(F.array_distinct(F.concat(forth, back)))
    return met.select("doc_id", "first_id", F.explode(places).alias("m")).select("doc_id", "first_id", "m.*", F.lit(True).alias("wanted"))


def chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """The good chains of a pair (doc_id, first_id) with a wanted match: matches as arrays, by group of pairs."""
    pdf = pdf.sort_values(["doc_id", "first_id", "pos", "first_pos"])
    doc, first = pdf["doc_id"].to_numpy(), pdf["first_id"].to_numpy()
    x, y, wanted = pdf["pos"].to_numpy(np.int64), pdf["first_pos"].to_numpy(np.int64), pdf["wanted"].to_numpy(bool)
    cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (first[1:] != first[:-1])) + 1
    out = []
    for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(pdf)).tolist()):
        if hi - lo < LEAST_SEEDS:
            continue
        of_x, of_y = x[lo:hi], y[lo:hi]
        for found in chain(of_x, of_y):
            if len(found) >= LEAST_SEEDS and wanted[lo:hi][found].any():
                out.append((doc[lo], first[lo], of_x[found].tolist(), of_y[found].tolist()))
    return pd.DataFrame(out, columns=["doc_id", "first_id", "xs", "ys"])


def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, of_last = None, []
    for batch in batches:
        out = []
        for doc_id, first_id, xs, ys, text, first_text in zip(batch["doc_id"], batch["first_id"], batch["xs"], batch["ys"], batch["text"], batch["first_text"]):
            if first_id != last:
                last, of_last = first_id, words(first_text)
            mine = words(text)
            a0, a1, b0, b1, matched = align(mine, of_last, list(zip(map(int, xs), map(int, ys))))
            n = max(a1 - a0, b1 - b0)
            if min(a1 - a0, b1 - b0) >= LEAST_WORDS and matched >= LEAST_IDENTITY * n:
                out.append((doc_id, first_id, a0, a1, b0, b1, matched / n))
        yield pd.DataFrame(out, columns=["doc_id", "first_id", "start", "stop", "first_start", "first_stop", "identity"])


PASSAGES = "doc_id long, first_id long, start int, stop int, first_start int, first_stop int, identity double"


def passages_of(matches: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """The passages that matches (doc_id, first_id, pos, first_pos, wanted) lead to."""
    pairs = matches.groupBy("doc_id", "first_id").agg(F.count(F.lit(1)).alias("_n"), F.max("wanted").alias("_w")).filter((F.col("_n") >= LEAST_SEEDS) & F.col("_w")).drop("_n", "_w")
    n_groups = parts_for(matches.count(), 100_000)
    dealt = matches.join(pairs, ["doc_id", "first_id"]).withColumn("_g", F.pmod(F.xxhash64("doc_id", "first_id"), F.lit(n_groups)))
    chains = written(dealt.groupBy("_g").applyInPandas(chained, "doc_id long, first_id long, xs array<int>, ys array<int>"), "chains")
    ends = chains.select("doc_id").union(chains.select("first_id"))
    texts = pick(rows, ends, "doc_id").groupBy("doc_id").agg(F.min(F.struct(key.alias("k"), "text"))["text"].alias("text"))
    # A document of many chains is dealt over tasks by a salt, its text sent to each.
    salts = chains.groupBy("first_id").agg(F.ceil(F.count(F.lit(1)) / CHAINS_PER_SALT).alias("_n"))
    of_first = salts.join(texts.withColumnsRenamed({"doc_id": "first_id", "text": "first_text"}), "first_id")
    of_first = of_first.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select("first_id", "_s", "first_text")
    salted = chains.join(salts, "first_id").withColumn("_s", F.pmod(F.xxhash64("doc_id", "xs"), F.col("_n"))).drop("_n")
    met = salted.join(texts, "doc_id").join(of_first, ["first_id", "_s"]).select("doc_id", "first_id", "xs", "ys", "text", "first_text")
    return written(met.mapInPandas(aligned, PASSAGES), "passages")


def _within(seeds: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both sides dealt by stretches of LEAST_WORDS words, and the condition that a seed lies in a passage."""
    part = lambda c: F.floor(F.col(c) / LEAST_WORDS)
    left = seeds.withColumn("_part", part("pos")).alias("s")
    right = passages.withColumn("_part", F.explode(F.sequence(part("start"), part("stop")))).alias("p")
    inside = (F.col("s.pos") >= F.col("p.start")) & (F.col("s.pos") + K <= F.col("p.stop"))
    return left, right, [F.col("s.doc_id") == F.col("p.doc_id"), F.col("s._part") == F.col("p._part"), inside]


def _dense(seeds: DataFrame) -> DataFrame:
    """seeds without those that no chain of LEAST_SEEDS with gaps of up to REACH words can hold."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    run = seeds.withColumn("_run", F.sum(F.when(F.col("pos") - F.lag("pos").over(by) <= REACH, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    long = run.groupBy("doc_id", "_run").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= LEAST_SEEDS).select("doc_id", "_run")
    return run.join(long, ["doc_id", "_run"], "left_semi").drop("_run")


def _runs(seeds: DataFrame) -> DataFrame:
    """doc_id, key and places of the runs of three of seeds(doc_id, seed, pos, wanted), at least one wanted, no gap above REACH."""
    by = Window.partitionBy("doc_id").orderBy("pos", "seed")
    ahead = seeds.withColumns({f"_{i}": F.lead(F.struct("seed", "pos", "wanted"), i).over(by) for i in range(1, 2 * SKIP + 1)})
    here = F.struct("seed", "pos", "wanted")
    runs = F.array(*[F.struct(here.alias("a"), F.col(f"_{i}").alias("b"), F.col(f"_{i + j}").alias("c")) for i in range(1, SKIP + 1) for j in range(1, SKIP + 1)])
    near = F.filter(runs, lambda r: (r["b"]["pos"] - r["a"]["pos"] <= REACH) & (r["c"]["pos"] - r["b"]["pos"] <= REACH) & (r["a"]["wanted"] | r["b"]["wanted"] | r["c"]["wanted"]))
    out = ahead.select("doc_id", F.explode(near).alias("r"))
    places = F.array(*[F.struct(F.col(f"r.{x}.pos").alias("pos"), F.col(f"r.{x}.wanted").alias("wanted")) for x in "abc"])
    return out.select("doc_id", F.xxhash64("r.a.seed", "r.b.seed", "r.c.seed").alias("key"), places.alias("places"))


def _meetings(mine: Column, theirs: Column) -> Column:
    """Pairs of places of one run in two documents: all, or where both say it over and over, in turn from both ends."""
    n, m = F.size(mine), F.size(theirs)
    pair = lambda x, y: F.struct(x.alias("mine"), y.alias("theirs"))
    every = F.flatten(F.transform(mine, lambda x: F.transform(theirs, lambda y: pair(x, y))))
    forth = F.transform(mine, lambda x, i: pair(x, F.get(theirs, i % m)))
    back = F.transform(mine, lambda x, i: pair(x, F.get(theirs, m - 1 - (n - 1 - i) % m)))
    return F.when(n * m <= FEW, every).otherwise(F.concat(forth, back))


def _matches(links: DataFrame) -> DataFrame:
    """doc_id, first_id, pos, first_pos and wanted of links(doc_id, first_id, mine, theirs), once each.

    Runs of a pair overlap, so a match comes up many times; as one number each they are put together before rows are made.
    """
    packed = lambda r: F.transform(r["mine"], lambda x, i: F.shiftleft(x["pos"].cast("long"), 32) + F.shiftleft(F.get(r["theirs"], i).cast("long"), 1) + x["wanted"].cast("long"))
    met = links.select("doc_id", "first_id", F.array_distinct(F.flatten(F.transform(_meetings(F.col("mine"), F.col("theirs")), packed))).alias("m"))
    met = met.groupBy("doc_id", "first_id").agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("m")).select("doc_id", "first_id", F.explode("m").alias("m"))
    low = F.col("m").bitwiseAND(F.lit(0xFFFFFFFF))
    return met.select("doc_id", "first_id", F.shiftright("m", 32).cast("int").alias("pos"), F.shiftright(low, 1).cast("int").alias("first_pos"), (low % 2 == 1).alias("wanted"))


def _linked_passages(shared: DataFrame, found: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """found and the passages of shared seeds (doc_id, seed, pos, later) that lie in none of it.

    `later` tells the first holder of a seed, which repeats nothing, from the others. First
    with the first holder of a run in each part of the documents, then with all earlier holders.
    """
    own = shared.filter("later").drop("later")
    for every in (False, True):
        seeds, passages, inside = _within(own, found.select("doc_id", "start", "stop").distinct())
        bare = written(seeds.join(passages, inside, "left_anti").drop("_part"), "bare-seeds")
        if bare.isEmpty():
            return found
        wanted = bare.select("doc_id", "pos", F.lit(True).alias("wanted"))
        near = bare.select("doc_id", F.explode(F.array(*[F.floor(F.col("pos") / LEAST_WORDS) + i for i in (-1, 0, 1)])).alias("_part")).distinct()
        asks = own.withColumn("_part", F.floor(F.col("pos") / LEAST_WORDS)).join(near, ["doc_id", "_part"], "left_semi").drop("_part")
        asks = _dense(asks).join(wanted, ["doc_id", "pos"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
        asks = written(asks, "asking-seeds")
        theirs = _dense(shared.drop("later").join(asks.select("seed").distinct(), "seed", "left_semi")).withColumn("wanted", F.lit(True))
        asks = written(_runs(asks), "asking-runs")
        keys = written(asks.select("key").distinct(), "keys")
        theirs = _runs(theirs).join(keys, "key", "left_semi").select("key", F.col("doc_id").alias("first_id"), F.col("places")["pos"].alias("first_pos"))
        if every:
            theirs = theirs.groupBy("key", "first_id").agg(F.sort_array(F.collect_list("first_pos")).alias("theirs"))
        else:
            part = F.pmod(F.xxhash64("first_id"), F.lit(FIRSTS))
            theirs = theirs.groupBy("key", part.alias("_p")).agg(F.min(F.struct("first_id", "first_pos")).alias("m")).select("key", "m.first_id", F.array("m.first_pos").alias("theirs"))
        asks = asks.groupBy("key", "doc_id").agg(F.sort_array(F.collect_list("places")).alias("mine"))
        links = written(asks, "asking-documents").join(written(theirs, "asked-runs"), "key").filter(F.col("first_id") < F.col("doc_id"))
        more = passages_of(written(_matches(links), "links"), rows, key)
        seeds, passages, inside = _within(bare, more)
        new = passages.join(seeds, inside, "left_semi").drop("_part")
        found = written(found.unionByName(new.distinct()), "passages")
    return found


def fuzzy_passages(docs: DataFrame) -> DataFrame:
    """Passages of docs(doc_id, text) that repeat one of a document with a smaller doc_id, exactly or nearly.

    doc_id, first_id, word ranges [start, stop) in doc_id and [first_start, first_stop) in
    first_id, and identity, matching words by the longer range. A document whose whole text
    copies another's has one row, first_id the smallest doc_id of that text and identity 1.0,
    if it has 40 words. Passages of 40 equal words, of 60 with up to 4 % changed, 80 (8 %), 120
    (12 %) and 200 (15 %) are found with a recall of 0.9 or more; of shorter or more changed
    ones, those that still share three seeds. Only exact copies are collapsed: passages of texts that differ are
    found for each. Null or short texts and rows without doc_id have none; of a doc_id with
    several texts the first in text order counts. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        return _fuzzy_passages(docs)


def _fuzzy_passages(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    key = F.sha2(F.encode("text", "UTF-8"), 256)
    thin = written(rows.groupBy("doc_id").agg(F.min(key).alias("text_key")), "texts")
    firsts = thin.groupBy("text_key").agg(F.min("doc_id").alias("first_id"))
    copies = written(thin.join(firsts, "text_key").filter("doc_id <> first_id").select("doc_id", "first_id"), "copies")
    few = copies.count() <= BROADCAST_IDS
    table = written(seed_table(rows.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")), "seeds")
    shared = table.groupBy("seed").agg(F.min(F.struct("doc_id", "pos", "at")).alias("first"), F.max("doc_id").alias("_last")).filter("first.doc_id <> _last")
    shared = shared.select("seed", F.col("first.doc_id").alias("first_id"), F.col("first.pos").alias("first_pos"), F.col("first.at").alias("first_at"))
    shared = written(shared, "shared-seeds")  # a plain table, so that the join below can split a frequent seed
    held = written(table.join(shared, "seed"), "held-seeds")
    found = passages_of(first_matches(held), rows, key)
    found = _linked_passages(held.filter("at IS NULL").select("doc_id", "seed", "pos", (F.col("doc_id") > F.col("first_id")).alias("later")), found, rows, key)
    n_words = F.size(F.split(F.btrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+"))
    whole = pick(rows, copies.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min(F.struct(key.alias("_k"), n_words.alias("n")))["n"].alias("n")).filter(F.col("n") >= LEAST_WORDS)
    whole = copies.join(whole, "doc_id").select("doc_id", "first_id", F.lit(0).alias("start"), F.col("n").alias("stop"), F.lit(0).alias("first_start"), F.col("n").alias("first_stop"), F.lit(1.0).alias("identity"))
    return found.unionByName(whole)


def op8_chains(docs: DataFrame) -> DataFrame:
    return fuzzy_passages(docs.select("doc_id", "text"))
