import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from locus.llm import chains, repeats
from locus.llm.bwt import common_prefixes, least_owner, sorted_suffixes
from locus.llm.shingles import WordHashes, window_hashes, words

DOCS = "doc_id long, text string, n_bytes string, block string"


def brute(data):
    rows = [(i, (t or "").encode()) for i, t in data]
    seen = {}
    for i, b in rows:
        if i is not None:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                seen[s] = min(seen.get(s, i), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - 49):
                if seen[b[p : p + 50]] < i:
                    gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n, letters="abcdé \n": "".join(rng.choice(letters) for _ in range(n))
    shared = [text(rng.randint(45, 300)) for _ in range(4)] + ["a" * 200, "ab" * 60]
    data = []
    for i in range(50):
        parts = [text(rng.randint(0, 120)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 20)
            parts.insert(rng.randint(0, len(parts)), s[a : len(s) - rng.randint(0, 20)])
        data.append((rng.randrange(10_000), "".join(parts)))
    data += [(20_000, None), (20_001, ""), (20_002, "x" * 49), (20_003, "x" * 50), (20_004, "x" * 51), (None, shared[0]), (data[4][0], shared[1]), (20_005, data[7][1]), (20_006, shared[2] * 3), (20_007, shared[2] * 2)]
    return data


@pytest.mark.parametrize("seed,block,bucket", [(1, 2 << 20, 8 << 20), (2, 2000, 3000), (3, 700, 900)])
def test_cut_equals_brute_force(spark, monkeypatch, seed, block, bucket):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket)
    data = corpus(seed)
    df = spark.createDataFrame([(i, t, "own", "own") for i, t in data], DOCS)
    assert sorted(map(tuple, repeats.op10_bwt(df).collect()), key=str) == brute(data)


def test_kept_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "q" * 60 + "r", "", ""), (2, "q" * 60 + "s", "", "")], DOCS)
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.cut_repeats(df).collect()}
    assert got == {1: b"q" * 60 + b"r", 2: b"s"}
    assert repeats.op10_bwt(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion_equals_brute_force(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 30))] + [bytes(range(256))]
    owner = np.array([rng.randrange(1000) for _ in strings])
    least = rng.choice([1, 2, 5, 12])
    seen = {}
    for s, o in zip(strings, owner):
        for p in range(len(s) - least + 1):
            seen[s[p : p + least]] = min(seen.get(s[p : p + least], o), o)
    got = least_owner(strings, owner, least)
    assert [g.tolist() for g in got] == [[seen[s[p : p + least]] for p in range(max(0, len(s) - least + 1))] for s in strings]


@pytest.mark.parametrize("seed", range(6))
def test_borders_have_the_common_prefix_of_their_rows(seed):
    rng = random.Random(seed)
    strings = [[rng.choice((1, 2, 3)) for _ in range(rng.randint(1, 30))] for _ in range(30)]
    text, least = np.array(sum((s + [0] for s in strings), []), np.uint16), rng.choice([3, 6, 10])
    order = sorted_suffixes(text, least)
    prefix = common_prefixes(text[order - 1], least)
    padded = text.tolist() + [0] * least  # as the order has it
    heads = [tuple(padded[i : i + least]) for i in order.tolist()]
    assert heads == sorted(heads)
    whole = [j for j, h in enumerate(heads) if 0 not in h]
    for i, j in zip(whole, whole[1:]):  # rows that reach an end of a string between them count for nothing
        shared = next((d for d, (x, y) in enumerate(zip(heads[i], heads[j])) if x != y), -1)
        between = [p for p in prefix[i + 1 : j + 1].tolist() if p >= 0]
        assert (min(between) if between else -1) == shared


@pytest.mark.parametrize("piece", [1, 300, 1 << 20])
def test_pieces_of_stretches_do_not_change_what_owners_lose(monkeypatch, piece):
    rng = random.Random(piece)
    monkeypatch.setattr(repeats, "PIECE", piece)
    texts, anchor = [], []
    for a in range(20):
        base = bytes(rng.choice(b"xyz") for _ in range(76))
        texts += [base[i : i + rng.randint(50, 76 - i)] for i in range(0, 25, 6)]
        anchor += [a] * 5
    owner = np.array([rng.randrange(50) for _ in texts])
    seen = {}
    for t, o in zip(texts, owner.tolist()):
        for p in range(len(t) - 49):
            seen[t[p : p + 50]] = min(seen.get(t[p : p + 50], o), o)
    want = [{q for p in range(len(t) - 49) if seen[t[p : p + 50]] < o for q in range(p, p + 50)} for t, o in zip(texts, owner.tolist())]
    got = [set() for _ in texts]
    for k, x, y in zip(*repeats.lost_by_owners(texts, np.array(anchor), owner)):
        got[k] |= set(range(x, y))
    assert got == want and any(want)


def texts(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    many = lambda n: [word() for _ in range(n)]
    passage = many(80)
    fuzzy = list(passage)
    fuzzy[20] = word()
    del fuzzy[40]
    fuzzy.insert(60, word())
    common = many(60)
    data = {
        1: many(100) + passage + many(50), 2: many(30) + passage + many(10), 3: many(70) + fuzzy + many(70), 4: many(300), 5: passage[:20] + many(200) + passage[20:30], 6: common + many(30),
        8: ["long"] * 30_000,
    }
    for i in range(20, 60):
        data[i] = many(20) + common + many(20)
    return {i: " ".join(w) for i, w in data.items()}


def test_exact_and_fuzzy_passages_are_found_and_others_left(spark):
    data = texts()
    rows = [(i, t, "own", "own") for i, t in data.items()] + [(100, data[1], "", ""), (101, None, "", ""), (102, "", "", ""), (103, "few words", "", ""), (104, "few words", "", ""), (None, data[1], "", ""), (2, data[2], "", "")]
    got = chains.fuzzy_passages(spark.createDataFrame(rows, DOCS)).collect()
    pairs = {(r["doc_id"], r["first_id"]) for r in got}
    assert pairs == {(2, 1), (3, 1), (100, 1)} | {(i, 6) for i in range(20, 60)}
    for r in got:
        a, b = words(data.get(r["doc_id"], data[1]))[r["start"] : r["stop"]], words(data[r["first_id"]])[r["first_start"] : r["first_stop"]]
        if r["doc_id"] in (2, 100) or r["doc_id"] >= 20:
            assert a == b and r["identity"] == 1.0
        if r["doc_id"] == 3:
            assert len(a) == 80 and 0.9 < r["identity"] < 1
    spans = {r["doc_id"]: (r["start"], r["stop"]) for r in got}
    assert spans[2] == (30, 110) and spans[3] == (70, 150) and spans[20] == (20, 80)


def test_no_documents(spark):
    assert chains.op8_chains(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_chain_score_equals_quadratic_dynamic_programming(seed):
    rng = random.Random(seed)
    points = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randint(1, 40))})
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])

    def gain(i, j):
        return chains.K - chains.GAP * ((x[j] - x[i]) + (y[j] - y[i]))

    best = []
    for j in range(len(points)):
        best.append(max([float(chains.K)] + [best[i] + gain(i, j) for i in range(j) if x[i] < x[j] and y[i] < y[j]]))
    found = chains.chain(x, y)
    assert sorted(i for c in found for i in c) == list(range(len(points)))
    for c in found:
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:]))
    assert max(chains.K + sum(gain(a, b) for a, b in zip(c, c[1:])) for c in found) == pytest.approx(max(best))


def repeated(data):
    """By doc_id, the words of seeds that make a passage shared with any earlier document, by all pairs and all positions."""
    known, seen = WordHashes(), {}
    for i, t in data:
        w = words(t)
        h = np.array([known[x] for x in w], np.uint64)
        runs, places = window_hashes(h, chains.K), defaultdict(list)
        for p in chains.seeds(h).tolist():
            places[runs[p]].append(p)
        seen[i] = w, places
    out = {}
    for i, (w, mine) in seen.items():
        out[i] = set()
        for j, (v, theirs) in seen.items():
            met = [(x, y) for s in mine.keys() & theirs.keys() for x in mine[s] for y in theirs[s]] if j < i else []
            for c in chains.chain(*np.array(met).T) if met else []:
                a0, a1, b0, b1, n = chains.align(w, v, [met[k] for k in c]) if len(c) >= chains.LEAST_SEEDS else (0,) * 5
                if min(a1 - a0, b1 - b0) >= chains.LEAST_WORDS and n >= chains.LEAST_IDENTITY * max(a1 - a0, b1 - b0):
                    out[i] |= {p for k in c for p in range(met[k][0], met[k][0] + chains.K) if a0 <= p < a1}
    return out


def test_families_of_edited_copies_and_passages_quoted_before_in_parts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    many = lambda n: [word() for _ in range(n)]
    passage, quoted, twice = many(60), many(60), many(60)
    data = [(i, many(20) + [word() if rng.random() < 0.06 else w for w in passage] + many(20)) for i in range(100, 160)]
    data += [(i, many(10) + quoted[i * 10 : i * 10 + 18] + many(10)) for i in range(6)]  # each quote is the first holder of its seeds
    data += [(i, many(9) + quoted + many(9)) for i in (200, 201)]
    data += [(300, sum((twice[k : k + 18] + many(70) for k in range(40, -1, -10)), []) + twice), (301, many(7) + twice)]  # the first holder has the seeds before, in another order
    data = [(i, " ".join(w)) for i, w in data]
    want, got = repeated(data), defaultdict(set)
    for r in chains.fuzzy_passages(spark.createDataFrame([(i, t, "own", "own") for i, t in data], DOCS)).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["stop"]))
    assert want[201] and want[301] and sum(map(bool, want.values())) > 40
    assert [i for i in want if want[i] - got[i]] == []


def test_a_word_said_over_and_over_leaves_a_seed_in_each_stretch():
    rng = random.Random(3)
    for word_list in (["long"] * 200, ["a", "b"] * 90, [rng.choice("ab") for _ in range(300)]):
        h = np.array([WordHashes()[w.encode()] for w in word_list], np.uint64)
        at = chains.seeds(h).tolist()
        assert max(b - a for a, b in zip(at, at[1:])) <= chains.W and at[0] < chains.W and at[-1] >= len(h) - chains.K + 1 - chains.W
    assert len(chains.seeds(np.ones(30_000, np.uint64))) < 3000


def test_a_passage_whose_seeds_all_have_other_first_holders(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    many = lambda n: [word() for _ in range(n)]
    passage = many(144)
    data = [(i, many(10) + passage[12 * i : 12 * i + 24] + many(10)) for i in range(11)]
    data += [(100, many(20) + passage + many(5)), (101, many(3) + passage + many(30))]
    got = chains.fuzzy_passages(spark.createDataFrame([(i, " ".join(w), "", "") for i, w in data], DOCS)).collect()
    assert [(r["doc_id"], r["first_id"], r["start"], r["stop"], r["identity"]) for r in got] == [(101, 100, 3, 147, 1.0)]


def test_words_said_over_and_over_are_covered_without_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    data = [(i, " ".join([word() for _ in range(8)] + ["the"] * rng.randint(45, 200) + [word() for _ in range(8)])) for i in range(60)]
    data += [(100 + i, " ".join([word() for _ in range(30)] + ["a short common phrase of so many words that it has some seeds but is no passage by itself"] + [word() for _ in range(30)])) for i in range(60)]
    made, passages_of = [], chains.passages_of
    monkeypatch.setattr(chains, "passages_of", lambda m, *a: made.append(m.count()) or passages_of(m, *a))
    covered = defaultdict(set)
    for r in chains.fuzzy_passages(spark.createDataFrame([(i, t, "", "") for i, t in data], DOCS)).collect():
        covered[r["doc_id"]] |= set(range(r["start"], r["stop"]))
    for i, t in data[:60]:
        said = {p for p, w in enumerate(t.split()) if w == "the"}
        assert len(said - covered[i]) <= chains.K if i else not covered[i]  # a run's end may be aligned a little short
    assert not any(covered[i] for i, _ in data[60:]) and sum(made) < 6000


def aligned_words(a, b):
    """The best local alignment of two word lists by plain dynamic programming: start and stop in a, and matches."""
    best, row = (0, 0, 0, 0), [(0, 0, 0)] * (len(b) + 1)  # score, start in a, matches
    for i, x in enumerate(a, 1):
        now = [(0, i, 0)]
        for j, y in enumerate(b, 1):
            s, at, n = row[j - 1]
            now.append(max((s + 1, at, n + 1) if x == y else (s - 1, at, n), (row[j][0] - 1, *row[j][1:]), (now[-1][0] - 1, *now[-1][1:]), (0, i, 0)))
            if now[-1][0] > best[0]:
                best = now[-1][0], now[-1][1], i, now[-1][2]
        row = now
    return best[1:]


def test_recall_against_alignment_of_all_words_in_the_stated_range(spark):
    """README: 40 equal words, 60 of which 4 % differ, 80 (8 %), 120 (12 %), 200 (15 %)."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    many = lambda n: [word() for _ in range(n)]
    cells, data = [(40, 0.0), (60, 0.04), (80, 0.08), (120, 0.12), (200, 0.15)], {}
    for c, (n, rate) in enumerate(cells):
        for k in range(30):
            passage = many(n)
            other = list(passage)
            for p in rng.sample(range(1, n - 1), round(n * rate)):
                other[p] = word()
            data[1000 * c + 2 * k], data[1000 * c + 2 * k + 1] = many(30) + passage + many(30), many(20) + other + many(40)
    found = {r["doc_id"]: r for r in chains.fuzzy_passages(spark.createDataFrame([(i, " ".join(w), "", "") for i, w in data.items()], DOCS)).collect()}
    for c, (n, _) in enumerate(cells):
        hits = 0
        for i in range(1000 * c + 1, 1000 * c + 61, 2):
            start, stop, matches = aligned_words(data[i], data[i - 1])
            assert stop - start >= chains.LEAST_WORDS and matches >= chains.LEAST_IDENTITY * (stop - start)
            r = found.get(i)
            hits += r is not None and r["first_id"] == i - 1 and min(stop, r["stop"]) - max(start, r["start"]) >= 0.9 * (stop - start)
        assert hits >= 27, cells[c]


def test_flanks_are_extended_over_changes_and_pieces(monkeypatch):
    rng = random.Random(2)
    a = [b"%d" % i for i in range(400)]
    b = [w if i % 9 else b"x%d" % i for i, w in enumerate(a)]
    for size in (7, 50, 2000):
        monkeypatch.setattr(chains, "FLANK", size)
        start, stop, first, last, n = chains.align(a + [b"end"] * 9, b + [b"other"] * 9, [(199, 199)])
        assert (start, stop, first, last) == (1, 400, 1, 400) and n == sum(x == y for x, y in zip(a, b)), size
    assert chains.extend([], a, 1) == (0, 0, 0) and chains.extend(a, a[:5], 1) == (5, 5, 5)
    assert chains.extend(a[:10] + [b"q"] + a[10:20], a[:20], 1) == (21, 20, 20)
    rng.shuffle(b)
    assert chains.extend(a[:300], b, 1)[2] <= 1


def test_matches_of_overlapping_runs_are_made_once(spark):
    run = lambda *places: [{"pos": x, "wanted": w} for x, _, w in places], lambda *places: [y for _, y, _ in places]
    a, b, c, d = (0, 10, True), (5, 15, False), (2**31 - 1, 2**31 - 2, True), (7, 2**31 - 1, False)
    rows = [(1, 0, [run[0](*r)], [run[1](*r)]) for r in ((a, b, c), (a, b, d), (b, c, d))] + [(2, 0, [run[0](a, b, c)], [run[1](a, b, c)])]
    links = spark.createDataFrame(rows, "doc_id long, first_id long, mine array<array<struct<pos:int,wanted:boolean>>>, theirs array<array<int>>")
    assert sorted(map(tuple, chains._matches(links).collect())) == sorted([(1, 0, *x) for x in (a, b, c, d)] + [(2, 0, *x) for x in (a, b, c)])


def test_a_short_copy_is_no_passage_whatever_else_its_id_says(spark):
    short, number = "a short text", 0
    while hashlib.sha256((long := " ".join(f"w{number}x{k}" for k in range(60))).encode()).hexdigest() < hashlib.sha256(short.encode()).hexdigest():
        number += 1
    rows = [(1, short, "", ""), (5, short, "", ""), (5, long, "", "")]
    assert chains.fuzzy_passages(spark.createDataFrame(rows, DOCS)).count() == 0
