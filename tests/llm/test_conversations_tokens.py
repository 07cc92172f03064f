"""Repair, prefix trie and token counts against plain Python, the tokenizer library and SQL."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SMALL
from locus.llm import repair, tokens, trie

TURNS = "conv_id long, turn long, role string, text string, _id long, _text string, score double"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def cheapest(rows):
    """Dijkstra over (cost, audit) for rows of fault and initial."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        new = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 2, audit + "I", i, new))
        if i < len(rows):
            fault, initial = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if fault not in ("b", "d"):
                more = int(fault == "t")
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, new))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))
                if kept is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, kept))


def expected_repairs(rows):
    convs, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        convs[conv] += []
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        lattice, seen = [], set()
        for _, role, text in held:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            lattice.append(("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "-", role[:1]))
            seen.add((role, text))
        cost, audit = cheapest(lattice)
        lines, i, last = [], 0, ""
        for letter in audit:
            role, text = held[i][1:] if letter != "I" else (None, "")
            if letter in "IR":
                role = "assistant" if last == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
                last = role[0]
            i += letter != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = {t for t, _, _ in held if t is not None}
        faults = [f for f, _ in lattice]
        illegal = sum(a + b not in ("su", "ua", "au") for (_, a), (_, b) in zip(lattice, lattice[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(spark, seed, hot=0):
    rng, rows = random.Random(seed), []
    for conv in [*range(60), -7, 10**15, None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "", "robot", None]), rng.choice(["a.", "b!", " c? \x0b", "d", "", " \n", None, "é. x" * 3])))
    rows += [(61, t, ["user", "assistant"][t % 2], f"said {rng.randint(0, hot)}{rng.choice('.?! ')}") for t in range(hot)]
    rows += rows[:9] + [(62, 0, "user", "long! " * 100_000), (62, 1, "assistant", "x" * 600_000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, 1, "t", 0.5) for r in rows], TURNS).repartition(6)


@pytest.mark.parametrize("seed", range(3))
def test_auction_finds_the_least_audit(seed):
    rng = random.Random(seed)
    for n in range(700):
        rows = [(rng.choice("--tbd" if n % 2 else "-----t"), rng.choice(["s", "u", "a", "u", "a", ""])) for _ in range(rng.randint(0, 20))]
        cost, audit, state = repair.solve(rows)
        assert (cost, audit + repair.END_EDITS[state]) == cheapest(rows)


@pytest.fixture
def many_parts(spark):
    """Sorted tables keep all their parts, so that conversations go over part borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("block", [512, 40, 3, 1])
def test_repair_equals_brute_force_whole_and_in_blocks(spark, many_parts, block):
    rows, df = conversations(spark, 11, hot=150)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op11_auction(df, block=block).collect()}
    assert got == expected_repairs(rows)


def test_repair_of_large_texts_goes_by_blocks(spark):
    rows, df = conversations(spark, 4)
    got = {r["_id"]: tuple(r)[1:] for r in repair.repair(repair.damaged(df), large=1000).collect()}
    assert got == expected_repairs(rows)


def test_conversations_all_of_whose_rows_are_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    for block in (512, 0):
        assert [tuple(r) for r in repair.op11_auction(df, block=block).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repair.op11_auction(df.limit(0)).count() == 0


def expected_trie(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn, role or "", text or ""))
    for conv, held in said.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()[:30]))
        said[conv] = [r[1:] for r in held]
    full = {}
    for conv, own in said.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        full[conv] = tuple(said.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for conv, path in full.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = []
    for p, held in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in held if len(full[c]) == len(p))))
        out.append((min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def families(seed):
    """Conversations that share first turns, with bases that lack turns, copies, nulls and ties."""
    rng, rows = random.Random(seed), []
    for conv in [*range(-130, -90), *range(0, 12), *range(100, 160), *range(310, 330), 10**15 + 77]:
        for turn in range(rng.choice([1, 2, 3, 5, 7, 9])):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])))
    return rows + rows[:15] + [(None, 0, "user", "a")]


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_brute_force(spark, many_parts, monkeypatch, seed):
    rows = families(seed)
    if seed:
        monkeypatch.setattr(trie, "STEPS", 2)
        monkeypatch.setattr(trie, "IDS", 2)
    rows += [(500, t, "user", str(t)) for t in range(120)] + [(501, 0, "user", "long " * 200_000)]
    df = spark.createDataFrame([(*r, 1, "t", 0.5) for r in rows], TURNS).repartition(7)
    assert sorted(map(tuple, trie.op12_trie(df).collect()), key=str) == expected_trie(rows)


def test_trie_turn_references_point_to_the_last_turn(spark):
    rows = [(100, 0, "user", "a"), (100, 1, "user", "b"), *[(c, t, "user", x) for c in range(101, 140) for t, x in enumerate("abc")]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    text = {(c, t): x for c, t, _, x in rows}
    nodes = trie.prefix_trie(df).collect()
    full = [(n["depth"], text[n["turn_conv_id"], n["turn_number"]]) for n in nodes if n["depth"]]
    assert (1, "a") in full and (2, "b") in full and all(n["turn_conv_id"] is None for n in nodes if n["depth"] == 0)


def test_trie_takes_other_bases_if_hashes_collide(spark, monkeypatch):
    rows = families(5)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    real = trie.bases
    monkeypatch.setattr(trie, "bases", lambda seed: [1, 1] if seed == 0 else real(seed))  # sums without order
    got = sorted((r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in trie.op12_trie(df.filter("turn is not null")).collect())
    want = expected_trie([r for r in rows if r[1] is not None])
    assert got == sorted((r[1], r[3], r[4], r[5], r[6]) for r in want)


def test_trie_of_conversations_without_turns_left(spark):
    short = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1][:3]
    df = spark.createDataFrame([(c, 0, "user", "x") for c in short], "conv_id long, turn long, role string, text string")
    ends = hashlib.sha256(",".join(map(str, short)).encode()).hexdigest()
    assert [tuple(r) for r in trie.op12_trie(df).collect()] == [(short[0], 0, None, 3, 0, 1, 0, ends)]
    assert trie.op12_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("query, sql", [(repair.op11_auction, repair.OP11_SQL), (trie.op12_trie, trie.OP12_SQL)])
def test_sql_agrees(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    cursor = con.execute(sql)
    df = query(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    assert sorted(df.columns) == sorted(c[0] for c in cursor.description)
    got = sorted((tuple(r) for r in df.select([c[0] for c in cursor.description]).collect()), key=str)
    assert got == sorted(cursor.fetchall(), key=str)


ALPHABETS = [
    "abcdefghijklmnopqrstuvwxyz", "ABCXYZ", "0123456789", "'s't're've", " \t\n\x1c\x1f\x85\xa0　", "éèüßñçàİıΣσς", "漢字かなカナ한국어", "̧́̈e가", "<|endoftext|>",
    "<|startoftext|>", "!?.,;:-_()\"", "😀👍🏽", "ﬁ\x00\x01",
]


def odd_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        picks = [rng.choice(ALPHABETS) for _ in range(rng.randint(0, 12))]
        yield "".join(a if rng.random() < 0.2 else "".join(rng.choice(a) for _ in range(rng.randint(1, 9))) for a in picks)


def test_token_counts_equal_the_library(spark):
    rng = random.Random(2)
    texts = [None, "", "  ", *odd_texts(1, 1500), "a" * 50_001, "word " * 300_000, "".join(rng.choice("abcdefghijklmnop") for _ in range(50_000)), "<|endoftext|>" * 2100, "漢字" * 20_000]
    library = Tokenizer.from_file(WORDS)
    rows = [(i if i % 9 else None, t, -1, "x") for i, t in enumerate([*texts, "hello", "hello"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, n_bytes string").repartition(5)
    got = sorted((tuple(r) for r in tokens.op13_token_counts(df).collect()), key=str)
    want = []
    for i, t, _, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)
    assert tokens.op13_token_counts(df.limit(0)).count() == 0


def test_token_counts_with_small_stretches_and_memory(monkeypatch):
    texts = ["".join(odd_texts(s, 40)).encode() for s in range(4)]
    want = tokens.TokenCounter(WORDS).counts(texts)
    monkeypatch.setattr(tokens, "STRETCH", 50)
    monkeypatch.setattr(tokens, "HELD", 20)
    assert tokens.TokenCounter(WORDS).counts(texts) == want


def test_token_counts_keep_other_columns_and_refuse_other_files(spark):
    df = spark.createDataFrame([(1, "one two", "k")], "doc_id long, text string, extra string")
    assert tokens.token_counts(df, WORDS, limit=1).first().asDict() == {"doc_id": 1, "text": "one two", "extra": "k", "n_tokens": 2, "n_bytes": 7, "over_limit": True}
    with pytest.raises(ValueError):
        tokens.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
