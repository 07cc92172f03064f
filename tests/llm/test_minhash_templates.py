import random

import numpy as np
from pyspark.sql import functions as F

from locus.llm import minhash, templates
from locus.llm.components import components
from locus.llm.shingles import words

DOCS = "doc_id long, text string, component_id string, key string"


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(data):
    sets = {}
    for i, t in data:
        sets.setdefault(i, []).append(shingles(t))
    ids = [i for i in sets if i is not None]
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return sorted(((i, len(shingles(t)), None if i is None else root(i), i is None or root(i) == i) for i, t in data), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    data, base = [], None
    for g in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for c in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 18)):
                copy[rng.randrange(len(copy))] = word()
            data.append((len(data) + 10, " ".join(copy)))
    return data


def test_equals_brute_force_with_odd_rows(spark):
    data = corpus()
    data += [(500, None), (501, ""), (502, " \t\n"), (503, "One two"), (504, "one  TWO"), (505, "two one"), (506, "É x"), (507, "é x"), (508, data[0][1]), (3, data[0][1]), (508, data[0][1]), (None, data[0][1]), (600, "w " * 30_000)]
    df = spark.createDataFrame([(i, t, "own", "own") for i, t in data], DOCS)
    got = minhash.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(data)


def test_one_of_each_group_stays(spark):
    data = corpus(5) + [(500, None), (501, ""), (None, "a b")]
    df = spark.createDataFrame([(i, t, "own", "own") for i, t in data + data[:2]], DOCS)
    got = minhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted({i for i, _, _, k in brute(data) if k}, key=str)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_estimate_is_close_to_the_similarity(spark):
    rng = np.random.default_rng(2)
    by = minhash.multipliers()
    rows = []
    for share in (0.3, 0.6, 0.75, 0.9):
        both = rng.integers(0, 1 << 63, int(4000 * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, (4000 - len(both)) // 2, dtype=np.uint64)])) for _ in range(2))
        low = minhash.packed(minhash.minima([a, b], by)).view(np.int64)
        rows.append((share, low[0].tolist(), low[1].tolist()))
    df = spark.createDataFrame(rows, "share double, x array<long>, y array<long>")
    for r in df.select("share", minhash.estimate(F.col("x"), F.col("y")).alias("e")).collect():
        assert abs(r["e"] - r["share"]) < 0.15


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (7, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "a farmer named Otto sells 12 kg of ripe apples to his friend Anna for 30 dollars every week and Otto saves 12 dollars"


def leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, "own") for i, t in items], "item_id long, text string, window string")
    return {(r["doc_id"], r["item_id"]) for r in templates.contaminated(d, b).collect()}


def test_reparameterised_questions_are_caught_and_others_left(spark):
    changed = ITEM.replace("Otto", "Karl").replace("Anna", "Ida").replace("12", "57").replace("30", "88").replace("kg", "pounds")
    mixed = changed.replace("Karl saves", "Emil saves")  # one name of the item stands for two
    rng = random.Random(1)
    filler = " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(200))
    docs = [
        (1, f"{filler} {ITEM} {filler}"), (2, f"{filler} {changed}. {filler}"), (3, f"{filler} {mixed} {filler}"), (4, filler), (5, None), (6, ""), (7, "Otto 12 kg Anna 30 dollars " * 40),
        (8, " ".join(ITEM.split()[:9]) + " " + filler), (9, ITEM), (9, "other"), (None, ITEM), (10, f"{ITEM} " * 3000),
    ]
    got = leaks(spark, docs, [(1, ITEM), (2, None), (3, ""), (4, "too short to match"), (None, ITEM)])
    assert got == {(1, 1), (2, 1), (9, 1), (10, 1)}


def test_dropping_keeps_clean_documents_and_columns(spark):
    d = spark.createDataFrame([(1, ITEM, "own"), (2, "clean", "own"), (None, "clean", "own")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = templates.drop_contaminated(d, b)
    assert got.columns == d.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["2", "None"]


def test_no_rows(spark):
    assert leaks(spark, [], [(1, ITEM)]) == set() and leaks(spark, [(1, ITEM)], []) == set()


def test_templates_keep_the_number_of_tokens(spark):
    df = spark.createDataFrame([(ITEM,), (" x  1,000.5 km\n, Bob Miller  ",)], "text string")
    for r in df.select(templates.tokens(F.col("text")).alias("a"), templates.tokens(templates.template(F.col("text"))).alias("b")).collect():
        assert len(r["a"]) == len(r["b"])
    assert "<name>" in r["b"] and "<num>" in r["b"] and "<unit>" in r["b"]


def test_short_and_slot_heavy_items_are_matched(spark):
    heavy, short, bare = "Ann, Bob, Carl, Dan and Eve scored 3, 7, 9, 12 and 15 points. What is the mean?", "What is 12 times 7?", "add 1 2 3 4 5 6 7 8 9 10"
    rng = random.Random(1)
    filler = " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(50))
    docs = [(1, f"{filler} {heavy} {filler}"), (2, f"{filler}. {short} {filler}"), (3, f"{filler} what is 5 plus 6? {filler}"), (4, f"{filler} {bare} {filler}"), (5, f"{filler} add 1 2 3 4 {filler}"), (6, short)]
    assert leaks(spark, docs, [(1, heavy), (2, short), (3, bare), (4, "")]) == {(1, 1), (2, 2), (6, 2), (4, 3)}


def test_tiny_items_leave_clean_documents_alone(spark):
    rng = random.Random(3)
    say = lambda: " ".join(rng.choice("we saw Alice walk 10 km to town in 12 hours on a warm day with Bob".split()) for _ in range(30))
    docs = [(i, say()) for i in range(50)] + [(60, " 12 "), (61, "alice"), (62, "10  km"), (63, "12 13"), (64, "x 1 2 3 4 5 6 7 8 9 y"), (65, "x 1 2 3 4 5 6 7 8 0 y"), (66, "Bob")]
    items = [(1, "12"), (2, "Alice"), (3, "10 km"), (4, "1 2 3 4 5 6 7 8 9")]
    assert leaks(spark, docs, items) == {(60, 1), (61, 2), (62, 3), (64, 4)}


def edited_copies(n, edits, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(140)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(0, 140, 6), rng.choice(edits)):
            copy[at] = word()
        out.append(" ".join(copy))
    return out


def test_edited_copies_below_the_threshold_hardly_meet(spark):
    texts = edited_copies(1500, [5, 6, 7]) + edited_copies(40, [1, 2], 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = minhash.shingle_sets(df).withColumn("component", F.col("doc_id"))
    made = {(r["a"], r["b"]) for r in minhash.rare_partners(sets).collect()}
    of = [shingles(t) for t in texts]
    links = {(a, b) for a in range(len(of)) for b in range(a + 1, len(of)) if 100 * len(of[a] & of[b]) >= 75 * len(of[a] | of[b])}
    assert 40 < len(links) and links <= made and len(made) < len(links) + 3 * len(texts)


def test_links_between_components_are_all_found(spark):
    rng = random.Random(9)
    texts = edited_copies(60, [2, 4, 6, 9]) + [" ".join(t.split()[: rng.randint(30, 139)]) for t in edited_copies(60, [0, 1, 3])] + ["one two three"]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string")
    of = [shingles(t) for t in texts]
    component = [rng.choice([0, 1, 2 + i]) for i in range(len(of))]
    sets = minhash.shingle_sets(df).join(spark.createDataFrame(list(enumerate(component)), "doc_id long, component long"), "doc_id")
    made = {(r["a"], r["b"]) for r in minhash.rare_partners(sets).collect()}
    links = {(a, b) for a in range(len(of)) for b in range(a + 1, len(of)) if component[a] != component[b] and 100 * len(of[a] & of[b]) >= 75 * len(of[a] | of[b])}
    assert len(links) > 100 and links <= made and all(component[a] != component[b] for a, b in made)


def test_one_document_with_many_partners_and_ids_of_several_texts(spark):
    texts = edited_copies(400, [1])
    data = [(i + 10, t) for i, t in enumerate(texts)] + [(3, texts[0] + " more"), (3, "other words in a row here"), (900, "other words in a row here"), (901, "other words in a row there")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str) == brute(data)


def test_classes_meet_through_ids_of_several_texts(spark):
    x, y = "one two three four five six seven", "other words in a row here as well"
    data = [(3, y), (5, x), (5, y), (9, x), (11, ""), (11, x), (None, x), (12, None), (13, "alone")]
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect() if r["doc_id"] in (3, 5, 9, 11)} == {3}
    assert sorted(map(tuple, got.collect()), key=str) == brute([r for r in data])


def test_names_that_open_sentences_and_wide_blanks(spark):
    pears = "Alice buys 4 apples and 3 pears today. Alice eats 2 of the pears at lunch. How many pieces are left?"
    cards = "Mark has 5 cards. Mark buys 12 more. Mark loses 3 of them. How many are left?"
    rng = random.Random(1)
    filler = " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(50))
    changed = pears.replace("Alice", "Bob").replace("4", "7").replace("3", "5")
    docs = [
        (1, f"{filler}. {changed} {filler}"), (2, f"{filler}. {cards.replace('Mark', 'Tom').replace('12', '9')} {filler}"), (3, f"{filler} {changed.replace('Bob eats', 'Eve eats')} {filler}"),
        (4, pears.replace(" ", " \t\n    ")), (5, filler),
    ]
    assert leaks(spark, docs, [(1, pears), (2, cards)]) == {(1, 1), (2, 2), (4, 1)}
