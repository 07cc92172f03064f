"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Numbers, names and units of measure become typed placeholders, so a question whose values
were changed keeps its template. Windows of WINDOW template tokens are hashed and joined
with those of the benchmark; matches are gathered per (document, item, diagonal). For a
long enough match the aligned tokens are read again: templates must be equal token by token
inside matched windows, and each slot value of the item must stand for one value of the
document throughout (slot consistency), as it does in a re-parameterised question and does
not in text that only looks alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locus.llm.common import written

WINDOW, MIN_TOKENS, MIN_LITERALS = 8, 13, 4
#: Items with fewer words than this (slots left out) are no templates: others would share them by chance.
LEAST_WORDS = 3
TEMPLATE, VERBATIM, ALONE = 0, 1, 2
#: Benchmark windows that may be broadcast, about 40 bytes each; above, the join is shuffled.
BROADCAST_WINDOWS = 2_000_000
BROADCAST_IDS = 1_000_000
BLANK = r"[\x20\x09-\x0D]"
#: Blanks that are no single space.
WIDE = r"[\x09-\x0D]" + BLANK + r"*|\x20" + BLANK + "+"
#: The units of measure that become a placeholder after a number.
UNITS = ["km", "cm", "mm", "m", "kg", "mg", "g", "ml", "l", "ms", "s", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years",
         "meters", "miles", "feet", "inches", "pounds", "ounces", "dollars", "cents", "euros", "percent", "%"]
#: Capitalised words that open sentences and are no names there.
OPENERS = ["A", "After", "All", "An", "And", "Are", "As", "At", "Before", "But", "By", "Can", "Could", "Did", "Do", "Does", "Each", "Every", "Find", "For", "From", "Give", "Had", "Has", "Have", "He", "Her", "His", "How",
           "If", "In", "Is", "It", "Its", "Let", "Many", "Most", "No", "Not", "Now", "Of", "On", "One", "Or", "Our", "She", "Should", "Since", "So", "Some", "Such", "That", "The", "Their", "Then", "There", "These",
           "They", "This", "Those", "To", "Two", "Under", "Was", "We", "Were", "What", "When", "Where", "Which", "While", "Who", "Whose", "Why", "Will", "With", "Would", "You", "Your"]
_OPENERS = "|".join(OPENERS)
#: Blanks are single spaces where these are looked for. A capitalised word is a name after a word or comma, and elsewhere unless it is an opener.
NAME = r"(?=\p{Lu}\p{Ll})(?<![^ ])(?:(?<=[\p{L}\p{N},;] )|(?!(?:" + _OPENERS + r")(?![\p{L}'-])))\p{Lu}[\p{L}'-]+"
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
UNIT = r"(<num> ?)(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"


def tokens(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), BLANK + "+")


def template(text: Column) -> Column:
    """The canonical text: as many tokens as the text itself, placeholders <name>, <num> and <unit>."""
    spaced = F.regexp_replace(text, WIDE, " ")
    named = F.regexp_replace(spaced, NAME, "<name>")
    counted = F.regexp_replace(named, NUMBER, "<num>")
    return F.lower(F.regexp_replace(counted, UNIT, "$1<unit>"))


def is_slot(token: Column) -> Column:
    return token.contains("<name>") | token.contains("<num>") | token.contains("<unit>")


def windows(df: DataFrame, key: str, widths: list[int] | None = None, verbatim: bool = False) -> DataFrame:
    """key, width, pos and window hash of every run of template (or verbatim) tokens of the given widths (WINDOW by default)."""
    said = F.lower("text") if verbatim else template(F.col("text"))
    hashed = df.select(key, F.transform(tokens(said), lambda t: F.xxhash64(t)).alias("_h"))

    def hashes(width: int) -> Column:
        last = F.size("_h") - width
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(F.col("_h"), i + 1, width))))

    widths = widths or [WINDOW]
    if len(widths) == 1:
        return hashed.select(key, F.lit(widths[0]).alias("width"), F.posexplode(hashes(widths[0])).alias("pos", "window"))

    def of_width(width: int) -> Column:
        found = F.coalesce(hashes(width), F.array().cast("array<bigint>"))
        return F.transform(found, lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("pos"), h.alias("window")))

    every = [of_width(w) for w in widths]
    return hashed.select(key, F.explode(F.concat(*every)).alias("w")).select(key, "w.*")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the items with at least MIN_LITERALS tokens that are no slots, and how many of them a match needs."""
    toks = benchmark.select("item_id", "text", tokens(template(F.col("text"))).alias("_t"))
    toks = toks.withColumn("n_item", F.size("_t"))
    rich = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n_item") - WINDOW, F.lit(0))),
        lambda i: F.size(F.filter(F.slice(F.col("_t"), i + 1, WINDOW), lambda t: ~is_slot(t))) >= MIN_LITERALS,
    )
    rich = toks.filter(F.col("n_item") >= WINDOW).select("item_id", "n_item", F.posexplode(rich).alias("pos", "rich")).filter("rich").distinct()
    n_rich = rich.groupBy("item_id", "n_item").agg(F.count(F.lit(1)).alias("_n"))
    needed = n_rich.select("item_id", "n_item", F.least(F.least(F.lit(MIN_TOKENS), F.col("n_item") - 1) - WINDOW + 1, F.col("_n")).alias("n_needed"))
    rich = rich.join(needed, ["item_id", "n_item"])
    found = windows(benchmark, "item_id").join(rich, ["item_id", "pos"])
    return found.select("item_id", F.col("pos").alias("item_pos"), "width", "window", F.greatest("n_needed", F.lit(1)).alias("n_needed")).distinct()


def whole_items(benchmark: DataFrame) -> DataFrame:
    """Items without a window for item_windows: their length, how they are matched, and the hash of their first tokens, WINDOW at most.

    With at least LEAST_WORDS words that are no slots they are matched by their template; else
    verbatim from WINDOW tokens on, and shorter ones only as a document's whole text (the hash
    is then that of all tokens).
    """
    toks = benchmark.select("item_id", tokens(template(F.col("text"))).alias("_t"), tokens(F.lower("text")).alias("_v")).filter("_t[0] <> ''")
    literal = F.transform("_t", lambda t: F.when(is_slot(t), 0).otherwise(1))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    most = F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_t") - WINDOW, F.lit(0))), lambda i: total(F.slice(literal, i + 1, WINDOW))))
    few = total(literal) < LEAST_WORDS
    poor = toks.filter((F.size("_t") < WINDOW) | (most < MIN_LITERALS) | few)
    how = F.when(~few, TEMPLATE).when(F.size("_t") >= WINDOW, VERBATIM).otherwise(ALONE)
    hashes = F.transform(F.slice(F.when(few, F.col("_v")).otherwise(F.col("_t")), 1, WINDOW), lambda t: F.xxhash64(t))
    return poor.select("item_id", F.size("_t").alias("n_item"), how.alias("how"), F.least(F.size("_t"), F.lit(WINDOW)).alias("width"), F.xxhash64(hashes).alias("window")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, diagonal (document less item position) and the matched window count and ends.

    One pass over the documents looks for the windows of all items; for whole_items() that is
    their first tokens, all others to be compared.
    """
    of_items = written(item_windows(benchmark), "item-windows")
    whole = written(whole_items(benchmark), "whole-items")
    kinds = {(r["how"], r["width"]) for r in whole.select("how", "width").distinct().collect()}  # three times WINDOW at most
    widths = sorted({WINDOW} | {w for how, w in kinds if how == TEMPLATE})
    known = written(of_items.select("width", "window").union(whole.filter(F.col("how") == TEMPLATE).select("width", "window")).distinct(), "known-windows")
    few = known.count() <= BROADCAST_WINDOWS
    found = written(windows(docs, "doc_id", widths).join(F.broadcast(known) if few else known, ["width", "window"]), "found-windows")
    runs = found.join(of_items, ["width", "window"]).groupBy("doc_id", "item_id", "n_needed", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.countDistinct("item_pos").alias("n_windows"), F.min("item_pos").alias("first"), F.max("item_pos").alias("last"), F.sort_array(F.collect_set("item_pos")).alias("at")
    )
    runs = runs.filter(F.col("n_windows") >= F.col("n_needed")).withColumn("how", F.lit(TEMPLATE))
    at = F.sequence(F.lit(0), F.greatest(F.col("n_item") - WINDOW, F.lit(0)))

    def whole_runs(met: DataFrame) -> DataFrame:
        return met.select(
            "doc_id", "item_id", F.size(at).alias("n_needed"), F.col("pos").alias("diagonal"), F.size(at).cast("long").alias("n_windows"), F.lit(0).alias("first"), (F.col("n_item") - WINDOW).alias("last"), at.alias("at"), "how"
        ).distinct()

    out = runs.unionByName(whole_runs(found.join(whole.filter(F.col("how") == TEMPLATE), ["width", "window"])))
    if any(how == VERBATIM for how, _ in kinds):
        said = whole.filter(F.col("how") == VERBATIM)
        out = out.unionByName(whole_runs(windows(docs, "doc_id", [WINDOW], verbatim=True).join(said, ["width", "window"])))
    if any(how == ALONE for how, _ in kinds):
        toks = tokens(F.lower("text"))
        short = docs.select("doc_id", toks.alias("_v")).filter(F.size("_v") < WINDOW)
        short = short.select("doc_id", F.size("_v").alias("width"), F.xxhash64(F.transform("_v", lambda t: F.xxhash64(t))).alias("window"), F.lit(0).alias("pos"))
        out = out.unionByName(whole_runs(short.join(whole.filter(F.col("how") == ALONE), ["width", "window"])))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document, item) whose template stands in the document with consistent slots.

    doc_id, item_id, n_tokens (template tokens matched on the best diagonal), n_slots (slot
    tokens among them), item_pos and doc_pos (its first tokens). A match needs 13 tokens, or
    all but one of a shorter item, or, of an item with fewer windows that hold MIN_LITERALS
    words, all of these; an item without any, as one of fewer than 8 tokens, is matched as a
    whole. Items of fewer than LEAST_WORDS words that are no slots ("12", "Alice") are matched
    verbatim, and below 8 tokens only where a document's whole text is the item. Null or
    empty texts match nothing, rows without doc_id or item_id are left out. Rows that repeat a
    doc_id are judged together, each of its texts against each item. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    runs = written(matches(docs, items), "template-runs")
    ids = written(runs.select("doc_id").distinct(), "template-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").distinct()

    def both(df: DataFrame, key: str, to: str) -> DataFrame:
        return df.select(key, tokens(F.col("text")).alias(f"{to}_raw"), tokens(template(F.col("text"))).alias(f"{to}_tok"))

    aligned = runs.join(both(items, "item_id", "i"), "item_id").join(both(texts, "doc_id", "d"), "doc_id")
    # Items shorter than a window end before it does.
    covered = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + WINDOW - 1))))
    inside = F.filter(covered, lambda p: p <= F.col("last") + WINDOW - 1)
    pairs = F.transform(
        "_inside",
        lambda p: F.struct(
            F.get("i_tok", p).alias("it"), F.get("d_tok", p + F.col("diagonal")).alias("dt"), F.get("i_raw", p).alias("iv"), F.get("d_raw", p + F.col("diagonal")).alias("dv")
        ),
    )
    aligned = aligned.withColumn("_inside", inside).withColumn("_pairs", pairs)
    by_template = F.forall("_pairs", lambda x: x["it"].eqNullSafe(x["dt"]))
    verbatim = F.forall("_pairs", lambda x: F.lower(x["iv"]).eqNullSafe(F.lower(x["dv"])))
    same = F.when(F.col("how") == TEMPLATE, by_template).otherwise(verbatim & ((F.col("how") == VERBATIM) | (F.size("d_raw") == F.size("i_raw"))))
    slots = F.filter("_pairs", lambda x: is_slot(x["it"]))
    aligned = aligned.filter(same).withColumn("_slots", F.transform(slots, lambda x: F.struct(x["iv"].alias("v"), x["dv"].alias("u"))))
    consistent = F.size(F.array_distinct("_slots")) == F.size(F.array_distinct(F.transform("_slots", lambda x: x["v"])))
    rows = aligned.filter(consistent).select(
        "doc_id", "item_id",
        F.struct(
            F.size("_inside").alias("n_tokens"), (-(F.col("first") + F.col("diagonal"))).alias("before"), (-F.col("first")).alias("from"), F.size("_slots").alias("n_slots")
        ).alias("m"),
    )
    best = rows.groupBy("doc_id", "item_id").agg(F.max("m").alias("m"))
    return best.select("doc_id", "item_id", "m.n_tokens", "m.n_slots", (-F.col("m.from")).alias("item_pos"), (-F.col("m.before")).alias("doc_pos"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows without doc_id stay. All columns are kept."""
    found = written(contaminated(docs, benchmark).select(F.col("doc_id").alias("_leak_id")).distinct(), "leaks")
    few = found.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(found) if few else found, docs["doc_id"] == F.col("_leak_id"), "left_anti")


_UNITS = "|".join(sorted(UNITS, key=len, reverse=True))


def _toks(key: str, view: str) -> str:
    return f"""
  SELECT {key}, ws, list_transform(list_transform(nums, lambda t, i: CASE WHEN i > 1 AND regexp_matches(nums[i - 1], '<num>$') AND regexp_matches(t, '^({_UNITS})([^\\p{{L}}\\p{{N}}]|$)')
      THEN regexp_replace(t, '^({_UNITS})([^\\p{{L}}\\p{{N}}]|$)', '<unit>\\2') ELSE t END),
      lambda t: lower(regexp_replace(t, '<num>({_UNITS})([^\\p{{L}}\\p{{N}}]|$)', '<num><unit>\\2'))) AS ts
  FROM (SELECT *, list_transform(list_transform(ws, lambda t, i: CASE WHEN (i > 1 AND regexp_matches(ws[i - 1], '[\\p{{L}}\\p{{N}},;]$')) OR NOT regexp_matches(t, '^({_OPENERS})([^\\p{{L}}''-]|$)')
      THEN regexp_replace(t, '^\\p{{Lu}}\\p{{Ll}}[\\p{{L}}''-]*', '<name>') ELSE t END), lambda t: regexp_replace(t, '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*', '<num>', 'g')) AS nums
      FROM (SELECT {key}, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM {view} WHERE text IS NOT NULL))
"""


OP6_SQL = f"""
WITH d AS ({_toks("doc_id", "documents")}), b AS ({_toks("item_id", "benchmark")}),
dw AS (SELECT doc_id, unnest(generate_series(0, len(ts) - {WINDOW})) AS pos, ts FROM d),
bw AS (SELECT item_id, len(ts) AS n_item, unnest(generate_series(0, len(ts) - {WINDOW})) AS item_pos, ts FROM b),
dg AS (SELECT doc_id, pos, array_to_string(ts[pos + 1:pos + {WINDOW}], ' ') AS g FROM dw),
bg AS (SELECT item_id, n_item, item_pos, array_to_string(ts[item_pos + 1:item_pos + {WINDOW}], ' ') AS g FROM bw
       WHERE len(list_filter(ts[item_pos + 1:item_pos + {WINDOW}], lambda t: NOT regexp_matches(t, '<name>|<num>|<unit>'))) >= {MIN_LITERALS}),
m AS (SELECT doc_id, item_id, n_item, pos - item_pos AS diagonal, list(DISTINCT item_pos) AS ats FROM dg JOIN bg USING (g) GROUP BY ALL),
r AS (SELECT * FROM m WHERE len(ats) >= least({MIN_TOKENS}, n_item - 1) - {WINDOW} + 1),
p AS (SELECT DISTINCT doc_id, item_id, diagonal, unnest(ats) + w AS p FROM r, generate_series(0, {WINDOW} - 1) t(w)),
a AS (SELECT p.doc_id, p.item_id, diagonal, count(*) AS n_tokens, min(p) AS item_pos, count(*) FILTER (regexp_matches(b.ts[p + 1], '<name>|<num>|<unit>')) AS n_slots,
        count(DISTINCT b.ws[p + 1]) FILTER (regexp_matches(b.ts[p + 1], '<name>|<num>|<unit>')) AS n_values,
        count(DISTINCT (b.ws[p + 1], d.ws[p + diagonal + 1])) FILTER (regexp_matches(b.ts[p + 1], '<name>|<num>|<unit>')) AS n_pairs
      FROM p JOIN d ON d.doc_id = p.doc_id JOIN b ON b.item_id = p.item_id GROUP BY ALL)
SELECT doc_id, item_id, n_tokens::INTEGER AS n_tokens, n_slots::INTEGER AS n_slots, item_pos::INTEGER AS item_pos, (item_pos + diagonal)::INTEGER AS doc_pos
FROM a WHERE n_values = n_pairs QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_tokens DESC, item_pos + diagonal, item_pos) = 1
"""
