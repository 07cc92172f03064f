"""Column functions on DNA strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from locus.functions.rand import base, pick_index, shuffle_key

BASES = "ACGT"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside other functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def at(seq: Column, i: Column) -> Column:
    """The base at 0-based place i."""
    return F.substring(seq, i + 1, F.lit(1))


def places(n: Column) -> Column:
    """0 to n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def letters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def one_hot(seq: Column, unknown: str = "uniform") -> Column:
    """Four rows A, C, G, T of len(seq) numbers on end; other letters are .25 each, or 0 (`zero`)."""
    other = 0.25 if unknown == "uniform" else 0.0
    chars = letters(F.upper(seq))

    def row(b: str) -> Column:
        return F.transform(chars, lambda c: F.when(c == b, 1.0).when(c.isin(*BASES), 0.0).otherwise(other).cast("float"))

    return F.concat(*[row(b) for b in BASES])


def one_hot_by_base(seq: Column) -> Column:
    """The transposed layout: four numbers per base, 0 for other letters."""
    return F.flatten(F.transform(letters(F.upper(seq)), lambda c: F.array(*[(c == b).cast("float") for b in BASES])))


def decode_one_hot(tensor: Column) -> Column:
    """The string of a one_hot() array; a column of equal numbers is N."""
    n = (F.size(tensor) / 4).cast("int")

    def letter(i: Column) -> Column:
        column = F.array(*[F.element_at(tensor, (i + 1 + n * k).cast("int")) for k in range(4)])
        best = F.array_max(column)
        return F.when(best == F.array_min(column), "N").otherwise(F.substring(F.lit(BASES), F.array_position(column, best).cast("int"), F.lit(1)))

    return F.array_join(F.transform(places(n), letter), "")


def n_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.length(F.regexp_replace(seq, "[^N]", "")) / F.length(seq)).otherwise(0.0)


def gc_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.length(F.regexp_replace(seq, "[^GC]", "")) / F.length(seq))


def cpg_count(seq: Column) -> Column:
    return ((F.length(seq) - F.length(F.replace(seq, F.lit("CG"), F.lit("")))) / 2).cast("int")


def cpg_obs_exp(seq: Column) -> Column:
    """CpG count times length over C count times G count; null where C or G is missing."""
    c, g = (F.length(F.regexp_replace(seq, f"[^{b}]", "")) for b in "CG")
    return F.when((c > 0) & (g > 0), cpg_count(seq) * F.length(seq) / (c * g))


def longest_run(seq: Column) -> Column:
    """Length of the longest run of one letter, 0 for an empty string."""
    runs = F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def occurrences(seq: Column, word: str) -> Column:
    """Places of a word, overlaps included."""
    return F.filter(places(F.length(seq) - len(word) + 1), lambda i: F.substring(seq, i + 1, F.lit(len(word))) == word)


def swap_dinucleotides(seq: Column, source: str, count: int, seed: int, key: Column) -> Column:
    """Struct of seq with up to `count` randomly chosen occurrences of `source` reversed, and swaps made."""
    if len(source) != 2 or source[0] == source[1]:
        raise ValueError("source must be two different bases")
    found = F.array_sort(F.transform(occurrences(seq, source), lambda i: F.struct(shuffle_key(seed, key, i).alias("k"), i.alias("i"))))
    chosen = F.transform(F.slice(found, 1, count), lambda x: x["i"])

    def rebuilt(chosen: Column) -> Column:
        def letter(i: Column) -> Column:
            return F.when(F.array_contains(chosen, i), source[1]).when(F.array_contains(chosen, i - 1), source[0]).otherwise(at(seq, i))

        return F.struct(F.array_join(F.transform(places(F.length(seq)), letter), "").alias("seq"), F.size(chosen).alias("swaps"))

    return let(chosen, rebuilt)


def shuffle_spans(seq: Column, spans: Column, seed: int, key: Column) -> Column:
    """seq with the bases inside each (start, end) span put in random order, span after span."""

    def one(acc: Column, span: Column) -> Column:
        width = span["end"] - span["start"]
        drawn = F.array_sort(F.transform(places(width), lambda i: F.struct(shuffle_key(seed, key, span["start"], i).alias("k"), at(acc, span["start"] + i).alias("c"))))
        mixed = F.array_join(F.transform(drawn, lambda x: x["c"]), "")
        return F.concat(F.substring(acc, F.lit(1), span["start"]), mixed, F.substring(acc, span["end"] + 1, F.length(acc)))

    return F.aggregate(spans, seq, one)


def control_spans(spans: Column, length: Column, seed: int, key: Column, tries: int = 100, off: Column | None = None) -> Column:
    """Spans of the same widths off all given ones (or those in `off`) and off each other; one that finds no place in `tries` is left out.

    A start is drawn below max(1, length - width), so the last legal place is never taken.
    """

    def overlaps(s: Column, w: Column, with_: Column) -> Column:
        return F.exists(with_, lambda x: (s < x["end"]) & (s + w > x["start"]))

    def fold(given: Column) -> Column:
        def one(acc: Column, span: Column) -> Column:
            w = span["end"] - span["start"]
            starts = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: pick_index(seed, F.greatest(F.lit(1), length - w), key, span["start"], t))
            free = F.filter(starts, lambda s: ~overlaps(s, w, given if off is None else off) & ~overlaps(s, w, acc) & (s + w <= length))
            return F.concat(acc, F.transform(F.slice(free, 1, 1), lambda s: F.struct(s.alias("start"), (s + w).alias("end"))))

        return F.aggregate(given, F.slice(given, 1, 0), one)

    return let(spans, fold)


def random_bases(n: Column, seed: int, *key: Column | str | int) -> Column:
    return F.array_join(F.transform(places(n), lambda i: base(seed, *key, i)), "")


def occlude(seq: Column, start: Column, width: int, seed: int, key: Column) -> Column:
    """seq with the tile from `start` replaced by random bases; the last tile may be shorter."""
    size = F.least(F.lit(width), F.length(seq) - start)
    return F.concat(F.substring(seq, F.lit(1), start), random_bases(size, seed, key, start), F.substring(seq, start + size + 1, F.length(seq)))
