"""Token counts under a byte-pair vocabulary, by rank-synchronous merging of arrays.

A text is cut at white space, which this kind of vocabulary drops; every distinct chunk of a
batch of texts is cut into pre-tokens by the tokenizer library's own normaliser and splitter,
and all pre-tokens are laid on end in one array of symbols. In each round every sequence applies
its pair of lowest rank at all places at once (left to right where places overlap) and sequences
without a pair left retire with the number of symbols they have. A pre-token is first cut
between any two symbols that stand side by side in no token of the vocabulary: no merge crosses
such a place, so a very long run of letters is many short sequences.

A task holds at most twice STRETCH bytes of text as chunks (a longer chunk is held alone), and at most HELD counts of chunks seen before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus.llm.common import text_bytes

LIMIT, STRETCH, HELD, LONGEST_HELD = 2048, 1 << 20, 1 << 19, 64
#: White space of ASCII; the vocabulary's splitter drops it, so texts may be cut there.
BLANKS = re.compile(rb"[\x09-\x0D\x20]")
NONE = np.iinfo(np.int64).max


class Merges:
    """The merge table as sorted arrays: pairs of symbols as one key, their ranks and results."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str):
        self.size = max(vocab.values()) + 1
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # a pair that a merge brings about never ranks below that merge: places may be merged at once
        rank_of = np.full(self.size, -1, np.int64)
        np.maximum.at(rank_of, made, np.arange(len(merges)))
        if (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(merges))).any():
            raise ValueError("the merges aren't in the order in which their parts arise")
        self.plain, self.last = (self._codes(vocab, end) for end in ("", suffix))
        self.beside = self._beside(vocab, suffix)

    @staticmethod
    def _codes(vocab: dict[str, int], end: str) -> np.ndarray:
        """Symbol of each code point of the byte alphabet."""
        codes = np.full(512, -1, np.int64)
        for token, i in vocab.items():
            if len(token) == 1 + len(end) and token.endswith(end) and ord(token[0]) < 512:
                codes[ord(token[0])] = i
        return codes

    def _beside(self, vocab: dict[str, int], suffix: str) -> np.ndarray:
        """Which two code points of the byte alphabet (512 more for the last of a word) stand side by side in a token."""
        beside = np.zeros((1024, 1024), bool)
        for token in vocab:
            ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            codes = [ord(c) for c in (token[: -len(suffix)] if ends else token)]
            if not suffix or ends:
                codes[-1] += 512 * bool(suffix)
            for a, b in zip(codes, codes[1:]):
                beside[a, b] = True
        return beside

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' symbols on end, the starts of the sequences they are cut into, and each sequence's word."""
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes) - 1
        out, side = self.plain[codes], codes.copy()
        out[ends] = self.last[codes[ends]]
        if (self.last != self.plain).any():
            side[ends] += 512
        if (out < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.beside[side[:-1], side[1:]]
        cut[ends[:-1] + 1] = True
        starts = np.flatnonzero(cut)
        return out, starts, np.repeat(np.arange(len(words)), sizes)[starts]

    def survivors(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many symbols each sequence has when no pair of it can be merged."""
        counts, alive = np.zeros(len(starts), np.int64), np.arange(len(starts))
        sizes = np.diff(np.append(starts, len(symbols)))
        while len(alive):
            starts = np.cumsum(sizes) - sizes
            ranks = np.full(len(symbols), NONE)
            pairs = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            known = self.keys[at] == pairs
            ranks[:-1][known] = self.ranks[at[known]]
            ranks[starts + sizes - 1] = NONE
            best = np.minimum.reduceat(ranks, starts)
            stays = best < NONE
            counts[alive[~stays]] = sizes[~stays]
            held = np.repeat(stays, sizes)
            symbols, ranks, alive, sizes, best = symbols[held], ranks[held], alive[stays], sizes[stays], best[stays]
            if not len(alive):
                break
            hit = ranks == np.repeat(best, sizes)
            places = np.flatnonzero(hit)
            fresh = np.append(True, np.diff(places) > 1)  # "aaa": every other place of a run
            first = places[fresh][np.cumsum(fresh) - 1]
            places = places[(places - first) % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = self.made[ranks[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            sizes = np.add.reduceat(keep, np.cumsum(sizes) - sizes)
            symbols = symbols[keep]
        return counts


class TokenCounter:
    """Counts tokens of texts as the tokenizer library does for a word-level byte-pair file (.json)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec["pre_tokenizer"]
        first = splitter["pretokenizers"][0] if splitter["type"] == "Sequence" else splitter
        drops = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "")
        whole = not (model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"))
        if model["type"] != "BPE" or not drops or not whole:
            raise ValueError(f"{path}: only byte-pair vocabularies that drop white space between words")
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.merges = Merges(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]], model.get("end_of_word_suffix") or "")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.held: dict[bytes, int] = {}

    def _solve(self, chunks: list[bytes]) -> np.ndarray:
        counts, words, owners = np.zeros(len(chunks), np.int64), [], []
        for i, chunk in enumerate(chunks):
            parts = self.special.split(chunk.decode())
            counts[i] = len(parts) - 1
            for part in parts:
                found = [w for w, _ in self.split(self.normalise(part))] if part else []
                words += found
                owners += [i] * len(found)
        if words:
            symbols, starts, word = self.merges.symbols(words)
            np.add.at(counts, np.array(owners)[word], self.merges.survivors(symbols, starts))
        return counts

    def _stretches(self, batch: list[list[bytes]]) -> list[int]:
        """Tokens of each list of chunks; chunks not met before are solved together."""
        held, distinct = self.held, set().union(*batch)
        if len(held) + len(distinct) > HELD:
            held.clear()
        new = [c for c in distinct if c not in held]
        held.update(zip(new, self._solve(new).tolist()))
        totals = [sum([held[c] for c in chunks]) for chunks in batch]
        for c in new:
            if len(c) > LONGEST_HELD:
                del held[c]
        return totals

    def counts(self, texts: Iterable[bytes | None]) -> list[int]:
        totals, batch, owners, size = [], [], [], 0

        def settle() -> None:
            for i, n in zip(owners, self._stretches(batch)):
                totals[i] += n

        for i, text in enumerate(texts):
            totals.append(0)
            at = 0
            while text and at < len(text):
                blank = BLANKS.search(text, at + STRETCH)
                end = blank.start() if blank else len(text)
                batch.append(text[at:end].split())
                owners.append(i)
                size, at = size + end - at, end
                if size >= STRETCH:
                    settle()
                    batch, owners, size = [], [], 0
        settle()
        return totals


@lru_cache(2)  # a worker reads the file once
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to docs.

    tokenizer is a .json file of a byte-pair vocabulary whose splitter drops white space; it has
    to be readable on every executor. No begin or end tokens are added; special strings inside a
    text count as the one token that they are for the library. Nothing is truncated. A null or
    empty text has zero bytes and tokens. Rows are judged one by one, so repeated and null ids
    stay as they are; an empty table gives an empty result. Columns of docs that have the name
    of a result are replaced, all others are kept.
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = counter(tokenizer).counts
        for texts in batches:
            yield pd.Series(counts(texts), dtype="int64")

    text = F.col(text_col).cast("string")
    return docs.withColumns({"n_tokens": n_tokens(text.cast("binary")), "n_bytes": text_bytes(text)}).withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_counts(docs.select("doc_id", "text"), tokenizer).select("doc_id", "n_bytes", "n_tokens", "over_limit")
