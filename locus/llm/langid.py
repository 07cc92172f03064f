"""Language identification by interpolated Kneser-Ney character models.

Learning: up to about SAMPLE_DOCS whole labelled documents per language (chosen by a hash of
doc_id; the bound is a parameter) are counted on the executors into distinct 4-grams per
language, a table bounded by the sample. From it come, per language, the interpolated
Kneser-Ney probabilities of orders 4 to 1: raw counts at the top, continuation counts (distinct
left neighbours) below, one absolute discount per order. The models are stored together as
sorted arrays of gram hashes with one row of log-probabilities per gram, and sorted arrays of
context hashes with back-off weights.

Scoring: every whole text is lower-cased, runs of other characters than letters become one
space, each position is looked up by binary search (backing off where a gram is unknown), and
the language with the lowest cross-entropy per character wins. Rejection is calibrated on a
tenth of the sample that isn't counted: a text is rejected if its cross-entropy lies above
mean + SIGMAS standard deviations of its language's, the deviation allowing for short texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locus.llm.common import release, unit_hash
from locus.llm.shingles import mixed

ORDER, SAMPLE_DOCS, CALIBRATE, SIGMAS, CHUNK = 4, 2000, 0.1, 8.0, 1 << 17
SPACE, UNKNOWN = 32, "und"
PRIVATE, PRIVATE_SIZE = 0xE000, 0x1900
#: Languages with fewer labelled documents are calibrated by FOLDS models of their own, and their spread
#: is taken with PRIOR more documents that deviate by a tenth of the mean.
SMALL, FOLDS, PRIOR = 300, 5, 10
#: What a batch of texts holds on its way to Python; learn() sets this for the session, as texts are scored when its caller runs the plan.
BATCH = "8m"


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts on end, the text each belongs to, and the letters of each text."""
    joined = "\0".join(t.replace("\0", " ").lower() for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = code == 0
    owner = np.cumsum(ends)
    is_letter = letters()[code]
    first = np.ones(len(code), bool)
    first[1:] = is_letter[:-1] | ends[:-1]
    keep = (is_letter | first) & ~ends
    # letters beyond 16 bits take numbers of the private range, which no letter below has
    low = np.where(code > 0xFFFF, PRIVATE + code % PRIVATE_SIZE, code)
    code = np.where(is_letter, low, SPACE)[keep].astype(np.uint64)
    return code, owner[keep], np.bincount(owner[is_letter], minlength=len(texts))


def grams(code: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """At each symbol the last ORDER symbols, 16 bits each; before a text there are spaces."""
    out = code.copy()
    for k in range(1, ORDER):
        before = np.full(len(code), SPACE, np.uint64)
        same = owner[k:] == owner[:-k] if len(code) > k else np.empty(0, bool)
        before[k:][same] = code[:-k][same]
        out |= before << np.uint64(16 * k)
    return out


def suffix(packed: np.ndarray, order: int) -> np.ndarray:
    return packed & np.uint64((1 << (16 * order)) - 1)


def hashed(packed: np.ndarray, order: int) -> np.ndarray:
    return mixed(packed + np.uint64(order * 0xD6E8FEB86659FD93 % (1 << 64)))


class Table:
    """Rows of numbers by gram hash, in a sorted array."""

    def __init__(self, packed: np.ndarray, order: int, rows: np.ndarray):
        keys = hashed(packed, order)
        at = np.argsort(keys)
        self.keys, self.rows, self.order = keys[at], rows[at].astype(np.float32), order

    def find(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = hashed(packed, self.order)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


class Models:
    """All languages' models over the union of their grams."""

    def __init__(self, counts: pd.DataFrame):
        """counts: lang, gram (packed, as int64) and n."""
        self.langs = sorted(counts["lang"].unique())
        self.probs: dict[int, Table] = {}
        self.weights: dict[int, Table] = {}
        self.limits = np.full((len(self.langs), 3), np.nan)
        if not self.langs:
            return
        per = {lang: (g["gram"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy(np.float64)) for lang, g in counts.groupby("lang")}
        levels: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        for lang, (gram, n) in per.items():
            levels[lang] = {ORDER: (gram, n)}
            for order in range(ORDER - 1, 0, -1):
                shorter, kinds = np.unique(suffix(levels[lang][order + 1][0], order), return_counts=True)
                levels[lang][order] = (shorter, kinds.astype(np.float64))
        n_symbols = len(np.unique(np.concatenate([levels[x][1][0] for x in self.langs])))
        for order in range(1, ORDER + 1):
            union = np.unique(np.concatenate([levels[x][order][0] for x in self.langs]))
            contexts = np.unique(union >> np.uint64(16))
            p, weight = np.zeros((len(union), len(self.langs))), np.ones((len(contexts), len(self.langs)))
            for j, lang in enumerate(self.langs):
                gram, n = levels[lang][order]
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = ones / (ones + 2 * twos) if ones else 0.5
                own, inverse = np.unique(gram >> np.uint64(16), return_inverse=True)
                total = np.bincount(inverse, n)
                weight[np.searchsorted(contexts, own), j] = discount * np.bincount(inverse) / total
                p[np.searchsorted(union, gram), j] = np.maximum(n - discount, 0) / total[inverse]
            lower = np.exp(self._log_p(suffix(union, order - 1), order - 1)) if order > 1 else np.full((len(union), len(self.langs)), 1 / (n_symbols + 1))
            p += weight[np.searchsorted(contexts, union >> np.uint64(16))] * lower
            self.probs[order] = Table(union, order, np.log(p))
            self.weights[order] = Table(contexts, order, np.log(weight))
        self.floor = np.log(1 / (n_symbols + 1))

    def _log_p(self, packed: np.ndarray, order: int) -> np.ndarray:
        """Log-probabilities of the last symbol given those before, per language."""
        if order == 0:
            return np.full((len(packed), len(self.langs)), self.floor, np.float32)
        at, hit = self.probs[order].find(packed)
        out = self.probs[order].rows[at]
        if not hit.all():
            miss = packed[~hit]
            back = self._log_p(suffix(miss, order - 1), order - 1)
            known, seen = self.weights[order].find(miss >> np.uint64(16))
            out[~hit] = back + np.where(seen[:, None], self.weights[order].rows[known], 0)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (texts by languages), symbols and letters of each text."""
        code, owner, n_letters = symbols(texts)
        n = np.bincount(owner, minlength=len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        if len(code):
            log_p = self._log_p(grams(code, owner), ORDER)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[starts]] = np.add.reduceat(log_p, starts, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n, n_letters

    def predict(self, texts: list[str]) -> pd.DataFrame:
        """lang, score, rejected, entropy and n_symbols of each text."""
        if not self.langs:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "rejected": True, "entropy": 0.0, "n_symbols": 0})
        h, n, n_letters = self.entropies(texts)
        best = h.argmin(axis=1)
        lowest = h[np.arange(len(h)), best]
        sharp = np.minimum(n, 20)[:, None]
        score = 1 / np.exp(-sharp * (h - lowest[:, None])).sum(axis=1)
        mean, variance, per_symbol = self.limits[best].T
        rejected = lowest > mean + SIGMAS * np.sqrt(variance + per_symbol / np.maximum(n, 1))
        none = n_letters == 0
        return pd.DataFrame({
            "lang": np.where(none, UNKNOWN, np.array(self.langs, object)[best]),
            "score": np.where(none, 0.0, score),
            "rejected": rejected | none,
            "entropy": np.where(none, 0.0, lowest),
            "n_symbols": n,
        })


def chunks(texts: list[str]) -> Iterator[list[str]]:
    out, size = [], 0
    for text in texts:
        out.append(text)
        size += len(text)
        if size >= CHUNK:
            yield out
            out, size = [], 0
    if out:
        yield out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Models from docs(doc_id, text, lang): rows that aren't held out, with text and lang."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    usable = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return Models(pd.DataFrame({"lang": [], "gram": [], "n": []}))
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample_docs / n))])
    sample = usable.filter(unit_hash("language sample", F.col("doc_id")) < F.element_at(rate, F.col("lang")))
    apart = unit_hash("language calibration", F.col("doc_id")) < CALIBRATE

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for part in chunks(list(texts)):
                    code, owner, _ = symbols(part)
                    gram, n = np.unique(grams(code, owner), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})

    small = [lang for lang, n in sorted(sizes.items()) if n < SMALL]
    is_small = F.col("lang").isin(small) if small else F.lit(False)
    counts = sample.filter(~apart | is_small).select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    models = Models(counts.toPandas())
    if models.langs:
        seen = sample.filter(apart & ~is_small).select("lang", predictor(models)(F.col("text")).alias("p")).filter("lang = p.lang AND p.n_symbols > 0").select("lang", "p.entropy", "p.n_symbols")
        if small:  # a few hundred documents of each at most
            seen = seen.unionByName(usable.filter(is_small).groupBy("lang").applyInPandas(crossed, "lang string, entropy double, n_symbols long"))
        mean = seen.groupBy("lang").agg(F.avg("entropy").alias("m"), F.var_pop("entropy").alias("v"), F.count(F.lit(1)).alias("k"))
        spread = seen.join(F.broadcast(mean), "lang").groupBy("lang", "m", "v", "k").agg(F.avg(F.pow(F.col("entropy") - F.col("m"), 2) * F.col("n_symbols")).alias("s"))
        for r in spread.collect():
            v = (r["k"] * r["v"] + PRIOR * (0.1 * r["m"]) ** 2) / (r["k"] + PRIOR) if r["lang"] in small else r["v"]
            models.limits[models.langs.index(r["lang"])] = r["m"], v, r["s"]
    return models


def crossed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entropy and symbols of one small language's documents, each by a model of the other folds."""
    pdf = pdf.sort_values(["doc_id", "text"], na_position="last").reset_index(drop=True)
    out = []
    for fold in range(FOLDS):
        own, rest = pdf[pdf.index % FOLDS == fold], pdf[pdf.index % FOLDS != fold]
        if not len(own) or not len(rest):
            continue
        code, owner, _ = symbols(list(rest["text"]))
        if not len(code):
            continue
        gram, n = np.unique(grams(code, owner), return_counts=True)
        h, size, _ = Models(pd.DataFrame({"lang": "own", "gram": gram.view(np.int64), "n": n})).entropies(list(own["text"]))
        out.append(pd.DataFrame({"lang": own["lang"].to_numpy(), "entropy": h[:, 0], "n_symbols": size})[size > 0])
    none = pd.DataFrame({"lang": pd.Series([], dtype=object), "entropy": pd.Series([], dtype=float), "n_symbols": pd.Series([], dtype="int64")})
    return pd.concat(out) if out else none


def predictor(models: Models):
    """A column function: text to (lang, score, rejected, entropy, n_symbols). A null text has no language."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(models)  # bounded by the sample

    @F.pandas_udf("lang string, score double, rejected boolean, entropy double, n_symbols long")
    def predict(text: pd.Series) -> pd.DataFrame:
        texts = [x if isinstance(x, str) else "" for x in text]
        found = [shared.value.predict(part) for part in chunks(texts)]
        release()
        return pd.concat(found, ignore_index=True) if found else shared.value.predict([])

    return predict


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """docs with lang_pred, score, rejected and entropy; columns of these names are replaced.

    Texts that are null or hold no letter are `und` with score 0, and rejected. A text in no
    learned language gets the nearest one and is rejected. Rejection needs two labelled rows of
    the language, else nothing of it is rejected. Repeated rows get equal answers; an empty
    table gives no rows. Without any labelled row everything is `und`.
    """
    docs = docs.drop("lang_pred", "score", "rejected", "entropy")
    p = docs.withColumn("_p", predictor(models)(F.col("text").cast(T.StringType())))
    return p.withColumns({"lang_pred": F.col("_p.lang"), "score": F.col("_p.score"), "rejected": F.col("_p.rejected"), "entropy": F.col("_p.entropy")}).drop("_p")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that language identification rejects; all columns are kept."""
    found = identify(docs.withColumnsRenamed({c: f"_own_{c}" for c in ("lang_pred", "score", "rejected", "entropy") if c in docs.columns}), learn(docs))
    kept = found.filter(~F.col("rejected")).drop("lang_pred", "score", "rejected", "entropy")
    return kept.withColumnsRenamed({c: c.removeprefix("_own_") for c in kept.columns if c.startswith("_own_")}).select(docs.columns)


def op5_kneser_ney(docs: DataFrame) -> DataFrame:
    narrow = docs.select("doc_id", "text", "lang")
    out = identify(narrow.select("doc_id", "text"), learn(narrow))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "entropy")
