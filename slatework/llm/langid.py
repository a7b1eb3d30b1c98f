"""Language identification by interpolated Kneser-Ney character language models.

Each language has one model over the letters of words (lower case, a boundary before and after each word); contexts do not
cross words, so a word's cost is a constant and is cached. N-grams are kept as sorted arrays of 64-bit hashes with their
discounted probability, contexts as sorted arrays with their back-off weight. A text gets the language with the lowest
cross-entropy per letter; ties go to the smaller name. Texts without letters are `und`.

Learning. The n-grams of the longest order are counted over all labelled texts; continuation counts, discounts and context
totals of every order are aggregations over all of them. Of the finished probabilities a model stores ENTRIES // languages
of each order, the most frequent ones; the weight of a context is what its stored n-grams leave, so what isn't stored is
backed off and nothing is learnt from a part of the counts. More than MOST_LANGUAGES languages raise.

Calibrated rejection. The models learn from nine in ten of the labelled texts (by a hash of the text), and the tenth, which
they haven't seen, tells what cross-entropy texts of a language reach: with x the bits per letter above the language's mean,
times the root of the letters (SURE_LETTERS at most), the limit is the QUANTILE of x over the rightly predicted texts, times
1 + margin. So no single text decides, and short texts, whose cross-entropy varies more, aren't rejected for being short. A
language without such texts gets the most lenient limit of the others, or none.

Null texts, empty texts and texts without letters are `und` with score 0 and are rejected. Without any labelled text all are
`und`. Extra columns are ignored; equal texts get equal predictions.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, limit_arrow, materialize, most_frequent, per_process

#: Letters of an n-gram; probabilities of one order that the models of all languages store together; languages at most;
#: distinct words that a counting task holds.
ORDER, ENTRIES, MOST_LANGUAGES, FLUSH_WORDS = 4, 1_000_000, 256, 100_000
#: Words of the cache.
CACHE_WORDS = 150_000
#: Letters that count towards the score's certainty and the rejection, at most.
SURE_LETTERS = 200
#: Of how many labelled texts one calibrates the rejection; the quantile of its limit; the alphabet that unseen letters share.
FOLDS, QUANTILE, ALPHABET = 10, 0.999, 2_000
EDGE = "\x02"
_LETTERS = regex.compile(r"\p{L}+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(chunk: str) -> list[str]:
    low = chunk.lower()
    if low.isalpha():
        return [low]
    if low[:-1].isalpha() and low[-1] in ".,;:!?":
        return [low[:-1]]
    return _LETTERS.findall(low)


def _grams(words: list[str], n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The n-grams of ORDER letters of padded words that occur n times each, and how often they occur."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer("".join(EDGE * (ORDER - 1) + w + EDGE for w in words).encode("utf-32-le"), dtype=np.uint32)
    starts = np.cumsum(np.r_[0, sizes[:-1] + ORDER - 1])
    at = np.repeat(starts - np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.arange(sizes.sum())
    codes = flat[at[:, None] + np.arange(ORDER)]
    _, first, inverse = np.unique(_hash(codes), return_index=True, return_inverse=True)
    found = codes[first].tobytes().decode("utf-32-le")
    return [found[i : i + ORDER] for i in range(0, len(found), ORDER)], np.bincount(inverse, np.repeat(n, sizes)).astype(np.int64)


def ngram_counts(df: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, gram string, n long: n-grams of ORDER letters in all texts, each word padded with boundaries."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks: dict[str, Counter] = {}

        def settle() -> Iterator[pd.DataFrame]:
            for name, seen in chunks.items():
                own: Counter = Counter()
                for chunk, n in seen.items():
                    for word in words_of(chunk):
                        own[word] += n
                if own:
                    grams, n = _grams(list(own), np.fromiter(own.values(), np.int64, len(own)))
                    yield pd.DataFrame({"lang": name, "gram": grams, "n": n})
            chunks.clear()

        for batch in batches:
            for name, t in zip(batch["lang"], batch["text"]):
                chunks.setdefault(name, Counter()).update(t.split())
            if sum(map(len, chunks.values())) > FLUSH_WORDS:
                yield from settle()
        yield from settle()

    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hash(codes: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each row of letter codes."""
    with np.errstate(over="ignore"):
        h = np.full(len(codes), codes.shape[1], dtype=np.uint64)
        for k in range(codes.shape[1]):
            h = (h ^ codes[:, k].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    return h


def _codes(strings: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32).reshape(-1, width)


@dataclass
class Sorted:
    """A map from hash to value as two arrays, sorted by hash."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> "Sorted":
        order = np.argsort(keys)
        return cls(keys[order], values[order].astype(np.float64))

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)


@dataclass
class KneserNey:
    """grams[k], contexts[k]: for n-grams of k + 1 letters, the discounted share and the weight of the shorter n-gram."""

    grams: list[Sorted]
    contexts: list[Sorted]
    longest: np.ndarray  # letter codes of its n-grams of ORDER letters
    floor: float = 1.0 / ALPHABET

    @classmethod
    def of(cls, shares: list[tuple[list[str], np.ndarray]]) -> "KneserNey":
        """shares[k]: the stored n-grams of k + 1 letters with their discounted shares of their contexts."""
        grams, contexts = [], []
        for k, (names, share) in enumerate(shares, start=1):
            codes = _codes(names, k)
            keys, inverse = np.unique(_hash(codes[:, :-1]) if k > 1 else np.zeros(len(codes), np.uint64), return_inverse=True)
            contexts.append(Sorted.of(keys, 1 - np.bincount(inverse, share, len(keys))))
            grams.append(Sorted.of(_hash(codes), share))
        return cls(grams, contexts, codes)

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of the last letter after the others, for rows of ORDER letter codes."""
        p = np.full(len(codes), self.floor)
        for k in range(1, ORDER + 1):
            part = codes[:, ORDER - k :]
            weight = self.contexts[0].values[0] if k == 1 else self.contexts[k - 1].get(_hash(part[:, :-1]), 1.0)  # 1: unseen
            p = self.grams[k - 1].get(_hash(part), 0.0) + weight * p
        return -np.log2(p)


class Identifier:
    """Costs of texts under every language's model."""

    def __init__(self, models: dict[str, KneserNey], limits: dict[str, tuple[float, float]] | None = None):
        """limits: by language the mean of the bits per letter, and the limit of the deviation from it."""
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        lenient = max(limits.values(), key=lambda x: x[0] + x[1], default=(0.0, np.inf)) if limits else (0.0, np.inf)
        self.limits = np.array([(limits or {}).get(n, lenient) for n in self.names]).reshape(-1, 2)
        self.place: dict[str, int] = {}
        self.table = np.zeros((1, len(self.names) + 1))
        # the costs of all n-grams that some language has seen, for every language, in one sorted hash array
        codes = np.unique(np.concatenate([m.longest for m in self.models]), axis=0) if models else np.zeros((0, ORDER), np.uint32)
        keys = _hash(codes)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.seen = np.stack([m.costs(codes[order]) for m in self.models], axis=1) if models else np.zeros((0, 0))

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of the last letter after the others by language, for rows of ORDER letter codes."""
        keys = _hash(codes)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = self.seen[at]
        new = np.flatnonzero(self.keys[at] != keys)
        if len(new):
            out[new] = np.stack([m.costs(codes[new]) for m in self.models], axis=1)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Fill the table: for each new chunk the cost by language and the letters counted."""
        new = [c for c in chunks if c not in self.place]
        if len(self.place) + len(new) > CACHE_WORDS:
            self.place, self.table, new = {}, self.table[:1], list(chunks)
        if not new:
            return
        padded, owner = [], []
        for i, c in enumerate(new):
            for w in words_of(c):
                padded.append(EDGE * (ORDER - 1) + w + EDGE)
                owner.append(i)
        rows = np.zeros((len(new), len(self.names) + 1))
        if padded:
            sizes = np.fromiter(map(len, padded), np.int64, len(padded)) - ORDER + 1
            flat = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32)
            starts = np.cumsum(np.r_[0, sizes[:-1] + ORDER - 1])
            at = np.repeat(starts - np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.arange(sizes.sum())
            codes = flat[at[:, None] + np.arange(ORDER)]
            whose = np.repeat(np.array(owner), sizes)
            costs = self.costs(codes)
            for j in range(len(self.names)):
                rows[:, j] = np.bincount(whose, costs[:, j], len(new))
            rows[:, -1] = np.bincount(whose, minlength=len(new))
        self.place.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.table = np.vstack([self.table, rows])

    def measure(self, texts: list[str | None]) -> np.ndarray:
        """For each text the cost by language, and the letters counted."""
        out = np.zeros((len(texts), len(self.names) + 1))
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            self.learn(set().union(*(c for _, c in held)))
            get = self.place.__getitem__
            for i, chunks in held:
                out[i] = self.table[np.fromiter(map(get, chunks), np.int64, len(chunks))].sum(axis=0)
            held.clear()

        for i, t in enumerate(texts):
            if t:
                held.append((i, t.split()))
                size += len(t)
            if size > 1_000_000:
                settle()
                size = 0
        settle()
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang, score (the certainty among the languages, 0 to 1), bits (cross-entropy per letter), letters, rejected."""
        if not self.names:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0, "bits": 0.0, "letters": 0, "rejected": True})
        found = self.measure(texts)
        letters = found[:, -1]
        bits = found[:, :-1] / np.maximum(letters, 1)[:, None]
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(bits)), best]
        gap = np.minimum((bits - low[:, None]) * np.minimum(letters, SURE_LETTERS)[:, None], 1000)
        score = 1 / (2.0**-gap).sum(axis=1)
        none = letters == 0
        mean, limit = self.limits[best].T
        names = np.array([*self.names, "und"], dtype=object)
        return pd.DataFrame({
            "lang": names[np.where(none, len(self.names), best)], "score": np.where(none, 0.0, score), "bits": low,
            "letters": letters.astype(np.int64), "rejected": none | (deviation(low, letters, mean) > limit),
        })


def deviation(bits, letters, mean):
    """How far a text's bits per letter are above the mean, as the rejection measures it; for arrays or columns' values."""
    return (bits - mean) * np.sqrt(np.clip(letters, 1, SURE_LETTERS))


def _levels(longest: DataFrame) -> list[DataFrame]:
    """Tables (lang, gram, n) of the orders from 1 to ORDER: occurrences at the top, distinct letters before below it."""
    out = [longest]
    for k in range(ORDER - 1, 0, -1):
        out.append(out[-1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
        out[-1] = materialize(longest.sparkSession, out[-1], f"grams-{k}")
    return out[::-1]


def learn(rows: DataFrame, lang_col: str, text_col: str, entries: int = ENTRIES) -> dict[str, KneserNey]:
    """One model per language of rows whose language and text aren't null."""
    spark = rows.sparkSession
    levels = _levels(materialize(spark, ngram_counts(rows, lang_col, text_col), "ngrams"))
    once, twice = (F.count(F.when(F.col("n") == k, 1)) for k in (1, 2))
    shares: dict[str, list] = {}
    for k, level in enumerate(levels, start=1):
        found = level.groupBy("lang").agg(once.alias("once"), twice.alias("twice")).limit(MOST_LANGUAGES + 1).collect()
        if len(found) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}: clean the labels first")
        if not found:
            return {}
        discounts = {name: a / (a + 2 * b) if a and b else 0.5 for name, a, b in found}
        totals = level.groupBy("lang", F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"))
        kept = most_frequent(level, "lang", "gram", "n", max(1, entries // len(discounts))).withColumn("context", F.substring("gram", 1, k - 1))
        stored = kept.join(totals, ["lang", "context"]).select("lang", "gram", "n", "total").toArrow()  # ENTRIES rows at most
        names, lang = stored["gram"].to_pandas(), stored["lang"].to_pandas().to_numpy()
        n, total = stored["n"].to_numpy().astype(np.float64), stored["total"].to_numpy().astype(np.float64)
        for name, d in discounts.items():
            own = np.flatnonzero(lang == name)
            shares.setdefault(name, []).append((names.iloc[own].tolist(), (n[own] - d) / total[own]))
    for level in levels:
        discard(spark, level)
    return {name: KneserNey.of(own) for name, own in shares.items()}


def fit(df: DataFrame, labelled: Column, lang_col: str = "lang", text_col: str = "text", margin: float = 0.75, entries: int = ENTRIES) -> Identifier:
    """Learn one model per language from the rows where `labelled` holds and language and text are not null."""
    limit_arrow(df.sparkSession)
    rows = df.filter(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    apart = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    models = learn(rows.filter(~apart), "lang", "text", entries)
    return Identifier(models, _calibrate(rows.filter(apart), models, margin) if models else None)


def _calibrate(rows: DataFrame, models: dict[str, KneserNey], margin: float) -> dict[str, tuple[float, float]]:
    """The mean of the bits per letter and the limit of the deviation from it, by language, from rows (lang, text)."""
    shared, key = rows.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = per_process(key, lambda: Identifier(shared.value))
        for batch in batches:
            found = own.predict(batch["text"].tolist())
            found["lang"] = found["lang"].where(found["lang"].to_numpy() == batch["lang"].to_numpy())
            yield found[["lang", "bits", "letters"]].dropna()

    told = materialize(rows.sparkSession, rows.mapInPandas(measure, "lang string, bits double, letters bigint"), "calibration")
    means = told.groupBy("lang").agg((F.sum(F.col("bits") * F.col("letters")) / F.sum("letters")).alias("mean"))  # a row a language
    x = (F.col("bits") - F.col("mean")) * F.sqrt(F.least("letters", F.lit(SURE_LETTERS)))
    found = told.join(F.broadcast(means), "lang").groupBy("lang", "mean").agg(F.percentile_approx(x, QUANTILE, 100_000).alias("limit")).collect()
    discard(rows.sparkSession, told)
    return {name: (mean, max(limit, 0.0) * (1 + margin)) for name, mean, limit in found}


def predict(spark, identifier: Identifier, text: Column) -> Column:
    """A column struct<lang string, score double, bits double, letters long, rejected boolean> for a text column."""
    limit_arrow(spark)
    key = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((dict(zip(identifier.names, identifier.models)), dict(zip(identifier.names, map(tuple, identifier.limits.tolist())))))

    @F.pandas_udf("lang string, score double, bits double, letters bigint, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = per_process(key, lambda: Identifier(*shared.value))
        for texts in batches:
            yield own.predict(texts.tolist())

    return run(text)
