r"""Language-model scores of whole texts by a log-bilinear neural model.

Tokens: ASCII letters lower-cased, words `[^\x20\x09-\x0D]+`, then one end. Symbols of the model: the end, the most
frequent words (their number grows with the root of the training tokens), and classes of all other words (by a hash of the
last three bytes). With a and c the symbols one and two places before, a symbol has the probability
softmax(p1[a] . r[symbol] + p2[c] . r[symbol] + b[symbol]), p1 and p2 being the context vectors of the two places times the
matrices of these places. Trained in numpy by noise-contrastive estimation: each step draws pairs of a context and a
symbol from the counts of all training texts at both distances, and noise from the unigram counts, and learns to tell them
apart. The normaliser of every pair of contexts is one matrix product, for exp of a sum over places is a product; all in
double precision. A word inside its class has (c + 1) / (n + v + 1), n tokens and v words of the class in training, c its own
count; the rest is for unseen words.

What grows with the corpus stays distributed: the word counts are a table. Workers get the head of it (HEAD_WORDS, by falling
count); tokens outside it meet their counts in a join. Driver and workers hold at most (1 + SOFTMAX_WORDS + CLASSES) ** 2
pairs of symbols for each distance.

Null and empty texts hold the end alone. Without training rows every symbol is equally likely. Repeated rows are scored
each; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_arrow, materialize, most_frequent, per_process, tasks

#: Bounds of the model: words with a symbol of their own, classes, length of vectors, words that workers hold.
SOFTMAX_WORDS, CLASSES, DIMENSIONS, HEAD_WORDS = 511, 1_024, 32, 262_144
#: Training: pairs and noise samples of a step, steps, Adam's rate. Symbols before a symbol that predict it, and the weight of
#: what each adds: they are learnt one by one and say partly the same (chosen on held-out texts).
BATCH, NOISE, STEPS, RATE, PLACES, WEIGHT = 2_048, 256, 800, 0.02, 2, 0.7
#: Words that a counting task holds at once; rows of pair counts that travel together.
FLUSH_WORDS, BLOCK = 200_000, 40
END = b"\n"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def word_counts(texts: DataFrame) -> DataFrame:
    """word binary, n long: tokens of all texts (one binary column `text`), ends included."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(words_of(text))
            counts[END] += len(batch)
            if len(counts) > FLUSH_WORDS:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts.clear()
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())}, columns=["word", "n"])

    return texts.mapInPandas(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The bounded part of the word counts that workers hold."""

    words: list[bytes]  # by falling count, then word; END isn't among them
    counts: np.ndarray
    end: int
    total: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    softmax: int

    @property
    def symbols(self) -> int:
        return 1 + self.softmax + len(self.class_tokens)

    def index(self) -> "Index":
        return Index(self)


class Index(dict):
    """word -> place in the head, or -1 - class for other words."""

    def __init__(self, v: Vocabulary):
        super().__init__(zip(v.words, range(len(v.words))))
        self.classes = len(v.class_tokens)
        classes = np.fromiter((class_of(w, self.classes) for w in v.words), np.int64, len(v.words))
        self.symbol = np.where(np.arange(len(v.words)) < v.softmax, 1 + np.arange(len(v.words)), 1 + v.softmax + classes)
        self.softmax = v.softmax

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[-3:]) % self.classes

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def symbols(self, places: np.ndarray) -> np.ndarray:
        out = self.softmax - places  # 1 + softmax + class of words outside the head
        known = places >= 0
        out[known] = self.symbol[places[known]]
        return out


def softmax_words_for(tokens: int) -> int:
    """Words with a symbol of their own: an eighth of the root of the training tokens."""
    return int(np.clip(math.sqrt(tokens) / 8, 32, SOFTMAX_WORDS))


def vocabulary(counts: DataFrame, softmax_words: int | None = None, classes: int = CLASSES, head_words: int = HEAD_WORDS) -> Vocabulary:
    words = counts.filter(F.col("word") != F.lit(END))
    class_tokens, class_words = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    own_class = F.crc32(F.substring("word", -3, 3)) % classes
    for c, n, v in words.groupBy(own_class.alias("c")).agg(F.sum("n"), F.count("*")).collect():
        class_tokens[c], class_words[c] = n, v
    end = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    total, distinct = int(class_tokens.sum()) + end, int(class_words.sum()) + (end > 0)
    head_rows = most_frequent(words.withColumn("all", F.lit("")), "all", "word", "n", head_words).select("word", "n")
    rows = sorted(((bytes(r[0]), r[1]) for r in head_rows.collect()), key=lambda r: (-r[1], r[0]))[:head_words]
    head = [w for w, _ in rows]
    n_head = np.array([n for _, n in rows], dtype=np.int64)
    softmax = min(softmax_words_for(total) if softmax_words is None else softmax_words, len(head))
    for w, n in zip(head[:softmax], n_head[:softmax].tolist()):
        class_tokens[class_of(w, classes)] -= n
        class_words[class_of(w, classes)] -= 1
    return Vocabulary(head, n_head, end, total, distinct, class_tokens, class_words, softmax)


def before(after: np.ndarray, place: int) -> np.ndarray:
    """The symbols `place` places before the symbols of a text; the end comes before the first one."""
    return np.concatenate([np.zeros(min(place, len(after)), after.dtype), after[: max(0, len(after) - place)]])


def pair_counts(texts: DataFrame, v: Vocabulary) -> np.ndarray:
    """How often a symbol (column) comes one and two places (first axis) after another (row) in all texts."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(v)
    n = v.symbols

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, pairs = shared.value.index(), np.zeros(PLACES * n * n, dtype=np.int64)
        some = False
        for batch in batches:
            parts = [np.append(index.symbols(index.places(words_of(text))), 0) for text in batch["text"]]
            if parts:
                some = True
                after = np.concatenate(parts)
                for place in range(PLACES):
                    key, times = np.unique((place * n + np.concatenate([before(p, place + 1) for p in parts])) * n + after, return_counts=True)
                    pairs[key] += times
        size = BLOCK * n
        rows = [(k, zlib.compress(pairs[k * size : (k + 1) * size].tobytes(), 1)) for k in range(-(-len(pairs) // size))] if some else []
        yield pd.DataFrame(rows, columns=["block", "data"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch["block"], batch["data"]):
                x = np.frombuffer(zlib.decompress(data), np.int64)
                sums[k] = sums[k] + x if k in sums else x
        yield pd.DataFrame([(k, zlib.compress(x.tobytes(), 1)) for k, x in sums.items()], columns=["block", "data"])

    schema = "block int, data binary"
    blocks = texts.mapInPandas(count, schema).repartition(tasks(spark), "block").mapInPandas(add, schema)
    out = np.zeros(PLACES * n * n, dtype=np.int64)
    for k, data in blocks.collect():
        out[k * BLOCK * n : (k + 1) * BLOCK * n] = np.frombuffer(zlib.decompress(bytes(data)), np.int64)
    return out.reshape(PLACES, n, n)


@dataclass
class Model:
    contexts: np.ndarray  # a vector for each symbol as a context
    places: np.ndarray  # a matrix for each place before the symbol
    symbols: np.ndarray  # a vector for each symbol
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the symbol at each place adds to each symbol (the bias is in the first), and the log of the normaliser of
        each pair of contexts."""
        adds = np.stack([self.contexts @ m @ self.symbols.T for m in self.places])
        adds[0] += self.bias
        tops = adds.max(axis=2, keepdims=True)
        first, second = np.exp(adds - tops)
        norm = first @ second.T
        return adds, np.log(norm) + tops[0] + tops[1].T


def train(pairs: np.ndarray, dimensions: int = DIMENSIONS, batch: int = BATCH, noise: int = NOISE, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Model:
    """Noise-contrastive estimation: tell a pair of the data from `noise` pairs of its context with symbols drawn by the
    unigram counts. pairs: counts by place, context and symbol."""
    n = pairs.shape[1]
    rng = np.random.default_rng(seed)
    start = [rng.normal(0, 0.1, (n, dimensions)), np.stack([np.eye(dimensions)] * PLACES), rng.normal(0, 0.1, (n, dimensions))]
    if not pairs.any():
        return Model(np.zeros_like(start[0]), start[1], start[2], np.zeros(n))
    unigram = pairs[0].sum(axis=0) + 1.0
    unigram /= unigram.sum()
    params = [p.astype(np.float32) for p in (*start, np.log(unigram))]
    log_noise = np.log(noise * unigram).astype(np.float32)
    cells = [np.flatnonzero(p) for p in pairs]
    shares = [np.cumsum(p.ravel()[c], dtype=np.float64) for p, c in zip(pairs, cells)]
    noise_share = np.cumsum(unigram)
    m, u = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        contexts, places, symbols, bias = params
        grads = [np.zeros_like(p) for p in params]
        for k in range(PLACES):
            drawn = cells[k][np.minimum(np.searchsorted(shares[k], rng.random(batch) * shares[k][-1], side="right"), len(cells[k]) - 1)]
            c, w = drawn // n, drawn % n
            other = np.minimum(np.searchsorted(noise_share, rng.random(noise) * noise_share[-1], side="right"), n - 1)
            context = contexts[c]
            guess = context @ places[k]
            right = 1 / (1 + np.exp(np.clip((guess * symbols[w]).sum(axis=1) + bias[w] - log_noise[w], -30, 30)))  # taken for noise
            wrong = -1 / (1 + np.exp(-np.clip(guess @ symbols[other].T + bias[other] - log_noise[other], -30, 30)))  # taken for data
            by_guess = right[:, None] * symbols[w] + wrong @ symbols[other]
            np.add.at(grads[0], c, by_guess @ places[k].T)
            grads[1][k] += context.T @ by_guess
            np.add.at(grads[2], w, right[:, None] * guess)
            np.add.at(grads[2], other, wrong.T @ guess)
            np.add.at(grads[3], w, right)
            np.add.at(grads[3], other, wrong.sum(axis=0))
        lr = rate * min(1.0, 2 * (1 - (t - 1) / steps))
        for p, g, a, v in zip(params, grads, m, u):
            g /= batch
            a += 0.1 * (g - a)
            v += 0.01 * (g * g - v)
            p += lr * (a / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    params[1] *= np.float32(WEIGHT)
    return Model(*(p.astype(np.float64) for p in params))


def fit(learned: DataFrame, softmax_words: int | None = None, classes: int = CLASSES, head_words: int = HEAD_WORDS) -> tuple[DataFrame, Vocabulary, Model]:
    """The table of word counts, the vocabulary and the model of all texts (one binary column `text`)."""
    counts = materialize(learned.sparkSession, word_counts(learned), "word-counts")
    v = vocabulary(counts, softmax_words, classes, head_words)
    return counts, v, train(pair_counts(learned, v))


def score(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", softmax_words: int | None = None, classes: int = CLASSES, head_words: int = HEAD_WORDS) -> DataFrame:
    """id, is_training boolean, n_tokens, n_known, train_tokens long, base_score, score double for every row of df.

    training: which rows the model learns from. base_score: add-one unigram log10 probability of the text.
    """
    spark = df.sparkSession
    limit_arrow(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    learned = df.filter(training).select(text.alias("text"))
    counts, v, model = fit(learned, softmax_words, classes, head_words)
    shared, key = spark.sparkContext.broadcast((v, model)), uuid.uuid4().hex

    @F.pandas_udf("n_tokens bigint, n_known bigint, base double, model double, rest array<binary>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = shared.value[0]
        index, (adds, norm) = per_process(key, lambda: (v.index(), shared.value[1].tables()))
        own = np.log10(v.counts + 1.0)
        share = np.log10(v.class_tokens + v.class_words + 1.0)
        inside = own.copy()
        inside[: v.softmax] = 0
        inside[v.softmax :] -= share[index.symbol[v.softmax :] - 1 - v.softmax]
        base_end = math.log10(v.end + 1)
        for texts in batches:
            rows = []
            for t in texts:
                words = words_of(t)
                places = index.places(words)
                after = np.append(index.symbols(places), 0)
                known = places[places >= 0]
                other = np.flatnonzero(places < 0)
                a, c = before(after, 1), before(after, 2)
                symbol_score = (adds[0, a, after] + adds[1, c, after] - norm[a, c]).sum() / math.log(10)
                model_score = symbol_score + inside[known].sum() - share[-1 - places[other]].sum()
                rows.append((len(after), len(known) + (v.end > 0), own[known].sum() + base_end, model_score, [words[i] for i in other]))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "model", "rest"])

    # equal rows (id and text) meet again after the join; each counts how many they are
    ident = F.xxhash64(text_col).alias("_hash")
    scored = df.select(F.col(id_col).alias("_id"), ident, training.alias("_training"), run(text).alias("s"))
    alone = F.concat(F.lit(" "), F.col("_hash").cast("string")).cast("binary")  # no token has a space
    each = scored.select("_id", "_hash", F.struct("_training", "s.n_tokens", "s.n_known", "s.base", "s.model").alias("own"), F.posexplode(F.concat(F.array(alone), "s.rest")).alias("_at", "word"))
    each = each.select("_id", "_hash", "word", F.when(F.col("_at") == 0, F.col("own")).alias("own"))
    met = each.join(counts, "word", "left")
    sums = met.groupBy("_id", "_hash").agg(F.max("own").alias("own"), F.count("own").alias("rows"), F.coalesce(F.sum(F.log10(F.col("n") + 1)), F.lit(0.0)).alias("logs"), F.count("n").alias("known"))
    rows = sums.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    logs = F.col("logs") / F.col("rows")
    return rows.select(
        F.col("_id").alias(id_col), F.col("own._training").alias("is_training"), F.col("own.n_tokens").alias("n_tokens"),
        (F.col("own.n_known") + (F.col("known") / F.col("rows")).cast("long")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("own.base") + logs - F.col("own.n_tokens") * math.log10(v.total + v.distinct + 1)).alias("base_score"),
        (F.col("own.model") + logs).alias("score"),
    )
