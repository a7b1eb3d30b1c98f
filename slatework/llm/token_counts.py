"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged numpy arrays.

Merges never cross a space here (checked when the model is read), so a text is split into pre-tokens, each a run of
spaces and what follows it. All pre-tokens of a batch that are not known yet are laid one after the other in flat arrays.
In each round every sequence applies its lowest-rank pair: the leftmost place of it, and further places of the same pair
as long as no merge before them opens a pair that would come first. The symbols that survive are the tokens; a symbol the
vocabulary lacks counts its UTF-8 bytes (byte fallback).

Long pre-tokens (texts without spaces) are cut first where no piece of the vocabulary that occurs in them reaches across,
since no merge can. A stretch that is still long after MANY_ROUNDS rounds is finished by a heap of its pairs, so that the
work stays about linear in the text.

Null and empty texts have 0 tokens and 0 bytes. Every row is handled alone; extra columns need no care.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_arrow, per_process

MARK = "▁"
NO_RANK = np.int64(1) << 40
#: Letters from which a pre-token is cut up and not cached; rounds after which a sequence of LONG_RUN symbols goes to a heap.
LONG_WORD, LONG_RUN, MANY_ROUNDS = 100, 512, 48
_BASE = np.uint64(0x9E3779B97F4A7C15)


class PieceCounter:
    def __init__(self, model: bytes, cache_size: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models with the identity normalizer and a dummy prefix are counted")
        kinds = proto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not handled")
        scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in scores):
            raise ValueError("a piece crosses a space or a line")
        self.rank_of = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = [*dict.fromkeys([*scores, *(c for p in scores for c in p)])]
        self.ids = {s: i for i, s in enumerate(symbols)}
        self.letters = {s: i for s, i in self.ids.items() if len(s) == 1}
        self.width = len(symbols) + 1
        unknown = [1 if s in scores else len(s.encode()) for s in symbols]
        self.cost = np.array([*unknown, 0], dtype=np.int64)
        keys, ranks, made = [], [], []
        for p, score in scores.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    ranks.append(self.rank_of[score])
                    made.append(self.ids[p])
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        self.cache: dict[str, int] = {}
        self.size = cache_size
        self.pairs: dict[int, tuple[int, int]] | None = None
        # by length: the sorted hashes of all beginnings of pieces, and whether each is a piece itself
        hashes: dict[int, dict[int, bool]] = {}
        for p in scores:
            h = 0
            for k, c in enumerate(p, start=1):
                h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
                begun = hashes.setdefault(k, {})
                begun[h] = begun.get(h, False) or k == len(p)
        self.begun = []
        for k in sorted(hashes):
            keys = np.array(sorted(hashes[k]), dtype=np.uint64)
            self.begun.append((keys, np.array([hashes[k][h] for h in keys.tolist()], dtype=bool)))

    def parts(self, word: str) -> list[str]:
        """A pre-token cut where no occurrence of a piece reaches across."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(codes)
        reach = np.zeros(n + 1, dtype=np.int64)
        at, h = np.arange(n), np.zeros(n, dtype=np.uint64)
        for k, (keys, whole) in enumerate(self.begun, start=1):
            some = at + k <= n
            at, h = at[some], h[some] * _BASE + codes[at[some] + k - 1]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            at, h, place = at[hit], h[hit], place[hit]
            if k > 1:  # a piece at a covers the borders after a, ..., a + k - 2
                own = at[whole[place]]
                np.add.at(reach, own, 1)
                np.add.at(reach, own + k - 1, -1)
            if not len(at):
                break
        cuts = (np.flatnonzero(np.cumsum(reach[: n - 1]) == 0) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, n])]

    def finish(self, sym: list[int]) -> int:
        """Tokens of a sequence of symbols, by a heap of its pairs."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        get, width, n = self.pairs.get, self.width, len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(hit[0], i) for i in range(n - 1) if (hit := get(sym[i] * width + sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if sym[i] < 0 or j < 0 or (hit := get(sym[i] * width + sym[j])) is None or hit[0] != rank:
                continue
            sym[i], sym[j] = hit[1], -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if after := get(sym[i] * width + sym[k]):
                    heapq.heappush(heap, (after[0], i))
            if (b := left[i]) >= 0 and (before := get(sym[b] * width + sym[i])):
                heapq.heappush(heap, (before[0], b))
        return int(self.cost[[x for x in sym if x >= 0]].sum())

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NO_RANK where the model has none."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (spaces already written as the mark)."""
        if all(len(w) <= LONG_WORD for w in words):
            return self.merge(words)
        own: list[tuple[int, str]] = []
        for i, w in enumerate(words):
            own += [(i, p) for p in (self.parts(w) if len(w) > LONG_WORD else [w])]
        place = {p: i for i, p in enumerate(dict.fromkeys(p for _, p in own))}
        counts = self.merge(list(place))
        total = np.zeros(len(words), dtype=np.int64)
        np.add.at(total, [i for i, _ in own], counts[[place[p] for _, p in own]])
        return total

    def merge(self, words: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        total = np.zeros(len(words), dtype=np.int64)
        text = "".join(words)
        letter = self.letters.get
        sym = np.fromiter((letter(c, -1) for c in text), np.int64, len(text))
        seq = np.repeat(np.arange(len(words)), sizes)
        unknown = np.flatnonzero(sym < 0)
        if len(unknown):
            np.add.at(total, seq[unknown], [len(text[i].encode()) for i in unknown])
            sym[unknown] = self.width - 1
        rank, made = np.full(len(sym), NO_RANK), np.zeros(len(sym), dtype=np.int64)
        if len(sym) > 1:
            inner = np.flatnonzero(seq[:-1] == seq[1:])
            rank[inner], made[inner] = self.look(sym[inner], sym[inner + 1])
        rounds = 0
        while len(sym):
            rounds += 1
            if rounds % MANY_ROUNDS == 0:
                held = np.bincount(seq, minlength=len(words))
                for i in np.flatnonzero(held > LONG_RUN).tolist():
                    total[i] += self.finish(sym[seq == i].tolist())
                keep = held[seq] <= LONG_RUN
                sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
                if not len(sym):
                    break
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(seq)])
            over = np.repeat(least == NO_RANK, lengths)
            if over.any():  # finished sequences leave
                np.add.at(total, seq[over], self.cost[sym[over]])
                keep = ~over
                sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
                lengths, least = lengths[least < NO_RANK], least[least < NO_RANK]
                if not len(sym):
                    break
            place = np.flatnonzero(rank == np.repeat(least, lengths))
            # overlapping places: in each run of neighbours every other one, from the left
            run = np.flatnonzero(np.r_[True, np.diff(place) != 1])
            nth = np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))
            place = place[nth % 2 == 0]
            new = made[place]
            own, low = seq[place], rank[place]
            before, after = np.maximum(place - 1, 0), np.minimum(place + 2, len(sym) - 1)
            has_before, has_after = (place > 0) & (seq[before] == own), (place + 2 < len(sym)) & (seq[after] == own)
            left = np.where(has_before, self.look(sym[before], new)[0], NO_RANK)
            right = np.where(has_after, self.look(new, sym[after])[0], NO_RANK)
            # a merge that opens a pair of the same or lower rank ends this round for its sequence
            stop = (left <= low) | (right <= low)
            if stop.any():
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                since = np.cumsum(stop) - stop
                fine = since == np.repeat(since[first], np.diff(np.r_[first, len(own)]))
                place, new = place[fine], new[fine]
            keep = np.ones(len(sym), dtype=bool)
            keep[place + 1] = False
            sym[place] = new
            moved = np.cumsum(keep) - 1
            sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
            at = moved[place]
            stale = np.unique(np.r_[at[at > 0] - 1, at])
            inner = stale[(stale + 1 < len(sym))]
            same = seq[inner] == seq[np.minimum(inner + 1, len(sym) - 1)]
            rank[stale] = NO_RANK
            inner = inner[same]
            rank[inner], made[inner] = self.look(sym[inner], sym[inner + 1])
        return total

    def pre_tokens(self, text: str) -> list[str]:
        """Cache keys of a text: words after one space, or, marked by a leading line end, words after a line end."""
        return text.replace("\n", " \n").split(" ")

    def counted(self, key: str) -> str:
        return key[1:] if key[:1] == "\n" else MARK + key

    def learn(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self.cache]
        if len(self.cache) + len(new) > self.size:
            self.cache = {k: self.cache[k] for k in keys if k in self.cache}
        lines = np.fromiter((k[:1] == "\n" for k in new), np.int64, len(new))
        self.cache.update(zip(new, (self.count([self.counted(k) for k in new]) + lines).tolist()))

    def texts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        plain: list[tuple[int, list[str]]] = []
        odd: list[tuple[int, str]] = []
        letters = 0

        def settle() -> None:
            self.learn(set().union(*(keys for _, keys in plain)))
            get = self.cache.__getitem__
            for i, keys in plain:
                out[i] = sum(map(get, keys))
            plain.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if "  " in text or MARK in text or text[0] == " ":
                odd.append((i, text))
                continue
            keys = self.pre_tokens(text)
            if max(map(len, keys)) > LONG_WORD:
                odd.append((i, text))
                continue
            plain.append((i, keys))
            letters += len(text)
            if letters > 2_000_000:
                settle()
                letters = 0
        settle()
        for i, text in odd:
            words = re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", MARK + text.replace(" ", MARK))
            times = Counter(words)
            out[i] = int(self.count(list(times)) @ np.fromiter(times.values(), np.int64, len(times))) + text.count("\n")
        return out


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + n_bytes long + n_tokens long for every row of df."""
    spark = df.sparkSession
    limit_arrow(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = per_process(("pieces", len(model.value), zlib.crc32(model.value)), lambda: PieceCounter(model.value))
        for texts in batches:
            yield pd.Series(counter.texts(texts.tolist()), dtype="int64")

    text = F.col(text_col)
    return df.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), run(text).alias("n_tokens"))
