"""BPE encoding and decoding with word ends, read from a tokenizers JSON file.

Encoding of one pre-token: a heap of (rank, position) over a doubly linked list of symbols. A popped entry is stale
when its left symbol was absorbed or its pair is no longer the one that was pushed; stale entries are skipped.
Decoding: the vocabulary strings of the ids, joined as the library joins them where a file has no decoder (one space).

White space never joins symbols, so the unit of caching is a chunk between white space; its ids depend on nothing else.
Null and empty texts have no ids and decode to the empty text. Texts of any length, repeated rows and extra columns need
nothing special: every row is handled alone. A file that asks for another normalizer, pre-tokenizer or decoder raises.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
import zlib
from array import array
from typing import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, limit_arrow, per_process

#: Unicode White_Space, which differs from str.isspace() in U+001C-U+001F.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_SPLIT = regex.compile(f"[{_SPACE}]+")
_ODD = regex.compile("[\x1c-\x1f]")


def split_chunks(text: str) -> list[str]:
    if _ODD.search(text):
        return [c for c in _SPLIT.split(text) if c]
    return text.split()


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where Latin-1 prints it, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ChunkCache(dict):
    """chunk -> value, at most two generations of `size` entries; what the older one still has is kept when used."""

    def __init__(self, compute, size: int = 300_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            value = self.compute(chunk)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(chunk) <= 100:
            self[chunk] = value
        return value


#: What the file has to say (fixed values): NFC, white space to one space, lower case; words as below; bytes as letters; no decoder.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def check_spec(d: dict) -> None:
    """Raise on a tokenizer that works otherwise than this module does."""
    model = d["model"]
    for name, found, wanted in (
        ("normalizer", d.get("normalizer"), NORMALIZER), ("pre_tokenizer", d.get("pre_tokenizer"), PRE_TOKENIZER), ("decoder", d.get("decoder"), None),
        ("model", model.get("type", "BPE"), "BPE"), *((k, model.get(k) or None, None) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        *((k, any(t.get(k) for t in d["added_tokens"]), False) for k in ("single_word", "lstrip", "rstrip", "normalized")),
    ):
        if found != wanted:
            raise ValueError(f"only tokenizers with {name} {wanted!r} are supported, not {found!r}")


class WordBpe:
    def __init__(self, spec: str):
        d = json.loads(spec)
        check_spec(d)
        model = d["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.special_re = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.special_starts = {t[0] for t in self.special}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        letters = byte_letters()
        self.inner, self.last = [self.vocab[x] for x in letters], [self.vocab[x + self.end] for x in letters]
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+")
        self.cache = ChunkCache(self.encode_chunk)

    def merge(self, word: str) -> list[int]:
        data = word.encode()
        inner, get = self.inner, self.pairs.get
        sym = [inner[b] for b in data]
        sym[-1] = self.last[data[-1]]
        n = len(sym)
        if n == 1:
            return sym
        # an entry of the heap is rank and place in one number
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [hit[0] << bits | i for i, pair in enumerate(zip(sym, sym[1:])) if (hit := get(pair))]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        while heap:
            entry = pop(heap)
            i = entry & mask
            j = right[i]
            if j < 0 or sym[i] < 0:
                continue
            hit = get((sym[i], sym[j]))
            if hit is None or hit[0] != entry >> bits:
                continue
            new = sym[i] = hit[1]
            sym[j] = -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if after := get((new, sym[k])):
                    push(heap, after[0] << bits | i)
            h = left[i]
            if h >= 0 and (before := get((sym[h], new))):
                push(heap, before[0] << bits | h)
        return [s for s in sym if s >= 0]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a normalized chunk. A chunk of several pre-tokens is put together from theirs, which are chunks as well."""
        if not chunk.isalpha():
            get = self.cache.__getitem__
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return get(chunk[:-1]) + get(chunk[-1])
            words = self.words.findall(chunk)
            if len(words) != 1:
                return b"".join(map(get, words))
        return array("I", self.merge(chunk)).tobytes()

    def encode_plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        else:  # letter by letter, so without the final sigma's rule
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()
        return b"".join(map(self.cache.__getitem__, split_chunks(text)))

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out, at = [], 0
        if self.special_re is not None and any(c in text for c in self.special_starts):
            for m in self.special_re.finditer(text):
                out += [self.encode_plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
                at = m.end()
        return b"".join([*out, self.encode_plain(text[at:] if at else text)])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, memoryview(ids).cast("I").tolist()))


def shared_model(spec: str) -> WordBpe:
    """The model of this file in this process; its caches serve all tasks that the process runs."""
    return per_process(("bpe", len(spec), zlib.crc32(spec.encode())), lambda: WordBpe(spec))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + ids (binary, packed unsigned 32-bit little-endian) + decoded (text) of every row of df."""
    spark = df.sparkSession
    limit_arrow(spark)
    text = read_spec(tokenizer_path)
    check_spec(json.loads(text))
    spec = spark.sparkContext.broadcast(text)

    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared_model(spec.value)
        for texts in batches:
            ids = [model.encode(t) for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [model.decode(i) for i in ids]})

    made = fresh(df, "made")
    return df.select(*keep, run(F.col(text_col)).alias(made)).select(*keep, F.col(made)["ids"].alias("ids"), F.col(made)["decoded"].alias("decoded"))
