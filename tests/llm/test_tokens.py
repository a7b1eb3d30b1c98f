"""BPE round trip, token counts, pieces: against the libraries, on odd texts and on the whole small table."""

import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slatework.llm import bpe, pieces, token_counts
from slatework.llm.queries import op1_bpe_round_trip, op9_token_counts

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def spm():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_round_trip(odd_docs, library):
    got = bpe.encode_decode(odd_docs, WORD, keep=("doc_id", "text", "n_tokens")).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == packed(ids), r["text"]
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_empty_tables(odd_docs):
    none = odd_docs.limit(0)
    assert bpe.encode_decode(none, WORD).count() == 0
    assert token_counts.count_tokens(none, PIECE).count() == 0
    assert pieces.token_pieces(none, WORD).count() == 0


def test_query_on_documents(spark, sf, library):
    import hashlib

    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    for r in op1_bpe_round_trip(spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_small_cache_gives_the_same(library):
    model = bpe.WordBpe(bpe.read_spec(WORD))
    model.cache.size = 3
    text = "the quick, brown fox! jumps' over THE lazy dog's back " * 3
    assert model.encode(text) == packed(library.encode(text, add_special_tokens=False).ids)


def test_counts(odd_docs, spm):
    for r in token_counts.count_tokens(odd_docs, PIECE, keep=("doc_id", "text", "node")).collect():
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(spm.encode(text))), text


def test_counts_of_long_runs(spm):
    counter = token_counts.PieceCounter(open(PIECE, "rb").read())
    texts = ["aaaa" * 2000, "=-" * 3000, " " * 500, "\n" * 50, "abcdef0123" * 1500, "a\n\n  b \n c", " lead", "trail "]
    assert counter.texts(texts) == [len(x) for x in spm.encode(texts)]


def test_counts_of_megabytes_without_spaces(spm):
    import base64
    import random
    import time

    rng = random.Random(4)
    syllables = ["the", "quick", "brown", "fox", "tion", "er", "ing", "zu", "qu", "ström", "x", "aa", "ba"]
    texts = [
        base64.b64encode(rng.randbytes(3_750_000)).decode(), "".join(rng.choices(syllables, k=1_500_000)), "a" * 5_000_000,
        "".join(rng.choices("\u4e2d\u6587\u5b57\u7b26的是一不了在", k=300_000)), "ab" * 200_000 + " tail", "=-" * 500_000,
    ]
    counter = token_counts.PieceCounter(open(PIECE, "rb").read())
    for text in texts:
        t = time.perf_counter()
        assert counter.texts([text]) == [sum(len(spm.encode(text)) for _ in range(1))], text[:20]
        print(text[:10], len(text), time.perf_counter() - t)


def test_heap_finishes_what_rounds_leave(spm, monkeypatch):
    import random

    rng = random.Random(5)
    monkeypatch.setattr(token_counts, "MANY_ROUNDS", 2)
    monkeypatch.setattr(token_counts, "LONG_RUN", 3)
    counter = token_counts.PieceCounter(open(PIECE, "rb").read())
    texts = ["".join(rng.choices(["tion", "th", "e", "ing", "a", "ß", "中", "aa"], k=rng.randint(1, 400))) for _ in range(60)]
    assert counter.texts(texts) == [len(x) for x in spm.encode(texts)]


def test_kept_columns_can_have_any_name(spark, library):
    df = spark.createDataFrame([("some text", 1, 2, 3)], "text string, r int, p int, made int")
    row = bpe.encode_decode(df, WORD, keep=("r", "p", "made")).first()
    assert tuple(row)[:3] == (1, 2, 3) and row["decoded"] == "some</w> text</w>"
    assert tuple(pieces.token_pieces(df, WORD, keep=("r", "p", "made")).first())[:5] == (1, 2, 3, 0, 0)
    assert tuple(token_counts.count_tokens(df, PIECE, keep=("r", "p", "made")).first())[:4] == (1, 2, 3, 9)


def test_other_tokenizers_are_refused(odd_docs):
    for f in (bpe.encode_decode, pieces.token_pieces):
        with pytest.raises(ValueError, match="supported"):
            f(odd_docs, public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_query(spark, sf, spm):
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    for r in op9_token_counts(spark, sf).collect():
        n = len(spm.encode(texts[r["doc_id"]] or ""))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 4096)


def test_pieces(odd_docs, library):
    rows = pieces.token_pieces(odd_docs.filter("doc_id != 4"), WORD, capacity=100, with_ids=True, keep=("doc_id", "text")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        by.setdefault((r["doc_id"], r["text"]), []).append(r)
    for (_, text), found in by.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        cut = [ids[i : i + 100] for i in range(0, len(ids), 100)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in found] == [(k, 100 * k, len(c), zlib.crc32(packed(c)), packed(c)) for k, c in enumerate(cut)]
