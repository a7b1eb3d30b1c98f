"""Language model scores and language identification."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework.llm import langid, lm
from slatework.llm.common import held_out
from slatework.llm.queries import op2_lm_score, op7_language_id


def tokens(text):
    return (text or "").encode().lower().split() + [lm.END]


def unigram(docs, training):
    c = Counter(w for i, t in docs if training(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return c, n, lambda t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))


def test_class_hash_is_the_same_in_sql(spark):
    words = [b"a", b"ab", b"abc", b"abcdef", "é".encode(), b"\xff\xfe"]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select("w", (F.crc32(F.substring("w", -3, 3)) % 7).alias("c"))
    assert all(r["c"] == lm.class_of(bytes(r["w"]), 7) for r in df.collect())


def test_scores(odd_docs):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    small = lm.score(odd_docs, ~held_out("doc_id", 7, 2), softmax_words=4, classes=3, head_words=8).collect()
    assert len(small) == len(docs)
    c, n, base = unigram(docs, lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2)
    by_id = {}
    for r in small:
        by_id.setdefault(r["doc_id"], []).append(r)
    for i, t in docs:
        for r in by_id[i]:
            assert abs(r["base_score"] - base(t)) < 1e-6 * max(1, abs(base(t)))
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n)
            assert r["score"] < 0


def brute_score(text, v, model, counts):
    """The score of a text from the definition: one softmax over all symbols for every token."""
    soft = {w: 1 + i for i, w in enumerate(v.words[: v.softmax])} | {lm.END: 0}
    classes = len(v.class_tokens)
    symbol = lambda w: soft.get(w, 1 + v.softmax + lm.class_of(w, classes))
    words = [lm.END, lm.END, *tokens(text)]
    total = 0.0
    for c, a, w in zip(words, words[1:], words[2:]):
        guess = model.contexts[symbol(a)] @ model.places[0] + model.contexts[symbol(c)] @ model.places[1]
        logits = model.symbols @ guess + model.bias
        total += logits[symbol(w)] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        if w not in soft:
            inside = {x: n for x, n in counts.items() if x not in soft and lm.class_of(x, classes) == lm.class_of(w, classes)}
            total += math.log((counts.get(w, 0) + 1) / (sum(inside.values()) + len(inside) + 1))
    return total / math.log(10)


def test_score_equals_brute_force(spark, odd_docs, words):
    rows = [(i, words(30)) for i in range(60)] + [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    training = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    learned = df.filter(training).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts, v, model = lm.fit(learned, 20, 5, 40)
    counts = {bytes(r[0]): r[1] for r in counts.collect()}
    assert counts == Counter(w for r in learned.collect() for w in tokens(bytes(r[0]).decode()))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["score"]) for r in lm.score(df, training, softmax_words=20, classes=5, head_words=40).collect())
    want = sorted((i if i is not None else -1, len(tokens(t)), brute_score(t, v, model, counts)) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-10)


def test_pairs_and_probabilities(spark, words):
    df = spark.createDataFrame([(i, words(60)) for i in range(30)] + [(30, ""), (31, "one")], "doc_id long, text string")
    learned = df.select(F.col("text").cast("binary").alias("text"))
    v = lm.vocabulary(lm.word_counts(learned), 20, 5, 1000)
    pairs = lm.pair_counts(learned, v)
    soft = {w: 1 + i for i, w in enumerate(v.words[: v.softmax])} | {lm.END: 0}
    want = np.zeros_like(pairs)
    for r in df.collect():
        own = [0, 0, *(soft.get(w, 21 + lm.class_of(w, 5)) for w in tokens(r["text"]))]
        for c, a, w in zip(own, own[1:], own[2:]):
            want[0, a, w] += 1
            want[1, c, w] += 1
    assert (pairs == want).all()
    adds, norm = lm.train(pairs, steps=20).tables()
    p = np.exp(adds[0][:, None, :] + adds[1][None, :, :] - norm[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-12)
    # inside a class: known words and one share for unseen ones
    counts = {bytes(r[0]): r[1] for r in lm.word_counts(learned).collect()}
    for k in range(5):
        inside = [(n + 1) for w, n in counts.items() if w not in soft and lm.class_of(w, 5) == k]
        assert sum(inside) + 1 == v.class_tokens[k] + v.class_words[k] + 1


def test_head_of_equal_counts(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(50)),)], "text string").select(F.col("text").cast("binary").alias("text"))
    v = lm.vocabulary(lm.word_counts(df), 10, 5, 40)
    assert 20 <= len(v.words) <= 40 and v.softmax == 10 and v.words == sorted(v.words)
    assert lm.softmax_words_for(10**4) < lm.softmax_words_for(10**6) < lm.softmax_words_for(10**7) < lm.softmax_words_for(10**8)


def test_empty_and_untrained(odd_docs):
    assert lm.score(odd_docs.limit(0), F.lit(True)).count() == 0
    got = lm.score(odd_docs, F.lit(False)).collect()
    assert len(got) == odd_docs.count() and all(r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == 0 for r in got)


def test_query_beats_the_base_on_held_out_texts(spark):
    rows = op2_lm_score(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert rows[1] > rows[0] + 0.2 * rows[2]  # log10 per token


def brute_kneser_ney(texts):
    """The cost in bits of a word's letters under the model of these texts, straight from the definition."""
    top = Counter()
    for t in texts:
        for w in langid.words_of(t):
            padded = langid.EDGE * 3 + w + langid.EDGE
            for i in range(len(padded) - 3):
                top[padded[i : i + 4]] += 1
    levels = [top]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))
    stats = []
    for level in levels:
        once, twice = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        total, kinds = Counter(), Counter()
        for g, v in level.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        stats.append((level, once / (once + 2 * twice) if once and twice else 0.5, total, kinds))

    def p(gram):
        level, d, total, kinds = stats[4 - len(gram)]
        lower = p(gram[1:]) if len(gram) > 1 else 1 / 2000
        n = total[gram[:-1]]
        return lower if not n else max(level[gram] - d, 0) / n + d * kinds[gram[:-1]] / n * lower

    return p


def brute_predict(models, text):
    letters, bits = 0, dict.fromkeys(models, 0.0)
    for w in langid.words_of(text or ""):
        padded = langid.EDGE * 3 + w + langid.EDGE
        for i in range(len(padded) - 3):
            letters += 1
            for name, p in models.items():
                bits[name] -= math.log2(p(padded[i : i + 4]))
    if not letters:
        return "und", 0.0
    per = {name: b / letters for name, b in bits.items()}
    best = min(sorted(per), key=per.get)
    gaps = [min((b - per[best]) * min(letters, langid.SURE_LETTERS), 1000) for b in per.values()]
    return best, 1 / sum(2.0**-g for g in gaps)


def by_language(df):
    rows = df.filter("lang IS NOT NULL AND text IS NOT NULL").filter(F.pmod(F.xxhash64("text"), F.lit(langid.FOLDS)) != 0).select("lang", "text").collect()
    out = {}
    for name, t in rows:
        out.setdefault(name, []).append(t)
    return {name: brute_kneser_ney(texts) for name, texts in out.items()}


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = by_language(docs.filter(~held_out("doc_id", 3, 1)))
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    for r in op7_language_id(spark, sf).collect():
        lang, score = brute_predict(models, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9, r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def many_letters(spark, n):
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 60)]
    rows = [(i, " ".join("".join(rng.choices(letters, k=6)) for _ in range(60)), f"l{i % 2}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_more_than_100000_ngrams_of_a_language(spark):
    df = many_letters(spark, 1_000)
    models = langid.learn(df, "lang", "text")
    assert all(len(m.grams[3].keys) > 100_000 for m in models.values())
    want = brute_kneser_ney([r["text"] for r in df.filter("lang = 'l1'").collect()])
    grams = [r[1][i : i + 4] for r in df.take(30) for i in range(0, 200, 7) if " " not in r[1][i : i + 4]] + ["zzzz"]
    assert np.allclose(2.0 ** -models["l1"].costs(langid._codes(grams, 4)), [want(g) for g in grams], rtol=1e-9)


def test_stored_entries_are_bounded_and_sum_to_one(spark):
    df = many_letters(spark, 200)
    whole, some = (langid.learn(df, "lang", "text", entries=n)["l0"] for n in (10**6, 4_000))
    assert len(whole.grams[3].keys) > 10_000 and len(some.grams[3].keys) <= 2_100
    letters = [*(chr(c) for c in range(0x4E00, 0x4E00 + 60)), langid.EDGE]
    for model in (whole, some):
        for context in ("\x02\x02\x02", "\u4e05\u4e06\u4e07", "\x02\x02\u4e10"):
            p = 2.0 ** -model.costs(langid._codes([context + c for c in letters], 4))
            assert 0.9 < p.sum() <= 1 + 1e-9


def test_kneser_ney_by_hand(spark):
    texts = ["abab abab", "abab abc", "abc ba"]
    model = langid.learn(spark.createDataFrame([("x", t) for t in texts], "lang string, text string"), "lang", "text")["x"]
    p = brute_kneser_ney(texts)
    grams = ["abab", "abca", "zzzz", "cabx", "\x02\x02ab", "\x02\x02\x02b"]
    assert np.allclose(2.0 ** -model.costs(langid._codes(grams, 4)), [p(g) for g in grams])
    joint = langid.Identifier({"x": model})
    assert np.allclose(joint.costs(langid._codes(grams, 4))[:, 0], model.costs(langid._codes(grams, 4)))


def test_too_many_languages(spark):
    df = spark.createDataFrame([(f"l{i}", "some text") for i in range(langid.MOST_LANGUAGES + 1)], "lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        langid.learn(df, "lang", "text")


@pytest.fixture(scope="module")
def two_languages(spark):
    rng = random.Random(5)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(40))
    rows = [(i, make("abcde") if i % 2 else make("uvwxy"), "l1" if i % 2 else "l2") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_identification(spark, two_languages, odd_docs):
    ident = langid.fit(two_languages.withColumn("score", F.lit("clash")), F.col("doc_id") < 40)
    told = two_languages.filter("doc_id >= 40").select("lang", langid.predict(spark, ident, F.col("text")).alias("p")).collect()
    assert all(r["lang"] == r["p"]["lang"] and 0.5 < r["p"]["score"] <= 1 for r in told)
    odd = odd_docs.select("text", langid.predict(spark, ident, F.col("text")).alias("p")).collect()
    for r in odd:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert r["p"]["lang"] == "und" if not letters else r["p"]["lang"] in ("l1", "l2")
        assert 0 <= r["p"]["score"] <= 1
        assert r["p"]["rejected"] or letters
    assert next(r for r in odd if r["text"] and r["text"].startswith("中"))["p"]["rejected"]


def test_short_clean_texts_stay_and_noise_goes(spark):
    rng = random.Random(6)
    syllables = {"l1": ["ba", "de", "ca", "be", "da", "ace"], "l2": ["uv", "wy", "xu", "yv", "vuw"]}
    make = lambda name, n: " ".join("".join(rng.choices(syllables[name], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(f"l{i % 2 + 1}", rng.choice((1, 3, 40))), f"l{i % 2 + 1}") for i in range(6_000)]
    noise = [(10_000 + i, "".join(rng.choices("kjqzxwmn\u0436\u0448", k=rng.choice((8, 60, 400)))), "l1") for i in range(6)]
    df = spark.createDataFrame(rows + noise, "doc_id long, text string, lang string")
    told = df.select("doc_id", langid.predict(spark, langid.fit(df, F.lit(True)), F.col("text"))["rejected"].alias("r")).collect()
    assert {r[0] for r in told if r[1]} == {i for i, *_ in noise}


def test_no_labels(spark, two_languages):
    for df in (two_languages.limit(0), two_languages.withColumn("lang", F.lit(None).cast("string"))):
        ident = langid.fit(df, F.lit(True))
        assert {r[0] for r in two_languages.select(langid.predict(spark, ident, F.col("text"))["lang"]).collect()} == {"und"}


def test_query_on_held_out_texts(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = op7_language_id(spark, d)
    assert got.count() == docs.count()
    hit = got.join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hit > 0.97
