"""The pipeline, stage by stage, on planted cases and odd rows."""

import random

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    vocab = {"aa": ["lore", "mip", "sum", "dolor", "sit", "amet", "con", "sec"], "bb": ["zug", "hund", "wolk", "tür", "grün", "berg", "kalt", "uhr"]}
    rows = []
    for i in range(40):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choice(vocab[lang]) + rng.choice(vocab[lang]) for _ in range(60)), lang))
    rows += [(100, rows[0][1], "bb"), (101, rows[1][1] + " sitamet", "aa"), (102, rows[3][1] + ' password="hunter2secret"', "aa")]
    rows += [(200, None, "aa"), (201, "", None), (202, "12345 !!! 678", "aa"), (203, "中文字符測試文本" * 30, None), (5, rows[5][1], "aa"), (None, "sumsit loremip dolorsec consum amet", "aa")]
    return spark.createDataFrame([(i, t, l, "s", len(t or ""), "x", 1) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long, told string, hash int")


def test_stages(spark, docs):
    kept = cp.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted(r[0] if r[0] is not None else -1 for r in kept.select("doc_id").collect())
    assert ids == sorted([-1, *range(40), 5, 100, 101, 102])
    once = cp.near_duplicates(spark, kept, "")
    assert once.columns == docs.columns
    ids = sorted(r[0] if r[0] is not None else -1 for r in once.select("doc_id").collect())
    assert ids == sorted([-1, *range(40)])
    clean = cp.secret_scan(spark, kept, "")
    assert clean.columns == docs.columns and clean.count() == kept.count()
    texts = {r["doc_id"]: r for r in clean.collect()}
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[102]["text"].endswith(' [SECRET]"') and texts[102]["n_chars"] == len(texts[102]["text"])
    assert all(r["text"] == before[i] for i, r in texts.items() if i != 102)
    packed = cp.best_fit_packing(spark, clean, "").collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    total = {}
    for r in packed:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 4096 and len(total) == -(-sum(total.values()) // 4096)


def test_empty(spark, docs):
    now = docs.limit(0)
    for _, stage in cp.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


def test_run(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "secret_scan", "best_fit_packing"]
    rows = cp.run(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.8 * n < len({r["doc_id"] for r in rows}) <= n


def test_repeated_rows_with_other_columns(spark):
    """Rows of one doc_id and text that differ elsewhere: the first as JSON stays, whatever the partitions."""
    text = "one two three four five six seven"
    rows = [(1, text, {"k": n}, n) for n in (3, 1, 2, 1)] + [(2, text, {"k": 0}, 0), (3, "quite another text of several words here", None, 5)]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, one map<string,int>, n int").repartition(parts)
        kept = cp.near_duplicates(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"], r["one"], r["n"]) for r in kept.collect()) == [(1, {"k": 1}, 1), (3, None, 5)]
