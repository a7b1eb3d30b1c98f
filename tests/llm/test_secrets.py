import random
import re

import pytest
from pyspark.sql import functions as F

from slatework.llm import secrets
from slatework.llm.queries import op10_secret_scan

TEXTS = [
    None, "", "nothing here", "password=abcdef", "password=abc", 'é👍 Secret : "abcdef12" and TOKEN:=abcdef', "secret=token: abcdefgh", "api_key='x.y-z=12' apikey=abcdefg ApI_KeY=zzzzzz",
    "AKIA" + "A1" * 8 + " AKIAAKIA AKIA" + "B" * 30, "deadbeef" * 3 + " 0123456789abcdef" * 2 + "f" * 23, "-----BEGIN RSA PRIVATE KEY-----\nxx token=abcdef0123456789abcdef0123",
    "ghp_" + "a" * 36 + " xoxb-123456789012-abcdef eyJabc.eyJdef.sig AIza" + "c" * 35, "password password password=secret token=\"" + "q" * 500, "passwd =\x20= abcdefgh", "ſecret=abcdefg toKen=abcdefg", "words of a book",
]


def brute(text):
    out = []
    for n, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.tested]) >= rule.least:
                out.append((m.start(), n, m.end()))
    return [(a, secrets.RULES[n].kind, b) for a, n, b in sorted(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, "x"), (None, "token=abcdef", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans int, _key string")


def test_scan(docs):
    got = secrets.scan(docs, keep=("doc_id", "text", "_key")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert [tuple(s) for s in r["spans"]] == brute(r["text"]), r["text"]


def test_many_segments(docs):
    got = secrets.scan(docs, keep=("text",), segment_rows=1).collect()
    assert all([tuple(s) for s in r["spans"]] == brute(r["text"]) for r in got)


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] == [] and q["access"] == [["aki", "kia"]]
    assert len(q["assign"]) == 6 and ["ken", "oke", "tok"] in q["assign"]
    assert secrets.trigram_query("ab(c|d)?e.*xyz") == [["abc", "bce", "xyz"], ["abd", "bde", "xyz"], ["abe", "xyz"]]
    assert secrets.trigram_query("(abc)*") == [] and secrets.trigram_query("(abc)+") == [["abc"]]
    for rule in secrets.RULES:  # every match holds all trigrams of one alternative
        for text in filter(None, TEXTS):
            for m in re.finditer(rule.pattern, text):
                assert not q[rule.kind] or any(all(g in m[0].lower() for g in way) for way in q[rule.kind])


def test_finder_finds_every_trigram():
    rng = random.Random(2)
    grams = sorted({g for r in secrets.RULES for way in secrets.trigram_query(r.pattern) for g in way} | {"-]^", "\\d+", ". *"})
    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), secrets.finder(grams))  # Python writes code points otherwise
    for _ in range(200):
        text = "".join(rng.choices([*grams, "a", "-", "x]", " "], k=20))
        assert {m[1] for m in re.finditer(pattern, text)} == {g for g in grams if g in text}


def test_candidates_come_from_the_postings(spark, docs):
    """The posting lists hold all texts with a trigram; what the Boolean queries leave of them are the candidates."""
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    texts = dict(map(tuple, keyed.collect()))
    queries = {n: q for n, r in enumerate(secrets.RULES) if (q := secrets.trigram_query(r.pattern))}
    grams = {g for q in queries.values() for way in q for g in way}
    lists = {}
    for r in secrets.index(keyed, list(queries.values()), "k", "t", 3).collect():
        assert all(k % 3 == r["_segment"] for k in r["_list"])
        lists.setdefault(r["_gram"], set()).update(r["_list"])
    low = {k: (spark.range(1).select(F.lower(F.lit(t))).first()[0]) for k, t in texts.items()}
    assert lists == {g: own for g in grams if (own := {k for k, t in low.items() if g in t})}
    got = {r["_key"]: set(r["_rules"]) for r in secrets.candidates(keyed, secrets.RULES, "k", "t", 3).collect()}
    want = {}
    for n, q in queries.items():
        for way in q:
            for k in set.intersection(*(lists.get(g, set()) for g in way)):
                want.setdefault(k, set()).add(n)
    assert got == want
    posted = set().union(*lists.values())
    assert set(got) < posted  # the lists hold texts that no rule is a candidate for


def test_the_plan_has_no_filter_before_the_postings(docs):
    plan = secrets.candidates(docs.select(F.lit(1).cast("long").alias("k"), F.col("text").alias("t")), secrets.RULES, "k", "t", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") == 0 and plan.count("regexp_extract_all") >= 1


def test_rules_without_trigrams_only(docs):
    rules = (secrets.Rule("hex", "[0-9a-f]+", 0, 24),)
    got = secrets.scan(docs, rules, keep=("text",)).collect()
    assert any(r["spans"] for r in got)
    for r in got:
        assert [(s["start"], s["end"]) for s in r["spans"]] == [m.span() for m in re.finditer("[0-9a-f]+", r["text"] or "") if len(m[0]) >= 24]


def test_redact(docs):
    got = secrets.redact(docs, mark="[S]").collect()
    assert docs.columns == secrets.redact(docs).columns and len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None or r["doc_id"] == 0:
            continue
        text, out, at = TEXTS[r["doc_id"]], "", 0
        for a, _, b in brute(text):
            if a >= at:
                out += text[at:a] + "[S]"
            at = max(at, b)
        assert r["text"] == out + text[at:]


def test_empty(docs):
    assert secrets.scan(docs.limit(0)).count() == 0


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = op10_secret_scan(spark, sf)
    names = sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({secrets.oracle_sql()})").fetchall())
