"""Jaccard join, components, exact and approximate vector search: against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework.llm import ann, components, jaccard, topk
from slatework.llm.queries import op3_exact_topk, op4_adaptive_ann


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(parent, x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, width):
    w = (text or "").encode().lower().split()
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = {i: i for i in range(len(rows))}
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            r = find(parent, i)
            least[r] = min(ident, least.get(r, ident))
    return sorted((ident if ident is not None else -1, len(s), least.get(find(parent, i), -1)) for i, ((ident, _), s) in enumerate(zip(rows, sets)))


@pytest.fixture(scope="module")
def near_copies(words):
    rng = random.Random(9)
    rows = []
    for group in range(6):
        base = words(rng.choice((8, 40, 90))).split()
        for _ in range(rng.choice((2, 5, 40))):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = words(rng.randint(0, 2)).split()
            rows.append((len(rows), " ".join(w)))
    passage = words(30)
    rows += [(len(rows) + i, f"{words(12)} {passage} {words(3)}") for i in range(25)]
    rows += [(900, None), (901, ""), (902, "  \n "), (903, "a b"), (904, "A  B"), (905, "one"), (None, rows[0][1]), (0, rows[0][1]), (3, "same id other text here now"), (906, words(3000))]
    return rows


@pytest.mark.parametrize(
    "width,percent,options",
    [(4, 85, {}), (3, 60, {"frequent": 1, "block_nodes": 8}), (4, 85, {"frequent": 0, "block_nodes": 5, "node_bits": 3}), (4, 80, {"frequent": 1, "most_run": 2, "block_nodes": 9})],
)
def test_jaccard(spark, near_copies, width, percent, options):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in near_copies], "doc_id long, text string, node string, class int")
    got = jaccard.smallest_ids(jaccard.classes(df, width, percent, **options)).collect()
    told = sorted((r["id"] if r["id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got)
    assert told == brute(near_copies, width, percent)


@pytest.mark.parametrize("percent,run", [(85, 2), (85, 3), (80, 2), (80, 3), (75, 3), (60, 2)])
def test_linked_sets_share_a_run(percent, run):
    """Whatever the order of the shingles, two linked sets post at least one run in common."""
    rng = np.random.default_rng(percent + run)
    assert jaccard.longest_run(percent) >= run
    linked = 0
    for _ in range(4_000):
        n = int(rng.integers(2, 120))
        universe = rng.permutation(4 * n + 8).astype(np.uint64)
        x = universe[:n]
        drop = int(rng.integers(0, n - n * percent // 100 + 1))
        add = int(rng.integers(0, n * 100 // percent - n + 1))
        y = np.r_[x[drop:], universe[n : n + add]]
        both = n - drop
        if not len(y) or 100 * both < percent * (n + add) or (drop == add == 0):
            continue
        linked += 1
        order = rng.integers(0, 3, 4 * n + 8) * 1_000_000 + np.arange(4 * n + 8)  # a few classes of counts
        order[rng.permutation(x)[: int(rng.integers(0, n + 1))].astype(int)] += 2_000_000  # shared ones late, or early
        keys = [
            jaccard.runs_of(s[np.argsort(order[s.astype(int)])][: jaccard.long_prefix(len(s), percent, run)[0]], run, jaccard.span(len(s), percent, run)) for s in (x, y)
        ]
        assert len(np.intersect1d(*keys)), (n, drop, add)
    assert linked > 1_000


def test_frequent_shingles_of_a_small_vocabulary(spark, monkeypatch):
    """Canopies walk nothing, and the pairs stay below FREQUENT times the postings, which are linear in the documents."""
    for n in (500, 3_000):
        rng = random.Random(n)
        rows = [(i, " ".join(rng.choice("abcdef") for _ in range(60))) for i in range(n)]
        rows += [(n + i, rows[i][1] + " a") for i in range(0, 50)]
        seen = {"walk": 0, "pairs": 0}
        walk, possible = jaccard._walk, jaccard.possible

        def count_walk(r, *a):
            seen["walk"] += r.count()
            return walk(r, *a)

        def count_pairs(p, *a):
            p = p.cache()
            seen["pairs"] += p.count()
            return possible(p, *a)

        with monkeypatch.context() as m:
            m.setattr(jaccard, "_walk", count_walk)
            m.setattr(jaccard, "possible", count_pairs)
            found = jaccard.smallest_ids(jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)).collect()
        least = {r["id"]: r["component_id"] for r in found}
        assert all(least[n + i] == i for i in range(50))
        longest = jaccard.long_prefix(57, 85, 3)[0]
        postings = longest * (1 + jaccard.span(57, 85, 2) + sum(range(jaccard.span(57, 85, 3))))
        print(n, seen, postings)
        assert seen["walk"] == 0 and seen["pairs"] <= jaccard.FREQUENT * postings * n / 10


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.smallest_ids(jaccard.classes(df)).count() == 0


def test_forest_spans_the_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, 25)).astype(np.uint64) for _ in range(60)]
    parent, mine = {i: i for i in range(60)}, {i: i for i in range(60)}
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    links = jaccard.forest(sets, 60)
    for i, j in links:
        a, b = find(mine, i), find(mine, j)
        assert a != b
        mine[max(a, b)] = min(a, b)
    assert all(find(parent, i) == find(mine, i) for i in range(60))


def test_matches_take_the_cheapest_prefix():
    assert jaccard.matches_for(np.zeros(20), 5) == 1
    assert jaccard.matches_for(np.full(20, 50.0), 5) > 1


VECTORS = [None, [], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf")], [1.0], [0.5, -0.5, 0.25]]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12)) * rng.lognormal(0, 0.8, (400, 1))
    x[100:160] = x[100]  # copies
    rows = [(i, x[i].astype(np.float32).tolist()) for i in range(400)] + [(1000 + i, v) for i, v in enumerate(VECTORS)] + [(20, x[20].astype(np.float32).tolist())]
    return rows, spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")


def usable(rows, zero):
    out = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out.append((i, np.pad(np.array(v, dtype=np.float32).astype(np.float64), (0, 12 - len(v)))))
    return out


def expected(rows, k, asks=lambda i: i % 20 == 0):
    """(query id, rank, id, score) for every query row."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = []
    for i, v in rows:
        if asks(i):
            s = x @ v
            keep = ids != i
            order = np.lexsort((ids[keep], -s[keep]))[:k]
            out += [(i, n + 1, int(ids[keep][j]), float(s[keep][j])) for n, j in enumerate(order)]
    return sorted(out)


def recall(got, want):
    """By query id; the rows of a repeated query count together."""
    hits, total = Counter(), Counter()
    mine, theirs = Counter((q, v) for q, _, v, _ in got), Counter((q, v) for q, _, v, _ in want)
    for (q, v), n in theirs.items():
        hits[q] += min(n, mine[q, v])
        total[q] += n
    return {q: hits[q] / total[q] for q in total}


def test_exact_topk(vectors):
    rows, df = vectors
    want = expected([(i, np.floor(64 * v)) for i, v in usable(rows, True)], 7)
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, k=7).collect())) == want


def test_exact_topk_of_an_id_with_many_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    rows = [(i, x[i]) for i in range(60)] + [(0, x[0] * s) for s in (3.0, 2.5, 2.0, 1.5, 1.0)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    want = expected([(i, np.floor(64 * v)) for i, v in rows], 5, lambda i: i == 0)
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") == 0, k=5).collect())) == want


def test_exact_topk_leaves_blocks_out(spark, monkeypatch):
    rng = np.random.default_rng(14)
    monkeypatch.setattr(topk, "CANDIDATES", 128)
    monkeypatch.setattr(topk, "BUCKET", 128)
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "SEEDS", 128)
    x = np.floor(8 * rng.normal(size=(3_000, 6)) * rng.lognormal(0, 1.5, (3_000, 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    pairs, width, whole = topk.block_pairs(df, F.col("vec_id") % 20 == 0, 5, 1.0, "vec_id", "embedding")
    sent = pairs.count()
    assert 0 < sent < whole / 2  # pairs of blocks that never meet
    pruned = sparse = 0
    for r in pairs.collect():
        ids, data = topk.unpack(r["ids"], r["data"], width, "f8")
        (_, qids), q = topk.unpack(r["qids"], r["qdata"], width + 1, "f8", 2)
        own = topk.Searcher(qids, q[:, :-1], 5, q[:, -1])
        for part in topk.buckets(data):
            own.bucket(ids[part], data[part])
        pruned, sparse = pruned + own.pruned, sparse + own.sparse
    assert pruned > 0 and sparse > 0
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, k=5, scale=1.0).collect()))
    assert got == expected(list(enumerate(x)), 5)


def test_exact_topk_sends_the_driver_one_block(spark):
    """every task sent the driver its 4,096 longest vectors, so results grew with the tasks."""
    x = np.random.default_rng(21).normal(size=(16_000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "5m")  # read when a stage begins
    try:
        got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 400 == 0, k=5).collect()))
    finally:
        conf.remove("spark.driver.maxResultSize")
    assert got == expected([(i, np.floor(64 * v)) for i, v in enumerate(x)], 5, lambda i: i % 400 == 0)


def test_exact_topk_sends_queries_to_groups_of_levels(spark, monkeypatch):
    """a block of queries went to every level, and each level gave up to k rows a query."""
    for name, value in (("CANDIDATES", 32), ("BUCKET", 32), ("SEEDS", 32), ("GROUPS", 0)):
        monkeypatch.setattr(topk, name, value, raising=False)
    x = np.random.default_rng(22).choice([-1.0, 1.0], size=(2_000, 24)) * np.arange(1, 25)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 40 == 0, k=5, scale=1.0).collect()))
    assert got == expected(list(enumerate(x)), 5, lambda i: i % 40 == 0)
    monkeypatch.setattr(topk, "ranked", lambda found, k: found)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else each part of the levels' rows meets the queries by itself
    try:
        assert topk.search(df, F.col("vec_id") % 40 == 0, k=5, scale=1.0).count() == 50 * 5  # one group, one block of queries
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("largest, size", [(127, 1), (128, 2), (32_768, 4), (2**31, 8)])
def test_exact_topk_holds_components_in_few_bytes(spark, monkeypatch, largest, size):
    """blocks held 8 bytes a component, whatever the components, in shuffles, joins and Python."""
    x = np.random.default_rng(23).integers(-100, 100, size=(1_500, 8)).astype(float)
    x[7, 3], x[20, 5] = -largest, largest
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    written, write = {}, topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda session, rows, name: written.setdefault(name, write(session, rows, name)))
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, k=5, scale=1.0).collect())) == expected(list(enumerate(x)), 5)
    assert written["candidates"].agg(F.sum(F.length("data"))).first()[0] == 1_500 * 8 * size
    assert written["queries"].agg(F.sum(F.length("qdata"))).first()[0] == 75 * (8 * size + 8)


def test_too_wide_vectors(spark, monkeypatch):
    from slatework.llm import vectors as shared

    monkeypatch.setattr(shared, "MOST_WIDTH", 3)
    df = spark.createDataFrame([(0, [1.0] * 4)], "vec_id long, embedding array<double>")
    for f in (topk.search, ann.search):
        with pytest.raises(ValueError, match="components"):
            f(df, F.lit(True))


def test_exact_topk_prunes_by_coordinates():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 16))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    x = np.floor(64 * (centers[rng.integers(0, 40, 3000)] + 0.02 * rng.normal(size=(3000, 16))))
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    pick = rng.permutation(3000)[:50]
    own = topk.Searcher(np.arange(3000, 3050), x[pick], 5)
    sparse = []
    region = own.regions
    own.regions = lambda *a: sparse.append(r := region(*a)) or r
    for part in topk.buckets(x):
        own.bucket(np.arange(3000)[part], x[part])
    query, vec, score = own.found
    assert any(sparse)
    for q in range(50):
        s = x @ x[pick[q]]
        order = np.lexsort((np.arange(3000), -s))[:5]
        assert vec[query == q].tolist() == order.tolist()


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert topk.search(df, F.lit(True), k=20).count() == 6
    assert ann.search(df, F.lit(True), k=20).count() == 6
    for f in (topk.search, ann.search):
        assert f(df.limit(0), F.lit(True)).count() == 0


def test_ann(vectors):
    rows, df = vectors
    good = usable(rows, False)
    want = expected(good, 10)
    x = dict(good)
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, k=10).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]  # every row of a repeated query has its own ranks
    assert all(abs(s - x[q] @ x[v]) < 1e-9 and q != v for q, _, v, s in got)
    assert np.mean(list(recall(got, want).values())) >= 0.9


def test_ann_of_repeated_and_crowded_vectors(spark):
    """A third of the rows is one vector of one id, so many lists are small and the sample is mostly one point."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    rows = [(i, x[i]) for i in range(600)] + [(40, x[40])] * 300
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got, want = (sorted(r) for r in (map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, k=10).collect()), expected(rows, 10)))
    assert Counter(q for q, *_ in got) == Counter(q for q, *_ in want)
    assert np.mean(list(recall(got, want).values())) >= 0.9


def test_ann_sample_is_bounded_and_lists_grow(spark, monkeypatch):
    monkeypatch.setattr(ann, "LISTS", 4)
    df = spark.createDataFrame([(20, [float(i % 7), 1.0]) for i in range(500)], "vec_id long, embedding array<double>")
    rows = df.select(F.col("vec_id").alias("id"), F.monotonically_increasing_id().alias("number"), F.col("embedding").alias("v"))
    assert 0 < len(ann.sample_of(rows, 500, 2)) <= ann.PER_LIST * ann.lists_for(500)
    monkeypatch.undo()
    assert ann.lists_for(10**4) < ann.lists_for(10**6) < ann.lists_for(10**8) < ann.lists_for(10**9)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_queries_recall(spark, folder):
    d = f"/root/testdata/{folder}"
    e = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    rows = list(zip(e["vec_id"].tolist(), np.array(e["embedding"].tolist(), dtype=np.float64)))
    assert sorted(map(tuple, op3_exact_topk(spark, d).collect())) == expected([(i, np.floor(64 * v)) for i, v in rows], 20)
    found = recall(list(map(tuple, op4_adaptive_ann(spark, d).collect())), expected(rows, 20))
    print(folder, "recall", np.mean(list(found.values())), "worst query", min(found.values()))
    assert np.mean(list(found.values())) >= 0.9
