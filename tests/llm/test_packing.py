import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from slatework.llm import packing
from slatework.llm.queries import op5_best_fit_packing


def brute_fullest(items, room):
    return max((sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room), default=0)


def test_fullest_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 12) for _ in range(rng.randint(0, 9))]
        counts, room = Counter(items), rng.randint(0, 30)
        got = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(got) == brute_fullest(items, room) and not Counter(got) - counts


def check(rows, capacity):
    bins = {}
    for length, seq, offset in rows:
        bins.setdefault(seq, []).append((offset, length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity,n,most", [(10, 300, 10), (100, 500, 60), (64, 1, 64), (50, 2000, 7)])
def test_packing(spark, capacity, n, most):
    rng = random.Random(n)
    rows = [(i, 0, rng.randint(1, most), "x", 0) for i in range(n)]
    rows += rows[:2]  # repeated rows get places of their own
    names = ("number", "size", "bucket", "before", "row", "place")
    rows = [(*r, *range(70, 76)) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, _row string, offset int, " + ", ".join(f"{n} int" for n in names))
    out = packing.pack(df, capacity)
    assert out.columns == [*(c for c in df.columns if c != "offset"), "sequence_id", "offset"]
    assert {tuple(r) for r in out.select("_row", *names).collect()} == {("x", *range(70, 76))}
    got = [(r["length"], r["sequence_id"], r["offset"]) for r in out.collect()]
    assert Counter(x for x, *_ in got) == Counter(r[2] for r in rows)
    used, least = check(got, capacity), -(-sum(r[2] for r in rows) // capacity)
    assert used <= least * 1.1 + 1


def test_equal_rows_are_spread(spark):
    df = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(7).alias("length"))
    with_plan = packing.pack(df, 64)
    assert check([tuple(r) for r in with_plan.select("length", "sequence_id", "offset").collect()], 64) == -(-100_000 // 9)
    rows = with_plan.sparkSession.range(100_000).select(F.pmod(F.xxhash64(F.col("id")), F.lit(-(-100_000 // packing.BUCKET_ROWS))).alias("b"))
    sizes = [r["count"] for r in rows.groupBy("b").count().collect()]
    assert len(sizes) == -(-100_000 // packing.BUCKET_ROWS) and max(sizes) < 2 * packing.BUCKET_ROWS


def test_too_large_a_capacity(spark):
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(spark.createDataFrame([(1, 0, 5)], "doc_id long, piece int, length long"), 1 << 20)


def test_empty_and_wrong_lengths(spark):
    schema = "doc_id long, piece int, length long"
    assert packing.pack(spark.createDataFrame([], schema), 8).count() == 0
    for bad in (0, 9, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, 0, bad)], schema), 8)


def test_query(spark, sf):
    rows = op5_best_fit_packing(spark, sf).collect()
    used = check([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 4096)
    assert used == -(-sum(r["length"] for r in rows) // 4096)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
