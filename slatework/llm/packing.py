"""Best-fit packing by minimum bin slack.

Per bin: the longest piece that is left goes first (it has to go somewhere), then a bitset subset-sum over the available
lengths finds the fullest combination that fits beside it. Only the number of pieces of each length matters, so the
search runs on the histogram of lengths (at most `capacity` entries), and a combination is taken as often as the counts
allow in one step. Each such step uses up at least one length or leaves less of it than one bin takes, which bounds the
number of steps by a few times the number of lengths, whatever the number of rows.

The plan is ranges of ranks within a length. Rows are numbered when they are written first; a piece's rank among its equals
is its place in a hash bucket of these numbers plus the sizes of the buckets before it. A length has as many buckets as it
has BUCKET_ROWS pieces, so a frequent length, and any number of equal rows, is spread over many tasks.

Lengths must be between 1 and `capacity`; others, and a capacity above MOST_CAPACITY, raise. An empty table gives an empty
table. Pieces of one length are interchangeable, equal rows too: each gets a place of its own, in the order in which they
are read. Extra columns are kept, whatever their names, but for those of the result.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, limit_arrow, materialize

#: Rows of one rank bucket on average; the largest capacity: the histogram has a row for each length and is broadcast.
BUCKET_ROWS, MOST_CAPACITY = 500, 1 << 16


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths (repeated, longest first) whose sum is the largest possible up to room, longer ones preferred."""
    whole = (1 << (room + 1)) - 1
    goal = 1 << room
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        k, unit = min(counts[n], room // n), 1
        while k > 0:  # 1, 2, 4, ... and the rest: every multiple up to k
            take = min(unit, k)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & whole
            k -= take
            unit *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    out: list[int] = []
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            out += [n] * take
            at -= n * take
    return sorted(out, reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, per_bin, first sequence, offset): ranks [from, to) of a length go, per_bin to a
    sequence, to consecutive sequences, at offset and then side by side."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    if None in counts or (counts and not 1 <= min(counts) <= max(counts) <= capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths = sorted(counts, reverse=True)
    used = dict.fromkeys(lengths, 0)
    rows, sequence = [], 0
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        combo = [first, *fullest(lengths, counts, capacity - first)]
        counts[first] += 1
        need: dict[int, int] = {}
        for n in combo:
            need[n] = need.get(n, 0) + 1
        times = min(counts[n] // k for n, k in need.items())
        offset = 0
        for n, k in need.items():
            rows.append((n, used[n], used[n] + times * k, k, sequence, offset))
            used[n] += times * k
            counts[n] -= times * k
            offset += n * k
        sequence += times
        lengths = [n for n in lengths if counts[n]]
    return rows


def pack(df: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """df + sequence_id long, offset long, which replace columns of these names."""
    if capacity > MOST_CAPACITY:
        raise ValueError(f"the capacity is {MOST_CAPACITY} at most")
    spark = df.sparkSession
    limit_arrow(spark)
    kept = [c for c in df.columns if c not in ("sequence_id", "offset")]
    number, size, bucket, before, row, place = (fresh(df, n) for n in ("number", "size", "bucket", "before", "row", "place"))
    rows = df.select(*kept, F.col(length_col).cast("int").alias(size)).withColumn(number, F.monotonically_increasing_id())
    rows = materialize(spark, rows, "pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy(size).count().limit(capacity + 2).collect()}
    placed = np.array(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 6)  # raises on wrong lengths
    shared = spark.sparkContext.broadcast(placed)
    spread = spark.createDataFrame([(n, -(-c // BUCKET_ROWS)) for n, c in histogram.items()], f"{size} int, {before} long")
    keyed = rows.join(F.broadcast(spread), size)  # a row for each length, capacity at most
    keyed = keyed.withColumn(bucket, F.pmod(F.xxhash64(number), F.col(before))).drop(before)
    sizes = keyed.groupBy(size, bucket).agg(F.count("*").alias(row))
    earlier = Window.partitionBy(size).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(size, bucket, F.coalesce(F.sum(row).over(earlier), F.lit(0)).alias(before))
    sizes = materialize(spark, sizes, "bucket-sizes")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def put(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        shift = int(rows[:, 2].max(initial=0)) + 1
        starts = rows[:, 0] * shift + rows[:, 1]
        for n, rank in batches:
            n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
            r = rows[np.searchsorted(starts, n * shift + rank, side="right") - 1]
            k = rank - r[:, 1]
            yield pd.DataFrame({"sequence_id": r[:, 4] + k // r[:, 3], "offset": r[:, 5] + n * (k % r[:, 3])})

    within = Window.partitionBy(size, bucket).orderBy(number)
    ranked = keyed.withColumn(row, F.row_number().over(within)).join(sizes, [size, bucket])
    ranked = ranked.withColumn(place, put(F.col(size).cast("long"), F.col(before) + F.col(row) - 1))
    return ranked.select(*kept, F.col(place)["sequence_id"].alias("sequence_id"), F.col(place)["offset"].alias("offset"))
