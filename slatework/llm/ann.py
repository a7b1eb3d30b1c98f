"""Approximate nearest neighbours by inner product: inverted lists with an adaptive scan of dimensions.

Largest inner product becomes least distance by one more coordinate, sqrt(M**2 - |x|**2) for candidates (M the greatest
length) and 0 for queries. Vectors are rotated at random and cut into blocks of columns. For a query and a chunk of a probed
list the distance grows block by block; after each block a hypothesis test abandons the candidates whose partial distance,
scaled to all dimensions, exceeds the query's k-th best distance by more than chance allows (epsilon). Survivors get the
exact product in double precision.

Centroids come from k-means on a sample of PER_LIST vectors a list. Lists grow with the root of the table up to LISTS, so the
sample is bounded by LISTS * PER_LIST vectors. The number of probed lists is the smallest that finds `recall` of the sample's
own neighbours; a query probes more where these hold too few candidates, by the true sizes of all lists. Every vector is
indexed. Lists are written in chunks of bounded size, dealt by row, so one that holds a large part of all vectors is many
chunks of many tasks; a block of queries is sent to a list once and meets its chunks inside the join.

Vectors that are null or zero or have null or non-finite components take no part; shorter vectors count as filled up with
zeros, and vectors of more than MOST_WIDTH components raise. Ties go to the smaller id; a candidate with the query's own id
is passed over. Every row of a query id is a query and has its own ranks.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_arrow, materialize
from .vectors import best, check_width, matrix, numbered, pack_rows, ranked, unpack

#: Lists at most (their number is half the root of the table's rows); sample vectors a list; candidates of a chunk; query
#: rows that are sent together.
LISTS, PER_LIST, CHUNK, QUERIES = 16_384, 16, 4_096, 4_096
#: Columns of a block; the test's epsilon; the share of living pairs below which they are followed one by one.
COLUMNS, EPSILON, SPARSE = 16, 2.1, 0.15


def lists_for(total: int) -> int:
    return int(np.clip(math.sqrt(total) / 2, 1, LISTS))


def sample_of(rows: DataFrame, total: int, width: int) -> np.ndarray:
    """At most PER_LIST vectors a list, of rows (number, v); at least 4,096, so that small tables are taken whole."""
    most = PER_LIST * lists_for(total)
    most = max(most, 4_096) if lists_for(total) < LISTS else most
    share = F.pmod(F.xxhash64("number"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.05 * most / max(1, total)))
    return matrix([r[0] for r in rows.filter(share).limit(most).select("v").collect()], width, np.float64)


def rotation(width: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def lift(x: np.ndarray, greatest: float | None) -> np.ndarray:
    """One more coordinate, which makes inner products distances; 0 for queries (greatest None)."""
    more = np.zeros(len(x)) if greatest is None else np.sqrt(np.maximum(greatest**2 - (x.astype(np.float64) ** 2).sum(axis=1), 0))
    return np.column_stack([x, more])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The place of the nearest center, in steps that keep the table of distances small."""
    step = max(1, (1 << 22) // len(centers))
    return np.concatenate([np.zeros(0, np.int64), *(distances(x[i : i + step], centers).argmin(axis=1) for i in range(0, len(x), step))])


def k_means(x: np.ndarray, n: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(centers))
        some = counts > 0
        centers[some] = sums[some] / counts[some][:, None]
    return centers


def probes_for(sample: np.ndarray, as_queries: np.ndarray, centers: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """The fewest lists that hold `recall` of the sample's own k nearest."""
    if len(sample) < 2:
        return len(centers)
    pick = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
    near = distances(as_queries[pick], sample)
    near[np.arange(len(pick)), pick] = np.inf
    top = np.argsort(near, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    own = nearest(sample, centers)
    order = np.argsort(distances(as_queries[pick], centers), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centers)), order.shape).copy(), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1


def enough(order: np.ndarray, sizes: np.ndarray, n_probes: int, wanted: int) -> np.ndarray:
    """How many of each query's lists, in order, to probe: n_probes, or more where these hold fewer than wanted rows."""
    filled = np.cumsum(sizes[order], axis=1)
    return np.minimum(np.maximum((filled < wanted).sum(axis=1) + 1, n_probes), order.shape[1])


class Thresholds(dict):
    """The k-th best distance of each query that this task has seen; of bounded size."""

    def put(self, query: int, value: float) -> None:
        if len(self) > 500_000:
            self.clear()
        self[query] = value


def scan_chunk(queries: np.ndarray, rows: np.ndarray, bounds: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place) of the survivors, and the new k-th best distances. Inputs are rotated, float32.

    own: places of pairs that don't count, a query and a row of its own id.
    """
    n, width = rows.shape
    starts = list(range(0, max(1, width - COLUMNS // 2), COLUMNS))
    ends = [*starts[1:], width]
    slack = 1e-4 * max(float((rows * rows).sum(axis=1).max(initial=0)), float((queries * queries).sum(axis=1).max(initial=0)), 1e-30)
    if n > k:  # a first bound from whole distances of a few
        head = distances(queries, rows[: max(4 * k, 64)])
        early = own[1] < head.shape[1]
        head[own[0][early], own[1][early]] = np.inf
        if head.shape[1] >= k:
            bounds = np.minimum(bounds, np.partition(head, k - 1, axis=1)[:, k - 1])
    partial = np.zeros((len(queries), n), np.float32)
    partial[own] = np.inf
    alive = np.ones(partial.shape, bool)
    at = col = value = None
    for a, b in zip(starts, ends):
        seen = b
        limit = (bounds * (seen / width) * (1 + EPSILON / math.sqrt(seen)) ** 2 if seen < width else bounds) + slack
        if value is None:
            q, p = queries[:, a:b], rows[:, a:b]
            partial += np.maximum((q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * (q @ p.T), 0)
            alive = (partial <= limit[:, None]) & (partial < np.inf)
            if alive.mean() < SPARSE or seen == width:
                at, col = np.nonzero(alive)
                value = partial[at, col]
        else:
            gap = queries[at, a:b] - rows[col, a:b]
            value = value + (gap * gap).sum(axis=1)
            keep = value <= limit[at]
            at, col, value = at[keep], col[keep], value[keep]
    # the k-th best and everything within the slack of it
    order = np.lexsort((value, at))
    at, col, value = at[order], col[order], value[order]
    counts = np.bincount(at, minlength=len(queries))
    first = np.cumsum(counts) - counts
    new = bounds.copy()
    full = counts >= k
    new[full] = np.minimum(new[full], value[first[full] + k - 1])
    keep = value <= new[at] + slack
    return at[keep], col[keep], new


def search(df: DataFrame, is_query: Column, k: int = 20, recall: float = 0.96, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score double: the k nearest found for every query row among the other rows."""
    spark = df.sparkSession
    limit_arrow(spark)
    rows = numbered(df, is_query, id_col, vector_col).filter(F.exists("v", lambda x: x != 0))
    rows = materialize(spark, rows, "usable")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, width, greatest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.max(F.sqrt(square)), F.lit(0.0))).first()
    width = check_width(width)
    own_rows = rows.filter("asks").select("id").distinct().join(rows.select("id"), "id").groupBy("id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    dtype = "f8" if "double" in dict(rows.dtypes)["v"] else "f4"
    sample = sample_of(rows, total, width)
    turn = rotation(width + 1)
    lifted = lift(sample, greatest) @ turn
    centers = k_means(lifted, min(len(sample), lists_for(total))) if len(sample) else np.zeros((1, width + 1))
    n_probes = probes_for(lifted, lift(sample, None) @ turn, centers, k, recall)
    shared = spark.sparkContext.broadcast((turn, centers))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, centers = shared.value
        for batch in batches:
            if len(batch):
                x = lift(matrix(batch["v"], width, np.float64), greatest) @ turn
                yield batch.assign(list=nearest(x, centers).astype(np.int32))

    kind = "double" if dtype == "f8" else "float"
    index = rows.mapInPandas(assign, f"id bigint, number bigint, asks boolean, v array<{kind}>, list int")
    index = materialize(spark, index, "index")
    sizes = np.zeros(len(centers), np.int64)
    for n, size in index.groupBy("list").count().collect():  # a row a list
        sizes[n] = size
    chunked = spark.createDataFrame([(n, -(-size // CHUNK)) for n, size in enumerate(sizes.tolist())], "list int, n_chunks int")
    chunk = F.pmod(F.xxhash64("number"), F.col("n_chunks").cast("long")).cast("int").alias("chunk")
    parts = max(1, min(int((-(-sizes // CHUNK)).sum()), max(4 * spark.sparkContext.defaultParallelism, total // (4 * CHUNK))))
    blocks = index.join(F.broadcast(chunked), "list").select("list", chunk, "id", "v")  # LISTS rows at most
    blocks = pack_rows(blocks.repartition(parts, "list", "chunk").sortWithinPartitions("list", "chunk"), ("list", "chunk"), width, 4 * CHUNK, dtype)
    blocks = materialize(spark, blocks, "lists")  # written, so that beside it the chunks of a long list can be split

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, centers = shared.value
        held: list[pd.DataFrame] = []

        def sent() -> Iterator[pd.DataFrame]:
            """Every list that some of the held queries probe, with these queries."""
            numbers = np.concatenate([b[["number", "id"]].to_numpy(np.int64) for b in held])
            data = np.concatenate([matrix(b["v"], width, np.dtype(dtype)) for b in held])
            order = np.concatenate([b["order"].to_numpy() for b in held])
            who = np.repeat(np.arange(len(order)), [len(o) for o in order])
            which = np.concatenate(order)
            by = np.argsort(which, kind="stable")
            cuts = np.flatnonzero(np.diff(which[by])) + 1
            for own in np.split(who[by], cuts):
                yield pd.DataFrame([(int(which[by[0]]), numbers[own].tobytes(), data[own].tobytes())], columns=["list", "qids", "qdata"])
                by = by[len(own) :]

        for batch in batches:
            if len(batch):
                x = lift(matrix(batch["v"], width, np.float64), None) @ turn
                order = np.argsort(distances(x, centers), axis=1, kind="stable").astype(np.int32)
                held.append(batch.assign(order=[o[:n] for o, n in zip(order, enough(order, sizes, n_probes, k + own_rows))]))
                if sum(map(len, held)) >= QUERIES:
                    yield from sent()
                    held = []
        if held:
            yield from sent()

    asks = index.filter("asks").select("number", "id", "v")
    asked = materialize(spark, asks.mapInPandas(probe, "list int, qids binary, qdata binary"), "probes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, _ = shared.value
        known = Thresholds()
        last, turned = None, None
        for batch in batches:
            for qids, qdata, ids, data in zip(batch["qids"], batch["qdata"], batch["ids"], batch["data"]):
                same = last == (ids[:64], ids[-64:], len(ids))
                last = ids[:64], ids[-64:], len(ids)
                ids, data = unpack(ids, data, width, dtype)
                (number, qids), qdata = unpack(qids, qdata, width, dtype, 2)
                if not same:
                    turned = (lift(data, greatest) @ turn).astype(np.float32)
                for a in range(0, len(qids), 512):
                    number_, qids_, qdata_ = number[a : a + 512], qids[a : a + 512], qdata[a : a + 512]
                    asks = (lift(qdata_, None) @ turn).astype(np.float32)
                    bounds = np.array([known.get(i, np.inf) for i in number_.tolist()], np.float64)
                    at, col, bounds = scan_chunk(asks, turned, bounds, k, np.nonzero(qids_[:, None] == ids[None]))
                    for i, b in zip(number_.tolist(), bounds.tolist()):
                        known.put(i, b)
                    score = np.concatenate([np.zeros(0), *((qdata_[at[i : i + 65536]].astype(np.float64) * data[col[i : i + 65536]]).sum(axis=1) for i in range(0, len(at), 65536))])
                    keep = best(at, ids[col], score, k)
                    yield pd.DataFrame({"query": number_[at[keep]], "query_id": qids_[at[keep]], "vec_id": ids[col[keep]], "score": score[keep]})

    pairs = asked.join(blocks, "list").select("qids", "qdata", "ids", "data")
    return ranked(pairs.mapInPandas(run, "query bigint, query_id bigint, vec_id bigint, score double"), k)
