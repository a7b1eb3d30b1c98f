"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are ordered by length (Euclidean norm) and cut into buckets of similar length. For a query and a bucket, the
query's k-th best product so far over the query's length and the bucket's greatest length is a local cosine threshold. Above
1 the whole bucket is pruned. Else one of two ways is chosen by what the threshold leaves: by coordinates (the normalised
candidates whose largest query coordinates lie within the angle that the threshold allows, found in sorted columns) or by
length (the prefix of the bucket that is long enough). What is left is verified by exact integer products.

Vectors are scaled and floored first. Candidates are written in blocks of a level each, levels by falling length. Every
query first meets the SEEDS longest candidates and gets the k-th best product there as its bound. A level whose greatest
length times the query's length stays under the bound (strictly, for ties go to the smaller id) is left out before the join:
queries are ordered by the shortest length that they need, so a block of queries needs levels up to some last one and
meets no other. It travels once to each group of neighbouring levels in which it needs one. Inside the join a task keeps the
bounds of the query blocks that it has seen, so that thresholds go on from block to block. A block of queries yields at most k
rows a query for a group of levels, as long as its pairs come one after the other. Blocks hold components in the fewest bytes
that take the largest one.

Null vectors and vectors with a null or non-finite component take no part. Shorter vectors count as filled up with zeros.
Ties go to the smaller id; equal rows of one id are equal candidates, and a candidate with the query's own id is passed over.
Every row of a query id is a query and has its own k ranks. Components beyond 2**53 / scale aren't supported, and vectors of
more than MOST_WIDTH components raise.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, limit_arrow, materialize, tasks
from .vectors import best, check_width, numbered, pack_rows, ranked, unpack

#: Levels of candidates at most; longest candidates that give the first bounds; query blocks whose bounds a task keeps.
LEVELS, SEEDS, KEPT_BLOCKS = 1_024, 4_096, 1_024
#: Groups of levels for each core at least, and bytes of the vectors in a group at most (the join holds them in a task).
GROUPS, GROUP_BYTES = 4, 128 << 20
#: Candidates and queries of one block, candidates of one bucket (at most, and before a bucket may end by length), and the
#: least length in a bucket, as a share of the greatest.
CANDIDATES, QUERIES, BUCKET, SMALL_BUCKET, SIMILAR = 8_192, 1_024, 1_024, 64, 0.9
#: Coordinates tried per query; the share of a bucket up to which coordinates prune better than lengths.
FOCUS, COORDINATE_SHARE = 3, 0.25
#: Types of components in blocks by bytes, and the largest component that each takes.
KINDS = {1: ("i1", 127), 2: ("i2", 32_767), 4: ("i4", 2**31 - 1), 8: ("f8", float("inf"))}


def _candidates(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a block of candidates."""
    return unpack(ids, data, width, KINDS[8 * len(data) // (len(ids) * width)][0])


def _queries(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """numbers, ids, vectors and bounds (8 bytes after each vector) of a block of queries."""
    numbers, own = np.frombuffer(ids, np.int64).reshape(-1, 2).T
    raw = np.frombuffer(data, np.uint8).reshape(len(own), -1)
    vectors, least = raw[:, :-8].copy(), raw[:, -8:].copy()
    return numbers, own, vectors.view(KINDS[vectors.shape[1] // width][0]), least.view("f8")[:, 0]


def _narrowed(blocks: DataFrame, width: int, dtype: str) -> DataFrame:
    """Blocks of queries (ids, data) of vectors and bounds as doubles, with vectors of dtype."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch["data"]:
                rows = np.frombuffer(data).reshape(-1, width + 1)
                parts = (np.ascontiguousarray(x).view(np.uint8) for x in (rows[:, :-1].astype(dtype), rows[:, -1:]))
                out.append(np.concatenate([x.reshape(len(rows), -1) for x in parts], axis=1).tobytes())
            yield pd.DataFrame({"qids": batch["ids"], "qdata": out})

    return blocks.select("ids", "data").mapInPandas(run, "qids binary, qdata binary")


def buckets(rows: np.ndarray) -> list[slice]:
    """Buckets of rows by falling length."""
    length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    out, at = [], 0
    while at < len(rows):
        similar = int(np.searchsorted(-length, -SIMILAR * length[at], side="right"))
        end = min(len(rows), at + BUCKET, max(similar, at + SMALL_BUCKET))
        out.append(slice(at, end))
        at = end
    return out


class Searcher:
    """The k best of a block of queries over buckets that come one after the other."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        """least: a product that k candidates of each query reach at least, where it is known."""
        self.ids, self.q, self.k = ids, queries.astype(np.float64), k
        self.length = np.sqrt((self.q**2).sum(axis=1))
        self.unit = self.q / np.maximum(self.length, 1e-300)[:, None]
        self.least = np.full(len(ids), -np.inf) if least is None else least.astype(np.float64)
        self.pruned = self.sparse = 0  # (query, bucket) pairs that are left out, or searched by coordinates
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        other = self.ids[query] != vec
        query, vec, score = (np.concatenate([a, b[other]]) for a, b in zip(self.found, (query, vec, score)))
        keep = best(query, vec, score, self.k)
        query, vec, score = self.found = query[keep], vec[keep], score[keep]
        counts = np.bincount(query, minlength=len(self.ids))
        full = counts >= self.k
        ends = np.cumsum(counts) - 1
        self.least[full] = np.maximum(self.least[full], score[ends[full]])

    def bucket(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """rows by falling length."""
        rows = rows.astype(np.float64)
        length = np.sqrt((rows**2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            local = self.least / (self.length * length[0])
        local[self.length * length[0] == 0] = -np.inf
        # a zero query or bucket scores 0 everywhere, which can only be pruned by a positive k-th best
        alive = np.where(self.length * length[0] == 0, self.least <= 0, local <= 1 + 1e-12)
        self.pruned += int((~alive).sum())
        slices = self.regions(rows, length, local, np.flatnonzero(alive & (local > 0)))
        self.sparse += len(slices)
        dense = alive.copy()
        dense[list(slices)] = False
        self.by_length(ids, rows, length, np.flatnonzero(dense))
        if slices:
            parts = []
            for i, at in slices.items():
                score = rows[at] @ self.q[i]
                hit = score >= self.least[i]
                parts.append((np.full(hit.sum(), i), ids[at[hit]], score[hit]))
            self.add(*(np.concatenate(x) for x in zip(*parts)))

    def regions(self, rows: np.ndarray, length: np.ndarray, local: np.ndarray, queries: np.ndarray) -> dict[int, np.ndarray]:
        """For the queries that coordinates prune well: the places of the candidates within the feasible region."""
        if not len(queries):
            return {}
        angle = np.arccos(np.clip(local[queries], -1, 1))
        at_query = np.arccos(np.clip(np.take_along_axis(self.unit[queries], self.focus[queries], axis=1), -1, 1))
        low = np.cos(np.minimum(np.pi, at_query + angle[:, None])) - 1e-9
        high = np.cos(np.maximum(0, at_query - angle[:, None])) + 1e-9
        worth = (high - low).min(axis=1) < 1.0  # wider regions hold most of a bucket
        if not worth.any():
            return {}
        unit = rows / np.maximum(length, 1e-300)[:, None]
        order, out = {}, {}
        for j in np.flatnonzero(worth):
            i = queries[j]
            best_slice = None
            for f, lo, hi in zip(self.focus[i], low[j], high[j]):
                if f not in order:
                    o = np.argsort(unit[:, f])
                    order[f] = o, unit[o, f]
                o, column = order[f]
                a, b = np.searchsorted(column, lo), np.searchsorted(column, hi, side="right")
                if best_slice is None or b - a < len(best_slice):
                    best_slice = o[a:b]
            if len(best_slice) <= COORDINATE_SHARE * len(rows):
                for f, lo, hi in zip(self.focus[i], low[j], high[j]):
                    best_slice = best_slice[(unit[best_slice, f] >= lo) & (unit[best_slice, f] <= hi)]
                out[i] = best_slice
        return out

    def by_length(self, ids: np.ndarray, rows: np.ndarray, length: np.ndarray, queries: np.ndarray) -> None:
        if not len(queries):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(self.length[queries] > 0, self.least[queries] / self.length[queries], -np.inf) * (1 - 1e-12)
        upto = np.searchsorted(-length, -needed, side="right")
        score = self.q[queries] @ rows[: upto.max()].T
        score[self.ids[queries][:, None] == ids[None, : score.shape[1]]] = -np.inf  # an id can have any number of rows
        least = self.least[queries]
        if score.shape[1] > self.k:
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        hit = score >= least[:, None]
        at, col = np.nonzero(hit)
        self.add(queries[at], ids[col], score[at, col])


def _levels(rows: DataFrame, width: int, total: int, dtype: str) -> DataFrame:
    """level, longest (the greatest length in the level), ids, data: blocks of candidates, levels by falling length."""
    spark = rows.sparkSession
    parts = max(1, min(total // BUCKET, LEVELS, max(tasks(spark), total // CANDIDATES)))
    order = F.col("norm").desc(), F.col("number")
    by_length = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = pack_rows(by_length.select(F.spark_partition_id().alias("level"), "id", "v"), ("level",), width, CANDIDATES, dtype)
    return materialize(spark, blocks, "candidates")


def _seeds(levels: DataFrame, sizes: list[tuple[int, float, int]], width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of the `most` longest candidates by falling length; sizes: level, longest, rows by level.

    They come from the first levels that hold as many. Tasks cut their blocks to `most` rows, then one task cuts theirs, so
    that the driver gets one block, however many tasks there are.
    """
    upto, held = -1, 0
    for level, _, rows in sizes:
        if held < most:
            upto, held = level, held + rows

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, data = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            for more, rows in zip(batch["ids"], batch["data"]):
                more, rows = _candidates(more, rows, width)
                ids, data = np.concatenate((ids, more)), np.concatenate((data, rows))
                order = np.argsort(-(data**2).sum(axis=1), kind="stable")[:most]
                ids, data = ids[order], data[order]
        if len(ids):
            yield pd.DataFrame([(ids.tobytes(), data.tobytes())], columns=["ids", "data"])

    schema = "ids binary, data binary"
    blocks = levels.filter(F.col("level") <= upto).select("ids", "data").mapInPandas(cut, schema)
    found = blocks.repartition(1).mapInPandas(cut, schema).collect()
    return unpack(found[0]["ids"], found[0]["data"], width, "f8") if found else (np.zeros(0, np.int64), np.zeros((0, width)))


def _seeded(rows: DataFrame, seeds: tuple[np.ndarray, np.ndarray], width: int, k: int) -> DataFrame:
    """query, id, v, least, need (the shortest candidate length that can reach least) of every query row."""
    shared = rows.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, data = shared.value
        parts = buckets(data)
        for batch in batches:
            if not len(batch):
                continue
            queries = np.zeros((len(batch), width))
            for i, v in enumerate(batch["v"]):
                queries[i, : len(v)] = v
            own = Searcher(batch["id"].to_numpy(np.int64), queries, k)
            for part in parts:
                own.bucket(ids[part], data[part])
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(own.least > 0, own.least / own.length * (1 - 1e-12), 0.0)
            yield batch.assign(least=own.least, need=need)

    return rows.filter("asks").select(F.col("number").alias("query"), "id", "v").mapInPandas(run, "query bigint, id bigint, v array<double>, least double, need double")


def block_pairs(df: DataFrame, is_query: Column, k: int, scale: float, id_col: str, vector_col: str, narrow: bool = False) -> tuple[DataFrame, int, int]:
    """The pairs of a query block and a candidate block that can hold results (qids: query and id, qdata: vector and least,
    ids, data), the width of the vectors, and the number of pairs of a query block and a level before pruning.

    narrow: components in as few bytes as take the largest one, else as doubles.
    """
    spark = df.sparkSession
    limit_arrow(spark)
    rows = numbered(df, is_query, id_col, vector_col)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")))
    rows = materialize(spark, rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "scaled")
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    total, width, asked, largest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if("asks"), largest).first()
    width = check_width(width)
    size = min(n for n, (_, most) in KINDS.items() if (largest or 0) <= most) if narrow else 8
    dtype = KINDS[size][0]
    levels = _levels(rows, width, total, dtype)
    # the greatest length and the rows of each level: LEVELS rows at most
    first = levels.mapInPandas(lambda batches: _longest(batches, width), "level int, longest double, rows bigint").groupBy("level").agg(F.max("longest"), F.sum("rows"))
    sizes = sorted(map(tuple, first.collect()))
    forget(spark)  # the sorted vectors' shuffle files
    seeds = _seeds(levels, sizes, width, max(2 * k, min(SEEDS, (1 << 22) // width)))
    seeded = materialize(spark, _seeded(rows, seeds, width, k), "seeded")
    # queries in blocks by what they need; a block goes to the levels that are long enough for one of its queries
    parts = max(1, -(-asked // QUERIES))
    packed = seeded.select(F.lit(0).alias("part"), "query", "id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")), F.array("least")).alias("v"), "need")
    packed = packed.repartitionByRange(parts, F.col("need"), F.col("query")).sortWithinPartitions("need", "query")
    packed = pack_rows(packed.select("part", "query", "id", "v"), ("part",), width + 1, QUERIES, "f8", ids=("query", "id"))
    packed = materialize(spark, _narrowed(packed, width, dtype), "queries")
    forget(spark)
    reach = np.array([x for _, x, _ in sizes])
    names = np.array([n for n, _, _ in sizes], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def wanted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for qids, qdata in batches:
            out = []
            for i, d in zip(qids, qdata):
                _, _, data, least = _queries(i, d, width)
                length = np.sqrt((data.astype(np.float64) ** 2).sum(axis=1))
                # strictly under the bound goes; without a positive length a bound above 0 is out of reach
                can = (length[:, None] * reach[None] * (1 + 1e-12) >= least[:, None]).any(axis=0)
                out.append(names[can])
            yield pd.Series(out)

    groups = max(GROUPS * spark.sparkContext.defaultParallelism, -(-total * width * size // GROUP_BYTES))
    per = max(1, -(-len(sizes) // groups))  # levels of one group
    sent = packed.select("qids", "qdata", wanted("qids", "qdata").alias("levels"))
    sent = sent.select("*", F.expr(f"explode(array_distinct(transform(levels, x -> x div {per})))").alias("group"))
    # no side is ever broadcast: blocks of equal vectors are far smaller in files than in the driver
    met = sent.hint("merge").join(levels.withColumn("group", F.expr(f"level div {per}")), "group").filter("array_contains(levels, level)")
    return met.select("qids", "qdata", "ids", "data"), width, -(-asked // QUERIES) * len(sizes)


def _longest(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [(level, float(np.sqrt((_candidates(i, d, width)[1].astype(np.float64) ** 2).sum(axis=1)).max()), len(i) // 8) for level, i, d in zip(batch["level"], batch["ids"], batch["data"])]
        yield pd.DataFrame(found, columns=["level", "longest", "rows"])


def search(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score long: the k largest products of every query row with the other rows."""
    pairs, width, _ = block_pairs(df, is_query, k, scale, id_col, vector_col, narrow=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds: dict[int, np.ndarray] = {}
        own, query = None, np.zeros(0, np.int64)

        def found() -> pd.DataFrame:
            at, vec, score = own.found
            return pd.DataFrame({"query": query[at], "query_id": own.ids[at], "vec_id": vec, "score": score.astype(np.int64)})

        for batch in batches:
            for qids, qdata, ids, data in zip(batch["qids"], batch["qdata"], batch["ids"], batch["data"]):
                if own is None or np.frombuffer(qids, np.int64, 1)[0] != query[0]:
                    if own is not None:
                        yield found()
                    if len(bounds) > KEPT_BLOCKS:
                        bounds.clear()
                    query, qids, qdata, least = _queries(qids, qdata, width)
                    own = Searcher(qids, qdata, k, bounds.get(int(query[0]), least))
                ids, data = _candidates(ids, data, width)
                for part in buckets(data):
                    own.bucket(ids[part], data[part])
                bounds[int(query[0])] = own.least
        if own is not None:
            yield found()

    return ranked(pairs.mapInPandas(run, "query bigint, query_id bigint, vec_id bigint, score bigint"), k)
