"""What the two vector searches share: usable vectors, blocks of vectors as single rows, the merge of best lists."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Components of a vector at most: blocks, rotations and centroids are dense arrays of this width.
MOST_WIDTH = 8_192


def usable(vector: Column) -> Column:
    """Not null, and no component that is null, NaN or infinite."""
    limit = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit), F.lit(False)))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(vectors: pd.Series, width: int, dtype) -> np.ndarray:
    """Rows of a batch; shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), width), dtype)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def pack_rows(rows: DataFrame, keys: tuple[str, ...], width: int, most: int, dtype: str, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """Blocks (keys, ids, data binary) of at most `most` vectors, of runs of rows (keys, ids long, v array) with equal keys.

    Rows are taken in the order in which they come; a task holds one block at a time.
    """
    schema = ", ".join(f"{k} int" for k in keys) + ", ids binary, data binary"
    columns = [*keys, "ids", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, size = None, 0

        def block() -> pd.DataFrame:
            numbers, data = (np.concatenate(x) for x in zip(*held))
            return pd.DataFrame([(*now, numbers.tobytes(), data.tobytes())], columns=columns)

        for batch in batches:
            if not len(batch):
                continue
            key = batch[list(keys)].to_numpy(np.int64)
            numbers, data = batch[list(ids)].to_numpy(np.int64), matrix(batch["v"], width, np.dtype(dtype))
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(numbers)]):
                own = tuple(key[a].tolist())
                if held and own != now:
                    yield block()
                    held, size = [], 0
                now = own
                while a < b:
                    take = min(b - a, most - size)
                    held.append((numbers[a : a + take], data[a : a + take]))
                    a, size = a + take, size + take
                    if size == most:
                        yield block()
                        held, size = [], 0
        if held:
            yield block()

    return rows.mapInPandas(run, schema)


def unpack(ids: bytes, data: bytes, width: int, dtype: str, columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The numbers (columns by rows, or one array) and vectors of a block."""
    numbers = np.frombuffer(ids, np.int64)
    return numbers if columns == 1 else numbers.reshape(-1, columns).T, np.frombuffer(data, np.dtype(dtype)).reshape(-1, width)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: the highest scores, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


def numbered(df: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """id, number (its own for every row), asks (whether it is a query), v of the usable rows. To be written before use."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), F.col(vector_col).alias("v"))
    rows = rows.filter(usable(F.col("v")) & F.col("id").isNotNull())
    return rows.select("id", F.monotonically_increasing_id().alias("number"), F.coalesce("asks", F.lit(False)).alias("asks"), "v")


def check_width(width: int) -> int:
    if width > MOST_WIDTH:
        raise ValueError(f"vectors have up to {width} components, {MOST_WIDTH} are supported")
    return max(1, width)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query row over all blocks; found: query, query_id, vec_id, score."""
    within = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
