"""Token pieces of documents for packing: tokenize whole texts, add an end id, cut what is longer than a sequence.

Null and empty texts give the end id alone. Repeated rows give their pieces each; kept columns can have any name but those of
the result.
"""

from __future__ import annotations

import json
import struct
import zlib
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import check_spec, read_spec, shared_model
from .common import fresh, limit_arrow


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """keep + piece int, start long, length long, ids_crc32 long (+ ids binary): one row per piece of at most `capacity` ids."""
    spark = df.sparkSession
    limit_arrow(spark)
    text = read_spec(tokenizer_path)
    check_spec(json.loads(text))
    spec = spark.sparkContext.broadcast(text)
    end = struct.pack("<I", end_id)
    step = 4 * capacity

    ids_field = ", ids: binary" if with_ids else ""

    @F.pandas_udf(f"array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint{ids_field}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared_model(spec.value)
        for texts in batches:
            out = []
            for text in texts:
                ids = model.encode(text) + end
                cut = [ids[i : i + step] for i in range(0, len(ids), step)]
                out.append([{"piece": k, "start": k * capacity, "length": len(c) // 4, "ids_crc32": zlib.crc32(c)} | ({"ids": c} if with_ids else {}) for k, c in enumerate(cut)])
            yield pd.Series(out)

    made = fresh(df, "made")
    return df.select(*keep, F.explode(run(F.col(text_col))).alias(made)).select(*keep, f"{made}.*")
