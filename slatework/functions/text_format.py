"""The text form of result rows: each value and a bar.

Floats are written with the fewest digits that give the value back, never with an exponent; whole ones below 1e15 get `.0`,
larger ones are written out. 32-bit floats are widened first. Strings are written as they are.
"""

from __future__ import annotations

import math
from decimal import Decimal
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_float(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    text = repr(x)
    if "e" in text:
        text = format(Decimal(text), "f")
    if x == math.trunc(x):
        whole = text.split(".")[0]
        return f"{whole}.0" if abs(x) < 1e15 else whole
    return text


@F.pandas_udf(T.StringType())
def _format_floats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([None if x is None else format_float(x) for x in batch.astype(object).where(batch.notna(), None)], dtype=object)


def _float_text(value: Column) -> Column:
    """Plain doubles in the JVM where Spark writes them alike; others (exponents, NaN) through the formatter."""
    x = value.cast("double")
    return F.when(F.isnan(x), F.lit("NaN")).when((F.abs(x) >= 0.001) & (F.abs(x) < 1e7) | (x == 0), x.cast("string")).otherwise(_format_floats(x))


def value_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _float_text(value)
    return value.cast("string")


def lines(df: DataFrame) -> DataFrame:
    """One column `value`: the text form of each row. Null values are written as nothing."""
    columns = [f"_v{i}" for i in range(len(df.columns))]
    kinds = [f.dataType for f in df.schema.fields]
    plain = df.toDF(*columns)
    return plain.select(F.concat(*(F.concat(F.coalesce(value_text(F.col(c), k), F.lit("")), F.lit("|")) for c, k in zip(columns, kinds))).alias("value"))
