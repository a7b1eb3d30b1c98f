"""Where results go: text lines with an end mark, and an SQLite database for cross-checks."""

from __future__ import annotations

import sqlite3
from itertools import islice
from pathlib import Path
from typing import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.text_format import lines

END_MARK = "!"
#: Rows of one INSERT.
INSERT_ROWS = 1024


def write_text(df: DataFrame, path: str, mode: str = "error") -> None:
    """The rows as lines, written by the executors."""
    lines(df).write.mode(mode).text(path)


def stream_text(df: DataFrame, end: str | None = END_MARK) -> Iterator[str]:
    """The rows as lines in their order, then the end mark; a partition at a time on the driver."""
    for row in lines(df).toLocalIterator(prefetchPartitions=True):
        yield row[0]
    if end is not None:
        yield end


def _sql_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INTEGER"
    return "REAL" if isinstance(kind, (T.FloatType, T.DoubleType)) else "TEXT"


def write_sqlite(tables: dict[str, DataFrame], path: str | Path) -> None:
    """A fresh SQLite database with these tables; rows stream through the driver."""

    def quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    Path(path).unlink(missing_ok=True)
    with sqlite3.connect(path) as db:
        for name, df in tables.items():
            columns = ", ".join(f"{quoted(f.name)} {_sql_type(f.dataType)}" for f in df.schema.fields)
            db.execute(f"CREATE TABLE {quoted(name)} ({columns})")
            marks = ", ".join("?" * len(df.columns))
            rows = df.toLocalIterator()
            while some := list(islice(rows, INSERT_ROWS)):
                db.executemany(f"INSERT INTO {quoted(name)} VALUES ({marks})", [tuple(r) for r in some])
    db.close()
