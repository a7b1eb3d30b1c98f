"""Bar-delimited tables with a schema file beside them.

`T.schema` has the names on its first line and the types on its second. Lines of `T.csv` are split at bars; one bar at the end
is tolerated. Empty strings are kept. A line with another number of fields or a value that isn't of its type raises, naming
the line's text; nothing is skipped silently. Blank lines raise too, except a single empty string column's.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.nodes import PlanError
from .catalog import CATALOG_TYPES, SCHEMA_TYPES

BAR = "|"


def parse_schema(text: str) -> T.StructType:
    rows = [line.strip().rstrip(BAR).split(BAR) for line in text.strip().splitlines()[:2]]
    if len(rows) != 2 or len(rows[0]) != len(rows[1]):
        raise PlanError("a schema has a line of names and a line of as many types")
    names, types = ([x.strip() for x in row] for row in rows)
    unknown = [t for t in types if t.upper() not in SCHEMA_TYPES]
    if unknown:
        raise PlanError(f"unknown types {', '.join(unknown)}")
    return T.StructType([T.StructField(n, CATALOG_TYPES[SCHEMA_TYPES[t.upper()]]) for n, t in zip(names, types)])


def parse_lines(df: DataFrame, schema: T.StructType, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of a column of lines, in the JVM, after the columns of df named in `keep`."""
    line = F.regexp_replace(column, "\r$", "")
    wide = len(schema)
    parts = F.split(line, r"\|", -1)
    closed = (F.size(parts) == wide + 1) & (F.trim(F.element_at(parts, -1)) == "")
    fine = closed | (F.size(parts) == wide)
    checked = F.when(fine, parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {wide} fields: "), F.col(column))))

    def field(i: int, f: T.StructField) -> Column:
        text = F.element_at("_parts", i + 1)
        return text.alias(f.name) if isinstance(f.dataType, T.StringType) else _number(text, f).alias(f.name)

    return df.select(*keep, checked.alias("_parts")).select(*keep, *(field(i, f) for i, f in enumerate(schema.fields)))


def _number(text: Column, f: T.StructField) -> Column:
    value = text.try_cast(f.dataType)
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"not {f.dataType.simpleString()} in {f.name}: "), text)).cast(f.dataType))


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return parse_lines(spark.read.text(path), schema)


def discover(folder: str | Path) -> dict[str, tuple[str, T.StructType]]:
    """name -> (path, schema) of every table of a folder that has both files, by name."""
    out = {}
    for data in sorted(Path(folder).glob("*.csv")):
        schema = data.with_suffix(".schema")
        if schema.exists():
            out[data.stem] = str(data), parse_schema(schema.read_text(encoding="utf-8"))
    return out


def tables(spark: SparkSession, folder: str | Path) -> dict[str, DataFrame]:
    return {name: read(spark, path, schema) for name, (path, schema) in discover(folder).items()}
