"""Tables by name: a folder of Parquet tables, or a catalog file with tables, typed columns and statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.nodes import PlanError

#: The type names of catalog files, and those of schema files.
CATALOG_TYPES = {"Int32": T.IntegerType(), "Int64": T.LongType(), "Float32": T.FloatType(), "Float64": T.DoubleType(), "String": T.StringType()}
SCHEMA_TYPES = {"I32": "Int32", "I64": "Int64", "FLOAT32": "Float32", "FLOAT64": "Float64", "STRING": "String"}


def catalog_type(kind: T.DataType) -> str:
    for name, known in CATALOG_TYPES.items():
        if kind == known:
            return name
    raise PlanError(f"{kind.simpleString()} has no catalog type")


@dataclass
class ColumnSpec:
    name: str
    type: str
    stats: list | None = None

    def __post_init__(self) -> None:
        if self.type not in CATALOG_TYPES:
            raise PlanError(f"unknown type {self.type!r} of column {self.name}")


@dataclass
class TableSpec:
    name: str
    file_id: str
    columns: list[ColumnSpec] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, CATALOG_TYPES[c.type], False) for c in self.columns])


@dataclass
class Catalog:
    tables: list[TableSpec]

    def __getitem__(self, name: str) -> TableSpec:
        for t in self.tables:
            if t.name == name:
                return t
        raise PlanError(f"unknown table {name!r}")

    def to_json(self) -> dict[str, Any]:
        return {"table_specs": [{"name": t.name, "file_id": t.file_id, "column_specs": [{"column_name": c.name, "data_type": c.type, "stats": c.stats} for c in t.columns]} for t in self.tables]}

    @classmethod
    def from_json(cls, given: dict[str, Any]) -> "Catalog":
        try:
            return cls([TableSpec(t["name"], t["file_id"], [ColumnSpec(c["column_name"], c["data_type"], c.get("stats")) for c in t["column_specs"]]) for t in given["table_specs"]])
        except (KeyError, TypeError) as e:
            raise PlanError(f"not a catalog: {e!r}") from e

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_json(), indent=2), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> "Catalog":
        return cls.from_json(json.loads(Path(path).read_text(encoding="utf-8")))


def parquet_tables(spark: SparkSession, folder: str):
    """A function from names to the tables `folder/<name>.parquet`, for lower()."""

    def table(name: str) -> DataFrame:
        if not name or "/" in name:
            raise PlanError(f"unknown table {name!r}")
        try:
            return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise PlanError(f"unknown table {name!r}") from e
            raise

    return table


def analyze(spark: SparkSession, names: dict[str, DataFrame], database: str = "default", columns: bool = True) -> None:
    """Save tables to the session's catalog with statistics, which cost-based join ordering needs."""
    for name, df in names.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
        spark.sql(f"ANALYZE TABLE {database}.{name} COMPUTE STATISTICS" + (" FOR ALL COLUMNS" if columns else ""))


#: Settings of a session that orders joins by cost, up to the number of relations that are searched exhaustively.
COST_BASED = {
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.cbo.joinReorder.dp.threshold": "16",
    "spark.sql.statistics.histogram.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}
