"""Command line: compile a data-set folder, print the example query, run plans and suites.

    python -m slatework disk     -d DATASET -c COMPILED -r RUNTIME [-s BLOCK_SIZE]   block files and the disk configuration
    python -m slatework database -d DATASET -r RUNTIME                               the catalog with statistics
    python -m slatework monitor  -r RUNTIME                                          a sample suite, disabled
    python -m slatework sqlite   -d DATASET -c COMPILED                              an SQLite database of the same rows
    python -m slatework all      -d DATASET -c COMPILED -r RUNTIME [-s BLOCK_SIZE]   all of these
    python -m slatework example                                                      the five-way example join as JSON
    python -m slatework run      PLAN.json --tables FOLDER                           rows of a plan as text
    python -m slatework check    SUITE.json --tables FOLDER                          a suite against its expected files
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import disk_model, statistics
from .operators.suites import SuiteQuery, load_suite, run_suite, save_suite
from .plans import codec
from .plans.builder import Q
from .plans.lower import lower
from .sources import blocks, delimited, sinks
from .sources.catalog import Catalog, ColumnSpec, TableSpec, catalog_type, parquet_tables


def session() -> SparkSession:
    return SparkSession.builder.appName("slatework").getOrCreate()


def make_disk(spark: SparkSession, dataset: Path, compiled: Path, runtime: Path, block_size: int) -> None:
    compiled.mkdir(parents=True, exist_ok=True)
    runtime.mkdir(parents=True, exist_ok=True)
    files = []
    for name, df in delimited.tables(spark, dataset).items():
        path = compiled.resolve() / f"{name}.bin"
        blocks.write(df, path, block_size)
        files.append({"id": name, "file_path": str(path)})
    config = runtime / "disk_sim_config.json"
    config.write_text(json.dumps({"disk_config": disk_model.Disk(block_size=block_size).to_json(), "files": files}, indent=2))
    disk_model.load_config(config)


def file_order(spark: SparkSession, path: str, schema: T.StructType) -> dict[str, bool]:
    """Whether each column of a text table is in order, by the line order of its file."""
    lines = spark.sparkContext.textFile(path).zipWithIndex().toDF("value string, _row long").withColumn("_file", F.lit(0))
    internal = T.StructType([T.StructField(f"_s{i}", f.dataType) for i, f in enumerate(schema.fields)])
    numbered = delimited.parse_lines(lines, internal, keep=("_file", "_row"))
    return dict(map(tuple, statistics.ordered_columns(numbered, schema.fieldNames()).collect()))


def make_catalog(spark: SparkSession, dataset: Path, runtime: Path) -> Catalog:
    runtime.mkdir(parents=True, exist_ok=True)
    specs = []
    for name, (path, schema) in delimited.discover(dataset).items():
        df = delimited.read(spark, path, schema)
        stats = statistics.collect(df, file_order(spark, path, schema))
        columns = []
        for f in schema.fields:
            kind = catalog_type(f.dataType)
            columns.append(ColumnSpec(f.name, kind, stats[f.name].to_json(kind) if f.name in stats else []))
        specs.append(TableSpec(name, name, columns))
    catalog = Catalog(specs)
    catalog.save(runtime / "db_config.json")
    return catalog


def make_suite(runtime: Path) -> None:
    runtime.mkdir(parents=True, exist_ok=True)
    queries = []
    for n, (name, table) in enumerate((("Simple Scan", "TableA"), ("Another Simple Scan", "TableB")), 1):
        expected = runtime.resolve() / f"expected_{n}.csv"
        expected.touch()
        queries.append(SuiteQuery(name, Q.scan(table).build(), expected, disabled=True, sort_before_check=True))
    save_suite(queries, runtime / "monitor_config.json")


def make_sqlite(spark: SparkSession, dataset: Path, compiled: Path) -> None:
    compiled.mkdir(parents=True, exist_ok=True)
    sinks.write_sqlite(delimited.tables(spark, dataset), compiled / "database.sqlite")


def example() -> str:
    from .queries import PLANS

    return codec.dumps(PLANS["q2_shape"][0], indent=2)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="slatework", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    for command, needs in {"disk": "dcrs", "database": "dr", "monitor": "r", "sqlite": "dc", "all": "dcrs"}.items():
        p = sub.add_parser(command)
        for flag, name in (("d", "dataset-folder"), ("c", "compiled-dataset-folder"), ("r", "runtime-folder")):
            if flag in needs:
                p.add_argument(f"-{flag}", f"--{name}", type=Path, required=True, dest=flag)
        if "s" in needs:
            p.add_argument("-s", "--block-size", type=int, default=blocks.BLOCK_SIZE, dest="s")
    sub.add_parser("example")
    for command in ("run", "check"):
        p = sub.add_parser(command)
        p.add_argument("file", type=Path)
        p.add_argument("--tables", required=True)
        p.add_argument("--strategy")
    a = parser.parse_args(argv)
    if a.command == "example":
        print(example())
        return 0
    if a.command == "monitor":
        make_suite(a.r)
        return 0
    spark = session()
    if a.command in ("disk", "all"):
        make_disk(spark, a.d, a.c, a.r, a.s)
    if a.command in ("database", "all"):
        make_catalog(spark, a.d, a.r)
    if a.command in ("sqlite", "all"):
        make_sqlite(spark, a.d, a.c)
    if a.command == "all":
        make_suite(a.r)
    if a.command == "run":
        query = codec.loads(a.file.read_text(encoding="utf-8"))
        for line in sinks.stream_text(lower(query, parquet_tables(spark, a.tables), a.strategy)):
            print(line)
    if a.command == "check":
        outcomes = run_suite(load_suite(a.file), parquet_tables(spark, a.tables), spark, a.strategy)
        for o in outcomes:
            print(f"{'passed' if o.passed else 'FAILED'}  {o.name}  {o.detail}")
        return int(not all(o.passed for o in outcomes))
    return 0


if __name__ == "__main__":
    sys.exit(main())
