"""Query suites: named plans with expected result files, and the check of results against them."""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import chain, zip_longest
from pathlib import Path
from typing import Iterable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text_format import lines
from ..plans import codec
from ..plans.lower import Tables, lower
from ..plans.nodes import PlanError, Query
from ..sources.sinks import END_MARK, stream_text

#: Fixed value: the least memory limit that a suite may give a query.
LEAST_MEMORY_MB = 64


@dataclass
class SuiteQuery:
    name: str
    query: Query
    expected: Path
    memory_limit_mb: int = LEAST_MEMORY_MB
    disabled: bool = False
    sort_before_check: bool = False

    def __post_init__(self) -> None:
        self.expected = Path(self.expected)
        if not self.expected.exists():
            raise PlanError(f"file {self.expected} doesn't exist")
        if self.memory_limit_mb < LEAST_MEMORY_MB:
            raise PlanError(f"the memory limit must be at least {LEAST_MEMORY_MB} MB, not {self.memory_limit_mb}")

    def to_json(self) -> dict:
        return {"execution_name": self.name, "disabled": self.disabled, "sort_before_check": self.sort_before_check, "query": codec.dump(self.query), "expected_output_file": str(self.expected), "memory_limit_mb": self.memory_limit_mb}

    @classmethod
    def from_json(cls, given: dict) -> "SuiteQuery":
        try:
            return cls(given["execution_name"], codec.load(given["query"]), given["expected_output_file"], given["memory_limit_mb"], given.get("disabled", False), given.get("sort_before_check", False))
        except KeyError as e:
            raise PlanError(f"a suite query needs {e}") from e


def load_suite(path: str | Path) -> list[SuiteQuery]:
    return [SuiteQuery.from_json(q) for q in json.loads(Path(path).read_text(encoding="utf-8"))["query_configs"]]


def save_suite(queries: Iterable[SuiteQuery], path: str | Path) -> None:
    Path(path).write_text(json.dumps({"query_configs": [q.to_json() for q in queries]}, indent=2), encoding="utf-8")


def expected_lines(path: str | Path) -> Iterable[str]:
    """Trimmed lines up to the first blank one."""
    with open(path, encoding="utf-8") as f:
        for line in f:
            if not line.strip():
                return
            yield line.strip()


def ordered_mismatch(df: DataFrame, expected: Iterable[str]) -> str | None:
    """The first difference of results in their order, read as a stream; None if there is none."""
    for n, (got, wanted) in enumerate(zip_longest(stream_text(df, END_MARK), chain(expected, [END_MARK])), 1):
        if got is None or wanted is None or got.strip() != wanted:
            return f"line {n}: expected {wanted!r}, got {got!r}"
    return None


def multiset_mismatch(df: DataFrame, expected: DataFrame) -> DataFrame:
    """value, difference: lines that the results have more (positive) or less often than the expected lines (`value`)."""
    got = lines(df).select(F.trim("value").alias("value"), F.lit(1).alias("d"))
    wanted = expected.select(F.trim("value").alias("value"), F.lit(-1).alias("d"))
    return got.unionByName(wanted).groupBy("value").agg(F.sum("d").alias("difference")).filter("difference != 0")


@dataclass
class Outcome:
    name: str
    passed: bool
    detail: str = ""


def run_suite(queries: Iterable[SuiteQuery], tables: Tables, spark, strategy: str | None = None) -> list[Outcome]:
    """Runs the enabled queries and stops at the first that fails, be it by its results, its plan or an error of Spark. Expected
    lines that may come in any order are held by the driver. Memory limits are checked when a suite is read; enforcing them is
    left to the session's own settings (spark.executor.memory), which a running session can't change."""
    out: list[Outcome] = []
    for q in queries:
        if q.disabled:
            continue
        try:
            df = lower(q.query, tables, strategy)
            if q.sort_before_check:
                wanted = spark.createDataFrame([(x,) for x in expected_lines(q.expected)], "value string")
                wrong = multiset_mismatch(df, wanted).take(3)
                detail = "; ".join(f"{r['value']!r} {r['difference']:+d}" for r in wrong)
            else:
                detail = ordered_mismatch(df, expected_lines(q.expected)) or ""
        except (PlanError, PySparkException, Py4JError) as e:  # whatever a query does at run time, the suite goes on to tell
            detail = f"{type(e).__name__}: {e}"
        out.append(Outcome(q.name, not detail, detail))
        if detail:
            break
    return out
