"""From plans to DataFrames.

Names resolve to the first column of that name, from the left, and may repeat; so every relation is built from columns with
unique internal names, next to the list of logical names, and the root gives the logical names back. Joins are lowered as
the cross and filter that they are: the optimizer turns them into equi-joins, pushes the filters and picks the algorithm.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count
from operator import and_
from typing import Callable, Iterator, Mapping, Union

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import comparison
from .nodes import Col, Cross, Filter, Node, PlanError, Predicate, Project, Query, Scan, Sort

Tables = Union[Mapping[str, DataFrame], Callable[[str], DataFrame]]
STRATEGIES = {"broadcast": "broadcast", "merge": "merge", "shuffle_hash": "shuffle_hash", "nested_loop": "shuffle_replicate_nl"}


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    names: tuple[str, ...]
    columns: tuple[str, ...]

    def place(self, name: str) -> int:
        try:
            return self.names.index(name)
        except ValueError:
            raise PlanError(f"unknown column {name!r}; there are {', '.join(self.names)}") from None

    def column(self, name: str) -> tuple[F.Column, T.DataType]:
        internal = self.columns[self.place(name)]
        return F.col(internal), self.df.schema[internal].dataType


class Lowering:
    """strategy: a join hint for every cross, left to the optimizer by default. strict_float: IEEE rules for NaN."""

    def __init__(self, tables: Tables, strategy: str | None = None, strict_float: bool = False):
        if strategy is not None and strategy not in STRATEGIES:
            raise PlanError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
        self.tables, self.strategy, self.strict_float = tables, strategy, strict_float
        self.fresh: Iterator[int] = count()

    def table(self, name: str) -> DataFrame:
        if callable(self.tables):
            return self.tables(name)
        if name not in self.tables:
            raise PlanError(f"unknown table {name!r}")
        return self.tables[name]

    def renamed(self, df: DataFrame, names: tuple[str, ...], sources: tuple[str, ...]) -> Relation:
        columns = tuple(f"_c{next(self.fresh)}" for _ in names)
        return Relation(df.select(*(F.col(s).alias(c) for s, c in zip(sources, columns))), names, columns)

    def predicate(self, on: Relation, p: Predicate) -> F.Column:
        column, kind = on.column(p.column)
        if isinstance(p.value, Col):
            other, other_kind = on.column(p.value.name)
            return comparison.columns(p.op, column, kind, other, other_kind, (p.column, p.value.name), self.strict_float)
        return comparison.literal(p.op, column, kind, p.value, p.column, self.strict_float)

    def relation(self, node: Node) -> Relation:
        match node:
            case Scan(table):
                df = self.table(table)
                return self.renamed(df, tuple(df.columns), tuple(f"`{c.replace('`', '``')}`" for c in df.columns))
            case Filter(predicates, child):
                on = self.relation(child)
                if not predicates:
                    return on
                return Relation(on.df.filter(reduce(and_, (self.predicate(on, p) for p in predicates))), on.names, on.columns)
            case Project(columns, child):
                on = self.relation(child)
                if not columns:
                    raise PlanError("a projection needs a column")
                return self.renamed(on.df, tuple(b for _, b in columns), tuple(on.columns[on.place(a)] for a, _ in columns))
            case Cross(left, right):
                a, b = self.relation(left), self.relation(right)
                other = b.df.hint(STRATEGIES[self.strategy]) if self.strategy else b.df
                return Relation(a.df.crossJoin(other), a.names + b.names, a.columns + b.columns)
            case Sort(keys, child):
                on = self.relation(child)
                if not keys:
                    return on
                order = []
                for k in keys:
                    column, kind = on.column(k.column)
                    if isinstance(kind, (T.ArrayType, T.MapType)):
                        raise PlanError(f"column {k.column} of type {kind.simpleString()} can't be a sort key")
                    order.append(column.asc() if k.ascending else column.desc())
                return Relation(on.df.orderBy(*order), on.names, on.columns)
        raise PlanError(f"not a plan node: {node!r}")


def lower(query: Query, tables: Tables, strategy: str | None = None, strict_float: bool = False) -> DataFrame:
    """The DataFrame of a plan over `tables`, a mapping or a function from table names to DataFrames."""
    out = Lowering(tables, strategy, strict_float).relation(query.root)
    return out.df.toDF(*out.names)
