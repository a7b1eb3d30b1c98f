"""The query algebra: a plan is a tree of five operators over named relations.

A predicate compares a column with a column or a literal; a filter is the conjunction of its predicates. A projection is
an ordered list of (source, new name). A cross is a Cartesian product, and a join is a filter over a cross.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Union


class PlanError(ValueError):
    """A plan that can't be read, resolved or typed."""


class Op(str, Enum):
    EQ = "EQ"
    NE = "NE"
    GT = "GT"
    GTE = "GTE"
    LT = "LT"
    LTE = "LTE"


class Kind(str, Enum):
    """Kinds of literals, by their names on the wire."""

    I32 = "I32"
    I64 = "I64"
    F32 = "F32"
    F64 = "F64"
    STRING = "String"


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Lit:
    kind: Kind
    value: Union[int, float, str]

    def __post_init__(self) -> None:
        wanted = {Kind.I32: int, Kind.I64: int, Kind.F32: (int, float), Kind.F64: (int, float), Kind.STRING: str}[self.kind]
        if isinstance(self.value, bool) or not isinstance(self.value, wanted):
            raise PlanError(f"{self.value!r} is not a literal of kind {self.kind.value}")
        bits = {Kind.I32: 31, Kind.I64: 63}.get(self.kind)
        if bits and not -(1 << bits) <= self.value < 1 << bits:
            raise PlanError(f"{self.value} is out of range for {self.kind.value}")


@dataclass(frozen=True)
class Predicate:
    column: str
    op: Op
    value: Union[Col, Lit]


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True


@dataclass(frozen=True)
class Scan:
    table: str


@dataclass(frozen=True)
class Filter:
    predicates: tuple[Predicate, ...]
    child: "Node"


@dataclass(frozen=True)
class Project:
    columns: tuple[tuple[str, str], ...]
    child: "Node"


@dataclass(frozen=True)
class Cross:
    left: "Node"
    right: "Node"


@dataclass(frozen=True)
class Sort:
    keys: tuple[SortKey, ...]
    child: "Node"


Node = Union[Scan, Filter, Project, Cross, Sort]


@dataclass(frozen=True)
class Query:
    root: Node
