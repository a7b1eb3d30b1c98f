"""A fluent way to write plans:

    Q.scan("nation").filter("n_regionkey", "EQ", i32(2)).project(("n_name", "name")).sort("name").build()
"""

from __future__ import annotations

from typing import Union

from .nodes import Col, Cross, Filter, Kind, Lit, Node, Op, Predicate, Project, Query, Scan, Sort, SortKey


def col(name: str) -> Col:
    return Col(name)


def i32(value: int) -> Lit:
    return Lit(Kind.I32, value)


def i64(value: int) -> Lit:
    return Lit(Kind.I64, value)


def f32(value: float) -> Lit:
    return Lit(Kind.F32, float(value))


def f64(value: float) -> Lit:
    return Lit(Kind.F64, float(value))


def string(value: str) -> Lit:
    return Lit(Kind.STRING, value)


def _value(value) -> Union[Col, Lit]:
    """Columns and typed literals as they are; plain Python values as the widest literal of their type."""
    if isinstance(value, (Col, Lit)):
        return value
    if isinstance(value, str):
        return string(value)
    return f64(value) if isinstance(value, float) else i64(value)


class Q:
    """A plan under construction. Every method gives a new one."""

    def __init__(self, node: Node):
        self.node = node

    @classmethod
    def scan(cls, table: str) -> "Q":
        return cls(Scan(table))

    def filter(self, column: str, op: str, value) -> "Q":
        return self.filter_all((column, op, value))

    def filter_all(self, *predicates: tuple) -> "Q":
        return Q(Filter(tuple(Predicate(c, Op(op), _value(v)) for c, op, v in predicates), self.node))

    def project(self, *columns: Union[str, tuple[str, str]]) -> "Q":
        return Q(Project(tuple((c, c) if isinstance(c, str) else tuple(c) for c in columns), self.node))

    def cross(self, other: "Q") -> "Q":
        return Q(Cross(self.node, other.node))

    def sort(self, *keys: Union[str, tuple[str, bool]]) -> "Q":
        return Q(Sort(tuple(SortKey(k) if isinstance(k, str) else SortKey(*k) for k in keys), self.node))

    def build(self) -> Query:
        return Query(self.node)
