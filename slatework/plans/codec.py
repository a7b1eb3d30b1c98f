"""The JSON form of plans. An operator, a value and a literal are objects with one member, named by the variant.

Reading is strict: unknown or missing members raise PlanError.
"""

from __future__ import annotations

import json
from typing import Any

from .nodes import Col, Cross, Filter, Kind, Lit, Node, Op, PlanError, Predicate, Project, Query, Scan, Sort, SortKey


def _node_out(node: Node) -> dict:
    match node:
        case Scan(table):
            return {"Scan": {"table_id": table}}
        case Filter(predicates, child):
            return {"Filter": {"predicates": [_predicate_out(p) for p in predicates], "underlying": _node_out(child)}}
        case Project(columns, child):
            return {"Project": {"column_name_map": [list(c) for c in columns], "underlying": _node_out(child)}}
        case Cross(left, right):
            return {"Cross": {"left": _node_out(left), "right": _node_out(right)}}
        case Sort(keys, child):
            return {"Sort": {"sort_specs": [{"column_name": k.column, "ascending": k.ascending} for k in keys], "underlying": _node_out(child)}}
    raise PlanError(f"not a plan node: {node!r}")


def _predicate_out(p: Predicate) -> dict:
    value = {"Column": p.value.name} if isinstance(p.value, Col) else {p.value.kind.value: p.value.value}
    return {"column_name": p.column, "operator": p.op.value, "value": value}


def _members(where: str, given: Any, *names: str) -> list:
    if not isinstance(given, dict) or set(given) != set(names):
        raise PlanError(f"{where} needs the members {', '.join(names)}, not {given!r}")
    return [given[n] for n in names]


def _variant(where: str, given: Any) -> tuple[str, Any]:
    if not isinstance(given, dict) or len(given) != 1:
        raise PlanError(f"{where} must be an object with one member, not {given!r}")
    return next(iter(given.items()))


def _text(where: str, given: Any) -> str:
    if not isinstance(given, str):
        raise PlanError(f"{where} must be a string, not {given!r}")
    return given


def _list(where: str, given: Any) -> list:
    if not isinstance(given, list):
        raise PlanError(f"{where} must be a list, not {given!r}")
    return given


def _node_in(given: Any) -> Node:
    tag, body = _variant("an operator", given)
    if tag == "Scan":
        return Scan(_text("table_id", *_members(tag, body, "table_id")))
    if tag == "Cross":
        left, right = _members(tag, body, "left", "right")
        return Cross(_node_in(left), _node_in(right))
    if tag == "Filter":
        predicates, child = _members(tag, body, "predicates", "underlying")
        return Filter(tuple(map(_predicate_in, _list("predicates", predicates))), _node_in(child))
    if tag == "Project":
        columns, child = _members(tag, body, "column_name_map", "underlying")
        pairs = [_list("a column pair", c) for c in _list("column_name_map", columns)]
        if any(len(c) != 2 for c in pairs):
            raise PlanError("a column pair has a source and a new name")
        return Project(tuple((_text("a column", a), _text("a column", b)) for a, b in pairs), _node_in(child))
    if tag == "Sort":
        specs, child = _members(tag, body, "sort_specs", "underlying")
        keys = [_members("a sort spec", s, "column_name", "ascending") for s in _list("sort_specs", specs)]
        if any(not isinstance(up, bool) for _, up in keys):
            raise PlanError("ascending must be true or false")
        return Sort(tuple(SortKey(_text("a column", c), up) for c, up in keys), _node_in(child))
    raise PlanError(f"unknown operator {tag!r}")


def _predicate_in(given: Any) -> Predicate:
    column, op, value = _members("a predicate", given, "column_name", "operator", "value")
    if op not in Op.__members__:
        raise PlanError(f"unknown comparison {op!r}")
    tag, body = _variant("a value", value)
    if tag == "Column":
        return Predicate(_text("a column", column), Op(op), Col(_text("a column", body)))
    if tag not in {k.value for k in Kind}:
        raise PlanError(f"unknown value {tag!r}")
    return Predicate(_text("a column", column), Op(op), Lit(Kind(tag), body))


def dump(query: Query) -> dict:
    return {"root": _node_out(query.root)}


def dumps(query: Query, **options) -> str:
    return json.dumps(dump(query), **options)


def load(given: Any) -> Query:
    return Query(_node_in(*_members("a query", given, "root")))


def loads(text: str) -> Query:
    try:
        given = json.loads(text)
    except json.JSONDecodeError as e:
        raise PlanError(f"not JSON: {e}") from e
    return load(given)
