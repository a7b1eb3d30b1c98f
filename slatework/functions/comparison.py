"""Typed comparisons.

Numbers compare as numbers whatever their widths. Values of incomparable types (a string and a number) are never equal
and have no order: every comparison is false but NE, which is true. Both are decided when the plan is lowered, so that no
failing or surprising cast reaches the scan, and literals take the column's own type where that is exact, so that the
comparison can be pushed into the files. A string literal against a timestamp or date is cast to that type once.
Longs compare exactly, also beyond 2**53.
"""

from __future__ import annotations

import math
import operator
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.nodes import Kind, Lit, Op, PlanError

COMPARE = {Op.EQ: operator.eq, Op.NE: operator.ne, Op.GT: operator.gt, Op.GTE: operator.ge, Op.LT: operator.lt, Op.LTE: operator.le}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (*INTEGERS, *FLOATS, T.DecimalType))


def incomparable(op: Op) -> Column:
    return F.lit(op is Op.NE)


def comparable(left: T.DataType, right: T.DataType) -> bool:
    if is_number(left) and is_number(right):
        return True
    if isinstance(left, TIMES) and isinstance(right, TIMES):
        return True
    return isinstance(left, T.StringType) and isinstance(right, T.StringType) or isinstance(left, T.BooleanType) and isinstance(right, T.BooleanType)


def _atomic(name: str, kind: T.DataType) -> None:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise PlanError(f"column {name} of type {kind.simpleString()} can't be compared")


def columns(op: Op, left: Column, left_kind: T.DataType, right: Column, right_kind: T.DataType, names: tuple[str, str] = ("?", "?"), strict_float: bool = False) -> Column:
    _atomic(names[0], left_kind)
    _atomic(names[1], right_kind)
    if not comparable(left_kind, right_kind):
        return incomparable(op)
    out = COMPARE[op](left, right)
    nan = [F.isnan(c) for c, k in ((left, left_kind), (right, right_kind)) if isinstance(k, FLOATS)] if strict_float else []
    return _without_nan(op, out, nan)


def literal(op: Op, column: Column, kind: T.DataType, value: Lit, name: str = "?", strict_float: bool = False) -> Column:
    _atomic(name, kind)
    if isinstance(kind, TIMES) and value.kind is Kind.STRING:
        return COMPARE[op](column, F.lit(value.value).cast(kind))
    if isinstance(kind, T.StringType):
        return COMPARE[op](column, F.lit(value.value)) if value.kind is Kind.STRING else incomparable(op)
    if not is_number(kind) or value.kind is Kind.STRING:
        return incomparable(op)
    x = value.value
    if value.kind is Kind.F32 and math.isfinite(x):
        x = struct.unpack("f", struct.pack("f", x))[0]
    if isinstance(x, float) and math.isnan(x):
        return incomparable(op)
    if isinstance(kind, INTEGERS):
        return _integer(op, column, kind, x)
    if isinstance(kind, T.DecimalType):
        return COMPARE[op](column, F.lit(x))
    exact = isinstance(kind, T.FloatType) and _is_float(float(x))
    out = COMPARE[op](column, F.lit(float(x)).cast("float" if exact else "double"))
    return _without_nan(op, out, [F.isnan(column)] if strict_float else [])


def _is_float(x: float) -> bool:
    """Whether 32 bits hold x."""
    return not math.isfinite(x) or abs(x) < 2.0**128 and struct.unpack("f", struct.pack("f", x))[0] == x


def _integer(op: Op, column: Column, kind: T.DataType, x: float) -> Column:
    """An integer column against any number, as an integer comparison; a constant (for rows with a value) out of range."""
    top = (1 << BITS[type(kind)]) - 1
    whole = math.isfinite(x) and x == math.floor(x)
    if not whole and op in (Op.EQ, Op.NE):
        return _constant(column, op is Op.NE)
    if not whole and math.isfinite(x):  # 4.5: over it is over 4, under it is under 5
        op, x = (Op.GT, math.floor(x)) if op in (Op.GT, Op.GTE) else (Op.LT, math.ceil(x))
    if x > top or x < -top - 1:
        under = x > top
        return _constant(column, op is Op.NE or (op in (Op.LT, Op.LTE)) == under and op is not Op.EQ)
    return COMPARE[op](column, F.lit(int(x)).cast(kind))


def _constant(column: Column, value: bool) -> Column:
    return column.isNotNull() if value else F.lit(False)


def _without_nan(op: Op, out: Column, nan: list[Column]) -> Column:
    """With IEEE rules a NaN equals nothing and has no order."""
    for c in nan:
        out = (out | c) if op is Op.NE else (out & ~c)
    return out
