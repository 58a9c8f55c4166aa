"""The ``where`` clause as a Column.

Two rules differ from plain Spark comparisons:

* a missing field makes every test on it false, so ``not`` of the test is true;
* values of different kinds are never equal and never ordered (``1`` is not
  ``"1"``, and ``gt`` on a string is false).

``not`` is pushed down to the tests. A test outside a ``not`` stays a bare
comparison, because a filter drops NULL anyway and bare comparisons reach the
Parquet reader.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.paths import Field, resolve

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_LONG_MIN, _LONG_MAX = -(2**63), 2**63 - 1
_ORDERED = ("gt", "gte", "lt", "lte")
_TEXT = ("startswith", "endswith", "contains")


def domain(data_type: T.DataType) -> str:
    """The comparison domain of a type; only equal domains can match."""
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    return data_type.simpleString()


def predicate(
    frame: DataFrame | T.StructType, where: Mapping[str, object], negate: bool = False
) -> Column:
    """The Column that keeps the rows ``where`` matches.

    ``where`` maps a field path to a value or to operators (``eq gt gte lt lte
    startswith endswith contains exists``), or one of ``and`` / ``or`` (lists)
    and ``not`` (one clause). Several keys must all hold.
    """
    clauses = [_clause(frame, key, value, negate) for key, value in where.items()]
    return _combine(clauses, any_of=negate)


def _clause(frame, key: str, value: object, negate: bool) -> Column:
    if key in ("and", "or"):
        if isinstance(value, Mapping) or not isinstance(value, Sequence):
            raise TypeError(f"'{key}' takes a list of clauses")
        parts = [predicate(frame, clause, negate) for clause in value]
        return _combine(parts, any_of=(key == "or") != negate)
    if key == "not":
        if not isinstance(value, Mapping):
            raise TypeError("'not' takes one clause")
        return predicate(frame, value, not negate)
    field = resolve(frame, key)
    tests = value.items() if isinstance(value, Mapping) else [("eq", value)]
    return _combine([_test(field, op, v, negate) for op, v in tests], any_of=negate)


def _combine(parts: list[Column], any_of: bool) -> Column:
    if not parts:
        return F.lit(not any_of)
    return reduce(or_ if any_of else and_, parts)


def _test(field: Field, op: str, target: object, negate: bool) -> Column:
    if op == "exists":
        wanted = bool(target) != negate
        return field.column.isNotNull() if wanted else field.column.isNull()
    if op == "eq":
        return _equals(field, target, negate)
    if op in _ORDERED:
        if not _is_number(target):
            raise TypeError(f"'{op}' needs a number, got {target!r}")
        test = _ordered(field, op, target)
    elif op in _TEXT:
        if not isinstance(target, str):
            raise TypeError(f"'{op}' needs a string, got {target!r}")
        test = (
            getattr(field.column, op)(target)
            if domain(field.data_type) == "string"
            else None
        )
    else:
        raise ValueError(f"unknown operator '{op}'")
    if test is None:
        return F.lit(negate)
    return (~test) | field.column.isNull() if negate else test


def _equals(field: Field, target: object, negate: bool) -> Column:
    literal = _equal_literal(field.data_type, target)
    if literal is None:
        return F.lit(negate)
    return ~field.column.eqNullSafe(literal) if negate else field.column == literal


def _equal_literal(data_type: T.DataType, target: object) -> Column | None:
    kind = domain(data_type)
    if isinstance(target, bool):
        return F.lit(target) if kind == "boolean" else None
    if isinstance(target, str):
        return F.lit(target) if kind == "string" else None
    if _is_number(target) and kind == "number":
        if isinstance(data_type, _INTEGRAL):
            whole = _whole(target)
            return None if whole is None else F.lit(whole)
        return None if math.isnan(target) else _number_literal(target)
    return None


def _ordered(field: Field, op: str, target: int | float) -> Column | None:
    """``column op target``, exact for whole-number columns, or None when no
    value can match."""
    if domain(field.data_type) != "number" or math.isnan(target):
        return None
    column = field.column
    if not isinstance(field.data_type, _INTEGRAL):
        return _compare(column, op, _number_literal(target))
    # On whole numbers a fractional bound is the same as the next whole one.
    if isinstance(target, float) and not math.isinf(target):
        if op in ("gt", "lte"):
            target = math.floor(target)
        else:
            target = math.ceil(target)
    if target > _LONG_MAX:
        return column.isNotNull() if op in ("lt", "lte") else None
    if target < _LONG_MIN:
        return column.isNotNull() if op in ("gt", "gte") else None
    return _compare(column, op, F.lit(int(target)))


def _compare(column: Column, op: str, bound: Column) -> Column:
    if op == "gt":
        return column > bound
    if op == "gte":
        return column >= bound
    if op == "lt":
        return column < bound
    return column <= bound


def _number_literal(target: int | float) -> Column:
    inside = isinstance(target, float) or _LONG_MIN <= target <= _LONG_MAX
    return F.lit(target if inside else float(target))


def _whole(target: int | float) -> int | None:
    if isinstance(target, float):
        if math.isinf(target) or math.isnan(target) or target != math.floor(target):
            return None
        target = int(target)
    return target if _LONG_MIN <= target <= _LONG_MAX else None


def _is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)
