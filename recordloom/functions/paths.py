"""Dotted field paths over a DataFrame schema.

A path names a field by literal name first: ``a.b`` is the column called
``a.b`` when there is one, otherwise field ``b`` of struct ``a``. A path may
cross structs but never an array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names starting with this prefix are the library's own.
RESERVED = "__"

#: Hidden ordinal column: the position of a row in its source.
ORD = "__ord"


class PathError(LookupError):
    """A path that names no field."""

    def __init__(self, path: str) -> None:
        super().__init__(f"unknown attribute '{path}'")
        self.path = path


@dataclass(frozen=True)
class Field:
    """A resolved path: the expression that reads it and its type."""

    column: Column
    data_type: T.DataType


def column(name: str) -> Column:
    """The top-level column literally named ``name``."""
    return F.col("`" + name.replace("`", "``") + "`")


def visible(schema: T.StructType) -> list[str]:
    """The column names a user sees."""
    return [f.name for f in schema.fields if f.name != ORD]


def resolve(frame: DataFrame | T.StructType, path: str) -> Field:
    """The field ``path`` names in ``frame``, or :class:`PathError`."""
    schema = frame if isinstance(frame, T.StructType) else frame.schema
    found = _descend(schema, path, None)
    if found is None:
        raise PathError(path)
    return found


def has_path(frame: DataFrame | T.StructType, path: str) -> bool:
    schema = frame if isinstance(frame, T.StructType) else frame.schema
    return _descend(schema, path, None) is not None


def _descend(schema: T.StructType, path: str, parent: Column | None) -> Field | None:
    types = {f.name: f.dataType for f in schema.fields}
    parts = path.split(".")
    options: list[tuple[Column, Field]] = []
    for size in range(len(parts), 0, -1):
        name, rest = ".".join(parts[:size]), ".".join(parts[size:])
        if name not in types:
            continue
        here = column(name) if parent is None else parent.getField(name)
        kind = types[name]
        if not rest:
            options.append((here, Field(here, kind)))
        elif isinstance(kind, T.StructType):
            deeper = _descend(kind, rest, here)
            if deeper is not None:
                options.append((here, deeper))
    if not options:
        return None
    # Both a literal and a nested field can exist; each record then uses the
    # longest name it really carries.
    *earlier, (_, last) = options
    result = last
    for guard, option in reversed(earlier):
        if option.data_type != result.data_type:
            result = option
        else:
            result = Field(
                F.when(guard.isNotNull(), option.column).otherwise(result.column),
                option.data_type,
            )
    return result
