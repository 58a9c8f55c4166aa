"""Declared schemas: a closed subset of JSON Schema, as Spark types.

The root is an object whose properties are entities. An entity is written as a
map (``additionalProperties``), an array (``items``) or a single record
(``properties``). A map is stored as an array of rows with the key as ``id``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Schema = Mapping[str, object]

# The schema keywords.
METADATA_KEYS = (
    "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly",
    "format",
)
VALIDATION_KEYS = (
    "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
    "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems",
)
STRUCTURE_KEYS = ("type", "properties", "additionalProperties", "items", "required", "x-ref")

_SCALARS = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
}

# The entities every project has.
CONTENT_SCHEMA: Schema = {
    "type": "object",
    "additionalProperties": False,
    "properties": {
        "prose": {
            "type": "array",
            "items": {
                "type": "object",
                "additionalProperties": False,
                "required": ["id", "mime_type", "content"],
                "properties": {
                    "id": {"type": "string"},
                    "title": {"type": "string"},
                    "order_key": {"type": "string"},
                    "depth": {"type": "integer"},
                    "headings": {
                        "type": "array",
                        "items": {
                            "type": "object",
                            "additionalProperties": False,
                            "required": ["id", "title", "level"],
                            "properties": {
                                "id": {"type": "string"},
                                "title": {"type": "string"},
                                "level": {"type": "integer"},
                            },
                        },
                    },
                    "mime_type": {"type": "string"},
                    "content": {"type": "string"},
                },
            },
        },
        "blob": {
            "type": "array",
            "items": {
                "type": "object",
                "additionalProperties": False,
                "required": ["id", "mime_type"],
                "properties": {"id": {"type": "string"}, "mime_type": {"type": "string"}},
            },
        },
    },
}


class SchemaProblem(ValueError):
    """A schema that cannot be used."""


@dataclass(frozen=True)
class Reference:
    """A declared reference: ``path`` inside ``entity`` names a row of
    ``target`` by its ``attribute``. ``arrays`` are the nested collections
    between the entity and the field, outermost first."""

    entity: str
    arrays: tuple[str, ...]
    path: str
    target: str
    attribute: str

    @property
    def field(self) -> str:
        return ".".join((self.entity, *self.arrays, self.path))


def entities(schema: Schema) -> Mapping[str, Schema]:
    """The entities a root schema declares."""
    if schema.get("type") != "object" or "properties" not in schema:
        raise SchemaProblem("the root schema must be an object with properties")
    for name, entity in schema["properties"].items():
        _check(entity, name)
    return schema["properties"]


def is_single(schema: Schema) -> bool:
    """Whether an entity is one record, not a collection."""
    return schema["type"] == "object" and "properties" in schema


def with_content(schema: Schema) -> Schema:
    """``schema`` plus the prose and blob entities."""
    merged = {**CONTENT_SCHEMA["properties"], **schema.get("properties", {})}
    return {**schema, "type": "object", "properties": merged}


def _check(schema: Schema, where: str) -> None:
    unknown = set(schema) - {*STRUCTURE_KEYS, *METADATA_KEYS, *VALIDATION_KEYS}
    if unknown:
        raise SchemaProblem(f"{where}: unknown keywords {sorted(unknown)}")
    kind = schema.get("type")
    if kind == "object":
        if "properties" in schema:
            if schema.get("additionalProperties", False) is not False:
                raise SchemaProblem(f"{where}: properties need additionalProperties: false")
            missing = set(schema.get("required", ())) - set(schema["properties"])
            if missing:
                raise SchemaProblem(f"{where}: required but not declared {sorted(missing)}")
            for name, child in schema["properties"].items():
                _check(child, f"{where}.{name}")
        elif isinstance(schema.get("additionalProperties"), Mapping):
            _check(schema["additionalProperties"], where)
        else:
            raise SchemaProblem(f"{where}: an object needs properties or additionalProperties")
    elif kind == "array":
        if not isinstance(schema.get("items"), Mapping):
            raise SchemaProblem(f"{where}: an array needs items")
        _check(schema["items"], where)
    elif not isinstance(kind, str) or kind not in _SCALARS:
        raise SchemaProblem(f"{where}: unsupported type {kind!r}")


# ── Types ────────────────────────────────────────────────────────────


def row_type(entity: Schema) -> T.StructType:
    """The row type of an entity."""
    kind = data_type(entity)
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def data_type(schema: Schema) -> T.DataType:
    """The stored type: maps are arrays of rows."""
    kind = schema["type"]
    if kind == "array":
        return T.ArrayType(data_type(schema["items"]))
    if kind != "object":
        return _SCALARS[kind]
    if "properties" in schema:
        return _struct(schema)
    value = schema["additionalProperties"]
    key = T.StructField("id", T.StringType(), True, {"required": True})
    if is_single(value):
        rest = [f for f in _struct(value).fields if f.name != "id"]
        return T.ArrayType(T.StructType([key, *rest]))
    field = T.StructField("value", data_type(value), True, {"required": True})
    return T.ArrayType(T.StructType([key, field]))


def _struct(schema: Schema) -> T.StructType:
    required = set(schema.get("required", ()))
    return T.StructType(
        [
            T.StructField(name, data_type(child), True, _metadata(child, name in required))
            for name, child in schema["properties"].items()
        ]
    )


def _metadata(schema: Schema, required: bool) -> dict[str, object]:
    out: dict[str, object] = {"required": required}
    for group, keys in (("metadata", METADATA_KEYS), ("validation", VALIDATION_KEYS)):
        chosen = {k: v for k, v in schema.items() if k in keys}
        if chosen:
            out[group] = json.dumps(chosen, ensure_ascii=False)
    if "x-ref" in schema:
        ref = schema["x-ref"]
        out["x_ref"] = json.dumps(
            {"entity": ref["entity"], "attribute": ref.get("attribute", "id")}
        )
    return out


def raw_type(schema: Schema) -> T.DataType:
    """The type a JSON reader gets: maps stay maps, and whole numbers are read
    as text because a JSON reader turns ``1.0`` into NULL for a bigint."""
    kind = schema["type"]
    if kind == "array":
        return T.ArrayType(raw_type(schema["items"]))
    if kind == "integer":
        return T.StringType()
    if kind != "object":
        return _SCALARS[kind]
    if "properties" in schema:
        return T.StructType(
            [T.StructField(n, raw_type(c)) for n, c in schema["properties"].items()]
        )
    return T.MapType(T.StringType(), raw_type(schema["additionalProperties"]))


def normalize(column: Column, schema: Schema) -> Column:
    """A raw value in stored form, at every level: each map becomes an array
    of rows in key order with the key as ``id``."""
    kind = schema["type"]
    if kind == "array":
        return F.transform(column, lambda item: normalize(item, schema["items"]))
    if kind == "integer":
        # Only whole numbers in range; anything else is absent here and a finding
        # of checks.text_violations.
        number = column.try_cast("decimal(38,18)")
        return F.when(number == F.floor(number), number.try_cast("bigint"))
    if kind != "object":
        return column
    if "properties" in schema:
        return F.when(column.isNotNull(), F.struct(*_fields(column, schema)))
    value = schema["additionalProperties"]
    return F.transform(F.map_entries(column), lambda e: _keyed(e["key"], e["value"], value))


def _fields(column: Column, schema: Schema) -> list[Column]:
    return [
        normalize(column.getField(n), child).alias(n)
        for n, child in schema["properties"].items()
    ]


def _keyed(key: Column, value: Column, schema: Schema) -> Column:
    if not is_single(schema):
        return F.struct(key.alias("id"), normalize(value, schema).alias("value"))
    own = schema["properties"].get("id")
    ident = F.coalesce(normalize(value.getField("id"), own), key) if own else key
    rest = {n: c for n, c in schema["properties"].items() if n != "id"}
    return F.struct(ident.alias("id"), *_fields(value, {"properties": rest}))


# ── References ───────────────────────────────────────────────────────


def references(schema: Schema) -> list[Reference]:
    """Every reference declared anywhere below the root."""
    return [
        ref
        for name, entity in entities(schema).items()
        if not is_single(entity)
        for ref in _references(name, row_type(entity), (), ())
    ]


def _references(
    entity: str, row: T.StructType, arrays: tuple[str, ...], parents: tuple[str, ...]
) -> Iterator[Reference]:
    for field in row.fields:
        path = (*parents, field.name)
        kind = field.dataType
        if "x_ref" in field.metadata:
            ref = json.loads(field.metadata["x_ref"])
            yield Reference(entity, arrays, ".".join(path), ref["entity"], ref["attribute"])
        if isinstance(kind, T.StructType):
            yield from _references(entity, kind, arrays, path)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            yield from _references(entity, kind.elementType, (*arrays, ".".join(path)), ())


def reference_problems(schema: Schema) -> list[str]:
    """References whose target entity or attribute does not exist. Only
    top-level collections can be targets."""
    targets = {
        n: set(row_type(e).names) for n, e in entities(schema).items() if not is_single(e)
    }
    problems: list[str] = []
    for ref in references(schema):
        if ref.target not in targets:
            problems.append(f"{ref.field}: unknown x-ref entity '{ref.target}'")
        elif ref.attribute not in targets[ref.target]:
            problems.append(
                f"{ref.field}: unknown x-ref attribute '{ref.attribute}' of '{ref.target}'"
            )
    return problems


def checked(schema: Schema) -> Sequence[str]:
    """The entity names of a schema that passed every check."""
    names = list(entities(schema))
    problems = reference_problems(schema)
    if problems:
        raise SchemaProblem("; ".join(problems))
    return names
