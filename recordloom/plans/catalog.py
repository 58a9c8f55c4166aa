"""The catalog: schemas and view definitions as frames any view may read.

Only schemas pass through the driver here, never records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.paths import ORD
from recordloom.operators import views as V
from recordloom.operators.nodes import origin_types
from recordloom.plans.bundle import ViewSpec, build_view, source_names
from recordloom.sources.schema import CONTENT_SCHEMA, Schema, entities, is_single, row_type

ENTITIES, VIEWS = "__definition.entities", "__definition.views"

_ATTRIBUTE = (
    "id string, type string, required boolean, metadata string, validation string,"
    " child_entity string, child_item_type string, x_ref struct<entity:string,attribute:string>"
)
ENTITY_DDL = (
    "id string, item_type struct<id:string,origin_item_type:string,attributes:array<struct<"
    + ",".join(p.strip().replace(" ", ":", 1) for p in _ATTRIBUTE.split(", "))
    + ">>,metadata:string>, parent_entity string, builtin boolean, view boolean, at int"
)
VIEW_DDL = (
    "id string, `from` string, flatten string, `join` string, `where` string, grouped string,"
    " `select` string, sort string, at int"
)

# The built-in views over the catalog.
CATALOG_VIEWS: Mapping[str, ViewSpec] = {
    "__entity_tree": {
        "from": ENTITIES,
        "where": {"view": False, "not": {"id": {"startswith": "__"}}},
        "select": [{"item": n} for n in ("id", "parent_entity", "builtin", "item_type")],
    },
    "__entity_defs": {
        "from": "__entity_tree",
        "where": {"parent_entity": {"exists": False}},
        "select": [{"item": n} for n in ("id", "builtin", "item_type")],
        "sort": {"by": "builtin"},
    },
    "__data": {
        "from": ENTITIES,
        "where": {"parent_entity": {"exists": False}, "not": {"id": {"startswith": "__"}}},
        "select": [{"item": "id"}],
    },
    "__view_defs": {"from": VIEWS, "where": {"not": {"id": {"startswith": "__"}}}},
}


def catalog(
    spark: SparkSession,
    types: Mapping[str, T.StructType],
    *,
    views: Mapping[str, T.StructType] | None = None,
    specs: Mapping[str, ViewSpec] | None = None,
    titles: Mapping[str, str] | None = None,
    builtin: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The catalog frames for entities by row type, plus views by the schema of
    their frames. Both carry their order and can be sources of further views."""
    views, specs = views or {}, specs or {}
    origins = origin_types(specs, {**types, **views}) if specs else {}
    rows = []
    for name, kind in types.items():
        rows += _entity_rows((name,), kind, None, origins, name in builtin, False,
                             (titles or {}).get(name))
    for name, kind in views.items():
        rows += _entity_rows((name,), kind, None, origins, False, True, None)
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ENTITY_DDL)
    shown = [
        tuple([n, s["from"]] + [_text(s.get(k)) for k in
                                ("flatten", "join", "where", "grouped", "select", "sort")] + [i])
        for i, (n, s) in enumerate(specs.items())
    ]
    definitions = spark.createDataFrame(shown, VIEW_DDL)
    return {n: V.source(f, ["at"]).drop("at") for n, f in
            ((ENTITIES, table), (VIEWS, definitions))}


def builtin_views(definitions: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The built-in views over the catalog frames."""
    frames = dict(definitions)
    for name, spec in CATALOG_VIEWS.items():
        frames[name] = build_view(frames, spec)
    return {n: frames[n] for n in CATALOG_VIEWS}


def schema_types(schema: Schema, with_builtin: bool = True) -> dict[str, T.StructType]:
    """Row types of the collections a schema declares, the built-in ones last."""
    out = {n: row_type(e) for n, e in entities(schema).items() if not is_single(e)}
    if with_builtin:
        for name, entity in entities(CONTENT_SCHEMA).items():
            out.setdefault(name, row_type(entity))
    return out


def _text(clause: object) -> str | None:
    return None if clause is None else json.dumps(clause, ensure_ascii=False)


def _type_id(path: tuple[str, ...]) -> str:
    return ".item.".join(path) + ".item"


def _entity_rows(path, kind, parent, origins, builtin, view, title) -> list[tuple]:
    me, type_id = ".".join(path), _type_id(path)
    attributes, below = [], []
    for name, field in _attributes(kind):
        child = _row_of(field.dataType)
        nested = (*path, name) if child is not None else None
        meta = field.metadata
        ref = json.loads(meta["x_ref"]) if "x_ref" in meta else None
        attributes.append((
            name, type_name(field.dataType), bool(meta.get("required", False)),
            meta.get("metadata"), meta.get("validation"),
            ".".join(nested) if nested else None, _type_id(nested) if nested else None,
            (ref["entity"], ref["attribute"]) if ref else None,
        ))
        if nested:
            below += _entity_rows(nested, child, me, origins, builtin, view, None)
    item = (type_id, origins.get(type_id, type_id), attributes, title)
    return [(me, item, parent, builtin, view), *below]


def _attributes(kind: T.StructType) -> Iterator[tuple[str, T.StructField]]:
    """Attributes of a row; fields of a single nested object are listed one
    level deep under dotted names."""
    for field in kind.fields:
        if field.name == ORD:
            continue
        yield field.name, field
        if isinstance(field.dataType, T.StructType):
            for sub in field.dataType.fields:
                yield f"{field.name}.{sub.name}", sub


def _row_of(kind: T.DataType) -> T.StructType | None:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
        if isinstance(kind, T.StructType):
            return kind
    return None


def type_name(kind: T.DataType) -> str:
    """The schema-language name of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return type_name(kind.elementType) + "[]"
    if isinstance(kind, T.StructType):
        return "object"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    return "number" if isinstance(kind, T.NumericType) else (
        "string" if isinstance(kind, T.StringType) else kind.simpleString()
    )


def attribute_rows(entity_table: DataFrame) -> DataFrame:
    """One row per attribute of every entity in the catalog."""
    flat = V.flatten(
        V.select(entity_table, ["id", ("item_type.attributes", "a"), "view", "builtin"]), "a"
    )
    names = ("id", "type", "required", "child_entity", "x_ref")
    return V.select(
        flat, [("id", "entity"), *[(f"a.{n}", "attribute" if n == "id" else n) for n in names]]
    )


def edges(entity_table: DataFrame, specs: Mapping[str, ViewSpec] | None = None) -> DataFrame:
    """The relations between catalog entities: ``kind`` (composition,
    reference, lineage), ``source``, ``target``, ``attribute``. References to
    entities outside the catalog are left out."""
    spark = entity_table.sparkSession
    text = lambda c: c.cast("string")
    composition = entity_table.filter("parent_entity is not null").select(
        F.lit("composition").alias("kind"), F.col("parent_entity").alias("source"),
        F.col("id").alias("target"), text(F.lit(None)).alias("attribute"),
    )
    refs = attribute_rows(entity_table).filter("x_ref is not null").select(
        F.lit("reference").alias("kind"), F.col("entity").alias("source"),
        F.col("x_ref.entity").alias("target"), "attribute",
    )
    known = entity_table.select(F.col("id").alias("target"))
    out = composition.unionByName(refs.join(known, "target", "left_semi"))
    lineage = [(n, read) for n, s in (specs or {}).items() for read in dict.fromkeys(source_names(s))]
    if lineage:
        table = spark.createDataFrame(lineage, "source string, target string")
        out = out.unionByName(table.select(
            F.lit("lineage").alias("kind"), "source", "target",
            text(F.lit(None)).alias("attribute"),
        ))
    return out


def downstream(specs: Mapping[str, ViewSpec], changed: Sequence[str]) -> list[str]:
    """The views to rebuild when the named sources change, in spec order."""
    stale = set(changed)
    while True:
        more = {n for n, s in specs.items() if n not in stale and stale & set(source_names(s))}
        if not more:
            return [n for n in specs if n in stale]
        stale |= more


