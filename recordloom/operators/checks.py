"""Integrity checks. Each yields diagnostics rows:
``severity, source, entity, record, path, message``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.paths import ORD, column, resolve, visible
from recordloom.functions.predicates import domain
from recordloom.functions.text import bind
from recordloom.sources.schema import (
    Reference,
    Schema,
    entities,
    is_single,
    references,
    row_type,
)

# The severities, most severe first.
SEVERITIES = ("error", "warning", "information", "hint")

FIELDS = ("severity", "source", "entity", "record", "path", "message")
DIAGNOSTICS = T.StructType([T.StructField(n, T.StringType()) for n in FIELDS])

_FOUND = "array<struct<path:string,rule:string,message:string>>"


def _diagnostics(frame: DataFrame, **columns: Column) -> DataFrame:
    chosen = [columns.get(n, F.lit(None)).cast("string").alias(n) for n in FIELDS]
    return frame.select(*chosen)


# ── Schema rules (I1) ────────────────────────────────────────────────


def schema_violations(frame: DataFrame, entity: str, schema: Schema, key: Column) -> DataFrame:
    """Diagnostics of the declared rules on a typed frame, found in one pass
    over its rows. ``key`` names a row in the result."""
    found = _typed_fields(column, frame.schema, _item_schema(schema), F.lit(""))
    return _exploded(frame, key, found, F.lit(entity))


def text_violations(files: DataFrame, schema: Schema) -> DataFrame:
    """Diagnostics of the declared rules on JSON text (``path``, ``text``, and
    ``problem`` for unreadable files), types and unknown keys included. A typed
    read cannot see those: it turns ``1`` into ``'1'`` and drops unknown keys."""
    entities(schema)
    root = {**schema, "additionalProperties": False}

    def found(value: Column) -> Column:
        unreadable = F.coalesce(
            F.col("problem"),
            F.when(value.isNull(), F.lit("not valid JSON, or a key occurs twice")),
        )
        syntax = lambda message: F.array(_violation(F.lit(""), "syntax", message))
        no_mapping = syntax(F.lit("expected a mapping at the root"))
        return F.when(unreadable.isNotNull(), syntax(unreadable)).otherwise(
            _variant_node(value, root, F.lit(""), no_mapping)
        )

    # The text is parsed once per file, not once per rule.
    checked = bind(F.try_parse_json("text"), found)
    # The entity is the first step of the path inside the file.
    entity = F.nullif(F.regexp_extract(F.col("__v.path"), "^/([^/]*)", 1), F.lit(""))
    return _exploded(files, F.col("path"), checked, entity)


def _exploded(frame: DataFrame, key: Column, found: Column, entity: Column) -> DataFrame:
    # The array is built inside the explode. As a column of its own it would be
    # worked out again by the filter Spark infers for exploded columns.
    rows = frame.select(key.alias("__key"), F.explode(found).alias("__v"))
    return _diagnostics(
        rows,
        severity=F.lit("error"),
        source=F.concat(F.lit("schema-"), F.col("__v.rule")),
        entity=entity,
        record=F.col("__key"),
        path=F.col("__v.path"),
        message=F.col("__v.message"),
    )


def _item_schema(schema: Schema) -> Schema:
    """The schema of one stored row of an entity."""
    if schema["type"] == "array":
        return schema["items"]
    if is_single(schema):
        return schema
    value = schema["additionalProperties"]
    key = {"id": {"type": "string"}}
    if is_single(value):
        return {**value, "properties": {**key, **value["properties"]},
                "required": ["id", *value.get("required", ())]}
    return {"type": "object", "properties": {**key, "value": value},
            "required": ["id", "value"]}


def _violation(path: Column, rule: str, message: Column) -> Column:
    return F.struct(
        path.alias("path"), F.lit(rule).alias("rule"), message.cast("string").alias("message")
    )


def _when(bad: Column, path: Column, rule: str, message: Column) -> Column:
    none = F.array().cast(_FOUND)
    return F.when(bad, F.array(_violation(path, rule, message))).otherwise(none)


def _all(parts: Sequence[Column]) -> Column:
    return F.flatten(F.array(*parts)) if parts else F.array().cast(_FOUND)


def _each(items: Column, check: Callable[[Column, Column], Column]) -> Column:
    """``check(item, index)`` over an array, joined."""
    return F.flatten(F.transform(items, check))


def _below(path: Column, step: Column | str) -> Column:
    step = F.lit(step) if isinstance(step, str) else step.cast("string")
    return F.concat(path, F.lit("/"), step)


def _typed_fields(
    read: Callable[[str], Column], row: T.StructType, schema: Schema, path: Column
) -> Column:
    declared, required = schema["properties"], schema.get("required", ())
    types = {f.name: f.dataType for f in row.fields}
    parts = []
    for name in types:
        if name not in declared and name != ORD:
            parts.append(_when(read(name).isNotNull(), path, "additionalProperties",
                               F.lit(f"unexpected key '{name}'")))
    for name, child in declared.items():
        if name not in types:
            if name in required:
                parts.append(F.array(_violation(path, "required", F.lit(f"'{name}' is missing"))))
            continue
        if name in required:
            parts.append(_when(read(name).isNull(), path, "required",
                               F.lit(f"'{name}' is missing")))
        parts.append(_typed(read(name), types[name], child, _below(path, name)))
    return _all(parts)


def _typed(value: Column, kind: T.DataType, schema: Schema, path: Column) -> Column:
    none = F.array().cast(_FOUND)
    declared = schema["type"]
    if declared == "object" and not is_single(schema):
        declared, schema = "array", {**schema, "type": "array", "items": _item_schema(schema)}
    if declared == "object" and isinstance(kind, T.StructType):
        found = _typed_fields(value.getField, kind, schema, path)
        return F.when(value.isNotNull(), found).otherwise(none)
    if declared == "array" and isinstance(kind, T.ArrayType):
        inner = _each(value, lambda v, i: _typed(v, kind.elementType, schema["items"],
                                                 _below(path, i)))
        rules = _array_rules(schema, value, path)
        return F.when(value.isNotNull(), _all([*rules, inner])).otherwise(none)
    integral = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    fits = {
        "string": F.lit(domain(kind) == "string"),
        "boolean": F.lit(domain(kind) == "boolean"),
        "number": F.lit(domain(kind) == "number"),
        "integer": F.lit(True) if integral else (
            value == F.floor(value) if domain(kind) == "number" else F.lit(False)
        ),
    }.get(declared, F.lit(False))
    rules = _scalar_rules(
        schema, path,
        number=value if domain(kind) == "number" else None,
        text=value if domain(kind) == "string" else None,
        flag=value if domain(kind) == "boolean" else None,
    )
    shown = value.cast("string")
    wrong = F.array(_violation(path, "type", F.concat(shown, F.lit(f" is not of type '{declared}'"))))
    return F.when(value.isNull(), none).when(~fits, wrong).otherwise(_all(rules))


def _variant(value: Column, schema: Schema, path: Column) -> Column:
    return bind(value, lambda v: _variant_node(v, schema, path))


def _variant_node(
    value: Column, schema: Schema, path: Column, wrong: Column | None = None
) -> Column:
    declared = schema["type"]
    if wrong is None:
        message = F.concat(F.to_json(value), F.lit(f" is not of type '{declared}'"))
        wrong = F.array(_violation(path, "type", message))
    # Reading a value as a map or array tells its kind at one level's cost;
    # schema_of_variant would visit everything below it.
    if declared == "object":
        if is_single(schema):
            fields = lambda m: _variant_fields(m, schema, path)
        else:
            child = schema["additionalProperties"]
            fields = lambda m: _each(
                F.map_entries(m),
                lambda e, i: _variant(e["value"], child, _below(path, e["key"])),
            )
        return bind(
            F.try_variant_get(value, "$", "map<string,variant>"),
            lambda m: F.when(m.isNotNull(), fields(m)).otherwise(wrong),
        )
    if declared == "array":
        inside = lambda items: _all([
            *_array_rules(schema, F.transform(items, lambda v: F.to_json(v)), path),
            _each(items, lambda v, i: _variant(v, schema["items"], _below(path, i))),
        ])
        return bind(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda items: F.when(items.isNotNull(), inside(items)).otherwise(wrong),
        )
    # A JSON null is the variant type VOID, never of a declared type.
    kind = F.schema_of_variant(value)
    read = {"string": "string", "boolean": "boolean"}.get(declared, "double")
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    fits = {"string": kind == "STRING", "boolean": kind == "BOOLEAN"}.get(declared, numeric)
    inner = F.try_variant_get(value, "$", read)
    if declared == "integer":
        fits = fits & (inner == F.floor(inner))
    rules = lambda v: _scalar_rules(
        schema, path,
        number=v if read == "double" else None,
        text=v if read == "string" else None,
        flag=v if read == "boolean" else None,
    )
    has_rules = bool(rules(inner))
    found = bind(inner, lambda v: _all(rules(v))) if has_rules else F.array().cast(_FOUND)
    return F.when(fits, found).otherwise(wrong)


def _variant_fields(keyed: Column, schema: Schema, path: Column) -> Column:
    declared, required = schema["properties"], schema.get("required", ())
    none = F.array().cast(_FOUND)
    known = F.array(*[F.lit(n) for n in declared]).cast("array<string>")
    extra = F.array_except(F.map_keys(keyed), known)
    parts = [F.transform(extra, lambda k: _violation(
        path, "additionalProperties", F.concat(F.lit("unexpected key '"), k, F.lit("'"))))]
    for name, child in declared.items():
        missing = none
        if name in required:
            missing = F.array(_violation(path, "required", F.lit(f"'{name}' is missing")))
        parts.append(_variant_child(F.try_element_at(keyed, F.lit(name)), child,
                                    _below(path, name), missing))
    return _all(parts)


def _variant_child(value: Column, schema: Schema, path: Column, missing: Column) -> Column:
    return bind(
        value, lambda v: F.when(v.isNull(), missing).otherwise(_variant_node(v, schema, path))
    )


def _array_rules(schema: Schema, items: Column, path: Column) -> list[Column]:
    size = F.size(items)
    out = []
    if "minItems" in schema:
        out.append(_when(size < schema["minItems"], path, "minItems",
                         F.concat(size, F.lit(f" items, at least {schema['minItems']} needed"))))
    if "maxItems" in schema:
        out.append(_when(size > schema["maxItems"], path, "maxItems",
                         F.concat(size, F.lit(f" items, at most {schema['maxItems']} allowed"))))
    if schema.get("uniqueItems"):
        out.append(_when(F.size(F.array_distinct(items)) < size, path, "uniqueItems",
                         F.lit("the items are not unique")))
    return out


def _scalar_rules(
    schema: Schema,
    path: Column,
    number: Column | None,
    text: Column | None,
    flag: Column | None,
) -> list[Column]:
    out: list[Column] = []
    value = next((v for v in (number, text, flag) if v is not None), None)
    if value is None:
        return out

    def rule(name: str, bad: Column, what: str) -> None:
        out.append(_when(bad, path, name, F.concat(value.cast("string"), F.lit(f" {what}"))))

    def same(target: object) -> Column:
        if isinstance(target, bool):
            return flag == target if flag is not None else F.lit(False)
        if isinstance(target, str):
            return text == target if text is not None else F.lit(False)
        return number == target if number is not None else F.lit(False)

    if "enum" in schema:
        allowed = reduce(lambda a, b: a | b, [same(t) for t in schema["enum"]], F.lit(False))
        rule("enum", ~allowed, f"is not one of {schema['enum']}")
    if "const" in schema:
        rule("const", ~same(schema["const"]), f"is not {schema['const']!r}")
    if number is not None:
        for name, bad in (
            ("minimum", lambda b: number < b),
            ("maximum", lambda b: number > b),
            ("exclusiveMinimum", lambda b: number <= b),
            ("exclusiveMaximum", lambda b: number >= b),
            ("multipleOf", lambda b: (number / F.lit(b)) != F.floor(number / F.lit(b))),
        ):
            if name in schema:
                rule(name, bad(schema[name]), f"breaks {name} {schema[name]}")
    if text is not None:
        if "minLength" in schema:
            rule("minLength", F.char_length(text) < schema["minLength"], "is too short")
        if "maxLength" in schema:
            rule("maxLength", F.char_length(text) > schema["maxLength"], "is too long")
        if "pattern" in schema:
            # (?U): character classes cover all of Unicode.
            rule("pattern", ~text.rlike("(?U)" + schema["pattern"]),
                 f"does not match {schema['pattern']!r}")
    return out


# ── References (I2) ──────────────────────────────────────────────────


def dangling(
    frame: DataFrame, path: str, target: DataFrame, attribute: str
) -> DataFrame:
    """The rows of ``frame`` whose value at ``path`` occurs nowhere in
    ``target.attribute``; rows without a value are fine.

    The distinct values of both sides are compared first, combined before the
    shuffle, so a value on a third of all rows is one value. Rows are then
    matched with the usually tiny set of dangling values.
    """
    left, right = resolve(frame, path), resolve(target, attribute)
    if domain(left.data_type) != domain(right.data_type):
        return frame.filter(left.column.isNotNull())
    used = frame.select(left.column.alias("__ref")).filter("__ref is not null").distinct()
    known = target.select(right.column.alias("__id")).distinct()
    loose = used.join(known, F.col("__ref") == F.col("__id"), "left_anti")
    return frame.join(loose, left.column == F.col("__ref"), "left_semi")


def check_references(
    frames: Mapping[str, DataFrame],
    schema: Schema,
    *,
    inside_structs: bool = True,
) -> DataFrame:
    """A warning per occurrence of a dangling reference, nested collections
    included. ``inside_structs=False`` leaves out references inside a single
    nested object."""
    parts = []
    for ref in references(schema):
        if ref.entity not in frames or ("." in ref.path and not inside_structs):
            continue
        rows = _unnested(frames[ref.entity], ref)
        target = frames.get(ref.target)
        loose = (
            rows.filter(F.col("__value").isNotNull())
            if target is None
            else dangling(rows, "__value", target, ref.attribute)
        )
        message = F.concat(
            F.lit(f"{ref.field} refers to '"), F.col("__value").cast("string"),
            F.lit(f"', which no {ref.target} has as its {ref.attribute}"),
        )
        parts.append(_diagnostics(
            loose, severity=F.lit("warning"), source=F.lit("x-ref-data"),
            entity=F.lit(ref.entity), record=F.col("__record"), path=F.lit(ref.field),
            message=message,
        ))
    return report(parts, next(iter(frames.values())).sparkSession)


def _unnested(frame: DataFrame, ref: Reference, *carry: str) -> DataFrame:
    record = column("id") if "id" in frame.columns else F.lit(None)
    fields = [n for n in visible(frame.schema) if n not in carry]
    rows = frame.select(record.cast("string").alias("__record"), *map(column, fields), *carry)
    path = ref.path
    for step in ref.arrays:
        rows = rows.select("__record", F.explode(resolve(rows, step).column).alias("__item"), *carry)
        fields = rows.schema["__item"].dataType.names
        rows = rows.select("__record", *[F.col("__item").getField(n).alias(n) for n in fields], *carry)
    return rows.select("__record", resolve(rows, path).column.alias("__value"), *carry)


REFERENCE_KEY = ("target", "attribute", "kind", "value")


def _comparable(value: Column, kind: T.DataType) -> list[Column]:
    """A value as text, and its kind; values of different kinds are never equal.
    Whole numbers look alike whatever their type."""
    text = value.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(text)
    return [F.lit(str(domain(kind))).alias("kind"), text.alias("value")]


def reference_values(frames: Mapping[str, DataFrame], schema: Schema, *carry: str) -> DataFrame:
    """``entity, record, field``, the :data:`REFERENCE_KEY` it refers to, and
    ``carry``: a narrow row per occurrence of a declared reference with a value."""
    parts = []
    for ref in references(schema):
        if ref.entity in frames:
            rows = _unnested(frames[ref.entity], ref, *carry)
            parts.append(rows.filter("__value is not null").select(
                F.lit(ref.entity).alias("entity"), F.col("__record").alias("record"), F.lit(ref.field).alias("field"),
                F.lit(ref.target).alias("target"), F.lit(ref.attribute).alias("attribute"),
                *_comparable(F.col("__value"), rows.schema["__value"].dataType), *carry))
    fields = ("entity", "record", "field", *REFERENCE_KEY)
    return _narrow(parts, frames, fields, carry)


def record_ids(frames: Mapping[str, DataFrame], schema: Schema, *carry: str) -> DataFrame:
    """``target, attribute, kind, value`` and ``carry``: a narrow row per value that
    references can be to, and per ``id``."""
    wanted = {(ref.target, ref.attribute) for ref in references(schema)}
    wanted |= {(n, "id") for n, f in frames.items() if "id" in f.columns}
    parts = []
    for name, attribute in sorted(wanted):
        if name in frames:
            field = resolve(frames[name], attribute)
            parts.append(frames[name].filter(field.column.isNotNull()).select(
                F.lit(name).alias("target"), F.lit(attribute).alias("attribute"),
                *_comparable(field.column, field.data_type), *carry))
    return _narrow(parts, frames, REFERENCE_KEY, carry)


def _narrow(parts: list[DataFrame], frames, fields: Sequence[str], carry: Sequence[str]) -> DataFrame:
    if parts:
        return reduce(DataFrame.unionByName, parts)
    kind = T.StructType([T.StructField(n, T.StringType()) for n in (*fields, *carry)])
    return next(iter(frames.values())).sparkSession.createDataFrame([], kind)


# ── Duplicate ids (I3) ───────────────────────────────────────────────

#: Findings of one id that are made at once.
AT_ONCE = 10_000


def duplicate_rows(frame: DataFrame, id_path: str = "id") -> DataFrame:
    """Every row that shares its id, compared as text, with another row.

    The count per id is combined before the shuffle; the rows are then matched
    with the colliding ids only.
    """
    key = resolve(frame, id_path).column.cast("string")
    twice = _repeated(frame, key).select("__dup")
    return frame.join(twice, key == F.col("__dup"), "left_semi")


def _repeated(frame: DataFrame, key: Column) -> DataFrame:
    """The keys that several rows have, and how many."""
    counts = frame.filter(key.isNotNull()).groupBy(key.alias("__dup")).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter("__n > 1")


def _as_often(counts: DataFrame) -> DataFrame:
    """A row of ``__dup`` for each of the ``__n`` it was counted on, made in two steps
    so that no array is longer than :data:`AT_ONCE` or so."""
    blocks = counts.select("__dup", "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / AT_ONCE))).alias("__block"))
    size = F.least(F.lit(AT_ONCE).cast("bigint"), F.col("__n") - F.col("__block") * AT_ONCE)
    return blocks.select("__dup", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).select("__dup")


def check_duplicate_ids(frames: Mapping[str, DataFrame], schema: Schema) -> DataFrame:
    """An error per row whose id a sibling shares. A finding says no more of a row
    than its id, so ids are counted and no row is sorted or joined. Rows of one nested
    collection lie in one record, so those are compared inside the row,
    without a shuffle; below a row without an id nothing is compared."""
    parts = []
    for name, entity in entities(schema).items():
        if name not in frames:
            continue
        frame, kind = frames[name], row_type(entity)
        single = is_single(entity)
        if not single and "id" in kind.names:
            message = F.concat(F.lit("'"), F.col("__dup"), F.lit(f"' is the id of several rows of {name}"))
            parts.append(_diagnostics(
                _as_often(_repeated(frame, column("id").cast("string"))), severity=F.lit("error"),
                source=F.lit("duplicate-id"), entity=F.lit(name), record=F.col("__dup"), path=F.lit(name), message=message,
            ))
        owner = F.lit(name) if single else F.concat(F.lit(f"{name}/"), column("id").cast("string"))
        found = _nested_duplicates(column, kind, owner)
        if found is not None and (single or "id" in kind.names):
            rows = frame.select(
                (F.lit(None) if single else column("id")).cast("string").alias("__record"),
                F.explode(found).alias("__d"),
            )
            message = F.concat(F.lit("'"), F.col("__d.id"), F.lit("' is the id of several rows of "),
                               F.col("__d.place"))
            parts.append(_diagnostics(
                rows, severity=F.lit("error"), source=F.lit("duplicate-id"), entity=F.lit(name),
                record=F.col("__record"), path=F.col("__d.place"), message=message,
            ))
    return report(parts, next(iter(frames.values())).sparkSession)


def _nested_duplicates(read, kind: T.StructType, owner: Column) -> Column | None:
    """Array of (place, id) for each colliding element below one record."""
    parts = []
    for field in kind.fields:
        value, place = read(field.name), F.concat(owner, F.lit("/" + field.name))
        if isinstance(field.dataType, T.StructType):
            inner = _nested_duplicates(value.getField, field.dataType, place)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, T.StructType
        ):
            inner = _array_duplicates(value, field.dataType.elementType, place)
        else:
            inner = None
        if inner is not None:
            parts.append(F.coalesce(inner, F.array().cast("array<struct<place:string,id:string>>")))
    return F.flatten(F.array(*parts)) if parts else None


def _array_duplicates(items: Column, kind: T.StructType, place: Column) -> Column | None:
    if "id" not in kind.names:
        return None
    empty = F.array().cast("array<struct<place:string,id:string>>")
    ids = F.transform(
        F.filter(items, lambda i: i["id"].isNotNull()), lambda i: i["id"].cast("string")
    )
    # Sorted, equal ids are neighbours: one pass marks them.
    ordered = F.sort_array(ids)
    last = F.size(ordered)
    marked = F.filter(
        F.transform(ordered, lambda x, i: F.when(
            ((i > 0) & F.get(ordered, i - 1).eqNullSafe(x))
            | ((i < last - 1) & F.get(ordered, i + 1).eqNullSafe(x)), x)),
        lambda x: x.isNotNull(),
    )
    own = F.when(
        F.size(F.array_distinct(ids)) < F.size(ids),
        F.transform(marked, lambda x: F.struct(place.alias("place"), x.alias("id"))),
    ).otherwise(empty)

    def below(item: Column) -> Column | None:
        return _nested_duplicates(
            item.getField, kind, F.concat(place, F.lit("/"), item["id"].cast("string"))
        )

    if below(F.lit(None).cast(kind)) is None:
        return own
    addressed = F.filter(items, lambda i: i["id"].isNotNull())
    return F.concat(own, F.flatten(F.transform(addressed, below)))


# ── Hand-written blobs (I4) ──────────────────────────────────────────


def check_handwritten_blobs(records: DataFrame) -> DataFrame:
    """An error per ``blob`` row that came from a record file."""
    message = F.concat(F.lit("a record file lists the blob '"), column("id").cast("string"),
                       F.lit("'; blobs are listed from the files themselves"))
    return _diagnostics(
        records, severity=F.lit("error"), source=F.lit("blob-data"), entity=F.lit("blob"),
        record=column("id"), path=F.lit("blob.id"), message=message,
    )


# ── Report and gate (I5, I6) ─────────────────────────────────────────


def report(parts: Iterable[DataFrame], spark: SparkSession) -> DataFrame:
    """One diagnostics table, one row per finding and occurrence."""
    parts = list(parts)
    if not parts:
        return spark.createDataFrame([], DIAGNOSTICS)
    return reduce(DataFrame.unionByName, parts)


def deduplicated(diagnostics: DataFrame) -> DataFrame:
    """The table without repeats, for reports that several checks add to."""
    return diagnostics.dropDuplicates(list(FIELDS))


class GateClosed(RuntimeError):
    """Outputs are blocked by the findings of the run."""

    def __init__(self, counts: Mapping[str, int]) -> None:
        super().__init__(f"blocked by {dict(counts)}")
        self.counts = dict(counts)


def severity_counts(diagnostics: DataFrame) -> dict[str, int]:
    """Findings per severity; at most one row per severity is collected."""
    known = diagnostics.filter(F.col("severity").isin(*SEVERITIES))
    return {r["severity"]: r["count"] for r in known.groupBy("severity").count().collect()}


def gate(diagnostics: DataFrame, strict: bool = False) -> dict[str, int]:
    """The counts per severity, or :class:`GateClosed` when the findings block
    the outputs: errors always, warnings too when ``strict``."""
    counts = severity_counts(diagnostics)
    if counts.get("error") or (strict and counts.get("warning")):
        raise GateClosed(counts)
    return counts


RUN_LOG = T.StructType(
    [T.StructField("stage", T.StringType()), T.StructField("status", T.StringType()),
     T.StructField("at", T.TimestampType())]
)


def run_stages(
    spark: SparkSession,
    stages: Sequence[tuple[str, Callable[[], DataFrame | None]]],
    log_path: str | None = None,
    strict: bool = False,
) -> list[tuple[str, str]]:
    """Run stages in order; each may return diagnostics. After a blocking one
    the later stages are skipped. Returns ``(stage, ok | ng | skipped)`` and
    appends the same rows to the Parquet table at ``log_path``."""
    out, blocked = [], False
    for name, stage in stages:
        status = "skipped"
        if not blocked:
            try:
                found = stage()
                if found is not None:
                    gate(found, strict)
                status = "ok"
            except GateClosed:
                status, blocked = "ng", True
        out.append((name, status))
    if log_path is not None:
        now = datetime.now(timezone.utc)
        rows = [(n, s, now) for n, s in out]
        spark.createDataFrame(rows, RUN_LOG).coalesce(1).write.mode("append").parquet(log_path)
    return out

