"""The address table: one row per addressable element of a set of frames, and
what is derived from it - lookups, labels, pages, links.

Columns: ``address``, ``parent``, ``segment``, ``type``, ``origin``, ``label``,
``fragment`` and ``ancestors`` (root first, the node itself last).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.paths import ORD, column, resolve, visible
from recordloom.functions.text import (
    iri_escape,
    md_cell,
    relative_path,
    shown,
)
from recordloom.plans.bundle import ViewSpec

# The built-in origins whose addresses follow rules of their own.
PROSE, BLOB, HEADING = "prose.item", "blob.item", "prose.item.headings.item"
ROOT_TYPE = ".item"

NODE = (
    "address:string,parent:string,segment:string,type:string,origin:string,label:string,"
    "fragment:string,ancestors:array<struct<address:string,type:string>>"
)
_NODES = f"array<struct<{NODE}>>"


def node_index(
    frames: Mapping[str, DataFrame],
    origins: Mapping[str, str] | None = None,
    single: Sequence[str] = (),
) -> DataFrame:
    """The address table of ``frames``. All nodes of a record are built in one
    pass over it, so each frame is scanned once whatever its depth, and nothing
    is shuffled. ``origins`` maps a type to the type its rows come from
    (:func:`origin_types`); ``single`` names frames of one record."""
    origins = origins or {}
    parts = [_fixed_nodes(frames, origins, single)]
    for name, frame in frames.items():
        parts.append(_frame_nodes(name, frame, origins, name in single))
    return reduce(DataFrame.unionByName, parts)


def _fixed_nodes(frames, origins, single) -> DataFrame:
    """The root and the collections: one row per frame."""
    spark = next(iter(frames.values())).sparkSession
    rows = [("", "", ROOT_TYPE)]
    parents = {n.rsplit(".", 1)[0] for n in frames if "." in n}
    rows += [("", p, p) for p in sorted(parents)]
    rows += [
        (n.rpartition(".")[0], n.rpartition(".")[2], f"{n}.item[]")
        for n in frames
        if n not in single
    ]
    table = spark.createDataFrame(rows, "up string, segment string, type string")
    parent = _top(F.col("up"))
    address = F.when(F.col("segment") == "", "/").otherwise(_step(parent, iri_escape(F.col("segment"))))
    origin = _origin(F.col("type"), origins)
    root = F.struct(F.lit("/").alias("address"), F.lit(ROOT_TYPE).alias("type"))
    middle = F.struct(parent.alias("address"), F.col("up").alias("type"))
    own = F.struct(address.alias("address"), F.col("type").alias("type"))
    line = (
        F.when(F.col("segment") == "", F.array(own))
        .when(F.col("up") == "", F.array(root, own))
        .otherwise(F.array(root, middle, own))
    )
    return table.select(
        address.alias("address"),
        F.when(F.col("segment") != "", parent).alias("parent"),
        "segment",
        "type",
        origin.alias("origin"),
        address.alias("label"),
        address.alias("fragment"),
        line.alias("ancestors"),
    )


def _top(name: Column) -> Column:
    return F.concat(F.lit("/"), iri_escape(name))


def _step(parent: Column, segment: Column) -> Column:
    return F.when(parent == "/", F.concat(parent, segment)).otherwise(
        F.concat(parent, F.lit("/"), segment)
    )


def _origin(kind: Column, origins: Mapping[str, str]) -> Column:
    if not origins:
        return kind
    table = F.create_map(*[F.lit(x) for kv in origins.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), kind)


def element_nodes(frames: Mapping[str, DataFrame], *carry: str) -> DataFrame:
    """The nodes of the rows of collections alone, with ``carry`` columns of the row
    each one lies in. What the collections themselves are is in :func:`node_index`
    of their empty frames."""
    return reduce(DataFrame.unionByName, [_frame_nodes(n, f, {}, False, carry) for n, f in frames.items()])


def _frame_nodes(name: str, frame: DataFrame, origins, single: bool, carry: Sequence[str] = ()) -> DataFrame:
    up, _, last = name.rpartition(".")
    lines = [_line(F.lit("/"), ROOT_TYPE)]
    here = _top(F.lit(last))
    if up:
        lines.append(_line(_top(F.lit(up)), up))
        here = F.concat(_top(F.lit(up)), here)
    kind = T.StructType([f for f in frame.schema.fields if f.name != ORD and f.name not in carry])
    if single:
        parent = _top(F.lit(up)) if up else F.lit("/")
        found = _record(column, kind, parent, F.lit(last), here, name, F.array(*lines), origins)
    elif "id" in kind.names:
        lines.append(_line(here, f"{name}.item[]"))
        frame = frame.filter(column("id").isNotNull())
        if not any(isinstance(f.dataType, (T.StructType, T.ArrayType)) for f in kind.fields):
            return _flat_nodes(frame, kind, here, f"{name}.item", lines, origins, carry)
        found = _element(column, kind, here, f"{name}.item", F.array(*lines), origins, None)
    else:
        # A row without an id, and all below it, has no address.
        found = F.array().cast(_NODES)
    return frame.select(F.explode(found).alias("n"), *carry).select("n.*", *carry)


def _flat_nodes(frame, kind, parent: Column, type_: str, above: list, origins, carry) -> DataFrame:
    """Nodes of rows with nothing below them: plain columns, one node a row."""
    origin, names = origins.get(type_, type_), _label_names(kind)
    segment = column("id").cast("string")
    address = _below(parent, iri_escape(segment, "/" if origin in (PROSE, BLOB) else ""))
    labels = [column(n).cast("string").alias(f"__l{i}") for i, n in enumerate(names)]
    rows = frame.select(address.alias("__a"), segment.alias("__s"), *labels, *carry)
    here = F.col("__a")
    label = F.coalesce(*[F.col(f"__l{i}") for i in range(len(names))], here)
    node = _node(here, parent, F.col("__s"), type_, origins, label,
                 F.lit("") if origin == BLOB else here, F.array(*above, _line(here, type_)))
    return rows.select(node.alias("n"), *carry).select("n.*", *carry)


def _label_names(kind: T.StructType) -> list[str]:
    return [n for n in ("title", "name", "id") if n in kind.names]


def _line(address: Column, kind: str) -> Column:
    return F.struct(address.alias("address"), F.lit(kind).alias("type"))


def _below(address: Column, segment: Column) -> Column:
    return F.concat(address, F.lit("/"), segment)


def _bound(value: Column, nodes) -> Column:
    """``nodes(value)`` with ``value`` worked out once, however often it is
    used: expressions stay as small as the schema."""
    return F.flatten(F.transform(F.array(value), nodes))


def _element(
    read, kind: T.StructType, parent: Column, type_: str, above: Column, origins, owner
) -> Column:
    """The nodes of one array element, itself first."""
    origin = origins.get(type_, type_)
    segment = read("id").cast("string")
    if origin == HEADING and owner is not None:
        # A heading folds onto its document: renderers give it this very id.
        address = F.concat(owner, F.lit("#"), segment)
    else:
        address = _below(parent, iri_escape(segment, "/" if origin in (PROSE, BLOB) else ""))
    return _record(read, kind, parent, segment, address, type_, above, origins)


def _record(read, kind, parent, segment, address, type_: str, above, origins) -> Column:
    origin = origins.get(type_, type_)
    names = [read(n).cast("string") for n in _label_names(kind)]

    def nodes(here: Column) -> Column:
        fragment = {BLOB: F.lit(""), HEADING: segment}.get(origin, here)
        own = lambda line: _node(
            here, parent, segment, type_, origins, F.coalesce(*names, here), fragment, line
        )
        return _bound(
            F.array_append(above, _line(here, type_)),
            lambda line: F.concat(F.array(own(line)), *inner(here, line)),
        )

    def inner(here: Column, line: Column) -> list[Column]:
        parts = []
        for field in kind.fields:
            value, data_type = read(field.name), field.dataType
            path = f"{type_}.{field.name}"
            below = _below(here, iri_escape(F.lit(field.name)))
            if isinstance(data_type, T.StructType):
                found = _record(value.getField, data_type, here, F.lit(field.name), below, path,
                                line, origins)
            elif isinstance(data_type, T.ArrayType):
                found = _array(value, data_type, here, field.name, below, path, line, origins)
            else:
                continue
            parts.append(F.when(value.isNotNull(), found).otherwise(F.array().cast(_NODES)))
        return parts

    return _bound(address, nodes)


def _array(value, data_type, parent, segment: str, address, path: str, above, origins) -> Column:
    type_ = f"{path}.item"
    kind = data_type.elementType
    has_rows = isinstance(kind, T.StructType) and "id" in kind.names

    def nodes(here: Column) -> Column:
        line = F.array_append(above, _line(here, f"{type_}[]"))
        own = lambda bound: F.array(_node(
            here, parent, F.lit(segment), f"{type_}[]", origins, here, here, bound
        ))
        if not has_rows:
            return own(line)
        items = F.filter(value, lambda item: item["id"].isNotNull())
        return _bound(line, lambda bound: F.concat(own(bound), F.flatten(F.transform(
            items,
            lambda item: _element(item.getField, kind, here, type_, bound, origins, parent),
        ))))

    return _bound(address, nodes)


def _node(address, parent, segment, type_: str, origins, label, fragment, line) -> Column:
    values = (address, parent, segment, F.lit(type_), F.lit(origins.get(type_, type_)), label,
              fragment, line)
    names = [part.split(":")[0] for part in NODE.split(",")[:7]] + ["ancestors"]
    return F.struct(*[v.alias(n) for v, n in zip(values, names)])


def origin_types(
    specs: Mapping[str, ViewSpec], types: Mapping[str, T.StructType]
) -> dict[str, str]:
    """The origin of each type of a view: rows of a view that only filters or
    sorts are still rows of its source, and so are the rows nested by
    ``grouped``, by a ``join`` without ``flatten``, and in kept lists.
    ``types`` holds the row types of the sources and of the views."""
    from recordloom.plans.bundle import listed, evaluation_order

    out: dict[str, str] = {}

    def copy(source: str, target: str) -> None:
        """Types at and below ``source`` are origins at and below ``target``."""
        out[target] = out.get(source, source)
        base = types_at.get(source)
        if base is None:
            return
        for field in base.fields:
            kind = field.dataType
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                nested = f"{source}.{field.name}.item"
                types_at.setdefault(nested, kind.elementType)
                copy(nested, f"{target}.{field.name}.item")

    types_at = {f"{n}.item": t for n, t in types.items()}
    for name in evaluation_order(dict(specs)):
        spec = specs[name]
        source, target = f"{spec['from']}.item", f"{name}.item"
        joins = listed(spec.get("join", ()))
        lists = {j.get("as", j["to"]): f"{j['to']}.item" for j in joins if not j.get("flatten")}
        if "grouped" in spec:
            as_ = spec["grouped"].get("as", spec["from"].rsplit(".", 1)[-1])
            changed = bool(spec.get("flatten") or joins)
            lists = {} if changed else {as_: source}
        elif not (spec.get("flatten") or joins or spec.get("select")):
            copy(source, target)
            continue
        for field in types.get(spec["from"], T.StructType()).fields:
            kind = field.dataType
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                lists.setdefault(field.name, f"{source}.{field.name}.item")
                types_at.setdefault(f"{source}.{field.name}.item", kind.elementType)
        names = {i: i for i in types[name].names}
        if spec.get("select"):
            names = {s["item"] if not isinstance(s, str) else s:
                     s.get("as", s["item"]) if not isinstance(s, str) else s
                     for s in spec["select"]}
        for item, as_ in names.items():
            if item in lists:
                copy(lists[item], f"{target}.{as_}.item")
    return out


# ── Lookups (N3-N5) ──────────────────────────────────────────────────


def address_of(*segments: Column, path: Column | None = None, fragment: Column | None = None):
    """The address of a reference: ``path`` as it is, then each segment
    escaped, then ``#fragment``. NULL when any part is absent: a reference
    never stated is not a broken one."""
    parts = [] if path is None else [path]
    for segment in segments:
        parts += [F.lit("/"), iri_escape(segment.cast("string"))]
    if fragment is not None:
        parts += [F.lit("#"), fragment]
    return F.concat(*parts)


def resolve_refs(refs: DataFrame, address: Column, nodes: DataFrame) -> DataFrame:
    """``refs`` plus ``address``, ``state`` (``ok``, ``missing``, ``none``) and
    the display ``label``: that of the node, or the address tried."""
    known = nodes.groupBy(F.col("address").alias("__address")).agg(
        F.min("label").alias("__label")
    )
    # References never stated get keys of their own, that no address has: they do
    # not meet in one task.
    spread = F.coalesce(F.col("address"), F.monotonically_increasing_id().cast("string"))
    joined = refs.withColumn("address", address).withColumn("__key", spread).join(
        known, F.col("__key") == F.col("__address"), "left"
    )
    state = (
        F.when(F.col("address").isNull(), "none")
        .when(F.col("__address").isNull(), "missing")
        .otherwise("ok")
    )
    label = F.coalesce(F.col("__label"), F.col("address"))
    return joined.withColumn("state", state).withColumn("label", label).drop(
        "__address", "__label", "__key"
    )


def children(steps: DataFrame, parent: Column, segment: Column, nodes: DataFrame) -> DataFrame:
    """``steps`` plus the ``child`` address of each (parent address, raw
    segment) and its ``state``; a missing child shows the address tried."""
    kids = nodes.groupBy(
        F.col("parent").alias("__parent"), F.col("segment").alias("__segment")
    ).agg(F.min("address").alias("__child"))
    joined = steps.withColumn("__p", parent).withColumn("__s", segment.cast("string")).join(
        kids, (F.col("__p") == F.col("__parent")) & (F.col("__s") == F.col("__segment")), "left"
    )
    absent = F.col("__p").isNull() | F.col("__s").isNull()
    tried = F.when(~absent, F.coalesce(F.col("__child"), _step(F.col("__p"), F.col("__s"))))
    state = F.when(absent, "none").when(F.col("__child").isNull(), "missing").otherwise("ok")
    return joined.withColumn("child", tried).withColumn("state", state).drop(
        "__parent", "__segment", "__child", "__p", "__s"
    )


def label_of(frame: DataFrame, address: Column) -> Column:
    """The first of title, name and id a row has, else its address."""
    names = [n for n in ("title", "name", "id") if n in frame.columns]
    return F.coalesce(*[column(n).cast("string") for n in names], address)


# ── Pages (N6, N7, N9) ───────────────────────────────────────────────


def assign_pages(nodes: DataFrame, editions: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each node once per edition, with the ``page_path`` it is on: the page of
    the nearest node, itself included, whose type is in the edition's list,
    else ``index.md``; a blob is its own file. Read off the ancestor list, so
    there is no join."""
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.array(*[F.lit(t) for t in types]).cast("array<string>").alias("types"),
            )
            for name, types in editions.items()
        ]
    )
    spread = nodes.select(*nodes.columns, F.explode(table).alias("__edition"))
    split = F.filter(
        F.col("ancestors"), lambda a: F.array_contains(F.col("__edition.types"), a["type"])
    )
    owner = F.try_element_at(split, F.lit(-1))["address"]
    page = F.when(F.col("origin") == BLOB, F.regexp_replace("address", "^/", "")).otherwise(
        F.coalesce(F.concat(F.regexp_replace(owner, "^/", ""), F.lit(".md")), F.lit("index.md"))
    )
    return spread.select(
        F.col("__edition.name").alias("edition"),
        *nodes.columns,
        page.alias("page_path"),
        (F.array_contains(F.col("__edition.types"), F.col("type"))
         | (F.col("address") == "/")).alias("opens_page"),
    )


def page_collisions(pages: DataFrame) -> DataFrame:
    """Page paths that several nodes open or are files of: ``edition``,
    ``page_path``, ``claims``."""
    claims = pages.filter(F.col("opens_page") | (F.col("origin") == BLOB))
    counted = claims.groupBy("edition", "page_path").agg(F.count(F.lit(1)).alias("claims"))
    return counted.filter("claims > 1")


# ── Links (N8, N10) ──────────────────────────────────────────────────


def href(source_page: Column, target_page: Column, fragment: Column) -> Column:
    """The link from one page to a node on another, or the same, page."""
    path = relative_path(target_page, source_page)
    return F.when(fragment == "", path).otherwise(F.concat(path, F.lit("#"), fragment))


def in_subtree(ancestors: Column, address: Column) -> Column:
    """Whether a node, given by its ancestors, is ``address`` or below it."""
    return F.exists(ancestors, lambda a: a["address"] == address)


# ── Rows of an entity (N11, N12) ─────────────────────────────────────


def entity_rows(name: str, frame: DataFrame, steps: Sequence[str] = ()) -> DataFrame:
    """All rows of an entity, or of the nested entity ``steps`` leads to, with
    their ``_address`` (absent where a row has none)."""
    out = frame.withColumn("_address", _row_address(frame, F.lit(f"/{name}"), f"{name}.item"))
    at = f"{name}.item"
    for step in steps:
        field = resolve(out, step)
        kept = [column(ORD)] if ORD in out.columns else []
        parent = F.col("_address")
        rows = out.select(parent.alias("__up"), *kept, F.posexplode(field.column).alias("__i", "v"))
        if kept:
            rows = rows.withColumn(ORD, F.struct(column(ORD).alias("a"), F.col("__i").alias("b")))
        names = field.data_type.elementType.names
        at = f"{at}.{step}.item"
        out = rows.select(*[F.col("v").getField(n).alias(n) for n in names], "__up", *kept)
        base = F.concat(F.col("__up"), *[
            part for s in step.split(".") for part in (F.lit("/"), iri_escape(F.lit(s)))
        ])
        own = F.concat(F.col("__up"), F.lit("#"), column("id").cast("string")) if (
            at == HEADING
        ) else _row_address(out, base, at)
        out = out.withColumn("_address", own).drop("__up")
    return out


def _row_address(frame: DataFrame, base: Column, kind: str) -> Column:
    if "id" not in frame.columns:
        return F.lit(None).cast("string")
    kept = "/" if kind in (PROSE, BLOB) else ""
    return F.concat(base, F.lit("/"), iri_escape(column("id").cast("string"), kept))


#: Fixed value: what stands for the rows of an entity that has none.
NO_RECORDS = "*(no records)*"


def record_table(name: str, frame: DataFrame, steps: Sequence[str] = ()) -> DataFrame:
    """The Markdown table of an entity as ordered lines: ``entity``, ``part``
    (0 title, 1 head, 2 rule, 3 rows), ``line``. An entity without rows has a
    notice instead of head and rule. One row per record, never one
    row per table; sort by ``part`` and the ordinal to print it."""
    rows = entity_rows(name, frame, steps)
    label = ".".join((name, *steps))
    fields = [f for f in rows.schema.fields if f.name in visible(rows.schema) and f.name != "_address"]
    names, cells = [], []
    for field in fields:
        value = column(field.name)
        if isinstance(field.dataType, T.StructType):
            for sub in field.dataType.fields:
                if not isinstance(sub.dataType, T.StructType):
                    names.append(f"{field.name}.{sub.name}")
                    cells.append(_cell(value.getField(sub.name), sub.dataType))
        else:
            names.append(field.name)
            cells.append(_cell(value, field.dataType))
    kept = [column(ORD)] if ORD in rows.columns else []
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells, md_cell(shown(F.col("_address")))),
                    F.lit(" |"))
    body = rows.select(F.lit(label).alias("entity"), F.lit(3).alias("part"), line.alias("line"), *kept)
    fixed = "entity string, part int, line string"
    spark = frame.sparkSession
    title = spark.createDataFrame([(label, 0, f"# {label}")], fixed)
    head = spark.createDataFrame([
        (label, 1, "| " + " | ".join([*names, "_anchor_path"]) + " |"),
        (label, 2, "|" + "---|" * (len(names) + 1)),
    ], fixed)
    none = spark.createDataFrame([(label, 1, ""), (label, 2, NO_RECORDS)], fixed)
    # One row at most on either side: whether there is a record at all.
    some = rows.select(F.lit(1).alias("__some")).limit(1)
    on = F.col("__some") == 1
    opening = head.join(some, on, "left_semi").unionByName(none.join(some, on, "left_anti"))
    return title.unionByName(opening).unionByName(body, allowMissingColumns=True)


def _cell(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        size = F.coalesce(F.size(value), F.lit(0))
        return F.concat(F.lit("*"), size.cast("string"), F.lit(" items*"))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return md_cell(shown(F.to_json(value)))
    return md_cell(shown(value))
