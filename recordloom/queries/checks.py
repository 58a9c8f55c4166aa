"""Integrity checks and catalog queries on the plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators import checks as C
from recordloom.operators.views import finish
from recordloom.plans import catalog as K
from recordloom.queries.registry import Tables, query
from recordloom.sources.schema import Reference, references
from recordloom.sources.tree import nfc, read_entities


def record(required=(), **properties):
    return {"type": "object", "additionalProperties": False, "required": list(required),
            "properties": properties}


def rows_of(item):
    return {"type": "array", "items": item}


def ref(entity, attribute, kind="integer"):
    return {"type": kind, "x-ref": {"entity": entity, "attribute": attribute}}


INTEGER, NUMBER, STRING = {"type": "integer"}, {"type": "number"}, {"type": "string"}

# The star schema of the tables.
STAR = record(
    region=rows_of(record(["r_regionkey"], r_regionkey=INTEGER, r_name=STRING)),
    nation=rows_of(record(["n_nationkey"], n_nationkey=INTEGER, n_name=STRING,
                          n_regionkey=ref("region", "r_regionkey"))),
    customer=rows_of(record(["c_custkey"], c_custkey=INTEGER, c_name=STRING,
                            c_nationkey=ref("nation", "n_nationkey"), c_acctbal=NUMBER,
                            c_mktsegment=STRING)),
    orders=rows_of(record(["o_orderkey"], o_orderkey=INTEGER, o_custkey=ref("customer", "c_custkey"),
                          o_orderstatus=STRING, o_totalprice=NUMBER, o_orderpriority=STRING)),
    labels=rows_of(record(["doc_id"], doc_id=ref("documents", "doc_id"), quality=INTEGER,
                          toxic=INTEGER)),
    documents=rows_of(record(["doc_id"], doc_id=INTEGER, text=STRING, lang=STRING, source=STRING,
                             n_chars=INTEGER)),
)


def star_frames(t: Tables) -> dict[str, DataFrame]:
    """The star tables with some rows left out of the referenced ones."""
    return {
        "region": t.region.filter("r_regionkey <> 3"),
        "nation": t.nation,
        "customer": t.customer.filter("c_acctbal >= 0"),
        "orders": t.orders.drop("o_orderdate"),
        "labels": t.labels,
        "documents": t.documents.filter("lang <> 'de'"),
    }


# ── References ───────────────────────────────────────────────────────


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def fk_dangling(t: Tables) -> DataFrame:
    loose = C.dangling(t.lineitem, "l_partkey", t.part.filter("p_size <= 25"), "p_partkey")
    return loose.select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT 'orders.o_custkey' AS path, CAST(o_custkey AS VARCHAR) AS value, 'warning' AS severity
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT 'nation.n_regionkey', CAST(n_regionkey AS VARCHAR), 'warning' FROM nation
WHERE n_regionkey = 3
UNION ALL SELECT 'labels.doc_id', CAST(doc_id AS VARCHAR), 'warning' FROM labels
WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')""")
def fk_declared(t: Tables) -> DataFrame:
    """All declared references at once, a warning per occurrence."""
    found = C.check_references(star_frames(t), STAR)
    value = F.regexp_extract("message", "refers to '([^']*)'", 1)
    return found.select("path", value.alias("value"), "severity")


@query("""SELECT 'reference' AS kind, 'nation' AS source, 'region' AS target, 'n_regionkey' AS attribute, count(n_regionkey) AS used,
  count(*) FILTER (n_regionkey = 3) AS dangling FROM nation
UNION ALL SELECT 'reference', 'customer', 'nation', 'c_nationkey', count(c_nationkey), 0
  FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'reference', 'orders', 'customer', 'o_custkey', count(o_custkey),
  count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)) FROM orders
UNION ALL SELECT 'reference', 'labels', 'documents', 'doc_id', count(doc_id),
  count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')) FROM labels""")
def relation_edges(t: Tables) -> DataFrame:
    """The reference edges of the catalog with how often each is used and
    dangling in the data."""
    frames = star_frames(t)
    entities = K.catalog(t.spark, K.schema_types(STAR, with_builtin=False))[K.ENTITIES]
    edges = K.edges(entities)

    def usage(r: Reference) -> DataFrame:
        named = frames[r.entity].select(F.col(r.path).alias("v")).filter("v is not null")
        loose = C.dangling(named, "v", frames[r.target], r.attribute)
        marked = named.select(F.lit(0).alias("loose")).unionByName(
            loose.select(F.lit(1).alias("loose")))
        return marked.agg(
            F.count_if(F.col("loose") == 0).alias("used"),
            F.count_if(F.col("loose") == 1).alias("dangling"),
        ).select(F.lit(r.entity).alias("source"), F.lit(r.path).alias("attribute"), "used",
                 "dangling")

    used = reduce(DataFrame.unionByName, map(usage, references(STAR)))
    return edges.join(used, ["source", "attribute"]).select(
        "kind", "source", "target", "attribute", "used", "dangling")


# ── Duplicate ids ────────────────────────────────────────────────────


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def dup_ids(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return C.duplicate_rows(rows).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""SELECT 'talks/' || conv_id || '/roles' AS path, role AS id FROM conversations
QUALIFY count(*) OVER (PARTITION BY conv_id, role) > 1""")
def dup_nested_ids(t: Tables) -> DataFrame:
    """Ids repeated inside one record's nested collection."""
    from recordloom.operators.views import grouped, source

    talks = finish(grouped(
        source(t.conversations.select("conv_id", "turn", F.col("role").alias("id")), ["turn"]),
        "conv_id", "roles"))
    schema = record(talks=rows_of(record(
        id=INTEGER, roles=rows_of(record(turn=INTEGER, id=STRING, conv_id=INTEGER)))))
    found = C.check_duplicate_ids({"talks": talks.withColumnRenamed("conv_id", "id")}, schema)
    return found.select("path", F.regexp_extract("message", "^'([^']*)'", 1).alias("id"))


# ── Schema rules ─────────────────────────────────────────────────────


@query("""SELECT source, record, path FROM (
  SELECT l_orderkey || '-' || l_linenumber AS record, * FROM lineitem), LATERAL (
  SELECT unnest([
    CASE WHEN l_quantity < 3 THEN {'source': 'schema-minimum', 'path': '/l_quantity'} END,
    CASE WHEN l_quantity >= 50 THEN {'source': 'schema-exclusiveMaximum', 'path': '/l_quantity'} END,
    CASE WHEN l_linenumber % 2 <> 0 THEN {'source': 'schema-multipleOf', 'path': '/l_linenumber'} END,
    CASE WHEN l_returnflag NOT IN ('A', 'N') THEN {'source': 'schema-enum', 'path': '/l_returnflag'} END,
    CASE WHEN l_discount <> floor(l_discount) THEN {'source': 'schema-type', 'path': '/l_discount'} END
  ]) AS v), LATERAL (SELECT v.source AS source, v.path AS path) WHERE v IS NOT NULL""")
def schema_rules(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount")
    schema = rows_of(record(
        ["l_orderkey"], l_orderkey=INTEGER,
        l_linenumber={"type": "integer", "multipleOf": 2},
        l_quantity={"type": "number", "minimum": 3, "exclusiveMaximum": 50},
        l_returnflag={"type": "string", "enum": ["A", "N"]},
        l_discount=INTEGER,
    ))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return C.schema_violations(rows, "lineitem", schema, key).select("source", "record", "path")


@query("""SELECT source, record, path, entity FROM (SELECT doc_id, text, lang, source AS src FROM documents),
  LATERAL (SELECT unnest([
    CASE WHEN length(text) < 400 THEN {'s': 'schema-minLength', 'path': '/text'} END,
    CASE WHEN length(text) > 3000 THEN {'s': 'schema-maxLength', 'path': '/text'} END,
    CASE WHEN NOT regexp_matches(text, '\\p{Lu}[^.]*[.]') THEN {'s': 'schema-pattern', 'path': '/text'} END,
    CASE WHEN lang <> 'en' THEN {'s': 'schema-const', 'path': '/lang'} END,
    {'s': 'schema-required', 'path': ''},
    {'s': 'schema-additionalProperties', 'path': ''}]) AS v),
  LATERAL (SELECT v.s AS source, CAST(doc_id AS VARCHAR) AS record, v.path AS path, 'documents' AS entity)
WHERE v IS NOT NULL""")
def schema_rules_text_fields(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", "lang", "source")
    schema = rows_of(record(
        ["title"], doc_id=INTEGER, title=STRING,
        text={"type": "string", "minLength": 400, "maxLength": 3000,
              "pattern": r"\p{Lu}[^.]*[.]"},
        lang={"type": "string", "const": "en"},
    ))
    found = C.schema_violations(rows, "documents", schema, F.col("doc_id"))
    return found.select("source", "record", "path", "entity")


@query("""SELECT source, record, path FROM (SELECT event_id, event_type, CAST(props->'k' AS INT) AS k,
  value, event_id % 10 AS d FROM events), LATERAL (SELECT unnest([
    CASE WHEN k > 50 THEN {'s': 'schema-maximum', 'p': '/props/k'} END,
    CASE WHEN d = 0 THEN {'s': 'schema-type', 'p': '/kind/name'} END,
    CASE WHEN d = 1 THEN {'s': 'schema-additionalProperties', 'p': '/kind'} END,
    CASE WHEN d = 2 THEN {'s': 'schema-required', 'p': '/kind'} END,
    CASE WHEN d = 3 THEN {'s': 'schema-syntax', 'p': ''} END]) AS v),
  LATERAL (SELECT v.s AS source, CAST(event_id AS VARCHAR) AS record, v.p AS path)
WHERE v IS NOT NULL AND (d <> 3 OR v.s = 'schema-syntax')""")
def schema_rules_json(t: Tables) -> DataFrame:
    """Types, unknown keys and syntax of JSON text, which a typed read hides."""
    kind = (
        F.when(F.col("d") == 0, F.lit('{"name":1}'))
        .when(F.col("d") == 1, F.lit('{"name":"x","more":1}'))
        .when(F.col("d") == 2, F.lit("{}"))
        .when(F.col("d") == 3, F.lit('{"name":"x","name":"y"}'))
        .otherwise(F.concat(F.lit('{"name":"'), "event_type", F.lit('"}')))
    )
    body = F.concat(F.lit('{"props":'), "props", F.lit(',"kind":'), kind, F.lit("}"))
    files = t.events.withColumn("d", F.col("event_id") % 10).select(
        F.col("event_id").cast("string").alias("path"), body.alias("text"),
        F.lit(None).cast("string").alias("problem"))
    schema = record(props=record(k={"type": "integer", "maximum": 50}),
                    kind=record(["name"], name=STRING))
    return C.text_violations(files, schema).select("source", "record", "path")


# ── Report ───────────────────────────────────────────────────────────


@query("""SELECT severity, source, count(*) AS n FROM (
  SELECT DISTINCT 'error' AS severity, 'duplicate-id' AS source, l_orderkey FROM lineitem
  WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
  UNION ALL SELECT DISTINCT 'warning', 'x-ref-data', o_custkey FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
  UNION ALL SELECT 'error', 'blob-data', s_suppkey FROM supplier) GROUP BY severity, source""")
def diagnostics_report(t: Tables) -> DataFrame:
    """Findings of several checks in one table, repeats removed, counted."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("id"))
    schema = record(lines=rows_of(record(id=INTEGER)))
    orders = {"orders": t.orders.select("o_custkey"), "customer": t.customer.filter("c_acctbal >= 0")}
    linked = record(
        orders=rows_of(record(o_custkey=ref("customer", "c_custkey"))),
        customer=STAR["properties"]["customer"],
    )
    blobs = t.supplier.select(F.col("s_suppkey").alias("id"))
    parts = [
        C.check_duplicate_ids({"lines": lines}, schema),
        C.check_references(orders, linked).filter("entity = 'orders'"),
        C.check_handwritten_blobs(blobs),
    ]
    found = C.deduplicated(C.report(parts, t.spark))
    return found.groupBy("severity", "source").agg(F.count(F.lit(1)).alias("n"))


# ── Reading ──────────────────────────────────────────────────────────


@query("""SELECT conv_id || '-' || turn AS id, role, CAST(length(text) AS BIGINT) AS size, tag.id AS tag,
  tag.n AS n FROM conversations, LATERAL (SELECT unnest([{'id': 'z', 'n': turn}, {'id': 'a', 'n': conv_id}]) AS tag)""")
def json_maps_to_rows(t: Tables) -> DataFrame:
    """JSON text with keyed maps at two levels, read by declared schema."""
    key = F.concat_ws("-", "conv_id", "turn")
    tags = F.create_map(
        F.lit("z"), F.struct(F.col("turn").alias("n")), F.lit("a"), F.struct(F.col("conv_id").alias("n")))
    body = F.to_json(F.struct(F.create_map(key, F.struct(
        "role", F.length("text").alias("size"), tags.alias("tags"))).alias("turns")))
    files = t.conversations.select(
        F.array(F.lit("talk"), key).alias("parts"), body.alias("text"))
    schema = record(turns={"type": "object", "additionalProperties": record(
        role=STRING, size=INTEGER,
        tags={"type": "object", "additionalProperties": record(n=INTEGER)})})
    turns = finish(read_entities(files, schema)["turns"])
    return turns.select("id", "role", "size", F.explode("tags").alias("t")).select(
        "id", "role", "size", F.col("t.id").alias("tag"), F.col("t.n").alias("n"))


@query("""SELECT arg_max(c_name, c_custkey) AS last_name,
  arg_max(c_mktsegment, c_custkey) FILTER (c_acctbal < 0) AS debtor,
  arg_max(c_nationkey, c_custkey) FILTER (c_mktsegment = 'BUILDING') AS nation FROM customer""")
def single_record_merge(t: Tables) -> DataFrame:
    """One record put together from many files; the last path wins per field."""
    about = F.struct(
        F.col("c_name").alias("last"),
        F.struct(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).alias("debtor"),
                 F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey")).alias("nation"),
                 ).alias("deep"))
    path = F.lpad(F.col("c_custkey").cast("string"), 12, "0")
    files = t.customer.select(F.array(path).alias("parts"),
                              F.to_json(F.struct(about.alias("about"))).alias("text"))
    schema = record(about=record(last=STRING, deep=record(debtor=STRING, nation=INTEGER)))
    out = finish(read_entities(files, schema)["about"])
    return out.select(F.col("last").alias("last_name"), F.col("deep.debtor").alias("debtor"),
                      F.col("deep.nation").cast("int").alias("nation"))


@query("""SELECT doc_id, md5(nfc_normalize(text)) AS folded,
  text <> nfc_normalize(text) AS changed FROM documents""")
def nfc_fold(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text", nfc(F.col("text")).alias("f")).select(
        "doc_id", F.md5("f").alias("folded"), (F.col("text") != F.col("f")).alias("changed"))


# ── Catalog ──────────────────────────────────────────────────────────


def _attribute_sql() -> str:
    """Every declared attribute and on how many rows it is present."""
    parts = []
    for name, kind in K.schema_types(STAR, with_builtin=False).items():
        for field in kind.fields:
            required = str(field.metadata["required"]).lower()
            parts.append(
                f"SELECT '{name}' AS entity, '{field.name}' AS attribute,"
                f" '{K.type_name(field.dataType)}' AS type, {required} AS required,"
                f" count({field.name}) AS present FROM {name}")
    return " UNION ALL ".join(parts)


@query(_attribute_sql())
def catalog_attributes(t: Tables) -> DataFrame:
    """The catalog's attributes with the number of rows that carry each."""
    types = K.schema_types(STAR, with_builtin=False)
    attributes = K.attribute_rows(K.catalog(t.spark, types)[K.ENTITIES])

    def present(name: str, kind: T.StructType) -> DataFrame:
        frame = getattr(t, name)
        counts = F.array(*[
            F.struct(F.lit(f.name).alias("attribute"), F.count(F.col(f.name)).alias("present"))
            for f in kind.fields])
        return frame.agg(counts.alias("c")).select(
            F.lit(name).alias("entity"), F.explode("c").alias("c")).select("entity", "c.*")

    counted = reduce(DataFrame.unionByName, [present(n, k) for n, k in types.items()])
    return attributes.join(counted, ["entity", "attribute"]).select(
        "entity", "attribute", "type", "required", "present")


TALKS = record(talks=rows_of(record(id=INTEGER, turns=rows_of(record(turn=INTEGER, role=STRING)))),
               orders=STAR["properties"]["orders"], customer=STAR["properties"]["customer"])
LINEAGE = {"mine": {"from": "talks"}, "both": {"from": "mine", "join": {
    "to": "orders", "on": {"left": "id", "right": "o_orderkey"}}}}


@query("""SELECT 'composition' AS kind, 'talks' AS source, 'talks.turns' AS target, count(*) AS n FROM conversations
UNION ALL SELECT 'reference', 'orders', 'customer', count(*) FROM orders
UNION ALL SELECT 'lineage', 'mine', 'talks', count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'lineage', 'both', 'mine', count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'lineage', 'both', 'orders', count(*) FROM orders""")
def entity_edges(t: Tables) -> DataFrame:
    """Composition, reference and lineage edges, each with the rows that run along it."""
    edges = K.edges(K.catalog(t.spark, K.schema_types(TALKS, with_builtin=False))[K.ENTITIES], LINEAGE)
    talks = t.conversations.agg(F.count_distinct("conv_id").alias("n"))
    counts = [(("talks", "talks.turns"), t.conversations.agg(F.count(F.lit(1)).alias("n"))),
              (("orders", "customer"), t.orders.agg(F.count("o_custkey").alias("n"))),
              (("mine", "talks"), talks), (("both", "mine"), talks),
              (("both", "orders"), t.orders.agg(F.count(F.lit(1)).alias("n")))]
    rows = reduce(DataFrame.unionByName, [
        c.select(F.lit(a).alias("source"), F.lit(b).alias("target"), "n") for (a, b), c in counts])
    return edges.filter("kind <> 'reference' or source = 'orders'").join(
        rows, ["source", "target"]).select("kind", "source", "target", "n")


@query("""SELECT id, builtin, n FROM (SELECT 'region' AS id, false AS builtin, count(*) AS n FROM region
UNION ALL SELECT 'nation', false, count(*) FROM nation UNION ALL SELECT 'customer', false, count(*) FROM customer
UNION ALL SELECT 'orders', false, count(*) FROM orders UNION ALL SELECT 'labels', false, count(*) FROM labels
UNION ALL SELECT 'documents', false, count(*) FROM documents)""")
def builtin_views(t: Tables) -> DataFrame:
    """The entities the built-in view of definitions lists, with their rows."""
    types = K.schema_types(STAR, with_builtin=False)
    defs = K.builtin_views(K.catalog(t.spark, types))["__entity_defs"]
    sizes = reduce(DataFrame.unionByName, [
        getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("id"), "n") for n in types])
    return finish(defs).join(sizes, "id").select("id", "builtin", "n")


@query("""SELECT 'closed' AS gate, 'error' AS severity, count(*) AS n FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'open', 'warning', count(*) FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def export_gate(t: Tables) -> DataFrame:
    """Errors close the gate of an export, warnings alone do not; the run log says so."""
    ids = t.lineitem.select(F.col("l_orderkey").alias("id"))
    doubles = C.check_duplicate_ids({"lines": ids}, record(lines=rows_of(record(id=INTEGER))))
    linked = record(orders=rows_of(record(o_custkey=ref("customer", "c_custkey"))),
                    customer=STAR["properties"]["customer"])
    loose = C.check_references({"orders": t.orders.select("o_custkey"),
                                "customer": t.customer.filter("c_acctbal >= 0")}, linked).filter("entity = 'orders'")
    log = f"{t.scratch()}/log"
    for name, found in (("closed", doubles), ("open", loose)):
        C.run_stages(t.spark, [(name, lambda f=found: f)], log)
    states = F.when(F.col("status") == "ng", "closed").otherwise("open").alias("gate")
    found = doubles.withColumn("stage", F.lit("closed")).unionByName(loose.withColumn("stage", F.lit("open")))
    return t.spark.read.parquet(log).select("stage", states).join(
        found.groupBy("stage", "severity").agg(F.count(F.lit(1)).alias("n")), "stage").select("gate", "severity", "n")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS value, doc_id % 3 <> 0 AS found FROM documents""")
def whole_numbers(t: Tables) -> DataFrame:
    """Only whole numbers in range are integers; others are absent, and findings."""
    kinds = F.array(F.col("doc_id").cast("string"), F.concat("doc_id", F.lit(".5")), F.lit("1" + "0" * 23))
    body = F.concat(F.lit('{"rows":{"'), "doc_id", F.lit('":{"n":'), F.get(kinds, (F.col("doc_id") % 3).cast("int")), F.lit("}}}"))
    files = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.array(F.col("doc_id").cast("string")).alias("parts"),
                               body.alias("text"), F.lit(None).cast("string").alias("problem"))
    schema = record(rows={"type": "object", "additionalProperties": record(n=INTEGER)})
    rows = finish(read_entities(files, schema)["rows"])
    loose = C.text_violations(files, schema).select(F.col("record").alias("id")).distinct().withColumn("f", F.lit(True))
    return rows.join(loose, "id", "left").select(
        F.col("id").cast("bigint").alias("doc_id"), F.col("n").alias("value"), F.coalesce("f", F.lit(False)).alias("found"))


# ── Array rules ──────────────────────────────────────────────────────

LISTS = record(lists=rows_of(record(
    ["id"], id=INTEGER, words={"type": "array", "items": STRING, "minItems": 3, "maxItems": 40, "uniqueItems": True},
    turns={"type": "array", "items": record(turn=INTEGER, role=STRING), "uniqueItems": True})))


@query(r"""WITH lists AS (SELECT doc_id AS id, string_split(coalesce(text, ''), ' ') AS words FROM documents),
talks AS (SELECT conv_id AS id, list({'turn': turn % 2, 'role': role}) AS turns FROM conversations GROUP BY conv_id)
SELECT CAST(id AS VARCHAR) AS record, '/words' AS path, 'minItems' AS rule FROM lists WHERE len(words) < 3
UNION ALL SELECT CAST(id AS VARCHAR), '/words', 'maxItems' FROM lists WHERE len(words) > 40
UNION ALL SELECT CAST(id AS VARCHAR), '/words', 'uniqueItems' FROM lists WHERE len(list_distinct(words)) < len(words)
UNION ALL SELECT CAST(id AS VARCHAR), '/turns', 'uniqueItems' FROM talks WHERE len(list_distinct(turns)) < len(turns)""")
def schema_rules_arrays(t: Tables) -> DataFrame:
    """Rules on the number of items and on items that are the same, for plain items
    and for rows."""
    words = t.documents.select(
        F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), " ", -1).alias("words"),
        F.lit(None).cast("array<struct<turn:bigint,role:string>>").alias("turns"))
    talks = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.struct(
        (F.col("turn") % 2).cast("bigint").alias("turn"), "role")).alias("turns")).select(
        "id", F.lit(None).cast("array<string>").alias("words"), "turns")
    found = C.schema_violations(words.unionByName(talks), "lists", LISTS["properties"]["lists"], F.col("id").cast("string"))
    return found.select("record", "path", F.regexp_replace("source", "^schema-", "").alias("rule"))
