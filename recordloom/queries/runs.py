"""Files, exports, change detection and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators import views as V
from recordloom.queries.checks import INTEGER, NUMBER, STRING, record
from recordloom.queries.registry import Tables, query
from recordloom.queries.views import LISTS_SQL, list_ends, keep
from recordloom.sources import sinks
from recordloom.sources.tree import (
    prose_problems, prose_rows, read_blobs, read_entities, read_prose, record_files, scan_tree, single_items,
)
from recordloom.streaming import incremental as I
from recordloom.streaming import keyed as K
from recordloom.streaming.tracked import TrackedTree

#: Customers per written file.
FILE_ROWS = 500

CUSTOMERS = record(customers={"type": "object", "additionalProperties": record(
    name=STRING, nation=INTEGER, balance=NUMBER)})


def _customer_files(t: Tables) -> str:
    """The customers as JSON record files, a bounded number in each."""
    entry = F.struct(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"))
    rows = t.customer.select(
        F.floor(F.col("c_custkey") / FILE_ROWS).alias("file"),
        F.struct(F.col("c_custkey").cast("string").alias("k"), entry.alias("v")).alias("e"))
    body = F.to_json(F.struct(F.map_from_entries(F.collect_list("e")).alias("customers")))
    files = rows.groupBy("file").agg(body.alias("body"))
    root = t.scratch()
    sinks.write_page_files(files.select(
        F.lit("tree").alias("edition"), F.lit(0).alias("part"), "body",
        F.concat(F.lit("people/c"), F.col("file").cast("string"), F.lit(".json")).alias("page_path"),
    ), root)
    return root


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation,
  c_acctbal AS balance FROM customer""")
def file_round_trip(t: Tables) -> DataFrame:
    """Written as record files, scanned and read back by schema."""
    files = record_files(t.spark, _customer_files(t))
    return V.finish(read_entities(files, CUSTOMERS)["customers"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation,
  c_acctbal AS balance FROM customer""")
def file_stream(t: Tables) -> DataFrame:
    """The same files taken in as a stream of new files."""
    root, out = _customer_files(t), t.scratch()
    I.ingest(I.stream_record_files(t.spark, root), CUSTOMERS, {"customers": f"{out}/table"},
             f"{out}/state").awaitTermination()
    return t.spark.read.parquet(f"{out}/table").select("id", "name", "nation", "balance")


ROLL = record(roll=record(names={"type": "array", "items": STRING}, deep=record(keys={"type": "array", "items": INTEGER})))


@query(f"""SELECT 'names' AS path, c_name AS item, 'f' || (c_custkey // {FILE_ROWS}) || '.json' AS file,
  CAST(row_number() OVER (PARTITION BY c_custkey // {FILE_ROWS} ORDER BY c_custkey) - 1 AS INTEGER) AS pos FROM customer
UNION ALL SELECT 'deep.keys', CAST(c_custkey AS VARCHAR), 'f' || (c_custkey // {FILE_ROWS}) || '.json',
  CAST(row_number() OVER (PARTITION BY c_custkey // {FILE_ROWS} ORDER BY c_custkey) - 1 AS INTEGER) FROM customer""")
def single_record_items(t: Tables) -> DataFrame:
    """The arrays of one record that many files have pieces of, as ordered rows."""
    rows = t.customer.select(F.floor(F.col("c_custkey") / FILE_ROWS).alias("file"), F.struct("c_custkey", "c_name").alias("e"))
    pieces = rows.groupBy("file").agg(F.sort_array(F.collect_list("e")).alias("e"))
    deep = F.struct(F.col("e.c_custkey").alias("keys")).alias("deep")
    files = pieces.select(
        F.array(F.concat(F.lit("f"), F.col("file").cast("string"), F.lit(".json"))).alias("parts"),
        F.to_json(F.struct(F.struct(F.col("e.c_name").alias("names"), deep).alias("roll"))).alias("text"))
    found = single_items(read_entities(files, ROLL, merge=False)["roll"], ROLL["properties"]["roll"])
    shown = lambda path: found[path].select(
        F.lit(path).alias("path"), F.col("item").cast("string").alias("item"), F.col("__ord.parts")[0].alias("file"),
        F.col("__ord.pos").alias("pos"))
    return shown("names").union(shown("deep.keys"))


@query("""SELECT 'nation' AS name, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name
  || '","n_regionkey":' || n_regionkey || '}' AS row FROM nation
UNION ALL SELECT 'priority', '{"o_orderkey":' || o_orderkey
  || CASE WHEN o_orderstatus <> 'O' THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || '}' FROM orders""")
def namespace_rows(t: Tables) -> DataFrame:
    """Every frame as (name, JSON row); absent fields are left out."""
    status = F.nullif("o_orderstatus", F.lit("O")).alias("status")
    return sinks.namespace_rows(
        {"nation": t.nation, "priority": t.orders.select("o_orderkey", status)})


@query("""SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders""")
def export_and_read(t: Tables) -> DataFrame:
    """A namespace exported all or nothing, then read back."""
    rows = t.orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status"))
    out = f"{t.scratch()}/export"
    sinks.export_namespace({"orders": V.source(rows, ["o_orderkey"])}, out)
    return t.spark.read.schema("o_orderkey bigint, status string").json(f"{out}/orders")


@query("""SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added'
  WHEN a.doc_id IS NULL THEN 'deleted' WHEN b.size = a.size AND b.source = a.source THEN 'unchanged'
  ELSE 'modified' END AS change
FROM (SELECT doc_id, n_chars AS size, source FROM documents WHERE lang <> 'de') b
FULL JOIN (SELECT d.doc_id, n_chars + coalesce(toxic, 0) AS size, source FROM documents d
  LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang <> 'fr') a ON b.doc_id = a.doc_id""")
def change_manifest(t: Tables) -> DataFrame:
    before = t.documents.filter("lang <> 'de'").select("doc_id", F.col("n_chars").alias("size"), "source")
    after = t.documents.join(t.labels, "doc_id", "left").filter("lang <> 'fr'").select(
        "doc_id", (F.col("n_chars") + F.coalesce("toxic", F.lit(0))).alias("size"), "source")
    return I.changes(before, after, "doc_id", ["size", "source"])


def _stream(t: Tables, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = t.spark.read.parquet(f"{t.folder}/{name}.parquet").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _drain(frame: DataFrame, out: str) -> DataFrame:
    frame.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(
        availableNow=True).start(f"{out}/rows").awaitTermination()
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in frame.schema.fields])
    return frame.sparkSession.read.schema(schema).parquet(f"{out}/rows")


@query("""SELECT event_id, event_type, c_name AS customer FROM events
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey
WHERE event_type IS DISTINCT FROM 'error' AND value > 3""")
def stream_view(t: Tables) -> DataFrame:
    """A view with a filter and a left join over a stream of events."""
    live = I.stream_view({"events": _stream(t, "events"), "customer": t.customer}, {
        "from": "events",
        "join": [{"to": "customer", "on": {"left": "user_id", "right": "c_custkey"},
                  "where": {"c_acctbal": {"gt": 0}}, "as": "c",
                  "flatten": {"preserve_empty": True}}],
        "where": {"not": {"event_type": "error"}, "value": {"gt": 3}},
        "select": keep("event_id", "event_type", "c.c_name=customer"),
    })
    return _drain(live, t.scratch())


@query(LISTS_SQL.format(key="o_custkey", rows="SELECT o_custkey, o_orderkey AS id FROM orders"))
def stream_grouped(t: Tables) -> DataFrame:
    """Ordered lists over a stream of several batches; each writes its own items
    only, and parts are put together now and then."""
    out = t.scratch()
    t.orders.withColumn("third", F.col("o_custkey") % 3).write.partitionBy("third").parquet(f"{out}/in")
    stream = t.spark.readStream.schema(t.orders.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(f"{out}/in")
    view = {"from": "orders", "grouped": {"by": "o_custkey"}}
    K.keep_grouped(V.source(stream, ["o_orderkey"]), f"{out}/kept", {}, view, f"{out}/state", fan_in=3).awaitTermination()
    return list_ends(K.grouped_lists(K.grouped_items(t.spark, f"{out}/kept"), view), "o_custkey", "orders", "o_orderkey")


@query("""SELECT 'rich' AS view, count(*) AS n FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT 'rich_orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000""")
def incremental_refresh(t: Tables) -> DataFrame:
    """Customers changed: only the views downstream of them are rebuilt."""
    out = t.scratch()
    specs = {
        "rich_orders": {"from": "orders", "join": {
            "to": "rich", "on": {"left": "o_custkey", "right": "c_custkey"}, "as": "c", "flatten": True}},
        "rich": {"from": "customer", "where": {"c_acctbal": {"gt": 5000}}},
        "urgent": {"from": "orders", "where": {"o_orderpriority": {"startswith": "1"}}},
    }
    write = lambda name, frame: frame.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("view"), "n").write.mode("append").parquet(out)
    I.refresh({"orders": t.orders, "customer": t.customer}, specs, ["customer"], write)
    return t.spark.read.parquet(out)


@query("""SELECT 'rich' AS view, CAST(c_custkey AS BIGINT) AS key, c_name AS detail FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT 'rich_orders', o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000
UNION ALL SELECT 'urgent', o_orderkey, 'old' FROM orders WHERE o_orderpriority LIKE '1%'""")
def refreshed_rows(t: Tables) -> DataFrame:
    """The rows of all views after a change of the customers: two are rebuilt, the
    third is as it was written before."""
    out = t.scratch()
    specs = {
        "rich": {"from": "customer", "where": {"c_acctbal": {"gt": 5000}}},
        "rich_orders": {"from": "orders", "join": {
            "to": "rich", "on": {"left": "o_custkey", "right": "c_custkey"}, "as": "c", "flatten": True}},
        "urgent": {"from": "orders", "where": {"o_orderpriority": {"startswith": "1"}}},
    }
    detail = {"rich": ("c_custkey", "c_name"), "rich_orders": ("o_orderkey", "c.c_name")}

    def write(state: str):
        def put(name: str, frame: DataFrame) -> None:
            key, text = detail.get(name, ("o_orderkey", None))
            shown = F.lit(state) if text is None else F.col(text)
            frame.select(F.lit(name).alias("view"), F.col(key).cast("bigint").alias("key"), shown.alias("detail")).write.mode(
                "overwrite").parquet(f"{out}/view={name}")
        return put

    earlier = t.customer.withColumn("c_acctbal", -F.col("c_acctbal"))
    I.refresh({"orders": t.orders, "customer": earlier}, specs, ["customer", "orders"], write("old"))
    I.refresh({"orders": t.orders, "customer": t.customer}, specs, ["customer"], write("new"))
    return t.spark.read.parquet(*[f"{out}/view={n}" for n in specs])


TREE = record(people={"type": "object", "additionalProperties": record(name=STRING, nation=INTEGER)},
              about=record(last=STRING, count=INTEGER))


def _odd_tree(t: Tables) -> str:
    """Customers by segment as record files, one of them broken; a single record
    in two of them; prose and other files, empty ones and ones named with _."""
    entry = F.struct(F.col("c_custkey").cast("string").alias("k"),
                     F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("v"))
    part = F.floor(F.col("c_custkey") / FILE_ROWS).cast("string")
    rows = t.customer.groupBy(F.concat("c_mktsegment", part).alias("file")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("people"))
    records = rows.select(
        F.concat(F.lit("in/"), "file", F.lit(".json")).alias("page_path"), F.to_json(F.struct("people")).alias("body"))
    number = t.region.select(
        F.concat(F.lit("in/about"), "r_regionkey", F.lit(".json")).alias("page_path"),
        F.concat(F.lit('{"about":{"last":"'), "r_name", F.lit('","count":'), "r_regionkey", F.lit("}}")).alias("body"))
    broken = t.nation.select(F.concat(F.lit("in/broken"), "n_nationkey", F.lit(".json")).alias("page_path"),
                             F.lit('{"people":{').alias("body"))
    prose = t.documents.select(
        F.concat(F.lit("_drafts/"), "lang", F.lit("/d"), "doc_id", F.lit(".MD")).alias("page_path"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("body"))
    blobs = t.supplier.select(F.concat(F.lit("files/_s"), "s_suppkey", F.lit(".png")).alias("page_path"),
                              F.lit("").alias("body"))
    every = records.union(number).union(broken).union(prose).union(blobs)
    root = f"{t.scratch()}/tree"
    sinks.write_page_files(every.select(F.lit("all").alias("edition"), "page_path", F.lit(0).alias("part"), "body"), root)
    return f"{root}/all"


@query("""SELECT 'people' AS name, count(*) AS n, sum(c_custkey) AS total FROM customer
UNION ALL SELECT 'about', 1, max(r_regionkey) FROM region
UNION ALL SELECT 'findings', count(*), 0 FROM nation""")
def stream_of_odd_files(t: Tables) -> DataFrame:
    """Files taken in over several batches: a broken one is a finding and costs
    no row of another, and a single record is merged over all batches."""
    root, out = _odd_tree(t), t.scratch()
    files = I.stream_record_files(t.spark, f"{root}/in", max_files=40)
    tables = {n: f"{out}/{n}" for n in ("people", "about")}
    I.ingest(files, TREE, tables, f"{out}/state", f"{out}/findings").awaitTermination()
    count = lambda frame, name, total: frame.agg(
        F.count(F.lit(1)).alias("n"), total.cast("bigint").alias("total")).select(F.lit(name).alias("name"), "n", "total")
    return count(t.spark.read.parquet(tables["people"]), "people", F.sum(F.col("id").cast("bigint"))).union(
        count(t.spark.read.parquet(tables["about"]), "about", F.max("count"))).union(
        count(t.spark.read.parquet(f"{out}/findings"), "findings", F.lit(0)))


@query("""SELECT 'prose' AS kind, '_drafts/' || lang || '/d' || doc_id AS id, 'text/markdown' AS mime_type,
  md5(CASE WHEN doc_id % 5 = 0 THEN '' ELSE nfc_normalize(text) END) AS body FROM documents
UNION ALL SELECT 'blob', 'files/_s' || s_suppkey || '.png', 'image/png', NULL FROM supplier""")
def prose_and_blob_scan(t: Tables) -> DataFrame:
    """Prose and other files, with empty ones and names that start with _."""
    root = _odd_tree(t)
    prose = read_prose(t.spark, root).select(
        F.lit("prose").alias("kind"), "id", "mime_type", F.md5("content").alias("body"))
    blobs = read_blobs(t.spark, root).select(
        F.lit("blob").alias("kind"), "id", "mime_type", F.lit(None).cast("string").alias("body"))
    return prose.union(blobs)


@query("""SELECT 'd' || doc_id || '.bin' AS path, doc_id % 3 = 0 AS damaged,
  md5(CASE WHEN doc_id % 3 = 0 THEN chr(65533) || source ELSE source END) AS body FROM documents""")
def invalid_bytes(t: Tables) -> DataFrame:
    """A byte that is no UTF-8 is a finding; the rest of its text stays."""
    bytes_ = F.encode("source", "UTF-8")
    files = t.documents.select(
        F.concat(F.lit("d"), "doc_id", F.lit(".bin")).alias("path"), F.array(F.lit("d")).alias("parts"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FF")), bytes_)).otherwise(bytes_).alias("content"))
    bad = prose_problems(files).select("path", F.lit(True).alias("bad"))
    rows = prose_rows(files).select(F.concat("id", F.lit(".bin")).alias("path"), F.md5("content").alias("body"))
    return rows.join(bad, "path", "left").select("path", F.coalesce("bad", F.lit(False)).alias("damaged"), "body")


@query("""SELECT 'p' || p_partkey || '.txt' AS path, md5(p_name || CASE WHEN p_partkey % 4 = 1 THEN '!' ELSE '' END) AS body
FROM part WHERE p_partkey % 4 <> 0""")
def mirrored_files(t: Tables) -> DataFrame:
    """A mirror brought up to date: a fourth of the files deleted, a fourth changed,
    a fourth new."""
    def put(rule: str, out: str) -> None:
        body = F.expr(f"concat(p_name, if({'p_partkey % 4 = 1' if out == 'after' else 'false'}, '!', ''))")
        rows = t.part.filter(rule).select(
            F.lit(out).alias("edition"), F.concat(F.lit("p"), "p_partkey", F.lit(".txt")).alias("page_path"),
            F.lit(0).alias("part"), body.alias("body"))
        sinks.write_page_files(rows, f"{root}/{out}")

    root = t.scratch()
    put("p_partkey % 4 <> 2", "before")
    put("p_partkey % 4 <> 0", "after")
    old, new, mirror = f"{root}/before/before", f"{root}/after/after", f"{root}/mirror"
    states = [sinks.stored(scan_tree(t.spark, d, content=True).select(
        "path", "size", F.md5("content").alias("hash")), f"{root}/{n}") for n, d in (("s0", old), ("s1", new))]
    nothing = states[0].limit(0)
    sinks.copy_files(I.changes(nothing, states[0], compare=["hash"], carry=["size"]), old, mirror)
    sinks.copy_files(I.changes(states[0], states[1], compare=["hash"], carry=["size"]), new, mirror)
    return scan_tree(t.spark, mirror, content=True).select("path", F.md5("content").alias("body"))


# ── A tree kept up with its files ────────────────────────────────────

#: Orders per file, so the number of files grows with the table.
ORDER_ROWS = 5000

SHOP = record(
    customers={"type": "array", "items": record(id=INTEGER, name=STRING, balance=NUMBER)},
    orders={"type": "array", "items": record(
        id=INTEGER, customer={"type": "integer", "x-ref": {"entity": "customers"}}, status=STRING)})


def _put(t: Tables, root: str, name: str, rows: DataFrame, per_file: int, item: dict) -> None:
    """Rows with an ``id`` as record files below ``root/name``; what was there goes."""
    entries = rows.select(F.floor(F.col("id") / per_file).alias("file"), F.struct("id", *item).alias("e"))
    body = F.to_json(F.struct(F.sort_array(F.collect_list("e")).alias(name.split("-")[0])))
    files = entries.groupBy("file").agg(body.alias("body"))
    sinks.write_page_files(files.select(
        F.lit(name).alias("edition"), F.lit(0).alias("part"), "body",
        F.concat(F.lit("f"), F.col("file").cast("string"), F.lit(".json")).alias("page_path")), f"{root}/{name}")


def _three_runs(t: Tables) -> TrackedTree:
    """Customers in four folders and orders in one, taken in three times: as they
    are; with one folder edited; with one deleted and one new."""
    root = f"{t.scratch()}/tree"
    tree = TrackedTree(t.spark, root, SHOP, f"{t.scratch()}/kept")
    customer = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    fields = ["name", "balance"]
    for k in range(3):
        _put(t, root, f"customers-{k}", customer.filter(F.col("id") % 4 == k), FILE_ROWS, fields)
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"),
                             F.col("o_orderstatus").alias("status"))
    _put(t, root, "orders-0", orders, ORDER_ROWS, ["customer", "status"])
    tree.sync()
    raised = customer.filter("id % 4 = 1").withColumn("balance", F.col("balance") + 1).withColumn(
        "name", F.concat("name", F.lit("!")))
    _put(t, root, "customers-1", raised, FILE_ROWS, fields)
    tree.sync()
    _put(t, root, "customers-2", customer.filter("false"), FILE_ROWS, fields)
    _put(t, root, "customers-3", customer.filter("id % 4 = 3"), FILE_ROWS, fields)
    tree.sync()
    return tree


@query("""SELECT 'customer' AS kind, CAST(c_custkey AS BIGINT) AS id, c_name || CASE WHEN c_custkey % 4 = 1 THEN '!' ELSE '' END
  AS name, c_acctbal + CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS balance FROM customer WHERE c_custkey % 4 <> 2
UNION ALL SELECT 'order', o_orderkey, o_orderstatus, NULL FROM orders""")
def tracked_tree(t: Tables) -> DataFrame:
    """Files added, edited and deleted over three runs; only what differs is read."""
    frames = _three_runs(t).entities()
    return frames["customers"].select(F.lit("customer").alias("kind"), "id", "name", "balance").union(
        frames["orders"].select(F.lit("order"), "id", "status", F.lit(None).cast("double")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record, 'orders.customer' AS field, CAST(o_custkey AS VARCHAR) AS value
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 2)""")
def tracked_references(t: Tables) -> DataFrame:
    """Dangling references after the same runs: found when the ids went, dropped
    when they came, with the orders read once."""
    return _three_runs(t).dangling().select("record", "field", "value")


@query("""SELECT 'record' AS kind, CAST(c_custkey AS VARCHAR) AS id, md5(c_name) AS body FROM customer
UNION ALL SELECT 'prose', lang || '/d' || doc_id, md5(nfc_normalize(text)) FROM documents
UNION ALL SELECT 'blob', 'files/s' || s_suppkey || '.png', NULL FROM supplier""")
def tree_stream(t: Tables) -> DataFrame:
    """One stream over a tree of JSON, YAML, Markdown and other files."""
    root = f"{t.scratch()}/tree"
    line = F.concat(F.lit("- {id: "), F.col("c_custkey").cast("string"), F.lit(', name: "'), "c_name", F.lit('"}'))
    rows = t.customer.select(F.floor(F.col("c_custkey") / FILE_ROWS).alias("file"), line.alias("line"),
                             F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("e"))
    files = rows.groupBy("file").agg(F.collect_list("line").alias("lines"), F.collect_list("e").alias("customers"))
    yaml = F.col("file") % 2 == 0
    records = files.select(
        F.concat(F.lit("c"), F.col("file").cast("string"), F.when(yaml, ".yml").otherwise(".json")).alias("page_path"),
        F.when(yaml, F.concat(F.lit("customers:\n"), F.array_join("lines", "\n"))).otherwise(
            F.to_json(F.struct("customers"))).alias("body"))
    prose = t.documents.select(F.concat("lang", F.lit("/d"), "doc_id", F.lit(".md")).alias("page_path"),
                               F.coalesce("text", F.lit("")).alias("body"))
    blobs = t.supplier.select(F.concat(F.lit("files/s"), "s_suppkey", F.lit(".png")).alias("page_path"),
                              F.col("s_name").alias("body"))
    every = records.union(prose).union(blobs).select(F.lit("all").alias("edition"), F.lit(0).alias("part"), "page_path", "body")
    sinks.write_page_files(every, root)
    count = every.count()
    tree = TrackedTree(t.spark, f"{root}/all", SHOP, f"{t.scratch()}/kept")
    tree.stream(f"{t.scratch()}/state", max_files=count // 3 + 1).awaitTermination()
    frames = tree.entities()
    row = lambda kind, frame, body: frame.select(F.lit(kind).alias("kind"), F.col("id").cast("string"), body.alias("body"))
    return row("record", frames["customers"], F.md5("name")).union(
        row("prose", frames["prose"], F.md5("content"))).union(row("blob", frames["blob"], F.lit(None).cast("string")))
