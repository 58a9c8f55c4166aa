"""View clauses on the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import views as V
from recordloom.operators.groups import counted, repeated
from recordloom.plans.bundle import run_views
from recordloom.queries.registry import Tables, query


def view(sources, spec, **options) -> DataFrame:
    return run_views(sources, {"view": spec}, **options)["view"]


def keep(*names: str) -> list[dict[str, str]]:
    """Select items; ``path=name`` renames."""
    pairs = [n.split("=") for n in names]
    return [{"item": p[0], "as": p[-1]} for p in pairs]


# ── where ────────────────────────────────────────────────────────────


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_totalprice > 50000 AND o_totalprice <= 400000 AND o_custkey >= 10 AND o_custkey < 50000""")
def where_bundle(t: Tables) -> DataFrame:
    return view({"orders": t.orders}, {
        "from": "orders",
        "where": {"o_totalprice": {"gt": 50000, "lte": 400000},
                  "o_custkey": {"gte": 9.5, "lt": 50000}},
        "select": keep("o_orderkey", "o_custkey", "o_totalprice"),
    })


@query("""SELECT p_partkey, p_name, p_brand FROM part
WHERE starts_with(p_name, 'small') OR ends_with(p_name, 'ring') OR contains(p_brand, '#2')""")
def where_strings(t: Tables) -> DataFrame:
    return view({"part": t.part}, {
        "from": "part",
        "where": {"or": [{"p_name": {"startswith": "small"}}, {"p_name": {"endswith": "ring"}},
                         {"p_brand": {"contains": "#2"}}]},
        "select": keep("p_partkey", "p_name", "p_brand"),
    })


@query("""SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders
WHERE nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F'
  AND NOT (o_totalprice > 100000 AND nullif(o_orderstatus, 'O') IS NOT NULL)""")
def where_not_missing(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("status", F.nullif("o_orderstatus", F.lit("O")))
    return view({"rows": rows}, {
        "from": "rows",
        "where": {"not": {"or": [
            {"status": "F"}, {"o_totalprice": {"gt": 100000}, "status": {"exists": True}}]}},
        "select": keep("o_orderkey", "status"),
    })


@query("""SELECT c_custkey, c_name FROM customer
WHERE nullif(c_mktsegment, 'BUILDING') IS NULL OR NOT (c_acctbal > 100)""")
def where_exists(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return view({"rows": rows}, {
        "from": "rows",
        "where": {"or": [{"segment": {"exists": False}}, {"not": {"c_acctbal": {"gt": 100}}}]},
        "select": keep("c_custkey", "c_name"),
    })


@query("SELECT c_custkey, c_name FROM customer")
def where_type_gate(t: Tables) -> DataFrame:
    """Tests across kinds never match, so only the negated one keeps rows."""
    return view({"customer": t.customer}, {
        "from": "customer",
        "where": {"or": [{"c_name": {"gt": 5}}, {"c_custkey": "1"}, {"c_acctbal": True},
                         {"not": {"c_custkey": "1"}}]},
        "select": keep("c_custkey", "c_name"),
    })


@query("""SELECT doc_id, meta.lang AS lang, meta.size.n AS n FROM (
  SELECT doc_id, {'lang': lang, 'size': {'n': n_chars}} AS meta FROM documents)
WHERE meta.lang = 'en' AND meta.size.n >= 200""")
def where_dotted_path(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.struct(
        "lang", F.struct(F.col("n_chars").alias("n")).alias("size")).alias("meta"))
    return view({"rows": rows}, {
        "from": "rows",
        "where": {"meta.lang": "en", "meta.size.n": {"gte": 200}},
        "select": keep("doc_id", "meta.lang=lang", "meta.size.n=n"),
    })


# ── select, sort ─────────────────────────────────────────────────────


@query("""SELECT p_partkey AS id, p_name AS label, p_size, p_brand AS twice FROM part""")
def select_rename(t: Tables) -> DataFrame:
    return view({"part": t.part}, {
        "from": "part",
        "select": keep("p_partkey=id", "p_name=label", "p_size", "p_type=twice", "p_brand=twice"),
    })


@query("SELECT * FROM supplier")
def pass_through(t: Tables) -> DataFrame:
    return view({"supplier": t.supplier}, {"from": "supplier", "select": []})


def _sorted(t: Tables, direction: str, missing: str) -> DataFrame:
    rows = t.events.withColumn("value", F.nullif("value", F.floor("value").cast("double")))
    return view({"events": V.source(rows, ["event_id"])}, {
        "from": "events",
        "select": keep("event_id", "value"),
        "sort": {"by": "value", "direction": direction, "missing": missing},
    })


_SORTED = """SELECT event_id, nullif(value, floor(value)) AS value FROM events
ORDER BY 2 {} NULLS {}, event_id"""


@query(_SORTED.format("ASC", "LAST"))
def sort_asc_missing_last(t: Tables) -> DataFrame:
    return _sorted(t, "asc", "last")


@query(_SORTED.format("ASC", "FIRST"))
def sort_asc_missing_first(t: Tables) -> DataFrame:
    return _sorted(t, "asc", "first")


@query(_SORTED.format("DESC", "LAST"))
def sort_desc_missing_last(t: Tables) -> DataFrame:
    return _sorted(t, "desc", "last")


@query(_SORTED.format("DESC", "FIRST"))
def sort_desc_missing_first(t: Tables) -> DataFrame:
    return _sorted(t, "desc", "first")


# ── flatten ──────────────────────────────────────────────────────────


@query("SELECT vec_id, label, unnest(embedding) AS x FROM embeddings")
def flatten_vectors(t: Tables) -> DataFrame:
    return view({"embeddings": t.embeddings}, {
        "from": "embeddings",
        "flatten": [{"of": "embedding", "as": "x"}],
        "select": keep("vec_id", "label", "x"),
    })


@query("""SELECT doc_id, number FROM documents
LEFT JOIN LATERAL (SELECT unnest(regexp_extract_all(text, '[0-9]{4,}')) AS number) ON true""")
def flatten_keep_empty(t: Tables) -> DataFrame:
    rows = t.documents.select(
        "doc_id", F.regexp_extract_all("text", F.lit("([0-9]{4,})"), 1).alias("numbers"))
    return view({"rows": rows}, {
        "from": "rows",
        "flatten": [{"of": "numbers", "as": "number", "preserve_empty": True}],
    })


@query("""SELECT conv_id, turn, w AS word FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l FROM conversations),
  LATERAL (SELECT unnest(string_split(l, ' ')) AS w)""")
def flatten_chain(t: Tables) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    rows = t.conversations.select("conv_id", "turn", lines.alias("lines"))
    return view({"rows": rows}, {
        "from": "rows",
        "flatten": [{"of": "lines", "as": "line"}, {"of": "line", "as": "word"}],
    })


# ── join ─────────────────────────────────────────────────────────────


def _people(t: Tables):
    return {"customer": t.customer, "orders": t.orders, "nation": t.nation,
            "lineitem": t.lineitem, "supplier": t.supplier}


ORDERS_OF = {"to": "orders", "on": {"left": "c_custkey", "right": "o_custkey"}}


@query("""SELECT c_custkey, c_name, o_orderkey AS orderkey, o_totalprice AS price
FROM customer JOIN orders ON c_custkey = o_custkey""")
def join_inner(t: Tables) -> DataFrame:
    return view(_people(t), {
        "from": "customer",
        "join": [{**ORDERS_OF, "flatten": {"as": "o"}}],
        "select": keep("c_custkey", "c_name", "o.o_orderkey=orderkey", "o.o_totalprice=price"),
    })


@query("""SELECT c_custkey, o_orderkey AS orderkey, o_totalprice AS price
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) ON c_custkey = o_custkey""")
def prejoin_where(t: Tables) -> DataFrame:
    return view(_people(t), {
        "from": "customer",
        "join": [{**ORDERS_OF, "where": {"o_totalprice": {"gt": 480000}},
                  "flatten": {"as": "o", "preserve_empty": True}}],
        "select": keep("c_custkey", "o.o_orderkey=orderkey", "o.o_totalprice=price"),
    })


@query("""SELECT c_custkey, o_orderkey AS orderkey, o_orderstatus AS status
FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def join_left(t: Tables) -> DataFrame:
    return view(_people(t), {
        "from": "customer",
        "join": [{**ORDERS_OF, "flatten": {"as": "o", "preserve_empty": True}}],
        "select": keep("c_custkey", "o.o_orderkey=orderkey", "o.o_orderstatus=status"),
    })


@query("""SELECT c_custkey, o_orderkey AS orderkey FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' AND o_totalprice >= 200000""")
def postjoin_where(t: Tables) -> DataFrame:
    return view(_people(t), {
        "from": "customer",
        "join": [{**ORDERS_OF, "flatten": {"as": "o", "preserve_empty": True}}],
        "where": {"o.o_orderstatus": "F", "o.o_totalprice": {"gte": 200000}},
        "select": keep("c_custkey", "o.o_orderkey=orderkey"),
    })


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice AS price, c_name AS customer, n_name AS nation
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE l_extendedprice > 50000""")
def multi_join(t: Tables) -> DataFrame:
    """Each join's key may come from the row an earlier join brought in."""
    return view(_people(t), {
        "from": "lineitem",
        "join": [
            {"to": "orders", "on": {"left": "l_orderkey", "right": "o_orderkey"},
             "flatten": {"as": "o"}},
            {"to": "customer", "on": {"left": "o.o_custkey", "right": "c_custkey"},
             "flatten": {"as": "c"}},
            {"to": "nation", "on": {"left": "c.c_nationkey", "right": "n_nationkey"},
             "flatten": {"as": "n"}},
        ],
        "where": {"l_extendedprice": {"gt": 50000}},
        "select": keep("l_orderkey", "l_linenumber", "l_extendedprice=price", "c.c_name=customer",
                       "n.n_name=nation"),
    })


def list_ends(frame: DataFrame, key: str, items: str, item: str) -> DataFrame:
    """A nested list in a flat form two engines can compare."""
    ids = F.transform(items, lambda x: x[item])
    return frame.select(
        key, F.size(items).cast("bigint").alias("n"),
        F.get(ids, F.lit(0)).alias("first_id"), F.get(ids, F.size(ids) - 1).alias("last_id"),
        F.array_join(ids.cast("array<string>"), ",").alias("ids"),
    )


# One list per key, in the order of the item id.
LISTS_SQL = """SELECT {key}, count(id) AS n, min(id) AS first_id, max(id) AS last_id,
  coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') AS ids FROM ({rows}) GROUP BY {key}"""


@query(LISTS_SQL.format(key="n_nationkey", rows="""
  SELECT n_nationkey, s_suppkey AS id FROM nation
  LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey"""))
def nest_attach(t: Tables) -> DataFrame:
    out = view({"nation": t.nation, "supplier": V.source(t.supplier, ["s_suppkey"])}, {
        "from": "nation",
        "join": [{"to": "supplier", "on": {"left": "n_nationkey", "right": "s_nationkey"},
                  "where": {"s_acctbal": {"gt": 5000}}, "as": "suppliers"}],
    })
    return list_ends(out, "n_nationkey", "suppliers", "s_suppkey")


@query(LISTS_SQL.format(key="c_custkey", rows="""
  SELECT c_custkey, o_orderkey AS id FROM customer LEFT JOIN orders ON c_custkey = o_custkey"""))
def nest_attach_orders(t: Tables) -> DataFrame:
    sources = {"customer": t.customer, "orders": V.source(t.orders, ["o_orderkey"])}
    out = view(sources, {"from": "customer", "join": [ORDERS_OF]})
    return list_ends(out, "c_custkey", "orders", "o_orderkey")


# ── grouped ──────────────────────────────────────────────────────────


@query("""SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles
FROM conversations GROUP BY conv_id""")
def grouped_turns(t: Tables) -> DataFrame:
    out = view({"conversations": V.source(t.conversations, ["turn"])},
               {"from": "conversations", "grouped": {"by": "conv_id", "as": "turns"}})
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n"),
                      F.array_join(F.transform("turns", lambda x: x["role"]), ",").alias("roles"))


@query(LISTS_SQL.format(key="event_type",
                      rows="SELECT event_type, event_id AS id FROM events"))
def grouped_hot_keys(t: Tables) -> DataFrame:
    """A handful of values hold all rows."""
    out = view({"events": V.source(t.events, ["event_id"])},
               {"from": "events", "grouped": {"by": "event_type"}})
    return list_ends(out, "event_type", "events", "event_id")


@query("""SELECT kind, count(*) AS n FROM (SELECT {'kind': event_type} AS e FROM events), LATERAL (SELECT e.kind AS kind) GROUP BY kind""")
def grouped_dotted_key(t: Tables) -> DataFrame:
    """The group column is literally named ``e.kind``."""
    rows = t.events.select("event_id", "value", F.struct(F.col("event_type").alias("kind")).alias("e"))
    out = view({"rows": V.source(rows, ["event_id"])}, {
        "from": "rows", "grouped": {"by": "e.kind"},
        "select": keep("e.kind=kind", "rows"),
    })
    return out.groupBy("kind").agg(F.sum(F.size("rows")).alias("n"))


# ── views over views ─────────────────────────────────────────────────


@query("""SELECT c_name AS name, c_mktsegment AS segment_name, count(*) AS n,
  min(o_orderkey) AS first_order, max(o_orderkey) AS last_order
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'O' AND c_acctbal >= 0 GROUP BY c_custkey, c_name, c_mktsegment""")
def view_on_view(t: Tables) -> DataFrame:
    views = run_views(
        {"customer": t.customer, "orders": V.source(t.orders, ["o_orderkey"])},
        {
            "with_names": {
                "from": "by_customer",
                "join": {"to": "rich", "on": {"left": "o_custkey", "right": "c_custkey"},
                         "as": "c", "flatten": True},
                "select": keep("c.c_name=name", "c.c_mktsegment=segment_name", "open_orders"),
            },
            "by_customer": {"from": "open_orders", "grouped": {"by": "o_custkey"}},
            "open_orders": {"from": "orders", "where": {"o_orderstatus": "O"}},
            "rich": {"from": "customer", "where": {"c_acctbal": {"gte": 0}}},
        },
    )
    ids = F.transform("open_orders", lambda o: o["o_orderkey"])
    return views["with_names"].select(
        "name", "segment_name", F.size(ids).cast("bigint").alias("n"),
        F.get(ids, F.lit(0)).alias("first_order"), F.get(ids, F.size(ids) - 1).alias("last_order"))


@query("""SELECT conv_id, turn, role FROM conversations""")
def regroup_and_flatten(t: Tables) -> DataFrame:
    """Lists built by one view are unwound by the next."""
    return run_views(
        {"conversations": V.source(t.conversations, ["turn"])},
        {
            "talks": {"from": "conversations", "grouped": {"by": "conv_id", "as": "turns"}},
            "turns": {"from": "talks", "flatten": [{"of": "turns", "as": "x"}],
                      "select": keep("conv_id", "x.turn=turn", "x.role=role")},
        },
    )["turns"]


@query("""SELECT o_orderstatus AS status, o_orderpriority AS priority, n, orderkey FROM orders
JOIN (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY k) ON o_orderstatus = k
JOIN (SELECT o_orderstatus AS k2, o_orderkey AS orderkey FROM orders WHERE o_totalprice > 400000)
  ON o_orderstatus = k2 AND o_orderkey % 1000 = orderkey % 1000""")
def join_grouped_hot_keys(t: Tables) -> DataFrame:
    """A view joins the counts of a grouped view whose keys hold very many rows
    each, and another that keeps the items of its lists as rows; no list is built.
    Orders that give the same rows are joined as one and repeated in the end, so
    only the result grows with the pairs."""
    # Null where either part is, as the SQL then pairs nothing.
    place = F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit(" "), "o_orderstatus")
    orders = V.source(t.orders.withColumn("place", place), ["o_orderkey"])
    items = view({"orders": orders}, {"from": "orders", "where": {"o_orderstatus": {"exists": True}},
                                      "grouped": {"by": "o_orderstatus", "as": "item", "flat": True}})
    sizes = items.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    alike = counted(orders, ["o_orderstatus", "o_orderpriority", "place"], "times")
    out = run_views({"orders": orders, "alike": alike, "sizes": sizes}, {
        "big": {"from": "orders", "where": {"o_totalprice": {"gt": 400000}, "place": {"exists": True}},
                "grouped": {"by": "place", "as": "item", "flat": True}},
        "joined": {"from": "alike", "join": [
            {"to": "sizes", "on": {"left": "o_orderstatus", "right": "o_orderstatus"}, "as": "s", "flatten": True},
            {"to": "big", "on": {"left": "place", "right": "place"}, "as": "b", "flatten": True}]},
    })["joined"]
    return repeated(out.select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("s.n").alias("n"), F.col("b.item.o_orderkey").alias("orderkey"), "times"), "times")
