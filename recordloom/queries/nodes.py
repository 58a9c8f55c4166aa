"""Addresses, pages and links on the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.operators import nodes as N
from recordloom.operators import views as V
from recordloom.queries.registry import Tables, query
from recordloom.sources.tree import mime_type


def places(t: Tables) -> dict[str, DataFrame]:
    """Regions holding their nations, and customers."""
    nations = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                              F.col("n_regionkey").alias("up"))
    regions = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"))
    regions = V.finish(V.attach(regions, V.source(nations, ["id"]), ("id", "up"), "nations"))
    customers = t.customer.select(
        F.col("c_name").alias("id"), F.struct("c_nationkey", "c_acctbal").alias("account"))
    return {"regions": regions, "customers": customers}


# The address table of the above.
_NODES = """
SELECT '/' AS address, NULL AS parent, '' AS segment, '.item' AS type, '/' AS label
UNION ALL SELECT '/regions', '/', 'regions', 'regions.item[]', '/regions'
UNION ALL SELECT '/customers', '/', 'customers', 'customers.item[]', '/customers'
UNION ALL SELECT '/regions/' || r_regionkey, '/regions', CAST(r_regionkey AS VARCHAR), 'regions.item', r_name FROM region
UNION ALL SELECT '/regions/' || r_regionkey || '/nations', '/regions/' || r_regionkey, 'nations',
  'regions.item.nations.item[]', '/regions/' || r_regionkey || '/nations' FROM region
UNION ALL SELECT '/regions/' || n_regionkey || '/nations/' || n_nationkey, '/regions/' || n_regionkey || '/nations',
  CAST(n_nationkey AS VARCHAR), 'regions.item.nations.item', n_name FROM nation
UNION ALL SELECT '/customers/' || replace(c_name, '#', '%23'), '/customers', c_name, 'customers.item', c_name FROM customer
UNION ALL SELECT '/customers/' || replace(c_name, '#', '%23') || '/account', '/customers/' || replace(c_name, '#', '%23'),
  'account', 'customers.item.account', '/customers/' || replace(c_name, '#', '%23') || '/account' FROM customer"""


@query(_NODES)
def node_index(t: Tables) -> DataFrame:
    return N.node_index(places(t)).select("address", "parent", "segment", "type", "label")


@query("""SELECT page_id, '/pages/' || url_encode(url) AS address FROM pages""")
def address_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", N.address_of(F.lit("pages"), F.col("url")).alias("address"))


EDITIONS = {"web": ["regions.item", "customers.item", "regions.item.nations.item"], "book": ["regions.item"],
            "sheet": []}


@query(f"""SELECT edition, address, CASE
    WHEN edition = 'sheet' THEN 'index.md'
    WHEN starts_with(address, '/customers/') THEN CASE WHEN edition = 'book' THEN 'index.md'
      ELSE substr(regexp_replace(address, '/account$', ''), 2) || '.md' END
    WHEN starts_with(address, '/regions/') THEN CASE
      WHEN edition = 'web' AND type = 'regions.item.nations.item' THEN substr(address, 2) || '.md'
      ELSE regexp_extract(address, '^/(regions/[^/]*)', 1) || '.md' END
    ELSE 'index.md' END AS page_path
FROM ({_NODES}), (SELECT unnest(['web', 'book', 'sheet']) AS edition)""")
def page_assign(t: Tables) -> DataFrame:
    pages = N.assign_pages(N.node_index(places(t)), EDITIONS)
    return pages.select("edition", "address", "page_path")


@query("""SELECT 'web' AS edition, 'lines/' || l_orderkey || '-' || l_linenumber || '.md' AS page_path,
  count(*) AS claims FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def page_collision(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    pages = N.assign_pages(N.node_index({"lines": rows}), {"web": ["lines.item"], "one": []})
    return N.page_collisions(pages)


@query("""SELECT l.doc_id, CASE WHEN l.toxic <> 1 THEN '/documents/' || l.doc_id END AS address,
  CASE WHEN l.toxic = 1 THEN 'none' WHEN d.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS state,
  CASE WHEN l.toxic = 1 THEN NULL ELSE coalesce(d.source, '/documents/' || l.doc_id) END AS label
FROM (SELECT * FROM labels) l
LEFT JOIN (SELECT * FROM documents WHERE lang <> 'fr') d ON l.doc_id = d.doc_id AND l.toxic <> 1""")
def missing_refs(t: Tables) -> DataFrame:
    """References looked up by address: found, missing, or never stated."""
    documents = t.documents.filter("lang <> 'fr'").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"))
    nodes = N.node_index({"documents": documents})
    wanted = F.when(F.col("toxic") != 1, F.col("doc_id"))
    out = N.resolve_refs(t.labels, N.address_of(F.lit("documents"), wanted), nodes)
    return out.select("doc_id", "address", "state", "label")


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN '/customers/' || o_custkey
  ELSE '/customers/' || c_custkey END AS child, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'ok' END AS state
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""")
def child_step(t: Tables) -> DataFrame:
    customers = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    nodes = N.node_index({"customers": customers})
    out = N.children(t.orders, F.lit("/customers"), F.col("o_custkey"), nodes)
    return out.select("o_orderkey", "child", "state")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_name END, CASE WHEN p_size > 5 THEN p_brand END,
  CAST(p_partkey AS VARCHAR)) AS label FROM part""")
def display_label(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).alias("title"),
        F.when(F.col("p_size") > 5, F.col("p_brand")).alias("name"), F.col("p_partkey").alias("id"))
    address = N.address_of(F.lit("part"), F.col("id"))
    return rows.select("p_partkey", N.label_of(rows, address).alias("label"))


@query("""SELECT c_custkey, '../regions/' || n_regionkey || '/nations/' || n_nationkey || '.md#/regions/'
  || n_regionkey || '/nations/' || n_nationkey AS there,
  '../../../customers/' || replace(c_name, '#', '%23') || '.md#/customers/' || replace(c_name, '#', '%23') AS back
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def page_links(t: Tables) -> DataFrame:
    """The link from each customer's page to its nation's page, and back."""
    pages = N.assign_pages(N.node_index(places(t)), {"web": EDITIONS["web"]})
    people = pages.filter("type = 'customers.item'").select(
        F.col("segment").alias("c_name"), F.col("page_path").alias("cp"), F.col("fragment").alias("cf"))
    nations = pages.filter("type = 'regions.item.nations.item'").select(
        F.col("segment").cast("int").alias("c_nationkey"), F.col("page_path").alias("np"),
        F.col("fragment").alias("nf"))
    rows = t.customer.join(people, "c_name").join(nations, "c_nationkey")
    return rows.select("c_custkey", N.href(F.col("cp"), F.col("np"), F.col("nf")).alias("there"),
                       N.href(F.col("np"), F.col("cp"), F.col("cf")).alias("back"))


@query(f"SELECT address, label FROM ({_NODES}) WHERE address = '/customers' OR starts_with(address, '/customers/')")
def subtree(t: Tables) -> DataFrame:
    nodes = N.node_index(places(t))
    below = nodes.filter(N.in_subtree(F.col("ancestors"), F.lit("/customers")))
    return below.select("address", "label")


@query("""SELECT turn AS id, role, '/talks/' || conv_id || '/turns/' || turn AS _address FROM conversations""")
def nested_entity_rows(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", F.col("turn").alias("id"), "role")
    talks = V.finish(V.grouped(V.source(turns, ["id"]), "conv_id", "turns"))
    talks = talks.select(F.col("conv_id").alias("id"), "turns")
    return N.entity_rows("talks", talks, ["turns"]).select("id", "role", "_address")


@query("""SELECT 0 AS part, '# suppliers' AS line
UNION ALL SELECT 1, '| id | name | nation.key | _anchor_path |' UNION ALL SELECT 2, '|---|---|---|---|'
UNION ALL SELECT 3, '| ' || s_suppkey || ' | ' || replace(s_name, '#', '\\#') || ' | ' || s_nationkey
  || ' | \\/suppliers\\/' || s_suppkey || ' |' FROM supplier""")
def record_table(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                             F.struct(F.col("s_nationkey").alias("key")).alias("nation"))
    return N.record_table("suppliers", rows).select("part", "line")


@query(r"""SELECT doc_id, md5(regexp_replace(text, '([!-/:-@\[-`{-~])', '\\\1', 'g')) AS escaped,
  md5(replace(regexp_replace(text, '([!-/:-@\[-`{-~])', '\\\1', 'g'), chr(10), '<br>')) AS cell,
  '[' || regexp_replace(source, '([!-/:-@\[-`{-~])', '\\\1', 'g') || '](/documents/' || doc_id || ')' AS link
FROM documents""")
def markdown_escapes(t: Tables) -> DataFrame:
    link = X.md_link(F.col("source"), N.address_of(F.lit("documents"), F.col("doc_id")))
    return t.documents.select(
        "doc_id", F.md5(X.md_escape(F.col("text"))).alias("escaped"),
        F.md5(X.md_cell(F.col("text"))).alias("cell"), link.alias("link"))


@query("""SELECT page_id, CASE WHEN ends_with(lower(url), '.html') OR ends_with(lower(url), '.htm') THEN 'text/html'
  WHEN ends_with(lower(url), '.png') THEN 'image/png' WHEN ends_with(lower(url), '.pdf') THEN 'application/pdf'
  ELSE 'application/octet-stream' END AS mime_type FROM pages""")
def media_types(t: Tables) -> DataFrame:
    """The media type of a page by its address."""
    return t.pages.select("page_id", mime_type(F.col("url")).alias("mime_type"))


@query("""SELECT '# parts of size ' || size AS line, 0 AS part FROM (SELECT 99 AS size)
UNION ALL SELECT '', 1 UNION ALL SELECT '*(no records)*', 2 WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 99)""")
def record_table_of_nothing(t: Tables) -> DataFrame:
    """The table of an entity without rows."""
    rows = t.part.filter("p_size > 99").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return N.record_table("parts of size 99", rows).select("part", "line")


@query(r"""SELECT doc_id,
  md5(CASE WHEN regexp_matches(plain, '[^\t-\r\x{85}\p{Z}]') THEN '`' || plain || '`' ELSE '` ' || plain || ' `' END) AS code,
  md5('```' || coalesce(lang, '') || chr(10) || plain || CASE WHEN ends_with(plain, chr(10)) THEN '' ELSE chr(10) END || '```')
    AS fence,
  coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, '') AS shown,
  'https://example.org/' || doc_id || '?q=%20%28' || lang || '%29' AS url,
  md5('a' || chr(10) || '  ' || source || chr(10) || chr(10) || 'b') AS dedented
FROM (SELECT *, replace(text, '`', '') AS plain FROM documents)""")
def markdown_fences(t: Tables) -> DataFrame:
    """Code spans, fences, addresses, absent values, and common indentation taken away."""
    plain = F.replace("text", F.lit("`"), F.lit(""))
    block = F.concat(F.lit("  a\n    "), "source", F.lit("\n \n  b"))
    url = F.concat(F.lit("https://example.org/"), "doc_id", F.lit("?q= ("), "lang", F.lit(")"))
    return t.documents.select(
        "doc_id", F.md5(X.md_code(plain)).alias("code"), F.md5(X.md_fence(plain, F.col("lang"))).alias("fence"),
        X.shown(F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("shown"), X.url_encode(url).alias("url"),
        F.md5(X.dedent(block)).alias("dedented"))
