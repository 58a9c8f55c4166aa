"""Prose jobs: the documents table as a Markdown corpus.

Each document gets a heading, its own whole text, a second heading and links to
its neighbour, to a picture and to itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import nodes as N
from recordloom.operators import prose as P
from recordloom.queries.registry import Tables, query
from recordloom.sources.sinks import publish_pages, published, stored


def corpus(t: Tables) -> DataFrame:
    number, after = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    picture = (F.col("doc_id") % 7).cast("string")
    content = F.concat(
        F.lit("# Doc "), number, F.lit("\n\n"), "text", F.lit("\n\n## Links *in* `"), "lang",
        F.lit("`\n\n[next](d"), after, F.lit(".md#doc) ![pic](../../img/"), picture,
        F.lit(".png) [own](#doc) [web](http://example.org/"), number, F.lit(")\n"))
    return t.documents.select(
        F.concat(F.lit("docs/"), "lang", F.lit("/d"), number).alias("id"),
        F.lit("text/markdown").alias("mime_type"), content.alias("content"))


_DOCS = """(SELECT 'docs/' || lang || '/d' || doc_id AS id, doc_id, lang, text,
  '# Doc ' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Links *in* `' || lang || '`'
  AS opening FROM documents)"""


def pictures(t: Tables) -> DataFrame:
    """Picture files for four of the seven numbers in use."""
    kept = t.nation.filter("n_nationkey < 4").select(
        F.concat(F.lit("img/"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("id"))
    return kept.withColumn("mime_type", F.lit("image/png"))


# ── Headings ─────────────────────────────────────────────────────────


@query(f"""SELECT id, 0 AS ord, CAST(1 AS BIGINT) AS level, 'Doc ' || doc_id AS title, 'doc-' || doc_id AS slug FROM {_DOCS}
UNION ALL SELECT id, 1, 2, 'Links *in* `' || lang || '`', 'links-in-' || lang FROM {_DOCS}""")
def headings(t: Tables) -> DataFrame:
    return P.heading_table(corpus(t))


@query(f"SELECT id, 'Doc ' || doc_id AS title FROM {_DOCS}")
def document_titles(t: Tables) -> DataFrame:
    return P.title_table(P.heading_table(corpus(t)))


@query("""SELECT url, regexp_replace(url, '(^|/)index$', '\\1') AS order_key,
  len(string_split(url, '/')) + CASE WHEN regexp_matches(url, '(^|/)index$') THEN 0 ELSE 1 END AS depth
FROM (SELECT CASE WHEN page_id % 5 = 0 THEN url || '/index' ELSE url END AS url FROM pages)""")
def outline_order(t: Tables) -> DataFrame:
    url = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/index"))).otherwise(F.col("url"))
    rows = t.pages.select(url.alias("url"))
    return rows.select("url", P.order_key(F.col("url")).alias("order_key"),
                       P.depth(F.col("url")).alias("depth"))


# ── Links ────────────────────────────────────────────────────────────


_LINKS = f"""(SELECT id, doc_id, lang, unnest([
  {{'ord': 0, 'dest': 'd' || (doc_id + 1) || '.md#doc', 'kind': 'link'}},
  {{'ord': 1, 'dest': '../../img/' || (doc_id % 7) || '.png', 'kind': 'image'}},
  {{'ord': 2, 'dest': '#doc', 'kind': 'link'}},
  {{'ord': 3, 'dest': 'http://example.org/' || doc_id, 'kind': 'link'}}]) AS l FROM {_DOCS})"""


@query(f"SELECT id, l.ord AS ord, l.dest AS dest, l.kind AS kind FROM {_LINKS}")
def link_graph(t: Tables) -> DataFrame:
    return P.link_table(corpus(t))


@query(f"""SELECT id, ord, CASE ord WHEN 0 THEN 'node:/prose/docs/' || lang || '/d' || (doc_id + 1) || '#doc'
  WHEN 1 THEN 'node:/blob/img/' || (doc_id % 7) || '.png' ELSE dest END AS target
FROM (SELECT id, doc_id, lang, l.ord AS ord, l.dest AS dest FROM {_LINKS})""")
def link_targets(t: Tables) -> DataFrame:
    links = P.link_table(corpus(t))
    return links.select("id", "ord", P.link_target(F.col("id"), F.col("dest")).alias("target"))


def _nodes(t: Tables, docs: DataFrame) -> DataFrame:
    """The address table, from ids and headings alone, worked out once."""
    found = F.col("headings") if "headings" in docs.columns else P.heading_array(F.col("content"))
    heads = docs.select("id", "mime_type", found.alias("headings"))
    return stored(N.node_index({"prose": heads, "blob": pictures(t)}), f"{t.scratch()}/nodes")


@query(f"""SELECT id, address FROM (
  SELECT id, '/prose/docs/' || lang || '/d' || (doc_id + 1) || '#doc-' || (doc_id + 1) AS address,
    'docs/' || lang || '/d' || (doc_id + 1) AS target FROM {_DOCS})
WHERE target NOT IN (SELECT id FROM {_DOCS})
UNION ALL SELECT id, '/blob/img/' || (doc_id % 7) || '.png' FROM {_DOCS} WHERE doc_id % 7 >= 4""")
def broken_links(t: Tables) -> DataFrame:
    """Links to documents of another language, or to pictures that are not
    there, land nowhere."""
    docs = corpus(t)
    nodes = _nodes(t, docs)
    # The heading of the next document is '#doc-<number>'.
    links = P.link_table(docs).withColumn(
        "dest", F.regexp_replace("dest", r"^d(\d+)\.md#doc$", r"d$1.md#doc-$1"))
    return P.broken_links(P.node_links(links), nodes).select("id", "address")


@query(f"""SELECT id, md5(opening || chr(10) || chr(10) || '[next](node:/prose/docs/' || lang || '/d' || (doc_id + 1)
  || '#doc) ![pic](node:/blob/img/' || (doc_id % 7) || '.png) [own](#doc) [web](http://example.org/' || doc_id
  || ')' || chr(10)) AS content, 'Doc ' || doc_id AS title, id AS order_key, CAST(4 AS BIGINT) AS depth FROM {_DOCS}""")
def interpreted_prose(t: Tables) -> DataFrame:
    return P.interpret_prose(corpus(t)).select(
        "id", F.md5("content").alias("content"), "title", "order_key", "depth")


@query(f"""SELECT id, md5(opening || chr(10) || chr(10) || '[next]' || CASE WHEN EXISTS (
    SELECT 1 FROM documents n WHERE n.doc_id = d.doc_id + 1 AND n.lang = d.lang)
    THEN '(d' || (doc_id + 1) || '.md#doc-' || (doc_id + 1) || ')' ELSE '' END
  || ' ![pic]' || CASE WHEN doc_id % 7 < 4 THEN '(../../../blob/img/' || (doc_id % 7) || '.png)' ELSE '' END
  || ' [own](#doc) [web](http://example.org/' || doc_id || ')' || chr(10)) AS content FROM {_DOCS} d""")
def relinked_prose(t: Tables) -> DataFrame:
    """Links rewritten to paths between pages; broken ones cut."""
    # The heading of the next document is '#doc-<number>'.
    docs = corpus(t).withColumn("content", F.regexp_replace(
        "content", r"\(d([0-9]+)\.md#doc\)", r"(d$1.md#doc-$1)"))
    prose = stored(P.parse_prose(docs), f"{t.scratch()}/prose")
    nodes = _nodes(t, prose)
    pages = N.assign_pages(nodes, {"web": ["prose.item"]})
    return P.relink(prose, pages, "web").select("id", F.md5("content").alias("content"))


# ── Nesting, assembly ────────────────────────────────────────────────


@query(f"""SELECT id, md5(regexp_replace(regexp_replace(opening, '^# ', '#### '), '## (Links [*]in[*] `[a-z]*`)$',
  '##### \\1') || chr(10) || chr(10) || '[next](d' || (doc_id + 1) || '.md#doc) ![pic](../../img/' || (doc_id % 7)
  || '.png) [own](#doc) [web](http://example.org/' || doc_id || ')' || chr(10)) AS content FROM {_DOCS}""")
def shifted_headings(t: Tables) -> DataFrame:
    shifted = P.shift_headings(F.col("content"), "###")
    return corpus(t).select("id", F.md5(shifted).alias("content"))


def _parts(t: Tables) -> DataFrame:
    docs = t.documents.select(
        F.lit("web").alias("edition"),
        F.concat("lang", F.lit("/x."), (F.col("doc_id") % 50).cast("string"), F.lit(".md")).alias("page_path"),
        F.concat(F.lit("docs/"), "lang", F.lit("/d"), F.col("doc_id").cast("string")).alias("id"),
        F.col("text").alias("body"))
    return P.assemble(docs.withColumn("order_key", P.order_key(F.col("id"))).withColumn(
        "address", F.concat(F.lit("/prose/"), "id")))


_PAGES = f"""SELECT {{columns}}, md5(string_agg(
    '<a id="/prose/' || id || '"></a>' || chr(10) || text || chr(10), '' ORDER BY id)) AS body
FROM {_DOCS} GROUP BY lang, doc_id % 50"""


@query(_PAGES.format(columns="'web' AS edition, lang || '/x.' || (doc_id % 50) || '.md' AS page_path"))
def assembled_pages(t: Tables) -> DataFrame:
    """Documents put together to pages, in reading order."""
    return P.whole_pages(_parts(t)).withColumn("body", F.md5("body"))


@query(_PAGES.format(columns="'web/' || lang || '/x.' || (doc_id % 50) || '.md' AS path"))
def page_files(t: Tables) -> DataFrame:
    """The same pages as files, also those with names like ``x.1.md``, written
    over an earlier run that had other pages, and read back."""
    out = f"{t.scratch()}/site"
    earlier = t.region.select(F.lit("web").alias("edition"), F.concat("r_name", F.lit(".md")).alias("page_path"),
                              F.lit(0).alias("part"), F.col("r_name").alias("body"))
    publish_pages(earlier, out)
    publish_pages(_parts(t), out)
    run = published(out)
    files = t.spark.read.text(run, wholetext=True, recursiveFileLookup=True)
    place = F.substring_index(F.col("_metadata.file_path"), run.rsplit("/", 1)[1] + "/", -1)
    return files.select(place.alias("path"), F.md5("value").alias("body"))
