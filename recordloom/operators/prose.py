"""Jobs over a table of Markdown documents (``id``, ``content``), all of them
column expressions and joins; see :mod:`..functions.markdown` for the Markdown
that is covered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import markdown
from recordloom.functions.paths import ORD, column, visible
from recordloom.functions.text import bind, folder, normal_path
from recordloom.operators.groups import nested_lists
from recordloom.operators.nodes import BLOB, PROSE, href


def may_have_headings(content: Column) -> Column:
    """False only for texts without any heading mark."""
    return content.contains("#") | content.rlike(r"(?m)^[ \t>*+\-0-9.)]*(=+|-+)[ \t\r]*$")


def may_have_links(content: Column) -> Column:
    return content.contains("](")


# ── Headings, titles, order (T1-T3) ──────────────────────────────────


def heading_table(docs: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """``(key, ord, level, title, slug)``, one row per heading."""
    some = docs.filter(may_have_headings(column(content)))
    rows = some.select(column(key), F.posexplode(markdown.headings(column(content))).alias("ord", "h"))
    return rows.select(
        key, "ord", F.col("h.level").alias("level"), F.col("h.title").alias("title"),
        F.col("h.id").alias("slug"),
    )


def heading_array(content: Column) -> Column:
    """Array of ``(id, title, level)`` of a document."""
    none = F.array().cast("array<struct<id: string, title: string, level: bigint>>")
    return F.when(may_have_headings(content), markdown.headings(content)).otherwise(none)


def first_title(headings: Column) -> Column:
    """The title of the first level-1 heading in a heading array."""
    return F.get(F.filter(headings, lambda h: h["level"] == 1), F.lit(0))["title"]


def order_key(doc_id: Column) -> Column:
    """A sort key that puts a folder's ``index`` before its files."""
    return F.regexp_replace(doc_id, r"(^|/)index\z", "$1")


def depth(doc_id: Column) -> Column:
    """How deep a document lies; an ``index`` one level above its siblings."""
    steps = F.size(F.split(doc_id, "/")).cast("bigint")
    return F.when(doc_id.rlike(r"(^|/)index\z"), steps).otherwise(steps + 1)


# ── Links (T4-T6) ────────────────────────────────────────────────────


def link_table(docs: DataFrame, key: str = "id", content: str = "content", carry: Sequence[str] = ()) -> DataFrame:
    """``(key, ord, dest, kind)`` and ``carry``, one row per inline link or image."""
    some = docs.filter(may_have_links(column(content)))
    rows = some.select(column(key), F.posexplode(markdown.links(column(content))).alias("ord", "l"), *carry)
    return rows.select(key, "ord", F.col("l.dest").alias("dest"), F.col("l.kind").alias("kind"), *carry)


def link_target(doc_id: Column, dest: Column) -> Column:
    """Where a link of a document points: ``node:/prose/<id>`` or
    ``node:/blob/<path>`` with its fragment for a relative path inside the
    tree, else ``dest`` as it is."""
    path = F.regexp_extract(dest, r"^[^?#]*", 0)
    inside = (
        ~dest.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & (path != "") & ~path.startswith("/")
    )
    steps = normal_path(F.concat(folder(doc_id), F.split(path, "/")))
    resolved = bind(F.array_join(steps, "/"), lambda p: F.when(p == "", ".").otherwise(p))
    return F.when(
        inside, bind(resolved, lambda place: _node_address(place, dest))
    ).otherwise(dest)


def _node_address(resolved: Column, dest: Column) -> Column:
    node = F.when(
        F.lower(resolved).endswith(".md"),
        F.concat(F.lit("node:/prose/"), F.regexp_replace(resolved, r"...\z", "")),
    ).otherwise(F.concat(F.lit("node:/blob/"), resolved))
    # "#" alone is no fragment.
    whole = F.concat(node, F.regexp_extract(dest, r"#.+$", 0))
    return F.when(resolved.startswith("../"), dest).otherwise(whole)


def node_links(links: DataFrame, key: str = "id") -> DataFrame:
    """The links that point into the tree, with ``address``, ``base`` (without
    fragment) and ``fragment``."""
    target = link_target(column(key), F.col("dest"))
    address = F.regexp_extract("__target", "^node:(.*)$", 1)
    named = links.withColumn("__target", target).filter(F.col("__target").startswith("node:"))
    return named.select(
        *links.columns,
        address.alias("address"),
        F.regexp_extract(address, "^[^#]*", 0).alias("base"),
        F.regexp_extract(address, "#(.*)$", 1).alias("fragment"),
    )


def resolve_links(
    links: DataFrame, nodes: DataFrame, carry: Sequence[str] = ()
) -> DataFrame:
    """Links of :func:`node_links` plus ``found``, the address they land on,
    NULL for a broken link, and the ``carry`` columns of that node. Only a blob
    may carry a fragment of its own, so a link to one also matches by its base.

    ``nodes`` is read twice; give a stored table, not a plan that parses the
    documents again.
    """
    # One row per address, whatever the number of links that meet it.
    def known(part: DataFrame) -> DataFrame:
        values = [F.min(name).alias("__x_" + name) for name in carry]
        address = F.col("address").alias("__x_found")
        return part.groupBy(address).agg(*values) if values else part.select(address).distinct()

    tags = [F.col(f"__x_{name}").alias(name) for name in ("found", *carry)]
    joined = links.join(known(nodes), F.col("address") == F.col("__x_found"), "left")
    # Few links have a second try; only they are looked up again.
    retry = F.col("__x_found").isNull() & (F.col("fragment") != "")
    again = joined.filter(retry).select(*links.columns).join(
        known(nodes.filter(F.col("origin") == BLOB)), F.col("base") == F.col("__x_found"), "left")
    return joined.filter(~retry).select(*links.columns, *tags).unionByName(again.select(*links.columns, *tags))


def broken_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links whose target is nowhere in the address table."""
    return resolve_links(links, nodes).filter("found is null").drop("found")


# ── Rewriting (T7) ───────────────────────────────────────────────────


def parse_prose(docs: DataFrame) -> DataFrame:
    """Documents with ``title``, ``headings``, ``order_key`` and ``depth``, and
    ``tokens`` in place of ``content``: the text cut at its links, relative ones in
    ``node:`` form. Each text is read once for its links and once for its
    headings; store the result where several steps go on from it. Content that is
    not Markdown gets its place in the reading order only."""
    content, markdown_row = column("content"), column("mime_type") == "text/markdown"
    found = F.when(markdown_row, heading_array(content)).otherwise(heading_array(F.lit("")))
    parsed = docs.withColumn("__h", found)
    rewritten = F.transform(markdown.link_cuts(content), lambda token: F.when(
        markdown.is_link(token), markdown.with_target(
            token, link_target(column("id"), markdown.target(token)))).otherwise(token))
    title = first_title(F.col("__h"))
    if "title" in docs.columns:
        title = F.coalesce(column("title"), title)
    headings = F.when(markdown_row & content.isNotNull(), F.col("__h"))
    if "headings" in docs.columns:
        headings = F.coalesce(headings, column("headings"))
    hidden = [column(ORD)] if ORD in docs.columns else []
    rest = [n for n in visible(docs.schema)
            if n not in ("id", "title", "order_key", "depth", "headings", "mime_type", "content")]
    whole = F.when(content.isNotNull(), F.array(content))
    return parsed.select(
        "id",
        title.alias("title"),
        order_key(column("id")).alias("order_key"),
        depth(column("id")).alias("depth"),
        headings.alias("headings"),
        "mime_type",
        F.when(markdown_row & may_have_links(content), rewritten).otherwise(whole).alias("tokens"),
        *[column(n) for n in rest],
        *hidden,
    )


def interpret_prose(docs: DataFrame) -> DataFrame:
    """:func:`parse_prose` with the rewritten text as ``content``."""
    parsed = parse_prose(docs)
    content = F.array_join("tokens", "").alias("content")
    return parsed.select(*[content if n == "tokens" else column(n) for n in parsed.columns])


def relink(docs: DataFrame, pages: DataFrame, edition: str) -> DataFrame:
    """Documents (``id``, and ``tokens`` or ``content``, with ``node:`` links) for
    one edition, with ``content``: each link as a path from the document's page to
    the target's, broken ones cut to a bare ``[text]``. ``pages`` is the output of
    :func:`.nodes.assign_pages`. The documents are read twice, for their links and
    to put the new targets in: give the stored table of :func:`parse_prose`, so
    that no text is looked through again."""
    mine = pages.filter(F.col("edition") == edition).select(
        "address", "origin", "segment", "page_path", F.col("fragment").alias("landing")
    )
    if "tokens" not in docs.columns:
        text = column("content")
        docs = docs.withColumn("tokens", F.when(may_have_links(text), markdown.link_cuts(text)).otherwise(F.array(text)))
    marks = docs.select("id", F.explode(markdown.links_of(F.col("tokens"))).alias("l"))
    address = F.regexp_extract("l.dest", "^node:(.*)$", 1)
    inner = marks.filter(F.col("l.dest").startswith("node:")).select(
        "id", F.col("l.at").alias("at"), address.alias("address"),
        F.regexp_extract(address, "^[^#]*", 0).alias("base"),
        F.regexp_extract(address, "#(.*)$", 1).alias("fragment"),
    )
    found = resolve_links(inner, mine, carry=("page_path", "landing"))
    source = mine.filter(F.col("origin") == PROSE).groupBy(
        F.col("segment").alias("__doc")
    ).agg(F.min("page_path").alias("__from"))
    found = found.join(source, F.col("id") == F.col("__doc"), "left")
    # A blob found by its base keeps the fragment the author wrote.
    own = (F.col("found") != F.col("address")) & (F.col("landing") == "")
    landing = F.when(own, F.col("fragment")).otherwise(F.col("landing"))
    url = href(F.col("__from"), F.col("page_path"), landing)
    targets = found.select("id", F.struct("at", url.alias("to")).alias("s")).groupBy(
        F.col("id").alias("__id")).agg(F.sort_array(F.collect_list("s")).alias("__to"))
    joined = docs.join(targets, F.col("id") == F.col("__id"), "left")
    content = F.when(F.col("__to").isNotNull(), _spliced(F.col("tokens"), F.col("__to"))).otherwise(
        F.array_join("tokens", ""))
    kept = [n for n in docs.columns if n not in ("tokens", "content")]
    return joined.select(*[column(n) for n in kept], content.alias("content"))


def _spliced(tokens: Column, new: Column) -> Column:
    """The text with the tokens at ``new.at`` (ascending) pointing to ``new.to``;
    what stands between two of them is copied as one slice, so the work grows with
    the text and not with texts times links."""

    def piece(k: Column) -> Column:
        start = F.coalesce(F.get(new, k - 1)["at"] + 1, F.lit(0))
        end = F.coalesce(F.get(new, k)["at"], F.size(tokens))
        mark = F.when(k < F.size(new), markdown.with_target(F.get(tokens, end), F.get(new, k)["to"]))
        return F.concat(F.array_join(F.slice(tokens, start + 1, end - start), ""), F.coalesce(mark, F.lit("")))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(new)), piece), "")


# ── Nesting and assembly (T8, T9) ────────────────────────────────────


def shift_headings(content: Column, marker: str) -> Column:
    """``content`` with its top-level ATX headings as much deeper as ``marker``
    (such as ``##``) is long, at most level 6."""
    levels = marker.count("#")
    if not levels or levels != len(marker):
        raise ValueError(f"a heading marker has only '#', not {marker!r}")
    return F.when(content.contains("#"), markdown.shifted(content, levels)).otherwise(content)


def assemble(bodies: DataFrame, by: Sequence[str] = ("edition", "page_path")) -> DataFrame:
    """Pages from their parts: a row per part, in no order of its own, with the
    ``by`` columns, ``part`` (what a page's parts are ordered by) and ``body``,
    opened by the part's anchor. ``bodies`` has the ``by`` columns, ``order_key``,
    ``address``, ``body`` and optionally ``stamps`` (false: no anchor).

    A page of any size stays many rows; :func:`whole_pages` makes one row of each,
    and the page writer streams the parts."""
    stamp = F.concat(F.lit('<a id="'), F.col("address"), F.lit('"></a>\n'))
    if "stamps" in bodies.columns:
        stamp = F.when(F.col("stamps"), stamp).otherwise("")
    return bodies.select(
        *by, F.struct("order_key", "address").alias("part"),
        F.concat(stamp, F.col("body"), F.lit("\n")).alias("body"))


def whole_pages(parts: DataFrame, by: Sequence[str] = ("edition", "page_path")) -> DataFrame:
    """One row per page of :func:`assemble` with its whole ``body``, however long."""
    rows = parts.select(F.struct(*by).alias("__page"), "body", F.col("part").alias(ORD))
    lists = nested_lists(rows, "__page", F.struct("body"), "__parts")
    return lists.select(
        *[F.col("__page").getField(n).alias(n) for n in by],
        F.array_join(F.transform("__parts", lambda p: p["body"]), "").alias("body"))


def title_table(headings: DataFrame, key: str = "id") -> DataFrame:
    """``(key, title)``: the first level-1 heading of each document."""
    return headings.filter("level = 1").groupBy(key).agg(F.min_by("title", "ord").alias("title"))


