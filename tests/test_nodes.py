import posixpath
import random
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.operators import nodes as N
from recordloom.operators import views as V
from recordloom.plans import catalog as K
from tests.conftest import rows
from tests.test_checks import INTEGER, STRING, keyed, obj


@pytest.fixture(scope="module")
def frames(spark):
    members = spark.sql(
        "select * from values (0, 'alice', 'Alice', array(named_struct('id', 'l/1', 'url', 'u'),"
        " named_struct('id', cast(null as string), 'url', 'v')), named_struct('x', 1), array('t')),"
        " (1, 'bob', null, null, null, null) as t(o, id, name, links, home, tags)"
    )
    prose = spark.sql(
        "select 'guide/a' as id, 'Guide' as title, array(named_struct('id', 'set-up', 'title',"
        " 'Set up', 'level', 2L)) as headings, 'text/markdown' as mime_type, '# Guide' as content"
    )
    blob = spark.sql("select 'img/p 1.png' as id, 'image/png' as mime_type")
    overview = spark.sql("select 'Over' as title")
    return {"members": V.source(members, ["o"]).drop("o"), "prose": prose, "blob": blob,
            "overview": overview}


@pytest.fixture(scope="module")
def nodes(frames):
    return N.node_index(frames, single=["overview"])


def test_index(nodes):
    got = {r["address"]: r for r in rows(nodes)}
    assert {a: (r.get("parent"), r["type"]) for a, r in got.items()} == {
        "/": (None, ".item"),
        "/members": ("/", "members.item[]"),
        "/members/alice": ("/members", "members.item"),
        "/members/alice/links": ("/members/alice", "members.item.links.item[]"),
        "/members/alice/links/l%2F1": ("/members/alice/links", "members.item.links.item"),
        "/members/alice/home": ("/members/alice", "members.item.home"),
        "/members/alice/tags": ("/members/alice", "members.item.tags.item[]"),
        "/members/bob": ("/members", "members.item"),
        "/prose": ("/", "prose.item[]"),
        "/prose/guide/a": ("/prose", "prose.item"),
        "/prose/guide/a/headings": ("/prose/guide/a", "prose.item.headings.item[]"),
        "/prose/guide/a#set-up": ("/prose/guide/a/headings", "prose.item.headings.item"),
        "/blob": ("/", "blob.item[]"),
        "/blob/img/p%201.png": ("/blob", "blob.item"),
        "/overview": ("/", "overview"),
    }
    assert got["/members/alice"]["label"] == "Alice" and got["/members/bob"]["label"] == "bob"
    assert got["/overview"]["label"] == "Over" and got["/members"]["label"] == "/members"
    assert got["/prose/guide/a#set-up"]["fragment"] == "set-up"
    assert got["/blob/img/p%201.png"]["fragment"] == ""
    assert [a["address"] for a in got["/members/alice/links/l%2F1"]["ancestors"]] == [
        "/", "/members", "/members/alice", "/members/alice/links", "/members/alice/links/l%2F1",
    ]


def test_lookups(spark, nodes):
    refs = spark.createDataFrame(
        [("members", "alice"), ("members", "zed"), ("members", None), ("members", "/x")],
        "e string, k string",
    )
    got = rows(N.resolve_refs(refs, N.address_of(F.col("e"), F.col("k")), nodes))
    assert sorted((r.get("address"), r["state"], r.get("label")) for r in got if r.get("address")) == [
        ("/members/%2Fx", "missing", "/members/%2Fx"), ("/members/alice", "ok", "Alice"),
        ("/members/zed", "missing", "/members/zed"),
    ]
    assert [r["state"] for r in got if not r.get("address")] == ["none"]
    heading = refs.limit(1).select(N.address_of(path=F.lit("/prose/guide/a"),
                                                fragment=F.lit("set-up")).alias("a"))
    assert rows(N.resolve_refs(heading, F.col("a"), nodes))[0]["state"] == "ok"
    steps = spark.createDataFrame(
        [("/members", "bob"), ("/members", "no"), ("/prose", "guide/a"), ("/", "members"), (None, "x")],
        "p string, s string",
    )
    got = rows(N.children(steps, F.col("p"), F.col("s"), nodes))
    assert sorted((r.get("child") or "", r["state"]) for r in got) == [
        ("", "none"), ("/members", "ok"), ("/members/bob", "ok"), ("/members/no", "missing"),
        ("/prose/guide/a", "ok"),
    ]


def test_pages_and_links(nodes):
    editions = {"web": ["members.item", "prose.item"], "one": []}
    pages = N.assign_pages(nodes, editions)
    got = {(r["edition"], r["address"]): r["page_path"] for r in rows(pages)}
    assert got["web", "/members/alice/links/l%2F1"] == "members/alice.md"
    assert got["web", "/prose/guide/a#set-up"] == "prose/guide/a.md"
    assert got["web", "/members"] == "index.md" and got["one", "/members/bob"] == "index.md"
    assert got["web", "/blob/img/p%201.png"] == got["one", "/blob/img/p%201.png"] == "blob/img/p%201.png"
    assert rows(N.page_collisions(pages)) == []
    twice = N.assign_pages(nodes.unionByName(nodes.filter("address = '/members/bob'")), editions)
    assert rows(N.page_collisions(twice)) == [
        {"edition": "web", "page_path": "members/bob.md", "claims": 2}
    ]
    below = nodes.filter(N.in_subtree(F.col("ancestors"), F.lit("/members/alice")))
    assert len(rows(below)) == 5


def test_href_is_relpath(spark):
    rng = random.Random(3)
    path = lambda: "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + ".md"
    pairs = [(path(), path()) for _ in range(60)] + [("index.md", "index.md"), ("a/b.md", "a/b.md")]
    frame = spark.createDataFrame(pairs, "s string, t string")
    for row in rows(frame.select("s", "t", N.href(F.col("s"), F.col("t"), F.lit("f")).alias("h"))):
        expected = posixpath.relpath(row["t"], posixpath.dirname(row["s"]) or ".") + "#f"
        assert row["h"] == expected, row


def test_escapes(spark):
    cases = ["AZaz09-._~", "a b", "a/b#c?d", "書籍", "モーニング娘。", "𠮷野家", "😀", "￿", "100%", "",
             "a\nb", "é\u0085"]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    got = [r["e"] for r in rows(frame.select("i", X.iri_escape(F.col("v")).alias("e")).orderBy("i"))]
    expected = [quote(c, safe="") if c in ("￿", "a\nb") or c.isascii() else c for c in cases]
    expected[-1] = "é%C2%85"
    assert got == expected
    one = spark.range(1).select(
        X.md_escape(F.lit("a*b|c_é")).alias("a"), X.md_cell(F.lit("x|y\nz")).alias("b"),
        X.md_code(F.lit("a``b")).alias("c"), X.md_code(F.lit("`x")).alias("d"),
        X.md_fence(F.lit("a````"), F.lit("py")).alias("e"), X.md_fence(F.lit("q\n")).alias("f"),
        X.url_encode(F.lit("http://e.org/a b(1)?q=é")).alias("g"),
        X.md_link(F.lit("[x]"), F.lit("u")).alias("h"),
        X.dedent(F.lit("    a\n      b\n   \n    c")).alias("i"), X.dedent(F.lit("\ta\n  b")).alias("j"),
        X.shown(F.lit(None)).alias("k"), X.shown(F.lit(True)).alias("l"),
    )
    assert rows(one)[0] == {
        "a": "a\\*b\\|c\\_é", "b": "x\\|y<br>z", "c": "```a``b```", "d": "`` `x ``",
        "e": "`````py\na````\n`````", "f": "```\nq\n```",
        "g": "http://e.org/a%20b%281%29?q=é", "h": "[\\[x\\]](u)",
        "i": "a\n  b\n\nc", "j": "\ta\n  b", "k": "", "l": "true",
    }


def test_rows_and_table(frames):
    got = rows(N.entity_rows("members", frames["members"], ["links"]).orderBy("__ord").drop("__ord"))
    assert got == [
        {"id": "l/1", "url": "u", "_address": "/members/alice/links/l%2F1"}, {"url": "v"},
    ]
    heads = rows(N.entity_rows("prose", frames["prose"], ["headings"]))
    assert heads[0]["_address"] == "/prose/guide/a#set-up"
    table = N.record_table("members", frames["members"])
    lines = [r["line"] for r in rows(table.orderBy("part", "__ord"))]
    assert lines == [
        "# members",
        "| id | name | links | home.x | tags | _anchor_path |",
        "|---|---|---|---|---|---|",
        r'| alice | Alice | *2 items* | 1 | \[\"t\"\] | \/members\/alice |',
        r"| bob |  | *0 items* |  |  | \/members\/bob |",
    ]


def test_catalog(spark):
    schema = obj(
        tags=keyed(obj(["n"], n={"type": "integer", "title": "N", "minimum": 1})),
        tasks=keyed(obj(
            tag={"type": "string", "x-ref": {"entity": "tags"}},
            meta=obj(owner={"type": "string", "x-ref": {"entity": "people"}},
                     steps=keyed(obj(do=STRING))),
            words=keyed(INTEGER),
        )),
        people={"type": "array", "items": obj(id=STRING)},
    )
    types = K.schema_types(schema)
    specs = {
        "open": {"from": "tasks", "where": {"tag": {"exists": True}}},
        "by_tag": {"from": "open", "grouped": {"by": "tag", "as": "items"}},
        "tagged": {"from": "tags", "join": {"to": "tasks", "on": {"left": "id", "right": "tag"}}},
    }
    from recordloom.plans.bundle import run_views

    empty = {n: spark.createDataFrame([], t) for n, t in types.items()}
    views = run_views(empty, specs)
    frames = K.catalog(spark, types, views={n: v.schema for n, v in views.items()}, specs=specs,
                       builtin=["prose", "blob"])
    entities = {r["id"]: r for r in rows(frames[K.ENTITIES])}
    assert [n for n in entities if n.startswith("tasks")] == [
        "tasks", "tasks.meta.steps", "tasks.words",
    ]
    assert entities["tasks.meta.steps"]["item_type"]["id"] == "tasks.item.meta.steps.item"
    assert entities["tasks.meta.steps"]["parent_entity"] == "tasks"
    attributes = {a["id"]: a for a in entities["tasks"]["item_type"]["attributes"]}
    assert list(attributes) == ["id", "tag", "meta", "meta.owner", "meta.steps", "words"]
    assert attributes["meta.steps"]["type"] == "object[]" and attributes["id"]["required"]
    assert attributes["tag"]["x_ref"] == {"entity": "tags", "attribute": "id"}
    assert entities["tags"]["item_type"]["attributes"][1]["validation"] == '{"minimum": 1}'
    assert entities["open"]["view"] and entities["prose"]["builtin"]
    assert entities["open"]["item_type"]["origin_item_type"] == "tasks.item"
    origin = lambda n: entities[n]["item_type"]["origin_item_type"]
    assert origin("by_tag.items") == "tasks.item" and origin("by_tag") == "by_tag.item"
    assert origin("by_tag.items.words") == "tasks.item.words.item"
    assert origin("tagged.tasks") == "tasks.item"

    built = K.builtin_views(frames)
    ids = lambda n: [r["id"] for r in rows(built[n].orderBy("__ord"))]
    assert ids("__entity_tree")[:3] == ["tags", "tasks", "tasks.meta.steps"]
    assert [r["id"] for r in rows(built["__entity_defs"])] == [
        "tags", "tasks", "people", "prose", "blob",
    ]
    assert ids("__data") == ["tags", "tasks", "people", "prose", "blob", *specs]
    assert ids("__view_defs") == list(specs)
    found = {(r["kind"], r["source"], r["target"], r.get("attribute"))
             for r in rows(K.edges(frames[K.ENTITIES], specs)) if r["source"] != "prose"}
    assert {e for e in found if e[1] in ("tasks", "tagged")} == {
        ("composition", "tasks", "tasks.meta.steps", None),
        ("composition", "tasks", "tasks.words", None),
        ("reference", "tasks", "tags", "tag"), ("reference", "tasks", "people", "meta.owner"),
        ("composition", "tagged", "tagged.tasks", None), ("lineage", "tagged", "tags", None),
        ("lineage", "tagged", "tasks", None),
    }
    assert K.downstream(specs, ["tags"]) == ["tagged"]
    assert K.downstream(specs, ["tasks"]) == ["open", "by_tag", "tagged"]
