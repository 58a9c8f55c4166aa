import posixpath
import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import markdown as M
from recordloom.operators import nodes as N
from recordloom.operators import prose as P
from tests.conftest import rows


HEADINGS = [
    ("# A\n\ntext\n## B ##\n", [(1, "A", "a"), (2, "B", "b")]),
    ("#no\n####### no\n#\n", [(1, "", "")]),
    ("T\n==\nmore\n---\n", [(1, "T", "t"), (2, "more", "more")]),
    ("```\n# no\n```\n~~~\n# no\n````\n~~~\n# yes", [(1, "yes", "yes")]),
    ("```\nunclosed\n# no", []),
    ("    # no\n\npara\n    # no\n", []),
    ("> # q\n> text\n\n- # l\n  ## m\n\n1. x\n\n   # n\n", [
        (1, "q", "q"), (1, "l", "l"), (2, "m", "m"), (1, "n", "n")]),
    ("<div>\n# no\n</div>\n\n# yes\n", [(1, "yes", "yes")]),
    ("<!--\n\n# no\n-->\n# yes\n", [(1, "yes", "yes")]),
    ("***\n---\n# a\n# a\n# a-1\n# a\n", [
        (1, "a", "a"), (1, "a", "a-1"), (1, "a-1", "a-1-1"), (1, "a", "a-2")]),
    ("# `set:` and [docs](x.md) *em* _u_ s_c &amp; \\#", [
        (1, "`set:` and [docs](x.md) *em* _u_ s_c &amp; \\#", "set-and-docs-em-u-s_c--")]),
    ("# crlf\r\ntext\r\n", [(1, "crlf", "crlf")]),
    ("- a\n- b\n---\n", []),
    ("# x #\n# y#\n# z \\##\n", [(1, "x", "x"), (1, "y#", "y"), (1, "z \\##", "z-")]),
    ("", []),
    ("x " * 200_000 + "\n# h\n" + "`a " * 50_000 + "[" * 50_000, [(1, "h", "h")]),
]


def test_headings(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HEADINGS)], "i int, t string")
    for r in frame.select("i", M.headings(F.col("t")).alias("h")).collect():
        assert [(h.level, h.title, h.id) for h in r.h] == HEADINGS[r.i][1], HEADINGS[r.i][0][:80]


UNDERLINED = [
    ("Two\nlines\n===\n\ntext\n", [(1, "Two\nlines", "twolines")]),
    ("  A\n  B  \nC\n---\nmore\n", [(2, "A\n  B  \nC", "a--b--c")]),
    ("text\n\nT\n=\n", [(1, "T", "t")]),
    ("text\n# A\nmore\n--\n", [(1, "A", "a"), (2, "more", "more")]),
    ("```\n---", []), ("~~~\na\n---\n~~~\n", []), ("para\n```\nx\n```\n---\n", []),
    ("a\n    b\n===\n", [(1, "a\n    b", "a----b")]), ("\n===\n", []), ("> q\n---\n", []),
    ("line\n" * 30_000 + "\nT\n===", [(1, "T", "t")]),
]


def test_underlined_paragraphs(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(UNDERLINED)], "i int, t string")
    for r in frame.select("i", M.headings(F.col("t")).alias("h")).collect():
        assert [(h.level, h.title, h.id) for h in r.h] == UNDERLINED[r.i][1], UNDERLINED[r.i][0][:80]


def test_slugs(spark):
    cases = [("Größe in cm", "größe-in-cm"), ("my_table 2", "my_table-2"), ("終わり。", "終わり"), ("Rev. 3.2", "rev-32"),
             ("④つ目Ⅳ号", "つ目ⅳ号"), ("one  two", "one--two"), ("this / that", "this--that"), ("ΝΕΟΣ", "νεοσ"), ("tab\there", "tabhere")]
    got = spark.createDataFrame(cases, "t string, s string").select("t", "s", M.slug(F.col("t")).alias("g")).collect()
    assert all(r.s == r.g for r in got), got


LINKS = [
    ("[a](b.md) ![i](c.png)", ["b.md", "c.png"]),
    ("`[x](y)` \\[x](y) [a](<b c>) [t](u 'v') [r][ref] <http://e.org>", []),
    ("```\n[x](y)\n```\n\n    [x](y)\n\n[z](w)", ["w"]),
    ("[a [b](c) d](e)", ["c"]),
    ("[![alt](img.png)](to.md)", ["to.md"]),
    ("[p](a(b)c) [q](a\\)b)", ["a(b)c"]),
    ("> [a](x)\n> [b](x)\n\n- [c](y)\n  [d](z)", ["x", "x", "y", "z"]),
    ("[a](b&amp;c) [d]() [e](#f)", ["", "#f"]),
    ("# [h](x.md)\n\n[s](y.md)\n===", ["x.md", "y.md"]),
    ("[two\nlines](x.md)", ["x.md"]),
    ("`a [b](c)", ["c"]), ("``a ` [b](c)`` [d](e)", ["e"]), ("[a `]` b](c)", ["c"]),
    ("<a href='[x](y)'> [z](w)", ["w"]),
    ("[ " * 60_000 + "[a](b)", ["b"]), ("[x] " * 50_000 + "[a](b)", ["b"]),
]


def test_links(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINKS)], "i int, t string")
    same = M.joined(M.link_cuts(F.col("t")), lambda mark, _: mark)
    for r in frame.select("i", M.links(F.col("t")).alias("l"), (same == F.col("t")).alias("same")).collect():
        assert [x.dest for x in r.l] == LINKS[r.i][1] and r.same, LINKS[r.i][0][:80]


def test_shift(spark):
    text = "# A\n## B ##\n> # q\n- # l\n\nS\n==\n```\n# c\n```\n##### E\n  # I"
    frame = spark.createDataFrame([(text,), ("plain",), (None,)], "t string")
    got = [r[0] for r in frame.select(P.shift_headings(F.col("t"), "##")).collect()]
    assert got == [
        "### A\n#### B ##\n> # q\n- # l\n\nS\n==\n```\n# c\n```\n###### E\n  ### I", "plain", None]
    for bad in ("", "h2"):
        with pytest.raises(ValueError):
            P.shift_headings(F.col("t"), bad)


def test_no_python_in_the_plans(spark):
    docs = spark.createDataFrame([("a", "# x [y](z.md)", "text/markdown")], "id string, content string, mime_type string")
    for frame in (P.heading_table(docs), P.link_table(docs), P.interpret_prose(docs),
                  docs.select(P.shift_headings(F.col("content"), "#"))):
        assert "Python" not in frame._jdf.queryExecution().toString()


def test_targets(spark):
    cases = [
        ("a/b", "c.md", "node:/prose/a/c"), ("a/b", "./c.md#x", "node:/prose/a/c#x"),
        ("a/b", "../i.PNG", "node:/blob/i.PNG"), ("a/b", "../../out.md", "../../out.md"),
        ("a", "b/../c.MD?q=1#y", "node:/prose/c#y"), ("a", "#frag", "#frag"), ("a", "", ""),
        ("a", "/abs.md", "/abs.md"), ("a", "http://e.org/x.md", "http://e.org/x.md"),
        ("a", "//host/x.md", "//host/x.md"), ("a", "mailto:x@y", "mailto:x@y"),
        ("a", "node:/prose/x", "node:/prose/x"), ("x/a", "..", "node:/blob/."),
        ("a", "?q", "?q"), ("日/本", "語.md", "node:/prose/日/語"), ("a", "..", "node:/blob/.."),
    ]
    frame = spark.createDataFrame(cases, "i string, d string, e string")
    for row in rows(frame.select("*", P.link_target(F.col("i"), F.col("d")).alias("t"))):
        assert row["t"] == row["e"], row


def test_paths_are_normpath(spark):
    rng = random.Random(2)
    made = [("/".join(rng.choice("ab") for _ in range(rng.randint(1, 3))),
             "/".join(rng.choice(["a", "b", "..", ".", ""]) for _ in range(4)) + "/f")
            for _ in range(80)]
    made = [(i, d.lstrip("/")) for i, d in made]
    frame = spark.createDataFrame(made, "i string, d string")
    for row in rows(frame.select("*", P.link_target(F.col("i"), F.col("d")).alias("t"))):
        whole = posixpath.normpath(posixpath.join(posixpath.dirname(row["i"]), row["d"]))
        expected = row["d"] if whole.startswith("../") else f"node:/blob/{whole}"
        assert row["t"] == expected, row


def test_reading_order(spark):
    ids = ["index", "a", "b/index", "b/a", "b/c/index", "b/c/z", "b/d", "c", "myindex", "index/x"]
    frame = spark.createDataFrame([(i,) for i in reversed(ids)], "id string")
    got = rows(frame.select("id", P.order_key(F.col("id")).alias("k"),
                            P.depth(F.col("id")).alias("d")).orderBy("k"))
    by_id = {r["id"]: (r["k"], r["d"]) for r in got}
    assert by_id["index"] == ("", 1) and by_id["b/index"] == ("b/", 2)
    assert by_id["b/c/index"] == ("b/c/", 3) and by_id["a"] == ("a", 2) and by_id["b/a"] == ("b/a", 3)
    assert [r["id"] for r in got] == [
        "index", "a", "b/index", "b/a", "b/c/index", "b/c/z", "b/d", "c", "index/x", "myindex",
    ]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(
        [
            ("index", "# Home\n\n[a](docs/a.md) [bad](docs/no.md) [pdf](x.pdf#page=3) [w](http://e)"),
            ("docs/a", "Intro\n\n## Part\n\n[self](#part) [h](../index.md#home) ![p](../x.pdf)"),
            ("docs/plain", "No marks here."),
        ],
        "id string, content string",
    ).withColumn("mime_type", F.lit("text/markdown"))
    prose = P.interpret_prose(docs)
    blob = spark.sql("select 'x.pdf' as id, 'application/pdf' as mime_type")
    return docs, prose, N.node_index({"prose": prose, "blob": blob})


def test_interpret(corpus):
    docs, prose, _ = corpus
    got = {r["id"]: r for r in rows(prose)}
    assert got["index"]["content"] == (
        "# Home\n\n[a](node:/prose/docs/a) [bad](node:/prose/docs/no)"
        " [pdf](node:/blob/x.pdf#page=3) [w](http://e)"
    )
    assert got["docs/plain"] == {
        "id": "docs/plain", "order_key": "docs/plain", "depth": 3, "headings": [],
        "mime_type": "text/markdown", "content": "No marks here.",
    }
    assert [h["id"] for h in got["docs/a"]["headings"]] == ["part"] and "title" not in got["docs/a"]
    titled = P.interpret_prose(docs.withColumn("title", F.lit("Own")))
    assert {r["title"] for r in rows(titled)} == {"Own"}
    assert rows(P.title_table(P.heading_table(docs))) == [{"id": "index", "title": "Home"}]


def test_link_jobs(corpus):
    docs, prose, nodes = corpus
    links = P.link_table(docs)
    assert len(rows(links)) == 7
    inner = P.node_links(links)
    broken = rows(P.broken_links(inner, nodes))
    assert [(r["id"], r["address"]) for r in broken] == [("index", "/prose/docs/no")]
    pages = N.assign_pages(nodes, {"web": ["prose.item"], "one": []})
    got = {r["id"]: r["content"] for r in rows(P.relink(prose, pages, "web"))}
    assert got["index"] == (
        "# Home\n\n[a](docs/a.md#/prose/docs/a) [bad] [pdf](../blob/x.pdf#page=3) [w](http://e)"
    )
    assert got["docs/a"] == (
        "Intro\n\n## Part\n\n[self](#part) [h](../index.md#home) ![p](../../blob/x.pdf)"
    )
    assert got["docs/plain"] == "No marks here."


def test_assemble(spark):
    data = [("web", "index.md", f"k{i:03}", f"/p/{i}", f"body {i}", i != 3) for i in range(7)]
    random.Random(1).shuffle(data)
    frame = spark.createDataFrame(
        data + [("web", "b.md", "k", "/b", "b", True)],
        "edition string, page_path string, order_key string, address string, body string,"
        " stamps boolean",
    )
    parts = P.assemble(frame)
    assert parts.count() == 8
    got = {r["page_path"]: r["body"] for r in rows(P.whole_pages(parts))}
    assert got == {
        "b.md": '<a id="/b"></a>\nb\n',
        "index.md": "".join(("" if i == 3 else f'<a id="/p/{i}"></a>\n') + f"body {i}\n" for i in range(7)),
    }


def test_rewritten_links_are_exact(spark):
    rng = random.Random(9)
    new = {"[x](a.md)": "[x](node:/prose/a)", "![y](b.png)": "![y](node:/blob/b.png)"}
    rows_in, expected = [], {}
    for i in range(40):
        parts = [rng.choice(["é", "😀 ", *new, "\n\n", "`[c](d)`", "word "]) for _ in range(12)]
        rows_in.append((f"d{i}", "".join(parts), "text/markdown"))
        expected[f"d{i}"] = "".join(new.get(p, p) for p in parts)
    docs = spark.createDataFrame(rows_in, "id string, content string, mime_type string")
    assert {r["id"]: r["content"] for r in rows(P.interpret_prose(docs))} == expected
