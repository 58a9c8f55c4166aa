import json
import os

import pytest
from pyspark.sql import functions as F

from recordloom.operators.checks import GateClosed, check_handwritten_blobs
from recordloom.sources import sinks, yaml12
from recordloom.sources import tree as tree_module
from recordloom.sources.tree import mime_type, read_tree, record_files, scan_tree
from tests.conftest import rows
from tests.test_checks import SCHEMA


def put(root, **files):
    for name, body in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            handle.write(body if isinstance(body, bytes) else body.encode())


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    put(root, **{
        "a/one.yaml": "artists:\n  x: {name: Xé, kind: band}\n  10: {name: Ten}\n",
        "a/two.JSON": json.dumps({"albums": [{"id": "p", "year": 2000.0}]}),
        "a-b/x.yml": "albums:\n- {id: q}\n",
        "a/empty.yaml": "",
        "a/bad.yaml": "albums: [\n",
        "index.md": "# Home\n\nSee [x](docs/x.md#top) and ![p](img/p.png).\n",
        "docs/x.MD": "Text\n\n[up](../index.md) [web](http://e.org) [out](../../no.md)\n",
        "docs/_draft.md": "# Draft\n",
        "_hid/deep/n.yaml": "albums: [{id: r}]\n",
        "_hid/deep/k=v/_z.png": b"\x00",
        "img/p.png": b"\x89PNG",
        "img/data.tar.gz": b"x",
        "README": b"x",
        ".secret/s.yaml": "albums: [{id: no}]\n",
        "a/.dot.md": "# no",
    })
    return root


def test_scan(spark, tree):
    kinds = {r["path"]: r["kind"] for r in rows(scan_tree(spark, tree))}
    assert kinds == {
        "a/one.yaml": "record", "a/two.JSON": "record", "a-b/x.yml": "record",
        "a/empty.yaml": "record", "a/bad.yaml": "record", "index.md": "prose",
        "docs/x.MD": "prose", "docs/_draft.md": "prose", "_hid/deep/n.yaml": "record",
        "_hid/deep/k=v/_z.png": "blob", "img/p.png": "blob", "img/data.tar.gz": "blob",
        "README": "blob",
    }
    assert "content" not in scan_tree(spark, tree).columns


def test_the_walk_finds_the_same_however_it_is_spread(spark, tree, monkeypatch):
    whole = sorted(r["path"] for r in rows(scan_tree(spark, tree)))
    for levels in (0, 1, 9):
        monkeypatch.setattr(tree_module, "SPREAD_LEVELS", levels)
        assert sorted(r["path"] for r in rows(scan_tree(spark, tree))) == whole


def test_bytes_that_are_no_text(spark, tmp_path):
    put(str(tmp_path), **{"a.md": b"caf\xc3\xa9 \xff!", "b.md": "fine"})
    files = scan_tree(spark, str(tmp_path), "prose", content=True)
    assert {r["id"]: r["content"] for r in rows(tree_module.prose_rows(files))} == {"a": "café \ufffd!", "b": "fine"}
    assert [r["path"] for r in rows(tree_module.prose_problems(files))] == ["a.md"]


def test_read_tree(spark, tree):
    frames = read_tree(spark, tree, SCHEMA)
    got = lambda n: rows(frames[n].orderBy("__ord").drop("__ord"))
    assert got("artists") == [
        {"id": "x", "name": "Xé", "kind": "band"}, {"id": "10", "name": "Ten"},
    ]
    assert [r["id"] for r in got("albums")] == ["r", "p", "q"]
    prose = {r["id"]: r for r in got("prose")}
    assert set(prose) == {"index", "docs/x", "docs/_draft"}
    assert prose["index"]["content"] == (
        "# Home\n\nSee [x](node:/prose/docs/x#top) and ![p](node:/blob/img/p.png).\n"
    )
    assert prose["index"]["title"] == "Home" and prose["index"]["order_key"] == ""
    assert prose["docs/x"]["content"] == (
        "Text\n\n[up](node:/prose/index) [web](http://e.org) [out](../../no.md)\n"
    )
    assert prose["docs/x"]["headings"] == [] and "title" not in prose["docs/x"]
    blobs = {r["id"]: r["mime_type"] for r in got("blob")}
    assert blobs["img/p.png"] == "image/png" and blobs["img/data.tar.gz"] == "application/x-tar"
    assert blobs["README"] == "application/octet-stream"
    problems = {r["path"]: r.get("problem") for r in rows(record_files(spark, tree))}
    assert problems["a/bad.yaml"] and problems["a/one.yaml"] is None


def test_mime_types_follow_the_table(spark):
    import mimetypes

    known = mimetypes.MimeTypes(filenames=())
    names = ["a.html", "b.JPG", "c.tgz", "d.css.gz", "x/e.json", "f.", ".png", "g.woff2", "h.tar.Z",
             "dir.png/plain", "i.svgz"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    for row in rows(frame.select("n", mime_type(F.col("n")).alias("m"))):
        expected = known.guess_type(row["n"].rsplit("/", 1)[-1])[0] or "application/octet-stream"
        assert row["m"] == expected, row


def test_yaml_is_1_2():
    text = "a: no\nb: 010\nc: 12:30:45\nd: 2024-01-01\n5: x\ne: [1.5, ~, true, 0x1F, 1e3]\n"
    assert json.loads(yaml12.to_json(text)[0]) == {
        "a": "no", "b": 10, "c": "12:30:45", "d": "2024-01-01", "5": "x",
        "e": [1.5, None, True, 31, 1000.0],
    }
    assert yaml12.to_json("  \n") == ("{}", None)
    assert "duplicate key" in yaml12.to_json("a: 1\na: 2\n")[1]
    assert "mapping at the root" in yaml12.to_json("- 1")[1]
    assert yaml12.to_json("a: .nan")[0] is None


def test_sinks(spark, tmp_path):
    frame = spark.sql(
        "select * from values (2, 'b', null), (1, 'a', named_struct('x', 1, 'y', null))"
        " as t(o, id, s)"
    )
    from recordloom.operators.views import source

    out = str(tmp_path / "ns")
    frames = {"t": source(frame, ["o"])}
    sinks.export_namespace(frames, out)
    lines = [l for f in sorted(os.listdir(f"{out}/t")) if f.endswith(".json")
             for l in open(f"{out}/t/{f}").read().splitlines()]
    assert [json.loads(l) for l in lines] == [
        {"o": 1, "id": "a", "s": {"x": 1}}, {"o": 2, "id": "b"},
    ]
    before = sorted(os.listdir(f"{out}/t"))
    bad = check_handwritten_blobs(spark.sql("select 'x' as id"))
    with pytest.raises(GateClosed):
        sinks.export_namespace({"t": frame}, out, diagnostics=bad)
    broken = frame.withColumn("z", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        sinks.export_namespace({"t": broken}, out)
    assert sorted(os.listdir(f"{out}/t")) == before and os.listdir(tmp_path) == ["ns"]
    assert rows(sinks.namespace_rows(frames).orderBy("row"))[0] == {
        "name": "t", "row": '{"o":1,"id":"a","s":{"x":1}}',
    }


def test_page_files(spark, tmp_path):
    pages = spark.createDataFrame(
        [("web", "index.md", 1, "two\n"), ("web", "index.md", 0, "één\n"),
         ("web", "a/b.md", 0, "x\n"), ("pdf", "index.md", 0, "p\n")],
        "edition string, page_path string, part bigint, body string",
    )
    out = str(tmp_path / "pages")
    sinks.write_page_files(pages, out)
    assert open(f"{out}/web/index.md", encoding="utf-8").read() == "één\ntwo\n"
    assert open(f"{out}/web/a/b.md").read() == "x\n"
    # A later run replaces the earlier one; a name like index.1.md is like any other.
    later = pages.filter("page_path = 'index.md'").withColumn("page_path", F.lit("index.1.md"))
    sinks.write_page_files(later, out)
    assert sorted(os.listdir(tmp_path)) == ["pages"] and sorted(os.listdir(f"{out}/web")) == ["index.1.md"]
    broken = pages.withColumn("body", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        sinks.write_page_files(broken, out)
    assert open(f"{out}/web/index.1.md", encoding="utf-8").read() == "één\ntwo\n"
    sinks.write_page_table(pages, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).filter("edition = 'pdf'").count() == 1


def test_items_of_a_merged_record_stay_rows(spark):
    from recordloom.sources.tree import merge_single, single_items
    from tests.test_checks import STRING, obj

    strings = {"type": "array", "items": STRING}
    about = obj(notes=strings, deep=obj(more=strings), title=STRING)
    kind = "parts array<string>, v struct<notes: array<string>, deep: struct<more: array<string>>, title: string>"
    frame = spark.createDataFrame([
        (["b"], (["3", None], None, "b")), (["a"], (["1", "2"], (["x"],), None)), (["c"], (None, ([],), "c")), (["d"], None)], kind)
    found = {path: [r["item"] for r in f.orderBy("__ord").collect()] for path, f in single_items(frame, about).items()}
    merged = merge_single(frame, about).collect()[0]
    assert found == {"notes": ["1", "2", "3", None], "deep.more": ["x"]}
    assert found == {"notes": merged.notes, "deep.more": merged.deep.more}
    # A million items of many files: no task holds more than a few files' items.
    many = spark.range(0, 2000, 1, 20).selectExpr(
        "array(cast(id as string)) as parts", "named_struct('notes', transform(sequence(1, 500), x -> cast(x as string)),"
        " 'deep', cast(null as struct<more: array<string>>), 'title', 't') as v")
    rows_ = single_items(many, about)["notes"]
    counts = [r[1] for r in rows_.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 1_000_000 and max(counts) == 50_000


def test_file_contents_leave_a_task_in_small_parts(spark, tmp_path):
    import pyarrow as pa

    from recordloom.sources import tree

    size = tree._BATCH_BYTES
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(7)]})
    alive = [size // 2, size // 2, 1, 3 * size, 1, 1, size // 3]
    parts = list(tree._in_parts(batch, iter(alive), len_of=lambda n: n))
    assert [part.column("path").to_pylist() for part, _ in parts] == [["0", "1"], ["2", "3"], ["4", "5", "6"]]
    assert [n for _, made in parts for n in made] == alive
    # Files are decoded row by row: pandas would hold a whole batch several times over.
    put(str(tmp_path / "t"), **{"a.json": json.dumps({"x": "y"}), "b.yml": "x: [", "c.json": b"\xff"})
    texts = tree.record_files(spark, str(tmp_path / "t"))
    assert "record_text" not in texts._jdf.queryExecution().optimizedPlan().toString()
    found = {r["path"]: (r["text"], r["problem"] is None) for r in texts.collect()}
    assert found == {"a.json": ('{"x": "y"}', True), "b.yml": (None, False), "c.json": (None, False)}
