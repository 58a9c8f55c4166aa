import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from recordloom.operators import checks as C
from recordloom.operators import nodes as N
from recordloom.operators import prose as P
from recordloom.sources.schema import is_single
from recordloom.sources.tree import read_blobs, read_entities, read_prose, record_files
from recordloom.streaming import tracked
from recordloom.streaming.tracked import TrackedTree
from tests.conftest import rows
from tests.test_checks import SCHEMA
from tests.test_sources import put


def plain(frame):
    return sorted(json.dumps(r, sort_keys=True, default=str) for r in rows(frame.drop("__ord")))


def same_as_a_full_read(spark, tree):
    """The kept rows and findings against reading everything again."""
    files = record_files(spark, tree.root)
    full = read_entities(files, SCHEMA)
    full |= {"prose": read_prose(spark, tree.root), "blob": read_blobs(spark, tree.root)}
    kept = tree.entities()
    assert set(kept) == set(full)
    for name in full:
        assert plain(kept[name]) == plain(full[name]), name
    assert plain(tree.findings()) == plain(C.text_violations(files, SCHEMA))
    frames = {n: f for n, f in full.items() if n in SCHEMA["properties"] and not is_single(SCHEMA["properties"][n])}
    wanted = C.check_references(frames, SCHEMA)
    got = tree.dangling()
    assert sorted((r["entity"], r.get("record"), r["field"]) for r in rows(got)) == sorted(
        (r["entity"], r.get("record"), r["path"]) for r in rows(wanted))
    nodes = N.node_index({**{n: f for n, f in full.items() if n != "prose"}, "prose": full["prose"].select(
        "id", "mime_type", P.heading_array(F.col("content")).alias("headings"))}, single=["about"])
    nodes = spark.createDataFrame(nodes.collect(), nodes.schema)
    wanted = P.broken_links(P.node_links(P.link_table(full["prose"])), nodes)
    assert plain(tree.broken_links()) == plain(wanted)
    twice = sorted((n, r["id"], r["count"]) for n, f in frames.items() if "id" in f.columns
                   for r in rows(C.duplicate_rows(f).groupBy("id").count()))
    assert sorted((r["entity"], r["id"], r["rows"]) for r in rows(tree.duplicates())) == twice


def record(**parts):
    return json.dumps(parts)


def start(root):
    put(root, **{
        "a.json": record(albums=[{"id": "p", "artist": "x"}, {"id": "q", "artist": "gone"}], about={"title": "1", "notes": ["n1"]}),
        "b.yaml": "artists:\n  x: {name: Xé, home: {label: p}}\n  y: {name: y}\n",
        "c/d.json": record(albums=[{"id": "q", "artist": "y"}], words={"w": 1}),
        "bad.json": "{",
        "t/one.md": "# One\n", "t/_two.MD": "two", "i.png": b"\x89", "é.md": "decomposed",
    })


def test_adds_edits_and_deletions(spark, tmp_path):
    root = str(tmp_path / "in")
    start(root)
    tree = TrackedTree(spark, root, SCHEMA, str(tmp_path / "kept"))
    assert tree.sync().filter("change = 'added'").count() == 8
    same_as_a_full_read(spark, tree)
    assert tree.sync().count() == 0 and tree.last == 1
    # An id goes, a missing one comes, a broken file is mended, prose is edited.
    put(root, **{
        "b.yaml": "artists:\n  gone: {name: Gone}\n  y: {name: Yes, members: {m: {of: nope}}}\n",
        "bad.json": record(albums=[{"id": "r", "artist": "y", "year": 1}], about={"notes": ["n2"]}),
        "t/one.md": "# Other\n", "new.md": "new",
    })
    os.remove(f"{root}/c/d.json")
    os.remove(f"{root}/i.png")
    got = {r["path"]: r["change"] for r in rows(tree.sync())}
    assert got == {"b.yaml": "modified", "bad.json": "modified", "t/one.md": "modified", "new.md": "added",
                   "c/d.json": "deleted", "i.png": "deleted"}
    same_as_a_full_read(spark, tree)
    # Another file takes over the id of a deleted one; a reader opens the folder anew.
    put(root, **{"z.json": record(artists={"x": {"name": "Xe"}}, albums=[{"id": "r"}])})
    os.remove(f"{root}/bad.json")
    again = TrackedTree(spark, root, SCHEMA, str(tmp_path / "kept"))
    assert again.sync().count() == 2 and again.last == 3
    same_as_a_full_read(spark, again)


def test_many_runs_are_written_together(spark, tmp_path):
    root = str(tmp_path / "in")
    start(root)
    tree = TrackedTree(spark, root, SCHEMA, str(tmp_path / "kept"), most_runs=2)
    for k in range(3):
        put(root, **{f"r{k}.json": record(albums=[{"id": f"k{k}", "artist": "y"}])})
        tree.sync()
    assert len({r["run"] for r in rows(tree.snapshot())}) <= 2
    put(root, **{"again.json": record(albums=[{"id": "k0"}, {"id": "p"}])})
    os.remove(f"{root}/i.png")
    tree.sync()
    assert sum(n.startswith("run-") for n in os.listdir(tree.home)) <= 3
    same_as_a_full_read(spark, tree)


def test_a_failed_run_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "in")
    start(root)
    tree = TrackedTree(spark, root, SCHEMA, str(tmp_path / "kept"))
    tree.sync()
    before = plain(tree.entities()["albums"])
    put(root, **{"a.json": record(albums=[{"id": "only"}])})

    def fail(*_):
        raise OSError("injected")

    with monkeypatch.context() as patch:
        patch.setattr(TrackedTree, "_check", fail)
        with pytest.raises(OSError):
            tree.sync()
    assert tree.last == 1 and plain(tree.entities()["albums"]) == before
    with monkeypatch.context() as patch:
        patch.setattr(tracked, "_mark_done", fail)
        with pytest.raises(OSError):
            tree.sync()
    assert tree.last == 1 and plain(tree.entities()["albums"]) == before
    tree.sync()
    same_as_a_full_read(spark, tree)


def test_a_stream_of_all_kinds(spark, tmp_path):
    root, home = str(tmp_path / "in +1"), str(tmp_path / "kept")
    start(root)
    os.rename(f"{root}/t/_two.MD", f"{root}/t/two.MD")
    tree = TrackedTree(spark, root, SCHEMA, home)
    run = lambda: tree.stream(str(tmp_path / "cp"), max_files=3).awaitTermination()
    run()
    assert tree.last == 3
    put(root, **{"later.md": "later", "later.yml": "albums: [{id: s}]"})
    run()
    same_as_a_full_read(spark, tree)
    # What the stream does not see, a look at the whole tree does.
    shutil.rmtree(f"{root}/c")
    put(root, **{"later.md": "edited"})
    assert {r["change"] for r in rows(tree.sync())} == {"deleted", "modified"}
    same_as_a_full_read(spark, tree)


def test_only_changed_files_are_opened(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "in")
    put(root, **{f"f{i}.json": record(albums=[{"id": f"a{i}", "artist": "y"}]) for i in range(30)})
    tree = TrackedTree(spark, root, SCHEMA, str(tmp_path / "kept"))
    tree.sync()
    opened = []
    real = tracked.contents
    monkeypatch.setattr(tracked, "contents", lambda files, at: opened.extend(
        r["path"] for r in files.collect()) or real(files, at))
    put(root, **{"f3.json": record(albums=[{"id": "other"}])})
    tree.sync()
    assert opened == ["f3.json"]


def test_a_stream_lists_no_file_by_its_own_path(spark, tmp_path, monkeypatch):
    """A batch is a list of names found by tasks, of the stated length, and no path of
    its own to the files' relation: Spark would look each of those up in a task."""
    root, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    put(root, **{f"f{i}.md": "x" for i in range(10)}, **{"_hidden.md": "x", "d/g.png": ""})
    batches = []
    tree = TrackedTree(spark, root, SCHEMA, str(tmp_path / "kept"))
    monkeypatch.setattr(tree, "_apply", lambda found: batches.append(
        (found.count(), [f for f in found.inputFiles() if f.startswith(f"file://{root}/")])))
    tree.stream(checkpoint, max_files=4).awaitTermination()
    put(root, **{"later.md": "x"})
    os.utime(f"{root}/later.md", (1, 1))
    tree.stream(checkpoint, max_files=4).awaitTermination()
    tree.stream(checkpoint, max_files=4).awaitTermination()
    assert sorted(n for n, _ in batches if n) == [1, 3, 4, 4]
    assert not any(paths for _, paths in batches)
