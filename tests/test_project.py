import json
import os

import pytest

from recordloom.operators.checks import GateClosed
from recordloom.plans.project import (
    Project,
    check_tree,
    load_config,
    load_editions,
    load_views,
    namespace,
    pages,
    read_project,
    tap,
)
from tests.conftest import rows
from tests.test_sources import put

SCHEMA = """
type: object
additionalProperties: false
properties:
  members:
    type: object
    additionalProperties:
      type: object
      additionalProperties: false
      required: [name]
      properties:
        name: {type: string}
        role: {type: string}
        active: {type: boolean}
        bio: {type: string, x-ref: {entity: prose}}
  overview:
    type: object
    additionalProperties: false
    properties:
      title: {type: string}
"""
VIEWS = """
active_members:
  from: members
  where: {active: true}
by_role:
  from: members
  grouped: {by: role}
  sort: {by: role, direction: desc}
bios:
  from: members
  join:
    to: prose
    on: {left: bio, right: id}
    as: found
    flatten: {as: text, preserve_empty: true}
  select:
  - item: id
  - {item: text.title, as: title}
"""


@pytest.fixture
def project(tmp_path):
    put(str(tmp_path), **{
        "schema.yaml": SCHEMA, "views/v.yaml": VIEWS,
        "reports.yaml": "editions:\n  web: {file_per: [members.item, active_members.item]}\n  one: {}\n",
        "c/members.yaml": "members:\n  ann: {name: Ann, role: dev, active: true, bio: people/ann}\n"
                          "  bob: {name: Bob, role: ops, active: false, bio: people/bob}\n",
        "c/more.json": '{"members": {"cyd": {"name": "Cyd", "role": "dev", "active": true}},'
                       ' "overview": {"title": "Team"}}',
        "c/people/ann.md": "# Ann A.\n\n[pic](../img/a.png)\n",
        "c/img/a.png": b"x",
        "c/notes.yaml": "prose:\n- {id: notes, mime_type: text/plain, content: '# raw [x](y.md)'}\n",
    })
    root = str(tmp_path)
    return Project(
        f"{root}/c", load_config(f"{root}/schema.yaml"), load_views(f"{root}/views"),
        load_editions(load_config(f"{root}/reports.yaml")),
    )


def test_project(spark, project, tmp_path):
    tree = read_project(spark, project)
    found = rows(check_tree(project, tree))
    assert [(r["severity"], r["path"], r["record"]) for r in found] == [
        ("warning", "members.bio", "bob")
    ]
    out = str(tmp_path / "out")
    assert tap(spark, project, out) == {"warning": 1}
    with pytest.raises(GateClosed):
        tap(spark, project, out, strict=True)
    names = {"members", "overview", "prose", "blob", "active_members", "by_role", "bios",
             "__definition.entities", "__definition.views", "__entity_tree", "__entity_defs",
             "__data", "__view_defs"}
    assert set(os.listdir(out)) == names

    def read(name):
        return [json.loads(line) for f in sorted(os.listdir(f"{out}/{name}"))
                if f.endswith(".json") for line in open(f"{out}/{name}/{f}", encoding="utf-8")]

    assert [r["id"] for r in read("members")] == ["ann", "bob", "cyd"]
    assert read("bios") == [{"id": "ann", "title": "Ann A."}, {"id": "bob"}, {"id": "cyd"}]
    prose = {r["id"]: r for r in read("prose")}
    assert prose["people/ann"]["content"] == "# Ann A.\n\n[pic](node:/blob/img/a.png)\n"
    assert prose["notes"] == {"id": "notes", "order_key": "notes", "depth": 2,
                              "mime_type": "text/plain", "content": "# raw [x](y.md)"}
    roles = {r["role"]: [m["id"] for m in r["members"]] for r in read("by_role")}
    assert roles == {"ops": ["bob"], "dev": ["ann", "cyd"]}

    frames, origins = namespace(project, tree)
    assert origins["active_members.item"] == "members.item"
    assert origins["by_role.item.members.item"] == "members.item"
    placed = {(r["edition"], r["address"]): r["page_path"] for r in rows(pages(project, tree))}
    assert placed["web", "/active_members/ann"] == "active_members/ann.md"
    assert placed["web", "/prose/people/ann#ann-a"] == "index.md"
    assert placed["one", "/members/ann"] == "index.md" and ("one", "/overview") in placed
    assert ("web", "/__definition/entities/members") in placed


def test_bad_content_blocks(spark, project, tmp_path):
    put(project.root, **{"bad.yaml": "members:\n  ann: {name: 5}\nblob:\n- {id: x, mime_type: y}\n"})
    found = rows(check_tree(project, read_project(spark, project)))
    assert sorted(r["source"] for r in found if r["severity"] == "error") == [
        "blob-data", "duplicate-id", "duplicate-id", "schema-type",
    ]
    with pytest.raises(GateClosed):
        tap(spark, project, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")


def test_editions():
    assert load_editions({"file_per": ["a.item"]}) == {"default": ["a.item"]}
    assert load_editions({"editions": {"web": {"file_per": ["a"]}, "pdf": {}}}) == {
        "web": ["a"], "pdf": [],
    }
    with pytest.raises(ValueError):
        load_editions({"editions": {"__x": {}}})
