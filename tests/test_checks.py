import json

import pytest
from pyspark.sql import functions as F

from recordloom.operators import checks as C
from recordloom.sources.schema import (
    SchemaProblem,
    checked,
    entities,
    raw_type,
    reference_problems,
    row_type,
)
from recordloom.sources.tree import read_entities
from tests.conftest import rows


def obj(required=(), **props):
    return {"type": "object", "additionalProperties": False, "properties": props,
            "required": list(required)}


def keyed(value):
    return {"type": "object", "additionalProperties": value}


STRING, INTEGER = {"type": "string"}, {"type": "integer"}
SCHEMA = obj(
    artists=keyed(obj(
        ["name"],
        name={"type": "string", "minLength": 2, "pattern": r"^\p{Lu}"},
        kind={"type": "string", "enum": ["band", "solo"]},
        members=keyed(obj(plays=STRING, of={"type": "string", "x-ref": {"entity": "albums"}})),
        tags={"type": "array", "items": STRING, "uniqueItems": True, "maxItems": 3},
        home=obj(city=STRING, label={"type": "string", "x-ref": {"entity": "albums"}}),
    )),
    albums={"type": "array", "items": obj(
        ["id"], id=STRING,
        artist={"type": "string", "x-ref": {"entity": "artists", "attribute": "id"}},
        year={"type": "integer", "minimum": 1900, "exclusiveMaximum": 2100, "multipleOf": 2},
        rate={"type": "number", "maximum": 5}, live={"type": "boolean", "const": True},
    )},
    words=keyed(INTEGER),
    about=obj(title=STRING, notes={"type": "array", "items": STRING}, deep=obj(a=STRING, b=STRING)),
)


def files(spark, *bodies):
    data = [(p, p.split("/"), b if isinstance(b, str) else json.dumps(b), None) for p, b in bodies]
    return spark.createDataFrame(
        data, "path string, parts array<string>, text string, problem string"
    )


def test_maps_become_rows(spark):
    frames = read_entities(files(
        spark,
        ("b.json", {"artists": {"z": {"name": "Zed"}, "10": {"name": "Ten", "members": {
            "m": {"plays": "gt"}, "a": {}}}}, "words": {"w": 1, "v": 2.0}}),
        ("a.json", {"artists": {"y": {"name": "Why", "tags": []}},
                    "albums": [{"id": "p", "year": 2000.0, "rate": 1}],
                    "about": {"title": "A", "notes": ["1"], "deep": {"a": "x"}}}),
        ("a-b/x.json", {"albums": [{"id": "q"}], "about": {"notes": ["3"], "deep": {"b": "q"}}}),
        ("a/b.json", {"albums": [{"id": "r"}], "about": {"title": "B", "notes": ["2"]}}),
    ), SCHEMA)
    got = lambda n: rows(frames[n].orderBy("__ord").drop("__ord"))
    assert got("artists") == [
        {"id": "y", "name": "Why", "tags": []},
        {"id": "z", "name": "Zed"},
        {"id": "10", "name": "Ten", "members": [{"id": "m", "plays": "gt"}, {"id": "a"}]},
    ]
    assert got("words") == [{"id": "w", "value": 1}, {"id": "v", "value": 2}]
    assert got("albums") == [
        {"id": "r"}, {"id": "q"}, {"id": "p", "year": 2000, "rate": 1.0},
    ]
    assert got("about") == [
        {"title": "A", "notes": ["2", "3", "1"], "deep": {"a": "x", "b": "q"}}
    ]


def test_schema_types():
    kind = row_type(SCHEMA["properties"]["artists"])
    assert kind.names == ["id", "name", "kind", "members", "tags", "home"]
    assert kind["members"].dataType.elementType.names == ["id", "plays", "of"]
    assert kind["name"].metadata["required"] is True
    assert raw_type(INTEGER).simpleString() == "string"
    assert checked(SCHEMA) == ["artists", "albums", "words", "about"]


@pytest.mark.parametrize(
    "bad",
    [
        {"type": "array", "items": STRING},
        obj(a={"type": "null"}),
        obj(a={"type": ["string", "null"]}),
        obj(a={"type": "string", "nullable": True}),
        obj(a={"type": "object"}),
        obj(a={"type": "object", "properties": {}, "additionalProperties": STRING}),
        obj(a=obj(["x"], y=STRING)),
    ],
)
def test_refused_schemas(bad):
    with pytest.raises(SchemaProblem):
        entities(bad)


def test_reference_coherence():
    bad = obj(a=keyed(obj(r={"type": "string", "x-ref": {"entity": "nope"}},
                          s={"type": "string", "x-ref": {"entity": "a", "attribute": "no"}})))
    assert len(reference_problems(bad)) == 2
    assert reference_problems(SCHEMA) == []


def test_text_rules(spark):
    table = files(
        spark,
        ("ok.json", {"artists": {"x": {"name": "Élan", "kind": "band", "tags": ["a", "b"]}},
                     "albums": [{"id": "p", "year": 2000.0, "rate": 5, "live": True}],
                     "words": {"w": 1}}),
        ("bad.json", {"artists": {"x": {"name": "a", "kind": "duo", "extra": 1, "tags": ["a"] * 4},
                                  "y": {"members": {"m": {"plays": 1}}}},
                      "albums": [{"year": 1899, "rate": "5", "live": False}, {"id": None},
                                 {"id": "z", "year": 2100.5}],
                      "words": {"w": True}, "nope": 1}),
        ("dup.json", '{"words": {"a": 1, "a": 2}}'),
        ("list.json", "[1]"),
    )
    found = rows(C.text_violations(table, SCHEMA))
    got = sorted((r["record"], r["path"], r["source"].removeprefix("schema-")) for r in found)
    assert got == sorted([
        ("bad.json", "/artists/x/name", "minLength"),
        ("bad.json", "/artists/x/name", "pattern"),
        ("bad.json", "/artists/x/kind", "enum"),
        ("bad.json", "/artists/x", "additionalProperties"),
        ("bad.json", "/artists/x/tags", "maxItems"),
        ("bad.json", "/artists/x/tags", "uniqueItems"),
        ("bad.json", "/artists/y", "required"),
        ("bad.json", "/artists/y/members/m/plays", "type"),
        ("bad.json", "/albums/0", "required"),
        ("bad.json", "/albums/0/year", "minimum"),
        ("bad.json", "/albums/0/year", "multipleOf"),
        ("bad.json", "/albums/0/rate", "type"),
        ("bad.json", "/albums/0/live", "const"),
        ("bad.json", "/albums/1/id", "type"),
        ("bad.json", "/albums/2/year", "type"),
        ("bad.json", "/words/w", "type"),
        ("bad.json", "", "additionalProperties"),
        ("dup.json", "", "syntax"),
        ("list.json", "", "syntax"),
    ])
    assert {r["entity"] for r in found if r["path"].startswith("/albums")} == {"albums"}


def test_typed_rules(spark):
    frame = spark.sql(
        "select * from values ('p', 'a', 1899L, array('x', 'x'), 1), ('q', null, 2000L, null, null)"
        " as t(id, name, year, tags, extra)"
    )
    schema = keyed(obj(["name"], name=STRING, year={"type": "integer", "minimum": 1900},
                       tags={"type": "array", "items": STRING, "uniqueItems": True, "minItems": 3},
                       gone=STRING))
    got = rows(C.schema_violations(frame, "t", schema, F.col("id")))
    assert sorted((r["record"], r["path"], r["source"]) for r in got) == [
        ("p", "", "schema-additionalProperties"), ("p", "/tags", "schema-minItems"),
        ("p", "/tags", "schema-uniqueItems"), ("p", "/year", "schema-minimum"),
        ("q", "", "schema-required"),
    ]


def test_references(spark):
    frames = read_entities(files(spark, ("a.json", {
        "artists": {"x": {"members": {"m": {"of": "p"}, "n": {"of": "gone"}},
                          "home": {"label": "lost"}}, "y": {}},
        "albums": [{"id": "p", "artist": "x"}, {"id": "q", "artist": "zz"},
                   {"id": "r", "artist": "zz"}, {"id": "s"}],
    })), SCHEMA)
    got = rows(C.check_references(frames, SCHEMA))
    assert sorted((r["path"], r["record"], r["severity"]) for r in got) == [
        ("albums.artist", "q", "warning"), ("albums.artist", "r", "warning"),
        ("artists.home.label", "x", "warning"), ("artists.members.of", "x", "warning"),
    ]
    assert "'zz', which no artists has as its id" in got[-1]["message"] + got[0]["message"]
    flat = rows(C.check_references(frames, SCHEMA, inside_structs=False))
    assert len(flat) == 3
    empty = {"albums": frames["albums"], "artists": frames["artists"].filter("false")}
    assert len(rows(C.check_references(empty, SCHEMA))) == 3
    numbers = spark.sql("select 1 as id")
    assert rows(C.dangling(frames["albums"], "artist", numbers, "id")) != []


def test_duplicate_ids(spark):
    frames = read_entities(files(
        spark,
        ("a.json", '{"artists": {"x": {"members": {"m": {}, "m": {}, "n": {}}}}}'),
        ("b.json", {"artists": {"x": {}, "y": {"members": {"m": {}}}},
                    "albums": [{"id": "1"}, {"id": "1"}, {"id": "2"}, {}, {}]}),
    ), SCHEMA)
    got = rows(C.check_duplicate_ids(frames, SCHEMA))
    assert sorted(r["message"] for r in got) == [
        "'1' is the id of several rows of albums", "'1' is the id of several rows of albums",
        "'m' is the id of several rows of artists/x/members", "'m' is the id of several rows of artists/x/members",
        "'x' is the id of several rows of artists", "'x' is the id of several rows of artists",
    ]


def test_gate_and_log(spark, tmp_path):
    blobs = C.check_handwritten_blobs(spark.sql("select 'a.png' as id"))
    warn = blobs.withColumn("severity", F.lit("warning"))
    assert C.gate(warn) == {"warning": 1}
    with pytest.raises(C.GateClosed):
        C.gate(warn, strict=True)
    assert len(rows(C.deduplicated(C.report([blobs, blobs, warn], spark)))) == 2
    ran = []
    stages = [("read", lambda: warn), ("check", lambda: blobs), ("write", lambda: ran.append(1))]
    log = str(tmp_path / "log")
    assert C.run_stages(spark, stages, log) == [
        ("read", "ok"), ("check", "ng"), ("write", "skipped"),
    ]
    assert ran == [] and spark.read.parquet(log).count() == 3


def test_duplicate_ids_are_counted_and_not_joined(spark, monkeypatch):
    monkeypatch.setattr(C, "AT_ONCE", 4)
    ids = spark.createDataFrame([(i,) for i in [None, None, 1, 2, 2, *[3] * 9, *[4] * 8]], "id bigint")
    found = C.check_duplicate_ids({"albums": ids}, obj(albums={"type": "array", "items": obj(id={"type": "integer"})}))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    counts = {r["record"]: r["count"] for r in found.groupBy("record").count().collect()}
    assert counts == {"2": 2, "3": 9, "4": 8}
