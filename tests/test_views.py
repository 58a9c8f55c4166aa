import random

import pytest
from pyspark.errors import PySparkException

from recordloom.operators import groups
from recordloom.operators import views as V
from recordloom.plans.bundle import ViewError, run_views
from tests.conftest import rows


@pytest.fixture(scope="module")
def artists(spark):
    frame = spark.createDataFrame(
        [(0, "x", "A", [("m1", "gt"), ("m2", "dr")]), (1, "y", "B", []), (2, "z", None, None)],
        "o int, id string, name string, members array<struct<id string, plays string>>",
    )
    return V.source(frame, ["o"])


@pytest.fixture(scope="module")
def albums(spark):
    frame = spark.createDataFrame(
        [
            (0, "p", "y", 2001, True),
            (1, "q", "x", 1999, False),
            (2, "r", "x", 2005, True),
            (3, "s", None, 2000, False),
            (4, "t", "x", 1990, True),
        ],
        "o int, id string, artist string, year bigint, live boolean",
    )
    return V.source(frame, ["o"])


def out(frame):
    return rows(V.finish(frame.orderBy(*(["__ord"] if "__ord" in frame.columns else []))))


def test_select(artists):
    got = V.select(artists, ["id", {"item": "name", "as": "n"}, ("id", "key")])
    assert out(got) == [
        {"id": "x", "n": "A", "key": "x"},
        {"id": "y", "n": "B", "key": "y"},
        {"id": "z", "key": "z"},
    ]
    assert V.select(artists, []).columns == artists.columns
    twice = V.select(artists, [("id", "v"), ("o", "k"), ("name", "v")])
    assert V.finish(twice).columns == ["v", "k"]
    assert [r["v"] for r in out(twice)] == ["A", "B", "z"]


def test_flatten(artists):
    got = V.select(V.flatten(artists, "members", "m"), ["id", "m.plays"])
    assert out(got) == [{"id": "x", "m.plays": "gt"}, {"id": "x", "m.plays": "dr"}]
    kept = V.flatten(artists, "members", preserve_empty=True)
    assert [r["id"] for r in out(kept)] == ["x", "x", "y", "z"]
    assert V.finish(kept).columns[-1] == "members"
    for of, as_ in [("members", "name"), ("name", None)]:
        with pytest.raises(V.ClauseError):
            V.flatten(artists, of, as_)


def test_flatten_scalars_twice(spark):
    frame = spark.sql("select 1 as o, array(array(1, 2), array(3)) as a")
    got = V.flatten(V.flatten(V.source(frame, ["o"]), "a", "b"), "b")
    assert [r["b"] for r in out(got)] == [1, 2, 3]


def test_joins(artists, albums):
    pairs = V.join(artists, albums, ("id", "artist"), "album")
    assert [(r["id"], r["album"]["id"]) for r in out(pairs)] == [
        ("x", "q"), ("x", "r"), ("x", "t"), ("y", "p"),
    ]
    left = V.join(artists, albums, ("id", "artist"), "album", preserve_empty=True,
                  right_where={"live": False})
    assert [(r["id"], r.get("album", {}).get("id")) for r in out(left)] == [
        ("x", "q"), ("y", None), ("z", None),
    ]
    after = V.where(left, {"album.id": {"exists": True}})
    assert [r["id"] for r in out(after)] == ["x"]


def test_left_join_with_a_hot_right_key(artists, albums):
    plain = V.join(artists, albums, ("id", "artist"), "album", preserve_empty=True)
    hot = V.join(artists, albums, ("id", "artist"), "album", preserve_empty=True,
                 many=artists.select("id"))
    assert out(hot) == out(plain)


def test_left_join_with_keys_named_as_large(spark):
    left = spark.range(0, 40).selectExpr("id", "if(id % 4 = 0, 'hot', concat('k', id)) as k")
    right = spark.range(0, 60_000).selectExpr(
        "id as n", "if(id % 3 = 0, 'hot', concat('k', id % 20000)) as k")
    many = spark.createDataFrame([("hot",), ("absent",), ("k4",), (None,), ("hot",)], "k string")
    plain = V.join(left, right, ("k", "k"), "r", preserve_empty=True)
    hot = V.join(left, right, ("k", "k"), "r", preserve_empty=True, many=many)
    assert hot.exceptAll(plain).isEmpty() and plain.exceptAll(hot).isEmpty()


def test_attach(artists, albums):
    got = out(V.attach(artists, albums, ("id", "artist"), "albums"))
    assert [[a["id"] for a in r["albums"]] for r in got] == [["q", "r", "t"], ["p"], []]
    # A left row without the key keeps an empty list.
    got = out(V.attach(albums, artists, ("artist", "id"), "who"))
    assert [len(r["who"]) for r in got] == [1, 1, 1, 0, 1]


def test_kinds_of_key_never_mix(artists, albums):
    assert out(V.join(artists, albums, ("o", "artist"), "album")) == []
    left = V.join(artists, albums, ("o", "artist"), "album", preserve_empty=True)
    assert len(out(left)) == 3
    lists = out(V.attach(artists, albums, ("o", "artist"), "albums"))
    assert [r["albums"] for r in lists] == [[], [], []]


def test_grouped(albums):
    whole = V.where(albums, {"artist": {"exists": True}})
    got = out(V.grouped(whole, "artist", "albums"))
    assert [(r["artist"], [a["id"] for a in r["albums"]]) for r in got] == [
        ("y", ["p"]), ("x", ["q", "r", "t"]),
    ]
    assert got[0]["albums"][0] == {"o": 0, "id": "p", "artist": "y", "year": 2001, "live": True}
    with pytest.raises(PySparkException, match="no 'artist'"):
        V.grouped(albums, "artist", "albums").collect()


def test_dotted_group_key(artists):
    flat = V.flatten(artists, "members", "m")
    got = V.select(V.grouped(flat, "m.plays", "rows"), ["m.plays", "rows"])
    assert V.finish(got).columns == ["m.plays", "rows"]
    assert out(got)[0]["m.plays"] == "gt"


def test_one_list_per_key_at_any_size_and_the_same_rows_flat(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["hot", "hot", f"k{i % 7}"]), i * 3) for i in range(3000)]
    rng.shuffle(data)
    frame = V.source(spark.createDataFrame(data, "o int, k string, v int").repartition(7), ["o"])
    expected = {}
    for o, k, _ in sorted(data):
        expected.setdefault(k, []).append(o)
    got = rows(V.finish(V.grouped(frame, "k", "items")))
    assert {r["k"]: [i["o"] for i in r["items"]] for r in got} == expected
    flat = rows(V.finish(V.grouped(frame, "k", "item", flat=True)))
    assert sorted((r["k"], r["item"]["o"]) for r in flat) == sorted((k, o) for o, k, _ in data)


def test_counted_rows_repeated_are_the_rows(spark, monkeypatch):
    monkeypatch.setattr(groups, "REPEATS", 7)
    data = [(["a", "b", None][i % 3], [None, "x"][i % 2]) for i in range(101)]
    tally = groups.counted(spark.createDataFrame(data, "k string, `v.w` string"), ["k", "v.w"], "times")
    assert tally.count() == 6
    got = groups.repeated(tally, "times")
    assert got.columns == ["k", "v.w"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, data))
    odd = spark.createDataFrame([(1, None), (2, -3), (3, 0), (4, 1), (5, 7), (6, 8)], "k int, times int")
    assert sorted(r["k"] for r in groups.repeated(odd, "times").collect()) == [4] + [5] * 7 + [6] * 8


def test_attach_flat_is_a_row_per_item(artists, albums):
    got = out(V.attach(artists, albums, ("id", "artist"), "album", flat=True))
    assert [(r["id"], r.get("album", {}).get("id")) for r in got] == [
        ("x", "q"), ("x", "r"), ("x", "t"), ("y", "p"), ("z", None),
    ]


def test_no_job_runs_while_views_are_built(spark, artists, albums):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "views")
    run_views({"artists": artists, "albums": albums}, {
        "v": {"from": "artists", "join": [
            {"to": "albums", "on": {"left": "id", "right": "artist"}, "as": "a"},
            {"to": "albums", "on": {"left": "id", "right": "artist"}, "as": "b",
             "flatten": {"preserve_empty": True}}]},
        "g": {"from": "v", "grouped": {"by": "id"}, "sort": {"by": "id"}}})
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext._jsc.clearJobGroup()


@pytest.mark.parametrize(
    ("direction", "missing", "expected"),
    [
        ("asc", "last", "bdac"), ("asc", "first", "cbda"),
        ("desc", "last", "abdc"), ("desc", "first", "cabd"),
    ],
)
def test_sort(spark, direction, missing, expected):
    frame = V.source(
        spark.createDataFrame(
            [(0, "a", 2), (1, "b", 1), (2, "c", None), (3, "d", 1)], "o int, id string, x int"
        ),
        ["o"],
    )
    got = rows(V.finish(V.sort(frame, "x", direction, missing)))
    assert "".join(r["id"] for r in got) == expected


def test_bundle(artists, albums):
    sources = {"artists": artists, "albums": albums}
    specs = {
        "named": {
            "from": "by_artist",
            "join": {"to": "artists", "on": {"left": "artist", "right": "id"},
                     "as": "found", "flatten": {"as": "who"}},
            "select": [{"item": "who.name", "as": "name"}, {"item": "albums"}],
            "sort": {"by": "name"},
        },
        "by_artist": {
            "from": "albums",
            "where": {"artist": {"exists": True}},
            "grouped": {"by": "artist"},
        },
        "members": {
            "from": "artists",
            "flatten": [{"of": "members", "as": "member"}],
            "select": [{"item": "id"}, {"item": "member.plays", "as": "plays"}],
        },
        "multi": {
            "from": "albums",
            "join": [
                {"to": "artists", "on": {"left": "artist", "right": "id"}, "as": "a",
                 "flatten": True},
                {"to": "albums", "on": {"left": "a.id", "right": "artist"}, "as": "more",
                 "where": {"live": True}},
            ],
            "where": {"year": {"gte": 2000}},
            "select": [{"item": "id"}, {"item": "more"}],
        },
    }
    views = run_views(sources, specs)
    assert list(views) == list(specs)
    assert [(r["name"], len(r["albums"])) for r in rows(views["named"])] == [("A", 3), ("B", 1)]
    assert len(rows(views["members"])) == 2
    got = {r["id"]: [m["id"] for m in r["more"]] for r in rows(views["multi"])}
    assert got == {"p": ["p"], "r": ["r", "t"]}


def test_bundle_problems(spark, artists):
    sources = {"artists": artists}
    with pytest.raises(ViewError) as caught:
        run_views(
            sources,
            {
                "bad": {"from": "artists", "where": {"nope": 1}},
                "reader": {"from": "bad", "select": [{"item": "nope"}]},
                "other": {"from": "missing"},
                "odd": {"from": "artists", "limit": 3},
            },
        )
    assert sorted(p.view for p in caught.value.problems) == ["bad", "odd", "other"]
    with pytest.raises(ViewError, match="waits for itself"):
        run_views(sources, {"a": {"from": "b"}, "b": {"from": "a"}})
    with pytest.raises(ViewError) as caught:
        run_views(
            sources,
            [("__x", {"from": "artists"}), ("artists", {"from": "artists"}),
             ("v", {"from": "artists"}), ("v", {"from": "artists"})],
        )
    assert [p.view for p in caught.value.problems] == ["__x", "artists", "v"]
    empty = run_views({}, {"v": {"from": "albums"}}, declared={"albums": artists.schema},
                      spark=spark)
    assert rows(empty["v"]) == []


def test_nest_then_flatten_equals_join(spark):
    """Attaching lists and unwinding them gives the rows of the plain joins."""
    rng = random.Random(11)
    for _ in range(3):
        key = lambda: rng.choice(["a", "b", "c", "d", None])
        left = spark.createDataFrame([(i, key()) for i in range(12)], "id int, k string")
        right = spark.createDataFrame([(i, key()) for i in range(12)], "id int, k string")
        left, right = V.source(left, ["id"]), V.source(right, ["id"])
        for keep in (False, True):
            nested = V.flatten(V.attach(left, right, ("k", "k"), "r"), "r", preserve_empty=keep)
            plain = V.join(left, right, ("k", "k"), "r", preserve_empty=keep)
            assert out(nested) == out(plain)


def test_filter_reaches_the_scan_below_a_join(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 as v", "'t' as wide").write.parquet(str(tmp_path / "r"))
    right = spark.read.parquet(str(tmp_path / "r"))
    left = spark.range(5).toDF("k")
    got = V.select(V.where(V.join(left, right, ("k", "id"), "r"), {"r.v": {"gt": 4}}), ["k", "r.v"])
    plan = got._jdf.queryExecution().toString()
    assert "GreaterThan(v,4)" in plan
    assert "ReadSchema: struct<id:bigint,v:bigint>" in plan
