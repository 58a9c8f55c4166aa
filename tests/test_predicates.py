import pytest

from recordloom.functions.paths import PathError, resolve
from recordloom.functions.predicates import predicate
from tests.conftest import rows


def kept(frame, clause):
    return [r["id"] for r in rows(frame.filter(predicate(frame, clause)).select("id"))]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            ("a", "active", 1, 1.0, True, ""),
            ("b", None, 2, 2.5, False, None),
            ("c", "inactive", 0, 0.0, None, "x%y"),
        ],
        "id string, status string, n bigint, d double, flag boolean, note string",
    )


@pytest.mark.parametrize(
    ("clause", "expected"),
    [
        ({"status": "active"}, "a"),
        ({"not": {"status": "active"}}, "bc"),
        ({"not": {"not": {"status": "active"}}}, "a"),
        ({"n": 1}, "a"),
        ({"n": 1.0}, "a"),
        ({"n": 1.5}, ""),
        ({"n": "1"}, ""),
        ({"n": True}, ""),
        ({"not": {"n": "1"}}, "abc"),
        ({"d": 1}, "a"),
        ({"flag": True}, "a"),
        ({"flag": 1}, ""),
        ({"flag": {"gt": 0}}, ""),
        ({"not": {"flag": {"gt": 0}}}, "abc"),
        ({"status": {"gt": 0}}, ""),
        ({"n": {"gt": 1}}, "b"),
        ({"n": {"gt": 0.5}}, "ab"),
        ({"n": {"gte": 0.5}}, "ab"),
        ({"n": {"lt": 1.5}}, "ac"),
        ({"n": {"lte": 1.5}}, "ac"),
        ({"n": {"lt": float("inf")}}, "abc"),
        ({"n": {"gt": float("inf")}}, ""),
        ({"n": {"lt": 10**30}}, "abc"),
        ({"n": {"gt": 0, "lt": 2}}, "a"),
        ({"d": {"gte": 1, "lte": 2.5}}, "ab"),
        ({"not": {"d": {"gte": 1}}}, "c"),
        ({"status": {"startswith": "act"}}, "a"),
        ({"not": {"status": {"startswith": "act"}}}, "bc"),
        ({"status": {"startswith": "Act"}}, ""),
        ({"status": {"endswith": "active"}}, "ac"),
        ({"status": {"contains": "ina"}}, "c"),
        ({"note": {"contains": "%"}}, "c"),
        ({"n": {"contains": "1"}}, ""),
        ({"note": {"exists": True}}, "ac"),
        ({"note": {"exists": False}}, "b"),
        ({"not": {"note": {"exists": False}}}, "ac"),
        ({"note": ""}, "a"),
        ({"n": 0, "flag": {"exists": False}}, "c"),
        ({"or": [{"n": 2}, {"status": "active"}]}, "ab"),
        ({"and": [{"n": {"gt": 0}}, {"flag": False}]}, "b"),
        ({"not": {"or": [{"n": 2}, {"status": "active"}]}}, "c"),
        ({"not": {"and": [{"n": {"gt": 0}}, {"status": "active"}]}}, "bc"),
        ({"not": {"status": "active", "n": 1}}, "bc"),
        ({}, "abc"),
        ({"or": []}, ""),
    ],
)
def test_truth_table(people, clause, expected):
    assert "".join(kept(people, clause)) == expected


def test_bad_targets(people):
    for clause, error in [
        ({"n": {"gt": "1"}}, TypeError),
        ({"n": {"gt": True}}, TypeError),
        ({"status": {"startswith": 1}}, TypeError),
        ({"status": {"like": "x"}}, ValueError),
        ({"missing": 1}, PathError),
        ({"not": [{"n": 1}]}, TypeError),
    ]:
        with pytest.raises(error):
            predicate(people, clause)


def test_paths(spark):
    frame = spark.sql(
        "select 'r' as id, 1 as `a.b`, named_struct('b', 2, 'c', 3, 'd.e', 4) as a,"
        " array(named_struct('x', 1)) as list"
    )
    read = lambda p: frame.select(resolve(frame, p).column.alias("v")).head()["v"]
    assert (read("a.b"), read("a.c"), read("a.d.e")) == (1, 3, 4)
    for path in ("list.x", "a.z", "A", "a.b.c"):
        with pytest.raises(PathError):
            resolve(frame, path)
    assert kept(frame, {"a.c": {"gt": 2}}) == ["r"]


def test_literal_name_wins_per_record(spark):
    frame = spark.sql(
        "select * from values (1, named_struct('b', 2)), (cast(null as int), named_struct('b', 3))"
        " as t(`a.b`, a)"
    )
    found = frame.select(resolve(frame, "a.b").column.alias("v"))
    assert sorted(r["v"] for r in rows(found)) == [1, 3]


def test_positive_tests_reach_parquet(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "p"))
    frame = spark.read.parquet(str(tmp_path / "p"))
    plan = lambda c: frame.filter(predicate(frame, c))._jdf.queryExecution().toString()
    pushed = lambda c: [l for l in plan(c).splitlines() if "PushedFilters" in l][0]
    assert "GreaterThan(n,0)" in pushed({"n": {"gt": 0.5}})
    assert "StringStartsWith(status,act)" in pushed({"status": {"startswith": "act"}})
    assert "Not(EqualNullSafe(status,active))" in pushed({"not": {"status": "active"}})
    assert "IsNull(n)" in pushed({"not": {"n": {"gt": 1}}})
