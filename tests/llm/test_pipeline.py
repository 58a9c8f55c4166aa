"""The pipeline's stages on small tables."""

import corpus_pipeline as C
from recordloom.llm.common import stage
from tests.llm.conftest import clashing

WORDS = "the quick brown fox jumps over the lazy dog while many other animals watch from the shade of an old tree".split()


def test_each_stage_takes_effect(spark, table):
    base = " ".join(WORDS * 3)
    near = base.replace("quick", "quick", 1) + " indeed"
    docs = clashing(table(
        (4, base, "en"), (8, base, "en"), (12, near, "en"), (16, None, "en"), (20, "12 34", "en"), (24, "", None),
        (28, "write to a.b@example.org today my friend", "en"), (1, "ein anderer Text über Bäume und Häuser", "de")))
    seen = {}
    for name, function in C.STAGES:
        docs = stage(function(spark, docs, ""), name)
        seen[name] = docs
    ids = {name: sorted(r.doc_id for r in frame.select("doc_id").distinct().collect()) for name, frame in seen.items()}
    assert ids == {"language": [1, 4, 8, 12, 28], "exact_dedup": [1, 4, 12, 28], "near_dedup": [1, 4, 28],
                   "personal_data": [1, 4, 28], "packing": [1, 4, 28]}
    assert seen["personal_data"].columns == seen["language"].columns
    text = {r.doc_id: (r.text, r.n_chars) for r in seen["personal_data"].collect()}
    assert text[28] == ("write to [EMAIL] today my friend", 32) and text[4][0] == base
    assert {r.sequence_id for r in seen["packing"].collect()} == {0}


def test_repeated_rows_are_packed_once(spark, table):
    base = " ".join(WORDS * 3)
    other = "every single word of this second text is unlike those of the first one in the table"
    docs = clashing(table(
        *[(4, base, "en")] * 5, (4, base.replace(" ", "  "), "en"), (8, base, "en"), (8, base, "en"),
        (12, other, "en"), (4, other + " but longer", "en")).repartition(3))
    got = C.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [
        (4, other + " but longer"), (4, base.replace(" ", "  ")), (12, other)]
    unnamed = table((None, base, "en"), (None, base, "en"), (None, None, None), (None, "", None))
    assert C.drop_copies(spark, unnamed, "").count() == 2
    docs = clashing(table(*[(4, base, "en")] * 5, (12, other, "en")))
    for name, function in C.STAGES:
        docs = stage(function(spark, docs, ""), name)
        assert name == "language" or sorted(r.doc_id for r in docs.collect()) == [4, 12]


def test_stages_take_empty_tables(spark, table):
    docs = table()
    for name, function in C.STAGES:
        docs = stage(function(spark, docs, ""), name)
        assert docs.count() == 0
