"""The filter audit against applying the filters one after the other."""

import itertools
import random
import re
from collections import defaultdict

from recordloom.llm import filter_audit
from tests.llm.conftest import clashing


def fails(doc_id, text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
        "E": smaller,
    }


def applied(rows, labels):
    """Row by row, order by order."""
    texts = defaultdict(list)
    for doc_id, text, _ in rows:
        if doc_id is not None:
            texts[text or ""].append(doc_id)
    marks = {k: (any(d == k and q == 1 for d, q, _ in labels), any(d == k and t == 1 for d, _, t in labels))
             for k, _, _ in labels if k is not None}
    parts = defaultdict(list)
    for doc_id, text, lang in rows:
        smaller = doc_id is not None and min(texts[text or ""]) < doc_id
        parts[lang or ""].append((fails(doc_id, text or "", smaller), *marks.get(doc_id, (False, False))))
    out = {}
    for part, docs in parts.items():
        shapley = defaultdict(int)
        mine = {}
        for order in itertools.permutations("ABCDE"):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                out_now = [d for d in left if d[0][f]]
                redundant = sum(d[0][f] for d in gone)
                left = [d for d in left if not d[0][f]]
                gone = gone + out_now
                shapley[f] += len(out_now)
                mine["".join(order), step] = [
                    len(left), len(out_now), redundant,
                    sum(d[0][f] and sum(d[0].values()) == 1 for d in docs),
                    sum(d[1] for d in out_now), sum(d[2] for d in out_now)]
        for (order, step), counts in mine.items():
            out[part, order, step] = (*counts, shapley[order[step - 1]])
    return out


def test_audit(spark, table):
    rng = random.Random(3)
    texts = [None, "", " ", "a b", "A B", "x # y", "w " * 250, " ".join(f"w{i}" for i in range(300)),
             " ".join(f"W{i}" for i in range(300)), "é\x0bé" * 200, "z" * 200_000, " | ".join(f"v{i}" for i in range(260))]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(80)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(clashing(table(*rows)), clashing(marks)).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in got}
    assert len(found) == len(got) == 3 * 600
    assert found == applied(rows, labels)
    assert filter_audit.audit(table(), marks).count() == 0
    assert filter_audit.audit(table((1, "a")), marks.limit(0)).count() == 600


def test_other_filters(spark, table):
    made = lambda text: {"L": text.contains("l"), "M": text.contains("m"), "R": None}
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(table((1, "lm", "x"), (2, "lm", "x"), (3, "m", "x")), marks, made).collect()
    by = {(r.filter_order, r.step): r for r in got}
    assert len(by) == 18
    assert (by["LMR", 1].removed, by["LMR", 2].removed, by["LMR", 2].redundant, by["LMR", 3].redundant) == (2, 1, 2, 1)
    assert by["MLR", 2].redundant == 2 and by["RLM", 1].removed == 1 and by["RLM", 1].unique_fails == 0
