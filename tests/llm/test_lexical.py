"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from recordloom.llm import lexical
from tests.llm.conftest import clashing

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def scored(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    total, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        ranked = []
        for doc_id, bag in bags:
            m = 100 - 50 + 50 * sum(bag.values()) * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if bag[t])
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id or 0, doc_id))
        ranked.sort(key=lambda r: r[:3])
        out += [(item, n, r[3], -r[0]) for n, r in enumerate(ranked[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, k, shard_terms, block):
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    index = lexical.Index(docs, shard_terms=shard_terms)
    got = lexical.search(index, clashing(asked), k=k, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return index, sorted([tuple(r) for r in got.collect()], key=repr)


def test_search(spark, table):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)] + ["É", "b-b", "C3"]
    docs = [(rng.choice([None, *range(150)]), " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for _ in range(200)]
    docs += [(200, None), (201, ""), (202, "..."), (7, "w1 w2"), (7, "w1 w2"), (8, "W1\x00w2"), (9, "w1 " * 300_000 + "w3")]
    items = [(1, "w1 w2 w2"), (2, "nothing known"), (3, None), (4, ""), (5, " ".join(words)), (5, "w4"), (None, "É c3"),
             (1, "w1 w2 w2")]
    for shard_terms, block in ((400, 3), (2_000_000, 512)):
        index, got = searched(spark, clashing(table(*docs)), items, 20, shard_terms, block)
        assert (index.shards > 5) == (shard_terms == 400)
        assert got == scored(docs, items, 20)


def test_empty_tables(spark, table):
    assert searched(spark, table(), [(1, "a")], 5, 10, 2)[1] == []
    assert searched(spark, table((1, "a")), [], 5, 10, 2)[1] == []
    assert searched(spark, table((1, None)), [(1, "a")], 5, 10, 2)[1] == []


class Counted(lexical.ImpactList):
    looked_up = 0

    def places(self, docs):
        Counted.looked_up += len(docs)
        return super().places(docs)


def test_reading_stops_at_the_best_position():
    rng = np.random.default_rng(1)
    n = 20_000
    lists = []
    for _ in range(3):
        values = rng.integers(1, 1000, n)
        values[:20] = 900_000 - np.arange(20)
        lists.append(Counted(np.arange(n), values))
    docs, scores = lexical.best_positions(lists, [3, 2, 1], 10, depth=32)
    assert sorted(docs) == list(range(10)) and Counted.looked_up < 1000


def test_ties_at_the_end_are_all_kept():
    lists = [lexical.ImpactList(np.arange(500), np.full(500, 7))]
    docs, scores = lexical.best_positions(lists, [2], 5, depth=1)
    assert len(docs) == 500 and set(scores) == {14}
    mixed = [lexical.ImpactList(np.arange(300), np.r_[np.full(10, 9), np.full(290, 1)])]
    assert len(lexical.best_positions(mixed, [1], 5, depth=1)[0]) == 10


def test_best_positions_equals_scoring_all():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lists, weights = [], []
        full = np.zeros(200, np.int64)
        for _ in range(rng.integers(1, 6)):
            docs = rng.choice(200, rng.integers(1, 150), replace=False)
            values = rng.integers(1, 6, len(docs))
            weights.append(int(rng.integers(1, 4)))
            lists.append(lexical.ImpactList(docs, values))
            full[docs] += weights[-1] * values
        k = int(rng.integers(1, 30))
        docs, scores = lexical.best_positions(lists, weights, k, depth=2)
        assert (full[docs] == scores).all()
        low = np.sort(full[full > 0])[-k:].min()
        assert set(np.flatnonzero(full >= low)) <= set(docs)
