"""License templates against a plain matcher, with the awkward rows."""

import random
import re

import pytest

from recordloom.llm import licenses
from recordloom.llm.licenses import Automaton, Template
from tests.llm.conftest import clashing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ends(parts, words, at):
    """All places where a match of the parts from ``at`` can end."""
    found = {at}
    for part in parts:
        if isinstance(part, bytes):
            found = {e + 1 for e in found if e < len(words) and words[e] == part.decode()}
        elif part.replaceable:
            found = {e + k for e in found for k in range(part.low, part.high + 1) if e + k <= len(words)}
        else:
            found |= {x for e in found for x in ends(part.parts, words, e)}
    return found


def plain_search(template, words):
    parts = licenses.parse(template.markup).parts
    return {(at, min(e)) for at in range(len(words)) if (e := ends(parts, words, at))}


MADE = (
    Template("fixed", "a", "a b c"),
    Template("optional", "b", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d"),
    Template("variable", "c", 'b <<var;name="x";words=1-2>> c'),
    Template("any", "d", '<<var;name="x";words=0-9>> d <<var;name="x";words=0-1>> d <<beginOptional>>a<<endOptional>>'),
)


def test_automaton_accepts_what_a_plain_matcher_accepts():
    rng = random.Random(5)
    automaton = Automaton(MADE)
    for _ in range(600):
        words = [rng.choice("abcd") for _ in range(rng.randrange(14))]
        n, found = automaton.scan(w.encode() for w in words)
        assert n == len(words)
        for k, template in enumerate(MADE):
            got = {(s, e) for t, s, e in found if t == k}
            want = plain_search(template, words)
            # Runs that meet in a state go on as one, so of starts that overlap one is found.
            parts = licenses.parse(template.markup).parts
            assert all(e in ends(parts, words, s) for s, e in got) and bool(got) == bool(want), (template, words)
            if template.name in ("fixed", "optional"):
                assert got == want


def test_markup_that_says_nothing_is_refused():
    for markup in ("", "<<beginOptional>>a<<endOptional>>", "a <<beginOptional>> b", "a <<endOptional>> b",
                   'a <<var;name="x";words=3-2>> b', 'a <<var;name="x";words=0-0>> b'):
        with pytest.raises(ValueError):
            licenses.parse(markup)


def test_words_are_read_in_spans():
    text = ("Ab-cé\x00d9 " * 50).encode()
    assert [w.decode() for w in licenses.words_of(text, 7)] == plain_words(text.decode())


def filled(template, rng):
    """A text the template must accept, and one with a mandatory word changed."""
    out = []

    def write(parts):
        for part in parts:
            if isinstance(part, bytes):
                out.append(part.decode())
            elif part.replaceable:
                out.extend(f"holder{rng.randrange(9)}" for _ in range(rng.randint(max(part.low, 1), part.high)))
            elif rng.random() < 0.5:
                write(part.parts)

    parts = licenses.parse(template.markup).parts
    write(parts)
    spoiled = list(out)
    spoiled[-1] = "else"
    return out, spoiled


def test_every_template_accepts_its_text_only_as_a_whole():
    rng = random.Random(8)
    every = licenses.PHRASES + licenses.TEMPLATES
    automaton = Automaton(every)
    for k, template in enumerate(every):
        for _ in range(4):
            good, spoiled = filled(template, rng)
            around = lambda words: ["x", *words, "y"]
            assert (k, 1, 1 + len(good)) in automaton.scan(w.encode() for w in around(good))[1]
            assert k not in {t for t, _, _ in automaton.scan(w.encode() for w in around(spoiled))[1]}


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing, to deal in"
ROWS = [
    (1, "Released under the MIT License. mit-LICENSE"), (2, None), (3, ""), (4, "mit licenses"), (4, "x mit\nlicense"),
    (None, "the GNU General Public License, version 3."), (5, "Licensed under CC BY-NC 4.0."), (6, MIT),
    (7, "Licensed under the Apache License, Version 2.0."), (8, "word " * 90_000 + "apache license"), (8, "émit license"),
    (1, "Released under the MIT License. mit-LICENSE"),
]


def test_job(spark, table):
    got = licenses.summary(licenses.find_licenses(clashing(table(*ROWS)))).collect()
    assert len(got) == len(ROWS)
    for (doc_id, text), row in zip(ROWS, got):
        words = plain_words(text)
        base = {t: plain_search(t, words) for t in licenses.PHRASES}
        starts = sorted(s for found in base.values() for s, _ in found)
        hits = [t for t in licenses.PHRASES + licenses.TEMPLATES if plain_search(t, words)]
        most = max((licenses.mandatory_words(t.markup) for t in hits), default=0)
        assert row.asDict() == {
            "doc_id": doc_id, "n_words": len(words), "n_base": len(starts),
            "first_word": starts[0] if starts else None, "last_word": starts[-1] if starts else None,
            "base_labels": ",".join(sorted({t.label for t, f in base.items() if f})),
            "labels": ",".join(sorted({t.label for t in hits})), "score": most / (most + 4)}
    assert got[0].labels == "mit" and got[0].n_base == 2
    assert got[5].labels == "gpl,gpl-3.0" and got[6].labels == "cc-by-nc-4.0" and got[6].base_labels == ""
    assert licenses.find_licenses(table()).count() == 0
