"""Personal data: fixed forms, and bootstrapped contexts for what they miss.

Texts are scanned once. Validated matches of the fixed forms are the seeds. The
words around a seed are its lexical patterns; other tokens with digits or an @,
and runs of digit groups, are candidates with patterns of their own. In the graph of patterns and
instances Spark scores, in turns, patterns by the share of their instances that
are known and instances by the patterns they were seen in. What stands in a
pattern of high confidence, and looks like its kind, is personal data too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import picked, sliced, spare, stage, whole_text

#: In the order in which kinds are listed at equal starts.
KINDS = ("email", "ip", "card", "phone")

# ── Fixed forms ──────────────────────────────────────────────────────

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits, so looking only at their starts finds
# the same ones without trying every digit of a long run.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from
    the @ outwards, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        else:
            # A failed part can't be the front of a later match: @ is in neither class.
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


_ANY_DIGIT = re.compile("[0-9]")


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, rank of kind, end)`` of the validated matches, in order. Matches of
    a kind do not overlap; one that fails its test is dropped, not tried again."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if _ANY_DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ── Occurrences and their contexts ───────────────────────────────────

_HINT = re.compile("[0-9@]")
_EDGES = ".,;:!?()[]{}<>\"'`"
_MASK = str.maketrans("123456789", "000000000")


def _word_before(text: str, at: int) -> tuple[str, int]:
    end = at
    while end > 0 and text[end - 1].isspace():
        end -= 1
    start = end
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    return text[start:end].lower().translate(_MASK), start


def _word_after(text: str, at: int) -> str:
    start, size = at, len(text)
    while start < size and text[start].isspace():
        start += 1
    end = start
    while end < size and not text[end].isspace():
        end += 1
    return text[start:end].lower().translate(_MASK)


def _number(value: str) -> int:
    """A 64-bit stand-in; neither identifiers nor their surroundings are stored."""
    return xxhash.xxh64_intdigest(value.encode()) - (1 << 63)


def patterns(text: str, start: int, end: int) -> list[int]:
    """The two words before, and the words on either side."""
    before, at = _word_before(text, start)
    second, _ = _word_before(text, at)
    return [_number(f"2\t{second}\t{before}"), _number(f"1\t{before}\t{_word_after(text, end)}")]


#: Groups of digits with spaces, brackets, dots or hyphens between them, as far as they go.
_RUN = re.compile(r"(?<!\w)\(?[0-9]++(?:[\x20\u00a0().-]{1,3}+[0-9]++)+(?!\w)")


def _free(known: list[tuple[int, int, int]], start: int, end: int) -> bool:
    return not any(s < end for s, _, e in known if e > start)


def runs(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """``(start, end)`` of the identifiers of 7 to 19 digits that are written in
    groups with white space, outside all known spans."""
    out, taken = [], 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        # A bracket that opens before the run and closes behind it is not its own.
        if text[start] == "(" and ")" not in m[0]:
            start += 1
        while taken < len(known) and known[taken][2] <= start:
            taken += 1
        if 7 <= len(_digits(m[0])) <= 19 and (" " in m[0] or "\u00a0" in m[0]) and _free(
                known[taken: taken + 4], start, end):
            out.append((start, end))
    return out


def candidates(text: str, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, with an @)`` of what else could be an identifier, outside all
    known spans: runs of digit groups, and other tokens of six characters or more
    with an @ or three digits."""
    whole = runs(text, known)
    yield from ((s, e, False) for s, e in whole)
    done, taken, run = 0, 0, 0
    for hit in _HINT.finditer(text):
        if hit.start() < done:
            continue
        start, end = hit.start(), hit.end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        done = end
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        while taken < len(known) and known[taken][2] <= start:
            taken += 1
        token = text[start:end]
        while run < len(whole) and whole[run][1] <= start:
            run += 1
        # A token that reaches out of a run stays a candidate of its own.
        inside = run < len(whole) and whole[run][0] <= start and end <= whole[run][1]
        if inside or not _free(known[taken: taken + 4], start, end):
            continue
        if len(token) >= 6 and ("@" in token or len(_digits(token)) >= 3):
            yield start, end, "@" in token


SCAN = (
    "key bigint, doc_id bigint, spans array<struct<start: int, rank: int, end: int>>,"
    " seen array<struct<start: int, rank: int, end: int, at: boolean, instance: bigint, patterns: array<bigint>>>")
_SPAN = [("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]
_SPANS = pa.list_(pa.struct(_SPAN))
_SEEN = pa.list_(pa.struct([*_SPAN, ("at", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def _seen(text: str, known: list[tuple[int, int, int]]) -> list[dict]:
    found = [(s, rank, e, rank == 0) for s, rank, e in known]
    found += [(s, -1, e, at) for s, e, at in candidates(text, known)]
    return [
        {"start": s, "rank": rank, "end": e, "at": at, "instance": _number(text[s:e].lower()),
         "patterns": patterns(text, s, e)} for s, rank, e, at in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        spans, seen = [], []
        for text in batch.column("text").to_pylist():
            known = fixed_spans(text)
            spans.append([{"start": s, "rank": rank, "end": e} for s, rank, e in known])
            seen.append(_seen(text, known) if known or _HINT.search(text) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("doc_id"), pa.array(spans, _SPANS), pa.array(seen, _SEEN)],
            names=["key", "doc_id", "spans", "seen"])


# ── Bootstrapping ────────────────────────────────────────────────────


@dataclass(frozen=True)
class Bootstrap:
    """``support``: different known instances a pattern needs; ``confidence``: what
    a pattern and an instance must reach to count; ``rounds`` of scoring."""

    rounds: int = 3
    support: int = 5
    confidence: float = 0.8


def discovered(scanned: DataFrame, settings: Bootstrap) -> DataFrame:
    """``key, start, rank, end`` of candidates that the graph tells are of a kind."""
    each = scanned.filter(F.size("seen") > 0).select("key", F.explode("seen").alias("s")).select(
        "key", "s.start", "s.end", "s.rank", "s.at", "s.instance", F.explode("s.patterns").alias("pattern"))
    each = stage(each, "occurrences")
    # Copies of a text add nothing: an instance counts once per pattern.
    edges = stage(each.groupBy("pattern", "instance").agg(F.any_value("at").alias("at")), "graph")
    seeds = stage(each.filter("rank >= 0").groupBy("instance").agg(F.min("rank").alias("rank")).withColumn(
        "score", F.lit(1.0)), "seeds")
    known = seeds
    for _ in range(settings.rounds):
        scored = edges.join(known, "instance", "left").groupBy("pattern").agg(
            F.count(F.lit(1)).alias("all"),
            *[F.sum(F.when(F.col("rank") == k, F.col("score")).otherwise(0.0)).alias(f"mass_{k}")
              for k in range(len(KINDS))],
            *[F.count_if((F.col("rank") == k) & (F.col("score") >= settings.confidence)).alias(f"support_{k}")
              for k in range(len(KINDS))])
        best = F.array_max(F.array(*[
            F.struct(F.col(f"mass_{k}").alias("mass"), F.lit(k).alias("rank"), F.col(f"support_{k}").alias("support"))
            for k in range(len(KINDS))]))
        trusted = stage(
            scored.withColumn("best", best).filter(F.col("best.support") >= settings.support).select(
                "pattern", F.col("best.rank").alias("rank"), (F.col("best.mass") / (F.col("all") + 1)).alias("trust")),
            "patterns")
        # An instance is as sure as its patterns together: one minus the product of the doubts.
        like = F.col("at") == (F.col("rank") == 0)
        doubt = F.sum(F.log1p(-F.least("trust", F.lit(1 - 1e-9))))
        fresh = edges.join(trusted, "pattern").filter(like).groupBy("instance", "rank").agg(
            (1 - F.exp(doubt)).alias("score"))
        fresh = fresh.groupBy("instance").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"))).alias("m")).select(
            "instance", (-F.col("m.r")).alias("rank"), F.col("m.score").alias("score"))
        known = stage(seeds.union(fresh.join(seeds, "instance", "left_anti")), "instances")
    sure = trusted.filter(F.col("trust") >= settings.confidence)
    named = known.filter(F.col("score") >= settings.confidence).select("instance", F.col("rank").alias("kind"))
    found = each.filter("rank < 0").drop("rank").join(sure, "pattern").join(named, "instance").filter(
        (F.col("rank") == F.col("kind")) & (F.col("at") == (F.col("rank") == 0)))
    return found.select("key", "start", "rank", "end").distinct()


# ── Jobs ─────────────────────────────────────────────────────────────


def text_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Names a row by id and text; rows alike in both are one."""
    return F.xxhash64(doc_id, text)


def find_personal_data(
    documents: DataFrame, settings: Bootstrap | None = None, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """A stored row per document: ``key, doc_id, spans, extra``: arrays of (start,
    rank of kind, end) in code points, end exclusive, of the fixed forms and of
    what their contexts disclosed.

    Null and empty texts have no spans. Rows alike in id and text get the same
    answer each. An empty table gives no rows. Other columns are not looked at.
    """
    rows = picked(documents, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text("text").alias("text"))
    scanned = stage(rows.select(text_key().alias("key"), "doc_id", "text").mapInArrow(_scan, SCAN), "scanned")
    extra = stage(discovered(scanned, settings or Bootstrap()).groupBy("key").agg(
        F.collect_list(F.struct("start", "rank", "end")).alias("extra")), "extra")
    return scanned.drop("seen").join(extra, "key", "left")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def redact(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets. All columns
    stay; overlapping spans become one, named by the first. Null text stays null."""

    @F.pandas_udf("string")
    def cover(texts: pd.Series, starts: pd.Series, ranks: pd.Series, ends: pd.Series) -> pd.Series:
        rows = zip(texts, starts, ranks, ends, strict=True)
        return pd.Series([t if s is None else _covered(t, zip(s, r, e, strict=True)) for t, s, r, e in rows], dtype=object)

    own, spans = spare(documents, "key_of_row"), spare(documents, "spans_of_row")
    every = F.array_sort(F.concat("spans", F.coalesce("extra", F.array())))
    marks = stage(found.select(F.col("key").alias(own), every.alias(spans)).filter(
        F.size(spans) > 0).dropDuplicates([own]), "marks")
    keyed = documents.withColumn(own, text_key(documents[doc_id].cast("bigint"), whole_text(documents[text])))
    parts = [F.col(f"{spans}.{part}") for part in ("start", "rank", "end")]
    return keyed.join(marks, own, "left").withColumn(text, cover(F.col(text), *parts)).select(*documents.columns)


def _covered(text: str, spans) -> str:
    out, at = [], 0
    for start, rank, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[rank].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
