"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of 0 to ``order`` bytes is counted
over a bounded sample of labelled texts. A byte seen after its context has the
probability count / (total + different); an escape has different / (total +
different) and goes on with the context shortened by its oldest byte, where the
bytes that the longer context knows are excluded and the rest renormalised; below
the empty context all bytes are alike. The statistics are then frozen, so the
code length of a text under a language is an exact sum over its bytes, and the
shortest wins.

Counting and the probabilities are Spark jobs. The frozen tables of all
languages are laid side by side under common keys, so a text is scored for every
language at once with a few array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import picked, stage, whole_text

#: Bytes of text that a task scores at once.
AT_ONCE = 250_000
#: No language: text without a letter.
UNDETERMINED = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio, odd


def codes(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes ending at each position from ``width - 1`` on, as a number."""
    out = data[: len(data) - width + 1].astype(np.uint64)
    for k in range(1, width):
        out = (out << np.uint64(8)) | data[k: len(data) - width + 1 + k]
    return out


# ── Learning ─────────────────────────────────────────────────────────


def sample(labelled: DataFrame, per_language: int, most_languages: int) -> DataFrame:
    """At most ``per_language`` rows of each of the ``most_languages`` languages that
    have the most rows (of equals, the alphabetically first), spread by a hash of the
    id whatever the table's order. Texts are whole. Only ids and languages are counted
    to find the share to keep, so no language's rows meet in one task. Rows of one id
    are drawn together; each language has at least its first ones. The texts decide
    among those that the bound cuts, so the same table gives the same sample."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least"))
    langs = counted.orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not langs:
        return labelled
    last = F.create_map(*[F.lit(x) for r in langs for x in (
        r["lang"], max(r["least"], int((1 << 30) * min(1.0, 1.5 * per_language / r["n"]))))])
    near = labelled.withColumn("draw", draw).filter(F.col("draw") <= F.try_element_at(last, F.col("lang")))
    rank = F.expr("row_number() OVER (PARTITION BY lang ORDER BY draw, doc_id, text)")
    return near.withColumn("rank", rank).filter(F.col("rank") <= per_language).drop("rank", "draw")


def statistics(labelled: DataFrame, order: int) -> DataFrame:
    """``lang, width, code, bits, escape``: for each context byte string seen in a
    language the bits of its last byte (``width`` bytes with their context), and
    the bits of leaving it as a context for a shorter one (null if never one)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                for width in range(1, min(order + 1, len(data)) + 1):
                    code, n = np.unique(codes(data, width), return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(code)), "width": pa.array(np.full(len(code), width, np.int32)),
                        "code": pa.array(code.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    found = labelled.select("lang", "text").mapInArrow(count, "lang string, width int, code bigint, n bigint")
    grams = stage(found.groupBy("lang", "width", "code").agg(F.sum("n").alias("n")), "grams")
    context, tail = F.shiftright("code", 8), F.expr("code & (shiftleft(1L, 8 * (width - 1)) - 1)")
    parts = grams.withColumns({"context": context, "tail": tail})
    totals = stage(parts.groupBy("lang", "width", "context").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")), "totals")
    own = parts.join(totals, ["lang", "width", "context"]).withColumn("p", F.col("n") / (F.col("total") + F.col("kinds")))
    own = stage(own.select("lang", "width", "code", "context", "tail", "p", "total", "kinds"), "own")
    # What the known bytes would weigh one context shorter: left out after an escape.
    shorter = own.select("lang", (F.col("width") + 1).alias("width"), F.col("code").alias("tail"), F.col("p").alias("q"))
    leaving = own.join(shorter, ["lang", "width", "tail"], "left").groupBy("lang", "width", "context").agg(
        F.sum(F.coalesce("q", F.lit(1 / 256))).alias("known"),
        F.first("total").alias("total"), F.first("kinds").alias("kinds"))
    escape = F.log2((F.lit(1) - F.col("known")) * (F.col("total") + F.col("kinds")) / F.col("kinds"))
    leaving = leaving.filter("known < 1 - 1e-12").select(
        "lang", (F.col("width") - 1).alias("width"), F.col("context").alias("code"), escape.alias("escape"))
    return own.select("lang", "width", "code", (-F.log2("p")).alias("bits")).join(
        leaving, ["lang", "width", "code"], "full")


@dataclass
class Level:
    """Codes of one width in a hash table with their rows of ``bits`` and
    ``escape``, a column per language."""

    keys: np.ndarray
    slots: np.ndarray
    shift: int
    bits: np.ndarray
    escape: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, bits: np.ndarray, escape: np.ndarray) -> Level:
        power = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        slots, shift = np.full(1 << power, -1, np.int32), 64 - power
        at, todo = _slot(keys, shift), np.arange(len(keys))
        while len(todo):
            free = slots[at[todo]] < 0
            slots[at[todo[free]][::-1]] = todo[free][::-1]
            todo = todo[slots[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & (len(slots) - 1)
        return cls(keys, slots, shift, bits, escape)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(codes), -1, np.int32)
        at = _slot(codes, self.shift)
        row = self.slots[at]
        todo = np.flatnonzero((row >= 0) & (self.keys[row] != codes))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            row[todo] = self.slots[at[todo]]
            todo = todo[(row[todo] >= 0) & (self.keys[row[todo]] != codes[todo])]
        return row


def _slot(codes: np.ndarray, shift: int) -> np.ndarray:
    return ((codes * _MIX) >> np.uint64(shift)).astype(np.int64)


@dataclass
class Model:
    """Frozen statistics: ``levels[w]`` for byte strings of w bytes."""

    languages: list[str]
    levels: list[Level]

    def costs(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each byte under each language; a text's first bytes have the
        context that there is. ``starts``: where each text of ``data`` begins."""
        top = len(self.levels) - 1
        out = np.zeros((len(data), len(self.languages)), np.float64)
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        if len(data) >= top:
            full = np.flatnonzero(place >= top - 1)
            self._add(out, full, codes(data, top)[full - top + 1], top)
        for width in range(1, top):
            early = np.flatnonzero(place == width - 1)
            if len(early) and len(data) >= width:
                self._add(out, early, codes(data, width)[early - width + 1], width)
        return out

    def _add(self, out: np.ndarray, where: np.ndarray, code: np.ndarray, width: int) -> None:
        """Strings no language knows escape, under those that know the context."""
        while len(where):
            level = self.levels[width]
            row = level.find(code)
            known = row >= 0
            out[where[known]] += level.bits[row[known]]
            where, code = where[~known], code[~known]
            if width == 1:
                out[where] += 8 + self.levels[0].escape[0]
                return
            context = self.levels[width - 1].find(code >> np.uint64(8))
            there = context >= 0
            out[where[there]] += self.levels[width - 1].escape[context[there]]
            width -= 1
            code = code & np.uint64((1 << (8 * width)) - 1)


def model_from(table: pa.Table, order: int) -> Model:
    """Lay the languages' statistics side by side. What one language has not seen
    but another has costs it its escape and the shorter string."""
    langs = sorted(pc.unique(table.column("lang")).to_pylist())
    lang = pc.index_in(table.column("lang"), value_set=pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
    width, code = (table.column(c).to_numpy() for c in ("width", "code"))
    bits, escape = (table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("bits", "escape"))
    levels: list[Level] = []
    for w in range(order + 2):
        mine = np.flatnonzero(width == w)
        keys, row = np.unique(code[mine].astype(np.uint64), return_inverse=True)
        own, out = np.full((len(keys), len(langs)), np.nan), np.zeros((len(keys), len(langs)))
        own[row, lang[mine]] = bits[mine]
        out[row, lang[mine]] = np.nan_to_num(escape[mine])
        if w == 0:
            own = np.full_like(own, 0.0)
            if not len(keys):
                keys, own, out = np.zeros(1, np.uint64), np.zeros((1, len(langs))), np.zeros((1, len(langs)))
        elif w == 1:
            own = np.where(np.isnan(own), 8 + levels[0].escape[0], own)
        else:
            before = levels[w - 1]
            context = before.find(keys >> np.uint64(8))
            gone = np.where((context >= 0)[:, None], before.escape[context], 0.0)
            tail = before.find(keys & np.uint64((1 << (8 * (w - 1))) - 1))
            own = np.where(np.isnan(own), gone + before.bits[tail], own)
        levels.append(Level.of(keys, own, out))
    for level in levels:  # every worker holds them
        level.bits, level.escape = level.bits.astype(np.float32), level.escape.astype(np.float32)
    levels[-1].escape = levels[-1].escape[:0]  # the longest strings are no contexts
    return Model(langs, levels)


def learn(
    labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = 300, order: int = 4, most_languages: int = 64,
) -> Model:
    """Learn from rows with text and language; others are passed over. The sample
    is bounded: ``per_language`` whole texts of each, and the ``most_languages`` with
    the most rows, so the tables, which every task loads, do not grow with the corpus
    nor with odd values of the language column."""
    rows = picked(labelled, doc_id=doc_id, text=text, lang=lang).filter("lang is not null and text is not null")
    table = statistics(stage(sample(rows, per_language, most_languages), "labelled"), order).toArrow()
    return model_from(table, order)


# ── Predicting ───────────────────────────────────────────────────────

_WORD = re.compile(r"[^\W\d_]")


def _lettered(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def judgement(spark: SparkSession, model: Model, text: Column) -> Column:
    """``lang_pred, score, bits_per_byte`` of a text column, as a struct; see :func:`predict`."""
    frozen: Broadcast[Model] = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, bits_per_byte: double>")
    def judge(texts: pa.Array) -> pa.Array:
        sizes, parts, at = pc.binary_length(texts).to_numpy(zero_copy_only=False), [], 0
        while at < len(sizes):  # about so many bytes at once, a long text alone
            end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), AT_ONCE, "right")))
            parts.append(_judged(frozen.value, texts.slice(at, end - at).to_pylist()))
            at = end
        return pa.concat_arrays(parts) if parts else _judged(frozen.value, [])

    return judge(whole_text(text))


def predict(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` of every whole text.

    ``lang_pred`` is the language of the shortest code, the alphabetically first
    of equals; ``score`` is its posterior among the languages, all being equally
    likely before. Text that is null or has no letter is ``und`` with score 0 and
    no bits, and so is everything if nothing was learned. Repeated rows are
    scored row by row; other columns are not looked at.
    """
    rows = picked(documents, doc_id=doc_id, text=text)
    return rows.withColumn("j", judgement(rows.sparkSession, model, F.col("text"))).select("doc_id", "j.*")


def _judged(model: Model, texts: list[str]) -> pa.StructArray:
    lettered = [bool(model.languages) and _lettered(t) for t in texts]
    coded = [t.encode() for t, good in zip(texts, lettered, strict=True) if good]
    pred, score, rate = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
    if coded:
        sizes = np.array([len(c) for c in coded])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        bits = np.add.reduceat(model.costs(np.frombuffer(b"".join(coded), np.uint8), starts), starts, axis=0)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        rows = np.flatnonzero(lettered)
        score[rows] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        rate[rows] = least / sizes
        for k, row in enumerate(rows):
            pred[row] = model.languages[best[k]]
    columns = [pa.array(pred, pa.string()), pa.array(score), pa.array(rate, mask=np.isnan(rate))]
    return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "bits_per_byte"])


def held_out(doc_id: Column | str) -> Column:
    """The quarter of documents kept out of learning."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 4 == 2
