"""Byte-level BPE of whole texts, long ones by tree concatenation.

A text of more than ``leaf_chars`` characters is cut into leaves that Spark
encodes in parallel. Neighbouring parts are then joined pairwise, a level of the
tree at a time: around each join a window is encoded anew, and grown until its
tokens agree with both sides. From there on each side is known to stay as it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import picked, sliced, stage, whole_text
from recordloom.llm.tokens import encoder, token_bytes



# ── Joining two encoded parts ────────────────────────────────────────


def _kind(char: str) -> str:
    return "s" if char.isspace() else "l" if char.isalpha() else "n" if char.isnumeric() else "o"


def _sure(before: str, after: str) -> bool:
    """Whether a pre-token ends between these characters whatever stands around
    them. White space and apostrophes may go with what follows."""
    if _kind(after) == "s":
        return _kind(before) != "s"
    return _kind(before) != "s" and before != "'" and _kind(before) != _kind(after)


def _settled(zone: str, ends: set[int], run: str) -> bool:
    """Whether agreement over a zone fixes all beyond it: a sure cut lies inside
    at a token's end (``ends``, in bytes), or all characters up to the join are
    one run of a kind, which is a single pre-token."""
    at = 0
    for before, after in zip(zone, zone[1:], strict=False):
        at += len(before.encode())
        if at in ends and _sure(before, after):
            return True
    return bool(run) and "'" not in run and len({*map(_kind, run)}) == 1


def join_encoded(
    encode: Callable[[bytes], np.ndarray], sizes: np.ndarray,
    left: bytes, left_ids: np.ndarray, right: bytes, right_ids: np.ndarray, window: int = 64,
) -> np.ndarray:
    """Ids of ``left + right`` from those of both. ``sizes``: bytes of each id. The
    first window must be longer than any special token, which may lie across the
    join."""
    if not left or not right:
        return left_ids if not right else right_ids
    left_ends, right_ends = np.cumsum(sizes[left_ids]), np.cumsum(sizes[right_ids])
    while True:
        i = int(np.searchsorted(left_ends, len(left) - window, "right"))  # tokens left as they are
        while i > 0 and left[left_ends[i - 1]] & 0xC0 == 0x80:
            i -= 1
        j = int(np.searchsorted(right_ends, window, "left")) + 1  # tokens inside the window
        while j < len(right_ids) and right[right_ends[j - 1]] & 0xC0 == 0x80:
            j += 1
        a, b = (int(left_ends[i - 1]) if i else 0), (int(right_ends[j - 1]) if j < len(right_ids) else len(right))
        new = encode(left[a:] + right[:b])
        if i == 0 and b == len(right):
            return new
        heads, tails = left_ids[i:], right_ids[:j]
        n = min(len(new), len(heads))
        same = int(np.argmin(np.append(new[:n] == heads[:n], False)))
        n = min(len(new), len(tails))
        back = int(np.argmin(np.append((new[len(new) - n:] == tails[len(tails) - n:])[::-1], False)))
        ok = same + back <= len(new)
        if ok and i:
            ends = np.cumsum(sizes[new[:same]])
            ok = same >= 2 and _settled(
                left[a: a + int(ends[-1])].decode("utf-8", "ignore"), {*ends.tolist()}, left[a:].decode())
        if ok and b < len(right):
            span = int(sizes[new[len(new) - back:]].sum())
            ends = np.cumsum(sizes[new[len(new) - back:]])
            start = b - span
            while start < b and right[start] & 0xC0 == 0x80:
                start += 1
            shift = start - (b - span)
            ok = back >= 2 and start >= 0 and _settled(
                right[start:b].decode(), {e - shift for e in ends.tolist()}, right[:b].decode())
        if ok:
            return np.concatenate([left_ids[:i], new, right_ids[j:]])
        window *= 2


# ── Jobs ─────────────────────────────────────────────────────────────


def _encoding(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = encoder(path, "byte"), token_bytes(path) if decoded else []
        for batch in sliced(batches):
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            out = {name: batch.column(name) for name in batch.schema.names if name != "text"}
            out["ids"] = pa.array(ids, pa.binary())
            if decoded:
                out["decoded"] = pa.array([_decode(table, x) for x in ids], pa.string())
            else:
                out["text"] = batch.column("text")
            yield pa.RecordBatch.from_pydict(out)

    return run


def _decode(table: list[bytes], ids: bytes) -> str:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the text that the ``ids`` column stands for. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in sliced(batches):
            texts = [None if x is None else _decode(table, x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{_ddl(encoded)}, decoded string")


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def _joining(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, "byte")
        sizes = np.array([len(x) for x in token_bytes(path)])

        def encode(part: bytes) -> np.ndarray:
            return np.frombuffer(own.encode(part.decode()), "<u4")

        for batch in batches:
            for row in batch.to_pylist():
                ids = row["ids"]
                if row["next_ids"] is not None:
                    ids = join_encoded(
                        encode, sizes, row["text"].encode(), np.frombuffer(ids, "<u4"),
                        row["next_text"].encode(), np.frombuffer(row["next_ids"], "<u4")).tobytes()
                yield pa.RecordBatch.from_pydict({
                    "uid": [row["uid"]], "doc_id": pa.array([row["doc_id"]], pa.int64()),
                    "pos": pa.array([row["pos"] // 2], pa.int32()),
                    "ids": [ids], "text": [row["text"] + (row["next_text"] or "")]})

    return run


def encode_texts(
    documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
    leaf_chars: int = 65_536, decoded: bool = True,
) -> DataFrame:
    """Encode every whole text with the byte-level file at ``path``.

    Returns a row per document: ``doc_id``, ``ids`` (little-endian unsigned
    32-bit integers) and, with ``decoded``, the text decoded from them again.
    The ids are those of the tokenizers library without added special tokens; a
    special token written out in a text is one id.

    Null and empty texts have no ids and decode to "". Repeated rows and null
    ids are encoded row by row. An empty table gives no rows. Other columns are
    not looked at. Texts up to ``leaf_chars`` characters are encoded as they
    stream by; only longer ones are stored, as leaves and once per tree level.
    """
    rows = picked(documents, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text("text").alias("text"))
    size = F.length("text")
    last = ", decoded string" if decoded else ", text string"
    short = rows.filter(size <= leaf_chars).mapInArrow(
        _encoding(path, decoded), f"doc_id bigint, ids binary{last}")
    longest = rows.agg(F.max(size)).first()[0] or 0
    if longest <= leaf_chars:
        return short if decoded else short.drop("text")
    leaves = (
        rows.filter(size > leaf_chars).withColumn("uid", F.monotonically_increasing_id())
        .withColumn("pos", F.explode(F.sequence(F.lit(0), ((size - 1) / leaf_chars).cast("int"))))
        .select("uid", "doc_id", "pos", F.substring("text", F.col("pos") * leaf_chars + 1, F.lit(leaf_chars))
                .alias("text")))
    parts = stage(stage(leaves, "leaves").repartition("uid", "pos").mapInArrow(
        _encoding(path, False), "uid bigint, doc_id bigint, pos int, ids binary, text string"), "parts")
    for _ in range(math.ceil(math.log2(math.ceil(longest / leaf_chars)))):
        right = parts.filter("pos % 2 = 1").select(
            "uid", (F.col("pos") - 1).alias("pos"), F.col("ids").alias("next_ids"), F.col("text").alias("next_text"))
        pairs = parts.filter("pos % 2 = 0").hint("merge").join(right, ["uid", "pos"], "left")
        parts = stage(pairs.mapInArrow(
            _joining(path), "uid bigint, doc_id bigint, pos int, ids binary, text string"), "parts")
    long = parts.select("doc_id", "ids")
    return short.unionByName(decode_ids(long, path)) if decoded else short.drop("text").unionByName(long)
