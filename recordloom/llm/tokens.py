"""Whole-text encoding with a public tokenizer file, as the tokenizers library
encodes it, at a speed that suits a whole corpus.

Both files cut a text into pre-tokens by a pattern and encode each on its own.
For texts of plain characters (white space, ASCII, Latin-1 letters, common
punctuation) the same cut is made here with ``re``; each different pre-token is
merged once by tiktoken's piece encoder under the file's own ranks and then
remembered. Any other text, and texts in which special tokens are written out,
go to the tokenizers library whole. The tests hold both ways against each other.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

#: The characters of which class and case are the same in every
#: Unicode version, and the pre-token patterns of the two files over them.
PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ‐-‧]*")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
CUTS = {
    "byte": re.compile(
        rf" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{LETTER}0-9]+"),
}
#: Marks the end of a word in the ranks; no UTF-8 text has this byte.
WORD_END = b"\xff"
#: Remembered pre-tokens of a worker; beyond that it starts afresh.
REMEMBERED = 200_000


class Pieces(dict):
    """Pre-token -> its ids as bytes, merged when first asked for."""

    def __init__(self, path: str, end: bytes):
        import tiktoken

        letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {
            bytes(map(letters.__getitem__, t.removesuffix("</w>") if end else t))
            + (end if t.endswith("</w>") else b""): n
            for t, n in vocabulary.items()}
        self.end = end
        self.merge = tiktoken.Encoding(
            "pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, part: str) -> bytes:
        found = self[part] = array("I", self.merge(part.encode() + self.end)).tobytes()
        return found


class Encoder:
    """``kind`` is "byte" for byte-level files with leading spaces, "word" for
    lower-casing files that drop white space."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cut = CUTS[kind].findall
        self.fold = str.lower if kind == "word" else str
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = Pieces(path, WORD_END if kind == "word" else b"")

    def by_library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.by_library(text)
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, self.cut(self.fold(text))))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder for a file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def tokenizer_path(name: str) -> str:
    """Where an installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_bytes(path: str) -> list[bytes]:
    """What each id of a byte-level file stands for."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    table = [b""] * library.get_vocab_size(with_added_tokens=True)
    letters = byte_letters()
    added = library.get_added_tokens_decoder()
    for token, number in library.get_vocab(with_added_tokens=True).items():
        table[number] = token.encode() if number in added else bytes(map(letters.__getitem__, token))
    return table


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others,
    in order, for the characters from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest: Iterable[int] = (b for b in range(256) if b not in own)
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}
