"""Splitting texts as the public byte-level tokenizers do, with one lookup per piece.

A byte-level BPE tokenizer cuts a text into pieces by a fixed pattern and encodes each piece on its own, so the
tokens of a text are the tokens of its pieces. Texts of common Latin characters are cut here by the standard
library's ``re``; every other text (other scripts, odd blanks, special strings) goes whole to the tokenizers
library, so that its Unicode tables and special-token rules decide.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable

import pyarrow as pa

# Letters and marks on which ``re`` and the library agree; no blank but tab, line ends and space.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_COMMON = re.compile(f"[\\t\\n\\r\\x20-\\x7e¡-©«¬®-±´¶-¸»¿×÷{_LETTERS}]*")

# The cutting patterns of the two tokenizers, for the characters above.
BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")

# Pieces a worker remembers besides the shared ones, in two halves.
WORKER_PIECES = 1_000_000


class Pieces(dict):
    """Piece to value: first the shared table, then this worker's own cache, then the tokenizer.

    When the newer half of the cache is full, it becomes the older one, and what was in that is forgotten unless it was
    asked for meanwhile.
    """

    def __init__(self, encode: Callable, shared: dict | None = None, limit: int = WORKER_PIECES):
        super().__init__(shared or {})
        self.encode, self.shared, self.older, self.limit = encode, shared or {}, {}, max(1, limit // 2) + len(shared or {})

    def __missing__(self, piece: str):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
            self.update(self.shared)
        value = self.older.get(piece)
        if value is None:
            value = self.encode(piece)
        self[piece] = value
        return value


class Splitter:
    """One tokenizer file: cuts common texts into pieces, encodes anything."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.lower = spec.get("normalizer") is not None
        self.pattern = WORD_PIECES if self.lower else BYTE_PIECES
        self.size = self.library.get_vocab_size(with_added_tokens=True)

    def cut(self, text: str) -> list[str] | None:
        """The pieces of ``text``, or None if the library has to see the whole text."""
        if _COMMON.fullmatch(text) is None or any(s in text for s in self.specials):
            return None
        return self.pattern.findall(text.lower() if self.lower else text)

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


_SPLITTERS: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """The splitter of a file, loaded once per worker."""
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


_PIECES: dict[tuple, Pieces] = {}


def worker_pieces(key: tuple, encode: Callable, shared: dict | None = None) -> Pieces:
    """The cache of this worker under ``key``; it lives as long as the worker and serves all its tasks."""
    if key not in _PIECES:
        _PIECES[key] = Pieces(encode, shared)
    return _PIECES[key]


def forget() -> None:
    """Drop the caches of this worker and give back the memory that they and earlier tasks leave. Operators that need its
    memory call it when their tasks begin, since workers outlive the stage that filled them."""
    _PIECES.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
