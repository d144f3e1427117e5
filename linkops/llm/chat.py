"""Conversations as budgeted training windows with a loss mask, and reading them back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import splitter, worker_pieces

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates; none of them survives inside a turn.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_MARKED = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
_TURN = re.compile(re.escape(OPEN) + "([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)

BUDGET, HISTORY = 1024, 2
WINDOWS = """conv_id long, window int, formatted string, context_turns int, new_turns int, tokens long,
loss array<struct<start:int,end:int>>"""
DIGESTS = """conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,
formatted_chars long, n_windows long"""


def escape(text: str) -> str:
    """Double every backslash and put one behind the first character of every control string."""
    return _MARKED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the place of the escaped text of every turn."""
    for m in _TURN.finditer(formatted):
        yield unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)


@dataclass
class _Turn:
    text: str
    skip: int
    target: bool
    tokens: int


@dataclass
class _Conversation:
    """Windows of one conversation, turn by turn; holds one window and the history only."""

    key: object
    budget: int
    history: int
    system: _Turn | None = None
    turns: list[_Turn] = field(default_factory=list)
    prefix: list[int] = field(default_factory=lambda: [0])
    first: int = 0
    window: int = 0

    def add(self, turn: _Turn, is_system: bool) -> Iterator[tuple]:
        if self.system is None and not self.turns and is_system:
            self.system = turn
            return
        self.turns.append(turn)
        self.prefix.append(self.prefix[-1] + turn.tokens)
        fixed = self.system.tokens if self.system else 0
        if self.first < len(self.turns) - 1 and fixed + self.prefix[-1] - self.prefix[self._begin()] > self.budget:
            yield self._emit(len(self.turns) - 1)
            drop = max(0, self.first - self.history)
            base = self.prefix[drop]
            self.turns, self.prefix = self.turns[drop:], [p - base for p in self.prefix[drop:]]
            self.first -= drop

    def _begin(self) -> int:
        """First repeated turn: at most ``history`` turns, as many as fit beside the first new turn."""
        room = self.budget - (self.system.tokens if self.system else 0)
        upto = self.prefix[min(self.first + 1, len(self.turns))]
        begin = max(0, self.first - self.history)
        while begin < self.first and upto - self.prefix[begin] > room:
            begin += 1
        return begin

    def _emit(self, stop: int) -> tuple:
        begin, fixed = self._begin(), [self.system] if self.system else []
        context = fixed + self.turns[begin:self.first]
        # The system turn is new in the first window and repeated in all others.
        repeated = len(context) - (1 if self.system and not self.window else 0)
        parts, at, loss = [], 0, []
        for i, turn in enumerate(context + self.turns[self.first:stop]):
            parts.append(turn.text)
            if turn.target and i >= len(context):
                loss.append({"start": at + turn.skip, "end": at + len(turn.text) - len(CLOSE) - 1})
            at += len(turn.text)
        tokens = sum(t.tokens for t in fixed) + self.prefix[stop] - self.prefix[begin]
        new = len(context) - repeated + stop - self.first
        row = (self.key, self.window, "".join(parts), repeated, new, tokens, loss)
        self.first, self.window = stop, self.window + 1
        return row

    def finish(self) -> Iterator[tuple]:
        if self.first < len(self.turns) or (self.system and not self.window):
            yield self._emit(len(self.turns))


def _same(a, b) -> bool:
    return a == b or (a is None and b is None)


def format_windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY,
                   targets: tuple[str, ...] = ("assistant",), system: str = "system") -> DataFrame:
    """``conv_id, turn, role, text`` to formatted windows of at most ``budget`` tokens with loss spans.

    Prefix sums of turn tokens choose spans of whole turns. Every window begins with the system turn (the first
    turn, if ``system`` said it) and at most ``history`` turns of the window before, as many as fit; these are
    repeated, outside the loss, and counted in ``context_turns``. So every target text is under the loss once. A
    turn larger than the budget has a window of its own and stays whole. ``loss`` has code point spans of texts.

    Null texts and roles are empty; null turns come first, rows of one turn by role and text; null ids are one
    conversation. A conversation is read in order in one task, holding one window of it at a time. Other columns
    are left out; an empty table gives no windows.
    """
    small_batches(turns.sparkSession)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = splitter(tokenizer)
        length = worker_pieces((tokenizer, "length"), lambda piece: len(cut.ids(piece))).__getitem__
        held: _Conversation | None = None
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"].astype(object), batch["role"], batch["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if held is None or not _same(held.key, conv):
                    out += held.finish() if held else ()
                    held = _Conversation(conv, budget, history)
                head = f"{OPEN}{escape_role(role)}\n"
                whole = f"{head}{escape(text)}{CLOSE}\n"
                pieces = cut.cut(whole)
                n = len(cut.ids(whole)) if pieces is None else sum(map(length, pieces))
                out += held.add(_Turn(whole, len(head), role in targets, n), role == system)
            yield _windows(out)
        yield _windows(held.finish() if held else ())

    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInPandas(cells, WINDOWS)


def _windows(rows) -> pd.DataFrame:
    frame = pd.DataFrame(list(rows), columns=["conv_id", "window", "formatted", "context_turns", "new_turns", "tokens", "loss"])
    return frame.astype({"conv_id": "Int64"})


class _Digest:
    def __init__(self, key):
        self.key, self.turns, self.chars, self.loss, self.windows = key, 0, 0, 0, 0
        self.sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, skip: int, loss) -> None:
        self.chars += len(formatted)
        self.windows += 1
        for i, (role, text, _, _) in enumerate(parse(formatted)):
            if i >= skip:
                self.turns += 1
                self.sha.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(formatted[span["start"]:span["end"]])
            self.loss += len(text)
            self.loss_sha.update(text.encode())

    def row(self) -> tuple:
        return (self.key, self.turns, self.sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars, self.windows)


def read_windows(windows: DataFrame) -> DataFrame:
    """One row per conversation from its windows: digests of the turns and of the text under the loss mask."""
    names = [c.split()[0] for c in DIGESTS.replace("\n", " ").split(",")]

    def frame(rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: _Digest | None = None
        for batch in batches:
            out = []
            for conv, text, skip, loss in zip(batch["conv_id"].astype(object), batch["formatted"], batch["context_turns"], batch["loss"]):
                conv = None if pd.isna(conv) else int(conv)
                if held is None or not _same(held.key, conv):
                    out += [held.row()] if held else []
                    held = _Digest(conv)
                held.add(text, int(skip), loss)
            yield frame(out)
        yield frame([held.row()] if held else [])

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInPandas(digest, DIGESTS)
