"""Chat formatting in budgeted windows.

A conversation's turns are cut into windows at turn boundaries, by prefix sums
of their token counts.  Every window repeats the system turn and a limited
number of the latest earlier turns as context, then adds new turns up to the
budget.  The loss mask covers the texts of new assistant turns only, so every
assistant text is a target exactly once.  Control strings inside texts are
escaped reversibly; ``read_back`` recovers turns and targets from the output.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that some chat template treats as control; texts never carry them raw.
CONTROL = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]",
           "<<SYS>>", "<</SYS>>")
WINDOWS = ("conv_id long, window long, n_context int, n_tokens long, formatted string, "
           "loss array<struct<start:int,end:int>>")
TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes doubled, and a backslash after the first character of every
    control string."""
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def n_tokens(text: str, chars_per_token: int = 4) -> int:
    """Token estimate of a turn: its characters over ``chars_per_token``, plus
    four for the turn's markers."""
    return -(-len(text) // chars_per_token) + 4


class _Windows:
    """Cuts one conversation, turn by turn.  Holds the open window and the turns
    that may be repeated, both within the budgets (or one turn)."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system, self.recent, self.context, self.new = None, deque(), [], []
        self.used = self.window = self.seen = 0

    def add(self, role: str, text: str):
        turn = (role, text, n_tokens(text))
        if self.new and self.used + turn[2] > self.budget:
            yield self.close()
        if self.seen == 0 and role == "system":
            self.system = turn
        else:
            self.recent.append(turn)
        self.new.append(turn)
        self.used += turn[2]
        self.seen += 1

    def close(self) -> dict:
        parts, at, loss = [], 0, []
        for i, (role, text, _) in enumerate(self.context + self.new):
            head, body = START + escape(role).replace("\n", "\\\n") + "\n", escape(text)
            if role == "assistant" and i >= len(self.context):
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
        row = {"conv_id": self.conv_id, "window": self.window, "n_context": len(self.context), "n_tokens": self.used,
               "formatted": "".join(parts), "loss": loss}
        total = sum(t[2] for t in self.recent)
        while self.recent and total > self.history:  # prefix sums: drop from the front until the rest fits
            total -= self.recent.popleft()[2]
        self.context = ([self.system] if self.system else []) + list(self.recent)
        self.used = total + (self.system[2] if self.system else 0)
        self.window, self.new = self.window + 1, []
        return row


def _flush(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("conv_id", pa.int64()), ("window", pa.int64()), ("n_context", pa.int32()), ("n_tokens", pa.int64()),
             ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in kinds], [n for n, _ in kinds])


def format_chats(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> one row per window: ``conv_id``,
    ``window`` (from 0), ``n_context`` (repeated turns at its start), ``n_tokens``,
    ``formatted`` and ``loss`` (character ranges of the targets in it).

    * Turns are ordered by ``turn`` (null first), then role and text; null roles
      and texts count as empty; a null ``conv_id`` is a conversation of its own.
    * A turn over the budget gets a window of its own, whole; context is not cut
      to make room, at most the system turn and ``history`` tokens are added.
    * A first turn with role ``system`` is repeated in every window.
    * Extra columns are ignored; an empty table gives no windows.
    Each conversation streams through one task, window by window; the task holds
    one window, whatever the conversation's length.
    """
    def cut(batches: Iterator[pa.RecordBatch]):
        state, rows, held = None, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or state.conv_id != conv:
                    if state is not None:
                        rows.append(state.close())
                    state = _Windows(conv, budget, history)
                rows += state.add(role or "", text or "")
                if len(rows) >= 256:
                    yield _flush(rows)
                    rows = []
        if state is not None:
            rows.append(state.close())
        if rows:
            yield _flush(rows)

    return (turns.select(turns["conv_id"].cast("long").alias("conv_id"), "turn", "role", "text")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(cut, WINDOWS))


def read_back(windows: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from the formatted windows: the
    number and SHA-256 of its turns (role, newline, text, newline each), the
    code points and SHA-256 of all targets, and the formatted code points.
    Streams over the windows in order; the state is two hashes."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]):
        done, state = [], None

        def finish():
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]))

        for batch in batches:
            for conv, context, formatted, loss in zip(*(batch.column(c).to_pylist()
                                                        for c in ("conv_id", "n_context", "formatted", "loss"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        finish()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for i, turn in enumerate(TURN.finditer(formatted)):
                    if i >= context:
                        state[1] += 1
                        state[2].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                for span in loss:
                    target = unescape(formatted[span["start"]:span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(formatted)
                state[6] += 1
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done = []
        if state is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, n_windows long")
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(digest, schema)
