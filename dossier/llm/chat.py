"""Chat formatting in budgeted windows.

The turns of a conversation are read in order. Their prefix sums of tokens choose the windows: a
window starts where the one before ended and takes whole turns as long as the budget lasts. It
keeps the system turn, repeats the latest turns as far as the history budget goes, and carries loss
only on assistant turns that no earlier window has taught.

Template: ``<s>[INST] POSITION KIND ROLE [/INST]TEXT</s>``, POSITION counting turns from 0, KIND
``new`` or ``again``. A control string inside a role or text gets a backslash behind its first
character, and one that already has backslashes there gets one more, so ``unescape`` is exact.

* Null texts and roles count as empty. Turns with equal numbers are ordered by role and text; null
  numbers come first. Null is a conversation of its own.
* A turn longer than the budget is kept whole, alone in its window.
* One task reads the turns of a conversation as a stream (its digests need that order) and holds one
  window at most, so a very long conversation costs time, not memory.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
MARKS = 6  # tokens around every turn
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
TURN = re.compile(r"<s>\[INST\] (\d+) (new|again) (.*?) \[/INST\](.*?)</s>", re.S)
OUT = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("window", pa.int64()),
        ("formatted", pa.string()),
        ("loss_start", pa.list_(pa.int64())),
        ("loss_end", pa.list_(pa.int64())),
        ("n_tokens", pa.int64()),
    ]
)
SCHEMA = "conv_id long, window long, formatted string, loss_start array<long>, loss_end array<long>, n_tokens long"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def count_tokens(text: Column) -> Column:
    """The default measure of a turn: words and signs, and the marks of the template."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long") + MARKS


class Windows:
    """The windows of one conversation after another; ``step`` takes a turn and gives the window it closes."""

    def __init__(self, budget: int, history: int, learn: str):
        self.budget, self.history, self.learn = budget, history, learn
        self.conv = self.turns = None

    def begin(self, conv) -> None:
        self.conv, self.window, self.seen, self.prefix = conv, 0, 0, 0
        self.system = None
        self.past: deque = deque()
        self.open([])

    def open(self, head: list) -> None:
        self.head = head
        self.turns: list = []
        self.from_ = self.prefix - sum(t[3] for t in head)  # where the prefix sum of this window starts

    def close(self) -> tuple:
        parts, starts, ends, at = [], [], [], 0
        for kind, turns in (("again", self.head), ("new", self.turns)):
            for position, role, text, _ in turns:
                head = f"<s>[INST] {position} {kind} {escape(role)} [/INST]"
                body = escape(text)
                if kind == "new" and role == self.learn:
                    starts.append(at + len(head))
                    ends.append(at + len(head) + len(body))
                parts += [head, body, "</s>"]
                at += len(head) + len(body) + 4
        row = (self.conv, self.window, "".join(parts), starts, ends, self.prefix - self.from_)
        self.window += 1
        return row

    def step(self, role: str, text: str, tokens: int) -> tuple | None:
        turn = (self.seen, role, text, tokens)
        row = None
        if self.turns and self.prefix + tokens - self.from_ > self.budget:
            row = self.close()
            again = [t for t in self.past if self.system is None or t[0] != self.system[0]]
            while again and sum(t[3] for t in again) > self.history:
                again.pop(0)
            self.open(([self.system] if self.system else []) + again)
        self.turns.append(turn)
        self.prefix += tokens
        self.seen += 1
        if self.system is None and role == "system":
            self.system = turn
        self.past.append(turn)
        while len(self.past) > 1 and sum(t[3] for t in self.past) - self.past[0][3] >= self.history:
            self.past.popleft()
        return row


def format_conversations(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    learn: str = "assistant",
    tokens: Column | None = None,
) -> DataFrame:
    """Windows of every conversation of ``turns`` (conv_id, turn, role, text), with the spans that carry loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows, size = Windows(budget, history, learn), [], 0
        for batch in batches:
            for conv, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state.turns is None or conv != state.conv:
                    if state.turns:
                        rows.append(state.close())
                    state.begin(conv)
                if (row := state.step(role, text, n)) is not None:
                    rows.append(row)
                    size += len(row[2])
                if len(rows) >= 2000 or size > 1 << 22:
                    yield _batch(rows)
                    rows, size = [], 0
        if state.turns:
            rows.append(state.close())
        yield _batch(rows)

    read = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    read = read.withColumn("n", F.coalesce(count_tokens(F.col("text")) if tokens is None else tokens, F.lit(MARKS)).cast("long"))
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text", "n").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(OUT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)


def parse(formatted: str) -> list[tuple[int, str, str, str]]:
    """Position, kind, role and text of every turn of a window."""
    return [(int(m[1]), m[2], unescape(m[3]), unescape(m[4])) for m in TURN.finditer(formatted)]


def read_back(windows: DataFrame) -> DataFrame:
    """Digest of every conversation, from its formatted windows alone."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, out = None, None, []

        def done() -> None:
            if state:
                n, turns, chars, loss, size = state
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for row in batch.itertuples(index=False):
                key = None if pd.isna(row.conv_id) else int(row.conv_id)
                if state is None or key != conv:
                    done()
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for _, kind, role, text in parse(row.formatted):
                    if kind == "new":
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                for a, b in zip(row.loss_start, row.loss_end, strict=True):
                    text = unescape(row.formatted[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(row.formatted)
            if len(out) > 5000:
                yield _frame(out)
                out = []
        done()
        yield _frame(out)

    def _frame(rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        return frame.astype({"conv_id": "Int64"})

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInPandas(run, schema)
