"""Packing token pieces into windows with minimum bin slack.

Every task streams over its documents. Whole windows of a long document leave at once; what is left
of each document waits in a bounded buffer, counted by length. A window takes the longest waiting
piece and the multiset of other lengths that comes closest to its capacity, found by a subset-sum
over bitsets; backtracking gives the count of each length, and the same fill repeats as often as
the counts allow. The last windows of a task cut a piece where no multiset fits, so at most one
sequence per task needs padding.

* Null texts count as empty; an empty document is its end token alone.
* Rows that repeat are documents of their own; a null id stays null.
* Sequence numbers come from the number of the input partition, so the input has to be stable
  (files, or a written table): a task that runs again deals out the same numbers.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

LENGTH = 1024
BUFFER = 2048  # waiting pieces of a task
FLUSH = 1 << 20  # token bytes in a batch of results

OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of a text by a ``tokenizers`` file.

    ``ranks`` may name the same vocabulary as byte-pair ranks, which a second library encodes several
    times faster. It serves texts of Latin letters without the strings of special tokens; all others
    go through the tokenizer itself. Lines that repeat are looked up.
    """

    MANY = 20_000

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.other = re.compile("[^\\x00-\\u024f]")
        self.break_ = re.compile(r"(?<=\S)\n(?=\S)")
        self.lines: dict[str, np.ndarray] = {}
        self.newline = self._ids("\n") if self.fast else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self.other.search(text) or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        # A line break between two other characters is a token of its own: lines encode one by one.
        parts = []
        for line in self.break_.split(text):
            ids = self.lines.get(line)
            if ids is None:
                ids = self._ids(line)
                if len(line) < 2000:
                    if len(self.lines) >= self.MANY:
                        self.lines.clear()
                    self.lines[line] = ids
            parts += [ids, self.newline]
        return np.concatenate(parts[:-1])


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, out of ``counts``, whose sum is largest within ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, size = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            k = min(size, left)
            steps.append((length, k, reach))
            reach |= reach << (k * length) & mask
            left, size = left - k, size * 2
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] += k
            at -= k * length
    return dict(used)


class Packer:
    """Windows out of pieces ``(doc_id, start, ids, doc_tokens)``; ``rows`` collects what is placed."""

    def __init__(self, length: int, first: int):
        self.length, self.next = length, first
        self.waiting: dict[int, deque] = {}
        self.n = 0
        self.rows: list[tuple] = []
        self.bytes = 0

    def place(self, pieces: Iterable[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.next, offset))
            self.bytes += 4 * len(ids)
            offset += len(ids)
        self.next += 1

    def wait(self, piece: tuple) -> None:
        self.waiting.setdefault(len(piece[2]), deque()).append(piece)
        self.n += 1

    def pop(self, length: int) -> tuple:
        queue = self.waiting[length]
        piece = queue.popleft()
        if not queue:
            del self.waiting[length]
        self.n -= 1
        return piece

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.length * self.length
        for at in range(0, whole, self.length):
            self.place([(doc, at, ids[at : at + self.length], len(ids))])
        if whole < len(ids):
            self.wait((doc, whole, ids[whole:], len(ids)))

    def pack(self, until: int) -> None:
        """Fill windows until at most ``until`` pieces wait."""
        while self.n > until:
            counts = {k: len(q) for k, q in self.waiting.items()}
            largest = max(counts)
            counts[largest] -= 1
            used = best_fill(counts, self.length - largest)
            used[largest] = used.get(largest, 0) + 1
            slack = self.length - sum(k * n for k, n in used.items())
            times = min(len(self.waiting[k]) // n for k, n in used.items())
            for _ in range(times if not slack else 1):
                pieces = [self.pop(k) for k, n in used.items() for _ in range(n)]
                if slack and self.waiting:
                    # Nothing that waits fits into the slack: cut the shortest piece that is longer.
                    doc, start, ids, total = self.pop(min(self.waiting))
                    pieces.append((doc, start, ids[:slack], total))
                    self.wait((doc, start + slack, ids[slack:], total))
                self.place(pieces)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(OUT)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)


def pack(
    documents: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end: int = 0,
    buffer: int = BUFFER,
) -> DataFrame:
    """Sequences of at most ``length`` tokens: one row per piece, with its ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, ranks, pattern)
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        stop = np.array([end], "<u4")
        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.concatenate([encode(words.as_py() or ""), stop]))
                if packer.n >= buffer:
                    packer.pack(buffer // 2)
                if packer.bytes >= FLUSH:
                    yield packer.batch()
        packer.pack(0)
        yield packer.batch()

    return documents.select(documents[id].cast("long"), documents[text]).mapInArrow(run, SCHEMA)
