"""Suffix-array dedup: bytes covered by a string of ``SPAN`` bytes that an earlier document has too.

Every window of ``SPAN`` bytes belongs to an anchor, its least q-gram by hash; equal windows have
equal anchors, so only windows of one anchor have to meet. The windows of an occurrence of an anchor
form one short context. Where contexts are equal, all but those of the smallest id are covered
whole. Contexts that differ but share their anchor go into a suffix array, and neighbours in it that
share ``SPAN`` bytes give the covered windows. Anchors with many occurrences, as boilerplate next to
ever different text has, are told apart by context and then by the bytes of each window instead.

* Texts are UTF-8 bytes; null counts as empty. Null ids take no part and lose nothing.
* Rows that repeat an id are one document as to who is earlier; each row is judged on its own.
* Documents equal to an earlier one lose everything, if they have ``SPAN`` bytes.
* Anchors and contexts are compared by 64-bit hashes, windows of differing contexts by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import settle
from .suffixes import ordered
from .words import mix, slices, utf8

SPAN = 50
GRAM = 20  # 50 - 20 + 1 = 31 windows of an anchor at most
ROWS = 2_000  # contexts per suffix array, unless one anchor has more
MANY = 50_000  # occurrences of an anchor that meet in one suffix array, 4 MB: shapes the work, never the result
OFTEN = 4  # an anchor that is not counted exceeds ``MANY`` by less than this for every million anchors
_C = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_C), n, 1 << 64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` (20) bytes from each position, by doubling."""
    with np.errstate(over="ignore"):
        h = _BYTES[data]
        four = None
        for k in (1, 2, 4, 8):
            h = h[:-k] + h[k:] * _power(k) if len(h) > k else h[:0]
            if k == 2:
                four = h
        if len(h) <= 16:
            return h[:0] if len(data) < GRAM else mix(h[: len(data) - GRAM + 1] + four[16 : len(data) - GRAM + 17] * _power(16))
        m = len(data) - GRAM + 1
        return mix(h[:m] + four[16 : 16 + m] * _power(16))


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, text, first byte of the context, length) of all occurrences."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    n = len(data) - SPAN + 1
    if n <= 0:
        return none
    h = _gram_hashes(data)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8):
        key = np.minimum(key[:-k], key[k:])
    least = np.minimum(key[:n], key[15 : 15 + n])  # over 31 q-grams
    size = np.diff(offsets)
    inside = np.arange(n) + SPAN <= np.repeat(offsets[1:], size)[:n]
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    lo, hi = start[first], start[np.r_[first[1:], len(start)] - 1]
    return h[at[first]], np.searchsorted(offsets, lo, "right") - 1, lo, hi + SPAN - lo


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, text, first byte of the context in its text, length) of all occurrences."""
    h, text, lo, length = _anchors(data, offsets)
    if not len(h):
        return h, np.zeros(0, np.uint64), text, lo, length
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(len(data), _C)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(len(data), np.uint64(pow(int(_C), -1, 1 << 64)))])
        total = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * up[:-1])]
        context = mix((total[lo + length] - total[lo]) * down[lo] + length.astype(np.uint64))
    return h, context, text, lo - offsets[text], length


def _signature(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _first_texts(batch: pa.RecordBatch, seen: dict[int, int]) -> Iterator[tuple]:
    """For slices of a batch (id, text): data, offsets, ids, signatures, and which texts were not seen with an id as small."""
    data, offsets = utf8(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for a, b in slices(offsets):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        keep, keys = np.zeros(b - a, bool), np.zeros(b - a, np.int64)
        for i in range(b - a):
            keys[i] = key = _signature(d[o[i] : o[i + 1]].tobytes())
            if seen.get(key, ids[a + i] + 1) > ids[a + i]:
                keep[i], seen[key] = True, ids[a + i]
        yield d, o, ids[a:b], keys, keep


def anchor_counts(documents: DataFrame) -> DataFrame:
    """(anchor, times) of the anchors in ``occurrences``, but those met less than ``OFTEN`` times among a million."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        held, size = [], 0

        def often() -> pa.RecordBatch:
            anchor, times = np.unique(np.concatenate(held), return_counts=True)
            on = times >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(anchor[on].astype(np.int64)), pa.array(times[on])], names=["anchor", "times"])

        for batch in batches:
            for d, o, _, _, keep in _first_texts(batch, seen):
                h, text, _, _ = _anchors(d, o)
                held.append(h[keep[text]])
                size += len(held[-1])
                if size > 1_000_000:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    return documents.mapInArrow(run, "anchor long, times long")


def occurrences(documents: DataFrame) -> DataFrame:
    """(anchor, context, id, row, place, length) of all texts; in a task, once per text and smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for d, o, ids, keys, keep in _first_texts(batch, seen):
                h, c, text, place, length = anchors(d, o)
                on = keep[text]
                text = text[on]
                arrays = [h[on].astype(np.int64), c[on].astype(np.int64), ids[text], keys[text], place[on], length[on]]
                for x in range(0, len(text), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v[x : x + 100_000], pa.int64()) for v in arrays],
                        names=["anchor", "context", "id", "row", "place", "length"],
                    )

    return documents.mapInArrow(run, "anchor long, context long, id long, row long, place long, length long")


def shared_windows(contexts: list[bytes], ids: list[int], span: int = SPAN) -> list[tuple[int, int]]:
    """(context, first byte) of every window that a context of a smaller id has as well, by one suffix array."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    offsets = np.cumsum([0, *map(len, contexts)])
    return list(zip(*(x.tolist() for x in _shared(data, offsets, np.array(ids, np.int64), span)), strict=True))


def _shared(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """As ``shared_windows``, of contexts that lie in a row; sorted."""
    count = np.maximum(np.diff(offsets) - span + 1, 0)
    context = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
    if not len(at):
        return context, at
    # A window ends in its context, so suffixes may run on into the next one.
    order, new = ordered(data, span, offsets[context] + at)
    by = ids[context[order]]
    least = np.minimum.reduceat(by, np.flatnonzero(new))
    hits = np.sort(order[by > least[np.cumsum(new) - 1]])
    return context[hits], at[hits]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row, and the offsets of each value in them."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The bytes of ``data`` from every start on."""
    ends = np.cumsum(length)
    at = np.arange(int(length.sum())) + np.repeat(start - ends + length, length)
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())])


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The occurrences, sorted by anchor, context and id, that matter, and whether a smaller id has their whole context.

    Those of the smallest id only matter if their anchor has several contexts and ids. Rows of an
    anchor are held until its last one is there; of a crowded anchor no row is held.
    """

    def out(rows: np.ndarray, crowded: bool) -> pa.RecordBatch:
        anchor, _, ids, row, place, length, whole = rows
        columns = [*map(pa.array, (anchor, ids, row, place, length, whole.astype(bool), np.full(len(ids), crowded)))]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "row", "place", "length", "whole", "crowded"])

    def several(rows: np.ndarray) -> pa.RecordBatch:
        anchor, context, ids, whole = rows[0], rows[1], rows[2], rows[6]
        new = np.r_[True, anchor[1:] != anchor[:-1]]
        first = np.flatnonzero(new)
        differ = np.add.reduceat(np.r_[True, context[1:] != context[:-1]] & ~new, first) > 0
        differ &= np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        return out(rows[:, (whole > 0) | differ[np.cumsum(new) - 1]], False)

    held, last = np.zeros((7, 0), np.int64), None
    for batch in batches:
        if not len(batch):
            continue
        rows = np.stack([batch.column(k).to_numpy() for k in range(6)])
        crowded = batch.column(6).to_numpy(zero_copy_only=False)
        anchor, context, ids = rows[:3]
        new = np.r_[last is None or (anchor[0], context[0]) != last[:2], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])]
        least = np.r_[last[2] if last else 0, ids[new]][np.cumsum(new)]
        last = anchor[-1], context[-1], least[-1]
        rows = np.vstack([rows, ids > least])
        if crowded.any():
            yield out(rows[:, crowded], True)
        held = np.hstack([held, rows[:, ~crowded]])
        cut = np.flatnonzero(held[0, 1:] != held[0, :-1])
        if len(cut):
            yield several(held[:, : cut[-1] + 1])
            held = held[:, cut[-1] + 1 :]
    if held.shape[1]:
        yield several(held)


def covered(documents: DataFrame, many: int = MANY) -> DataFrame:
    """(id, row, start, end): byte spans that leave, not merged; ``documents``: (id, text)."""
    times = anchor_counts(documents).groupBy("anchor").agg(F.sum("times").alias("m"))
    crowded = settle(times.filter(F.col("m") > many).select("anchor"), "crowded").withColumn("crowded", F.lit(True))
    found = occurrences(documents).join(crowded, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    found = found.withColumn("part", F.when(F.col("crowded"), F.col("context")).otherwise(F.lit(0)))
    found = found.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "context", "id")
    found = found.select("anchor", "context", "id", "row", "place", "length", "crowded")
    found = settle(found.mapInArrow(judged, "anchor long, id long, row long, place long, length long, whole boolean, crowded boolean"), "occurrences")
    whole = found.filter("whole").select("id", "row", F.col("place").alias("start"), (F.col("place") + F.col("length")).alias("end"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            keep = np.array([_signature(data[a:b].tobytes()) == r for a, b, r in zip(offsets[:-1], offsets[1:], rows, strict=True)], bool)
            parts = batch.column(3)
            owner = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy(zero_copy_only=False)))
            fields = parts.flatten().flatten()
            anchor, place, length = (f.to_numpy(zero_copy_only=False)[keep[owner]] for f in fields)
            owner = owner[keep[owner]]
            for x in range(0, len(owner), 20_000):
                of, p, n = owner[x : x + 20_000], place[x : x + 20_000], length[x : x + 20_000]
                arrays = [*map(pa.array, (anchor[x : x + 20_000], ids[of], rows[of], p)), _pieces(data, offsets[of] + p, n)]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "id", "row", "place", "bytes"])

    def contexts(some: DataFrame) -> DataFrame:
        # Texts that hold a context which differs from others of its anchor hand out its bytes.
        parts = some.groupBy("id", "row").agg(F.collect_list(F.struct("anchor", "place", "length")).alias("parts"))
        joined = documents.join(parts, "id").select("id", "row", "text", "parts")
        return joined.mapInArrow(cut, "anchor long, id long, row long, place long, bytes binary")

    # Equal windows have equal anchors, so the bytes of a window are key enough.
    at = F.explode(F.sequence(F.lit(0), F.length("bytes") - SPAN)).alias("at")
    windows = contexts(found.filter("not whole and crowded")).select("id", "row", "place", "bytes", at)
    windows = windows.select("id", "row", (F.col("place") + F.col("at")).alias("start"), F.expr(f"substring(bytes, at + 1, {SPAN})").alias("window"))
    least = windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most")
    repeated = windows.join(least, "window").filter("id > least").select("id", "row", "start", (F.col("start") + SPAN).alias("end"))

    dealt = contexts(found.filter("not whole and not crowded")).repartition("anchor").sortWithinPartitions("anchor")

    def solve(held: pa.Table) -> pa.RecordBatch:
        held = held.combine_chunks()
        data, offsets = _binary(held["bytes"].combine_chunks())
        ids, rows, places = (held[c].to_numpy() for c in ("id", "row", "place"))
        k, at = _shared(data, offsets, ids)
        # Windows that touch or overlap are one span.
        new = np.r_[np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (at[1:] > at[:-1] + SPAN)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(k)][: len(first)] - 1
        of = k[first]
        columns = [ids[of], rows[of], places[of] + at[first], places[of] + at[last] + SPAN]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "row", "start", "end"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                anchor = part.column(0).to_numpy()
                # Anchors stay together, so that windows of one anchor meet in one array.
                before = held[-1].column(0)[-1].as_py() if held else None
                new = np.flatnonzero(np.r_[bool(held) and anchor[0] != before, anchor[1:] != anchor[:-1]])
                if len(new):
                    yield solve(pa.Table.from_batches([*held, part.slice(0, new[-1])]))
                    held, part = [], part.slice(new[-1])
                held.append(part)
        if held:
            yield solve(pa.Table.from_batches(held))

    return whole.unionByName(repeated).unionByName(dealt.mapInArrow(match, "id long, row long, start long, end long"))


def dedup(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the merged ``spans``."""
    read = documents.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = settle(covered(read.filter("id is not null")), "covered")
    by = spans.groupBy("id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    by = by.groupBy("id").agg(F.collect_list(F.struct("row", "spans")).alias("rows"))
    # The first of equal texts stays; the others lose everything.
    sizes = read.select("id", F.xxhash64("text").alias("k"), F.octet_length("text").alias("n"))
    first = sizes.filter(f"n >= {SPAN} and id is not null").groupBy("k", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    copies = settle(first, "copies")
    marked = read.withColumns({"k": F.xxhash64("text"), "n": F.octet_length("text")}).join(copies, ["k", "n"], "left")
    marked = marked.withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    joined = marked.join(by, "id", "left").select("id", "text", "copy", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, copy, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                found = [(0, len(raw))] if copy else []
                if rows and not copy:
                    key = _signature(raw)
                    found = sorted((s["start"], s["end"]) for r in rows if r["row"] == key for s in r["spans"])
                merged: list[list[int]] = []
                for a, b in found:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((i, len(raw), sum(b - a for a, b in merged), len(merged), digest.hexdigest(), merged))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.list_(pa.int64()))),
    ]
)
