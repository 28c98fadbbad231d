"""Packing token ids into fixed windows by minimum bin slack (operator 10).

Each task packs the documents of its own partition, in groups of a bounded number of ids, so nothing is shuffled and no
group grows with the data. Inside a group whole windows are cut from long documents, and what remains of each document is
one length from 1 to capacity - 1. A bitset subset-sum dynamic program over the counts of those lengths picks the
multiset that fills a window closest to capacity; its counts are backtracked, and the same multiset is used again for as
long as the counts allow. Where even the best multiset leaves slack, another document is cut to close it. The last rest of
a group is cut into windows whose sizes are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.wordids import word_ids
from chatloom.llm.workers import in_small_batches, slices

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest that is at most ``room``.

    Bit k of ``reach`` says that k can be made. Counts are split into powers of two, so a length that occurs a million
    times adds twenty steps; the steps are walked back to find how often each length is used.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            use = min(take, left)
            steps.append((length, use, reach))
            reach |= (reach << (length * use)) & mask
            left, take = left - use, take * 2
        if reach >> room & 1:
            break
    target, picked = reach.bit_length() - 1, {}
    for length, use, before in reversed(steps):
        if not before >> target & 1:
            target -= length * use
            picked[length] = picked.get(length, 0) + use
    return picked


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (index into lengths, start, length): every unit of every length lies in exactly one."""
    windows: list[list[tuple[int, int, int]]] = []
    rest: dict[int, list[tuple[int, int]]] = {}
    for i, n in enumerate(lengths):
        whole = n - n % capacity
        windows.extend([(i, s, capacity)] for s in range(0, whole, capacity))
        if n % capacity:
            rest.setdefault(n % capacity, []).append((i, whole))
    counts = {k: len(v) for k, v in rest.items()}
    largest = [-k for k in counts]
    heapq.heapify(largest)

    def drop(length: int) -> tuple[int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return rest[length].pop()

    def put(i: int, start: int, length: int) -> None:
        rest.setdefault(length, []).append((i, start))
        if length not in counts:
            counts[length] = 0
            heapq.heappush(largest, -length)
        counts[length] += 1

    while counts:
        while -largest[0] not in counts:
            heapq.heappop(largest)
        seed = -largest[0]
        counts[seed] -= 1
        picked = best_fill({k: v for k, v in counts.items() if v}, capacity - seed)
        counts[seed] += 1
        picked[seed] = picked.get(seed, 0) + 1
        slack = capacity - sum(k * v for k, v in picked.items())
        for _ in range(1 if slack else min(counts[k] // v for k, v in picked.items())):
            window = [(*drop(k), k) for k, v in picked.items() for _ in range(v)]
            windows.append(window)
        if slack and counts:
            # Whatever is left is longer than the slack, or the dynamic program would have used it.
            length = min(counts)
            i, start = drop(length)
            windows[-1].append((i, start, slack))
            put(i, start + slack, length - slack)
        elif slack:
            windows.extend(_powers(windows.pop(), capacity - slack))
    return windows


def _powers(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """Cut one unfilled window into windows of falling powers of two."""
    pieces = pieces[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total, window = total - size, []
        while size:
            i, start, n = pieces.pop()
            use = min(n, size)
            window.append((i, start, use))
            size -= use
            if use < n:
                pieces.append((i, start + use, n - use))
        yield window


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, group_ids: int) -> Iterator[pa.RecordBatch]:
    ids, end, sequence = word_ids(path), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId() << 32

    def group(names: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        rows: list[tuple] = []
        held = 0
        for window in pack_lengths([len(x) // 4 for x in texts], capacity):
            offset = 0
            for i, start, n in window:
                rows.append((names[i], start, n, len(texts[i]) // 4, sequence, offset, texts[i][4 * start : 4 * (start + n)]))
                offset += n
                held += n
            sequence += 1
            if held >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    names: list = []
    texts: list[bytes] = []
    held = 0
    for part, whole in slices(batches, 1):
        for name, text in zip(part.column(0).to_pylist(), whole, strict=True):
            names.append(name)
            texts.append(ids.encode(text) + end)
            held += len(texts[-1]) // 4
            if held >= group_ids:
                yield from group(names, texts)
                names, texts, held = [], [], 0
    if names:
        yield from group(names, texts)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_ids: int = 4_000_000) -> DataFrame:
    """Pack every whole ``text`` (with ``end_id`` after it) into sequences of at most ``capacity`` ids.

    Returns one row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned
    32-bit). ``group_ids`` bounds what one task holds: it packs as soon as it has that many ids (one longer document is
    packed alone). A sequence number carries the partition's number, so it is unique and a repeated task gives it again.

    Null or empty text: the end id alone. Null doc_id: packed, doc_id stays null. Repeated rows: each is packed. Empty
    table: no rows. Other columns are not read.
    """
    rows = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(lambda b: _pack(b, tokenizer_path, capacity, end_id, group_ids), SCHEMA)
