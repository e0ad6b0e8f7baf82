"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and one remainder. The remainders of a group of documents are dealt into
windows by differencing: each remainder starts as a partition of the windows that holds it alone; the two partitions of
the largest imbalance are merged again and again, the fullest window of one with the emptiest of the other, until one
partition is left, whose windows are nearly equal. It starts with the fewest windows that could hold the group; while
the fullest one exceeds the capacity, the number rises and the group is dealt anew.

A group is a run of consecutive rows of one task, so nothing is shuffled, memory is bounded by the group, and a lost
task gives the same windows when it runs again. A window's id is made of the task's partition and a count.

Defined results: null text counts as empty (a document of its end id alone); empty texts, repeated rows and equal
lengths are packed like any others, ties falling to the earlier row; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import slices, texts_of
from knotwork.llm.word_cache import cached_tokenizer


def difference(lengths: list[int], windows: int) -> np.ndarray:
    """The window of each item, by multiway differencing over the given number of windows.

    A partition is the sums of its windows, less the least of them, in falling order. A merge is remembered as the order
    in which the joined windows fell, so that membership is worked out once, from the last merge down.
    """
    turn = count()
    heap: list[tuple[int, int, np.ndarray, object]] = []
    for item, length in enumerate(lengths):
        sums = np.zeros(windows, np.int64)
        sums[0] = length
        heap.append((-length, next(turn), sums, item))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        joined = a + b[::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order] - joined[order[-1]]
        heapq.heappush(heap, (-int(joined[0]), next(turn), joined, (left, right, order.astype(np.int32))))
    window = np.zeros(len(lengths), np.int64)
    stack: list[tuple[object, np.ndarray]] = [(heap[0][3], np.arange(windows, dtype=np.int32))] if heap else []
    while stack:
        node, names = stack.pop()
        if not isinstance(node, tuple):
            window[node] = names[0]
            continue
        left, right, order = node
        of_joined = np.empty_like(names)
        of_joined[order] = names
        stack += [(left, of_joined), (right, of_joined[::-1])]
    return window


def balance(lengths: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item and the number of windows, which rises from the fewest that the total needs until the fullest
    one fits: by one at least, and by what the fullest one's excess over the mean would need."""
    total = sum(lengths)
    windows = max(1, -(-total // capacity))
    while True:
        window = difference(lengths, windows)
        fullest = int(np.bincount(window, weights=lengths, minlength=windows).max(initial=0))
        if fullest <= capacity:
            return window, windows
        over = fullest - total / windows
        # half of the way that an unchanged excess would ask for: near the end of it windows are added one by one
        windows += max(1, int((total / max(1.0, capacity - over) - windows) / 2)) if over < capacity else 1


class Packer:
    """Packs the documents of one task, group after group."""

    def __init__(self, capacity: int, group: int, first_id: int) -> None:
        self.capacity, self.group, self.next_id = capacity, group, first_id
        self.held: list[tuple[object, int, np.ndarray, int]] = []

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        """Full windows at once; the remainder waits for its group."""
        full = len(ids) - len(ids) % self.capacity
        for start in range(0, full, self.capacity):
            yield key, start, ids[start : start + self.capacity], len(ids), self.next_id, 0
            self.next_id += 1
        if full < len(ids):
            self.held.append((key, full, ids[full:], len(ids)))
            if len(self.held) >= self.group:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.held:
            return
        window, windows = balance([len(x[2]) for x in self.held], self.capacity)
        filled = np.zeros(windows, np.int64)
        for (key, start, ids, total), w in zip(self.held, window, strict=True):
            yield key, start, ids, total, self.next_id + int(w), int(filled[w])
            filled[w] += len(ids)
        self.next_id += windows
        self.held = []


def pack(df: DataFrame, tokenizer_file: str, spaced: bool = False, end_id: int = 1, capacity: int = 2048, group: int = 512, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of windows: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (unless with_ids is false).

    spaced: the tokenizer drops white space. group: how many remainders are dealt together; a window never holds pieces
    of two groups, and the last group of a task may leave one window part empty.
    """
    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def columns(pieces: list[tuple]) -> dict[str, list]:
        out = {key: [p[0] for p in pieces], "start": [p[1] for p in pieces], "length": [len(p[2]) for p in pieces]}
        out |= {"ids_crc32": [zlib.crc32(p[2].astype("<u4").tobytes()) for p in pieces], "doc_tokens": [p[3] for p in pieces]}
        out |= {"sequence_id": [p[4] for p in pieces], "offset": [p[5] for p in pieces]}
        return out | ({"ids": [p[2].astype(np.int32) for p in pieces]} if with_ids else {})

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cached_tokenizer(tokenizer_file, spaced)
        packer = Packer(capacity, group, TaskContext.get().partitionId() << 33)

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            made = columns(pieces)
            return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for part in slices(batch):
                pieces: list[tuple] = []
                for k, value in zip(part.column("key").to_pylist(), texts_of(part), strict=True):
                    pieces += packer.add(k, np.append(words.ids(value), np.uint32(end_id)))
                if pieces:
                    yield out(pieces)
        if rest := list(packer.flush()):
            yield out(rest)

    return source.mapInArrow(run, fields)
