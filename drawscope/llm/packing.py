"""Packing token streams into windows of at most ``capacity`` tokens by Karmarkar-Karp.

Every document is encoded and ended with ``end_id``. Stretches of exactly ``capacity`` tokens
are windows of their own; what is left of each document (under ``capacity``) is cut into
left-overs of at most a third of ``capacity``, small enough for windows to come out nearly
full, and dealt to windows by multiway differencing: every left-over starts as a partial partition into m
windows, all but one empty; again and again the two partial partitions of greatest imbalance
are merged so that the fullest windows of one meet the emptiest of the other. The result is m
nearly equal windows. m starts at the least number that could hold all tokens, and rises by
one whenever a window comes out over capacity.

Packing runs where the documents lie: each task packs its rows in groups of about
``group_windows`` windows, so no text is shuffled. What a task has left at its end, less than a group,
is packed with that of the other tasks in a second pass over numbers alone (ids, lengths and
checksums), in parts of several groups each. So padding hardly depends on how many tasks
there were. Window ids are (partition << 33) + running number, in the second pass
2**62 more.

Memory is bounded by a group: it ends after ``group_windows`` windows, or ``GROUP_PIECES``
left-overs, and left-overs under a 32nd of ``capacity`` go to windows in bundles of a 32nd to a 16th, so
that a group of one-token documents is no larger a problem than any other.

Padding: a window is filled up to ``capacity``, except where its length is a power of two;
``padded_length`` says to what. A window that could hold no document is never made.

Defined cases: a null or empty text is its end token alone; a document longer than
``capacity`` is cut into pieces; equal documents (repeated ids too) are packed each for
themselves; a null id is carried; an empty table gives no pieces; further columns are dropped.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from . import tokens

CAPACITY = 4096
GROUP_WINDOWS = 192
GROUP_PIECES = 1 << 18
#: Groups that a task of the second pass has at least, where there are as many.
SECOND_GROUPS = 4
SECOND_PASS = 1 << 62

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def differencing(sizes: list[int], m: int) -> np.ndarray:
    """The window (0 to m - 1) of each size, by Karmarkar-Karp differencing over m windows.

    A partial partition keeps its sums in ascending order, less the least of them, so its last
    sum is its imbalance. ``moves`` records, for every merge, where the windows of both went.
    """
    n = len(sizes)
    if m == 1 or n <= 1:
        return np.zeros(n, np.int64)
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(m, np.int64)
        sums[-1] = s
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    moves: list[tuple[int, int, np.ndarray]] = []
    back = np.arange(m)[::-1]
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        merged = x + y[::-1]
        order = np.argsort(merged, kind="stable")
        moves.append((a, b, order))
        merged = merged[order]
        merged -= merged[0]
        heapq.heappush(heap, (-int(merged[-1]), n + len(moves) - 1, merged))
    # From the last merge down: at[j] is the final window of the partition's j-th sum.
    at: dict[int, np.ndarray] = {n + len(moves) - 1: np.arange(m)}
    out = np.zeros(n, np.int64)
    for k in range(len(moves) - 1, -1, -1):
        a, b, order = moves[k]
        place = np.empty(m, np.int64)
        place[order] = at.pop(n + k)
        for part, where in ((a, place), (b, place[back])):
            if part < n:
                out[part] = where[-1]
            else:
                at[part] = where
    return out


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each size, none over capacity; sizes are at most ``capacity``."""
    if not sizes:
        return np.zeros(0, np.int64)
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, m)
        if np.bincount(found, weights=sizes, minlength=m).max() <= capacity:
            return found
        m += 1


def padded_length(length: int, capacity: int = CAPACITY) -> int:
    return length if length & (length - 1) == 0 else capacity


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def bundles(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bundle of each left-over: one of its own, or one shared with neighbours as small."""
    least = max(1, capacity // 32)
    small = sizes < least
    before = np.cumsum(np.where(small, sizes, 0)) - np.where(small, sizes, 0)
    key = np.where(small, before // least, -1 - np.arange(len(sizes)))
    return np.unique(key, return_inverse=True)[1]


class _Group:
    """Left-overs of one task that are packed together, as columns; ``first`` is the next free window id."""

    NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")

    def __init__(self, capacity: int, first: int):
        self.capacity, self.first = capacity, first
        self._clear()

    def _clear(self) -> None:
        self.columns = [array("q") for _ in self.NAMES]
        self.no_id = array("b")
        self.tokens = 0

    def add(self, doc_id: int | None, start: int, length: int, crc: int, doc_tokens: int) -> None:
        for column, value in zip(self.columns, (doc_id or 0, start, length, crc, doc_tokens), strict=True):
            column.append(value)
        self.no_id.append(doc_id is None)
        self.tokens += length

    def full(self, group_windows: int) -> bool:
        return self.tokens >= group_windows * self.capacity or len(self.no_id) >= GROUP_PIECES

    def _table(self, window: np.ndarray | None, offset: np.ndarray | None) -> pa.RecordBatch:
        columns = [np.frombuffer(c, np.int64) if len(c) else np.zeros(0, np.int64) for c in self.columns]
        found = [pa.array(columns[0], mask=np.array(self.no_id, bool)), *map(pa.array, columns[1:])]
        for x in (window, offset):
            found.append(pa.nulls(len(columns[0]), pa.int64()) if x is None else pa.array(x, pa.int64()))
        return pa.RecordBatch.from_arrays(found, [*self.NAMES, "sequence_id", "offset"])

    def left(self) -> pa.RecordBatch:
        """The left-overs, without a window."""
        out = self._table(None, None)
        self._clear()
        return out

    def close(self) -> pa.RecordBatch:
        sizes = np.array(self.columns[2], np.int64)
        item = bundles(sizes, self.capacity)
        where = windows(np.bincount(item, weights=sizes).astype(np.int64).tolist(), self.capacity)[item]
        _, dense = np.unique(where, return_inverse=True)
        order = np.argsort(dense, kind="stable")
        ends = np.cumsum(sizes[order])
        offset = np.zeros(len(sizes), np.int64)
        begins = np.searchsorted(dense[order], dense[order])
        offset[order] = ends - sizes[order] - (ends - sizes[order])[begins]
        out = self._table(dense + self.first, offset)
        self.first += int(dense.max()) + 1 if len(dense) else 0
        self._clear()
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], [*_Group.NAMES, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, end_id: int = tokens.END_ID) -> DataFrame:
    """A row for every piece: where it comes from in its document, and where it lies in its window."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(capacity, TaskContext.get().partitionId() << 33)
        most = max(1, capacity // 3)
        for batch in batches:
            whole: list[tuple] = []
            for doc_id, found in zip(batch.column(0).to_pylist(), tokens.encoder(tokenizer).encode(batch.column(1)), strict=True):
                ids = tokens.with_end(found, end_id)
                n = len(ids)
                rest = n - n % capacity
                for start in range(0, rest, capacity):
                    whole.append((doc_id, start, capacity, _crc(ids[start : start + capacity]), n, group.first, 0))
                    group.first += 1
                for start in range(rest, n, most):
                    part = ids[start : start + most]
                    group.add(doc_id, start, len(part), _crc(part), n)
                if group.full(group_windows):
                    yield group.close()
            if whole:
                yield _batch(whole)
        yield group.left()

    def packed_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(capacity, SECOND_PASS + (TaskContext.get().partitionId() << 33))
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(_Group.NAMES))), strict=True):
                group.add(*row)
                if group.full(group_windows):
                    yield group.close()
        yield group.close()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = materialise(rows.mapInArrow(packed, PIECES), "pieces")
    left = pieces.where("sequence_id is null")
    total = left.agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).first()
    parts = max((total.n or 0) // (SECOND_GROUPS * group_windows * capacity), total.pieces // (SECOND_GROUPS * GROUP_PIECES))
    dealt = left.repartition(parts) if parts > 1 else left.coalesce(1)
    return pieces.where("sequence_id is not null").unionByName(dealt.select(*_Group.NAMES).mapInArrow(packed_again, PIECES))
