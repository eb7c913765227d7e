"""Exact top-k inner products with a bit-sliced index.

Components are quantised to integers. A block of the index holds up to ``block_rows`` vectors
as bitmaps: one for each (bit, dimension), a bit a vector. A query's score over a whole block
is then bit-sliced arithmetic: for each bit set in a query weight, the bitmaps of the
dimension are added at the right significance by carry-save adders (XOR, AND, OR over whole
bitmaps), which leaves the sum itself in bit slices. The lowest ``dropped`` slices of the
attributes are left out of the sum, so it is off by a known bound. The rows of greatest sum
are selected from the most significant slice downward, counting bits; every row within the
bound of the k-th sum is a boundary row, and all of those are resolved by exact integer inner
products. So the result is exact.

Queries are sent to the blocks of the index, each of which is read once and moved once: a
task sees a block first and then its queries as a stream, so its memory is that of one block and one
batch of queries. A block returns at most k rows a query. The work is that of the query set
against all rows, in blocks; a query's
results are merged by a window that keeps k rows a task before it shuffles.

Defined cases: vectors that are null or hold null or non-finite components take no part;
vectors are compared with those of equal length only; the query's own id is no candidate;
repeated rows are candidates each for themselves; equal query rows are one query, and different
vectors under one id share that id's k best rows (the greatest scores of any of them); ties go
to the smaller id; a query without candidates has no rows; empty tables give empty results;
further columns are dropped. Where a sum of absolute products could pass 64 bits, or a quantised
component 62, the job stops with an error: no score is ever wrapped around.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

BLOCK_ROWS = 1 << 15
#: Fewer rows than this are not worth a block of their own.
LEAST_ROWS = 1 << 14
DROPPED = 1

_INDEX = "dims int, ids binary, low binary, slices binary, bits int, values binary"


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(least value of each dimension, bitmaps [bit, dimension, word], bits) of [row, dimension]."""
    low = values.min(axis=0)
    above = (values - low).astype(np.uint64)
    bits = max(1, int(above.max()).bit_length())
    rows = -(-len(values) // 64) * 64
    padded = np.zeros((rows, values.shape[1]), np.uint64)
    padded[: len(values)] = above
    planes = [np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(bool).T, axis=1, bitorder="little") for b in range(bits)]
    return low, np.ascontiguousarray(np.stack(planes)).view(np.uint64), bits


def _sum(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bit slices, least significant first, of a sum of bitmaps by significance."""
    out = []
    p = 0
    while any(k >= p for k in columns):
        here = columns.pop(p, [])
        stack = np.concatenate(here) if here else None
        carries = columns.setdefault(p + 1, [])
        while stack is not None and len(stack) > 2:
            t = len(stack) // 3
            a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
            x = a ^ b
            carries.append((a & b) | (x & c))
            stack = np.concatenate([x ^ c, stack[3 * t :]])
        if stack is not None and len(stack) == 2:
            carries.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        if not carries:
            columns.pop(p + 1)
        out.append(None if stack is None else stack[0])
        p += 1
    return out


class Block:
    """A block of the index, ready for queries."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray, values: np.ndarray):
        self.ids, self.low, self.values = ids, low, values
        self.bits, self.dims, self.words = slices.shape
        # Bitmaps and their complements: a negative weight adds (greatest value - value) instead.
        self.slices = np.concatenate([slices, ~slices]).reshape(-1, self.words)
        self.all = np.packbits(np.arange(self.words * 64) < len(ids), bitorder="little").view(np.uint64)
        self.order = np.argsort(ids, kind="stable")
        self.most = np.maximum(np.abs(values.max(axis=0, initial=0).astype(np.int64)), np.abs(values.min(axis=0, initial=0).astype(np.int64)))

    def sums(self, q: np.ndarray, dropped: int) -> tuple[list[np.ndarray], int]:
        """(bit slices of the sum short of its dropped part, bound of that part)."""
        weight = np.abs(q)
        side = np.where(q < 0, self.bits * self.dims, 0) + np.arange(self.dims)
        columns: dict[int, list[np.ndarray]] = {}
        for w in range(int(weight.max()).bit_length() if len(weight) else 0):
            at = side[(weight >> w) & 1 == 1]
            if len(at):
                for b in range(dropped, self.bits):
                    columns.setdefault(w + b - dropped, []).append(self.slices[at + b * self.dims])
        return _sum(columns), int(weight.sum()) * ((1 << dropped) - 1)

    def top(self, q: np.ndarray, own: int, k: int, dropped: int = DROPPED) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the block's k best rows other than ``own``."""
        if np.abs(q).astype(float) @ self.most.astype(float) >= 2.0**62 and sum(abs(a) * b for a, b in zip(q.tolist(), self.most.tolist(), strict=True)) >= 1 << 63:
            raise OverflowError(f"scores of query {own} may not fit in 64 bits")
        dropped = min(dropped, self.bits - 1)
        live = self.all
        a, b = np.searchsorted(self.ids, [own, own + 1], sorter=self.order)
        if b > a:
            live = live.copy()
            for row in self.order[a:b].tolist():
                live[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        total = int(np.bitwise_count(live).sum())
        if total > k:
            sums, bound = self.sums(q, dropped)
            live = self._within(sums, live, k, -(-bound >> dropped))
        rows = np.flatnonzero(np.unpackbits(live.view(np.uint8), bitorder="little"))
        scores = self.values[rows].astype(np.int64) @ q
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]

    @staticmethod
    def _within(sums: list[np.ndarray], live: np.ndarray, k: int, slack: int) -> np.ndarray:
        """Rows whose sum is at least the k-th greatest less ``slack``."""
        equal, above, kth = live, 0, 0
        for i in range(len(sums) - 1, -1, -1):
            if sums[i] is None:
                continue
            ones = equal & sums[i]
            n = int(np.bitwise_count(ones).sum())
            if above + n >= k:
                equal = ones
                kth |= 1 << i
            else:
                above += n
                equal = equal & ~sums[i]
        least = max(0, kth - slack)
        greater, equal = np.zeros_like(live), live
        for i in range(len(sums) - 1, -1, -1):
            s = np.zeros_like(live) if sums[i] is None else sums[i]
            if least >> i & 1:
                equal = equal & s
            else:
                greater = greater | (equal & s)
                equal = equal & ~s
        return greater | equal


def quantised(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * component) as longs, of the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = lambda x: F.when(F.abs(F.lit(scale) * x) < float(1 << 62), F.floor(F.lit(scale) * x).cast("long")).otherwise(F.raise_error(F.lit("a quantised component does not fit in 62 bits")).cast("long"))
    return rows.where(finite).select("id", F.transform("v", fits).alias("v"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = pa.concat_arrays(table.column("v").chunks)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return table.column("id").to_numpy(), flat.reshape(len(lists), -1)


def _narrow(values: np.ndarray) -> np.ndarray:
    kind = next(k for k in (np.int16, np.int32, np.int64) if not values.size or (values.min() >= np.iinfo(k).min and values.max() <= np.iinfo(k).max))
    return values.astype(kind)


def _indexed(table: pa.Table, of: int) -> pa.Table:
    ids, values = _matrix(table)
    low, slices, bits = slices_of(values)
    row = {"of": of, "dims": values.shape[1], "ids": ids.tobytes(), "low": low.tobytes(), "slices": slices.tobytes(), "bits": bits, "values": _narrow(values).tobytes()}
    return pa.Table.from_pylist([row], pa.schema([("of", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("slices", pa.binary()), ("bits", pa.int32()), ("values", pa.binary())]))


def block_of(row: dict) -> Block:
    ids, d = np.frombuffer(row["ids"], np.int64), row["dims"]
    values = np.frombuffer(row["values"], np.dtype(f"i{len(row['values']) // (len(ids) * d)}")).reshape(len(ids), d)
    return Block(ids, np.frombuffer(row["low"], np.int64), np.frombuffer(row["slices"], np.uint64).reshape(row["bits"], d, -1), values)


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(blocks, [(dims, first block, number of blocks)]): rows of (of, dims, ids, low, slices, bits, values).

    Vectors are dealt evenly, so blocks hold ``block_rows`` vectors or a little less, and fewer
    where there would be fewer blocks than cores.
    """
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("d > 0").collect()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    first, parts = 0, []
    for s in sorted(sizes, key=lambda s: s.d):
        rows = min(block_rows, max(LEAST_ROWS, -(-s.n // cores)))
        parts.append((s.d, first, math.ceil(s.n / (0.9 * rows))))  # the hash deals unevenly
        first += parts[-1][2]
    block = F.lit(None).cast("long")
    for d, at, n in parts:
        block = F.when(F.size("v") == d, F.pmod(F.xxhash64("n"), F.lit(n)) + at).otherwise(block)
    dealt = vectors.where(F.size("v") > 0).withColumn("n", F.monotonically_increasing_id()).select(block.alias("of"), "id", "v")
    made = dealt.groupBy("of").applyInArrow(lambda key, t: _indexed(t, key[0].as_py()), f"of bigint, {_INDEX}")
    return materialise(made, "bit-slices"), parts


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, dropped: int = DROPPED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` of greatest inner product with
    each row of ``queries``; both tables have the columns ``key`` and ``vector``."""
    index, parts = build_index(quantised(vectors, key, vector, scale), block_rows)
    asked = quantised(queries, key, vector, scale).where("id is not null and size(v) > 0").distinct()
    blocks = F.array().cast("array<bigint>")
    for d, at, n in parts:  # a query meets the blocks of its own length
        blocks = F.when(F.size("v") == d, F.sequence(F.lit(at).cast("long"), F.lit(at + n - 1).cast("long"))).otherwise(blocks)
    wanted = asked.select(F.explode(blocks).alias("of"), "id", "v")
    both = index.unionByName(wanted, allowMissingColumns=True).repartitionById(max(1, sum(n for _, _, n in parts)), F.col("of").cast("int")).sortWithinPartitions("of", F.col("id").asc_nulls_first())

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for batch in batches:
            ids = batch.column("id")
            for i in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)).tolist() + [batch.num_rows]:
                # Queries before the next block are those of the one before.
                lo = 0 if at is None else at
                if i > lo:
                    part = pa.Table.from_batches([batch.slice(lo, i - lo).select(["id", "v"])])
                    out = [(np.full(len(f), own), f, s) for own, q in zip(*_matrix(part), strict=True) for f, s in [block.top(q, int(own), k, dropped)]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out]).astype(np.int64)) for j in range(3)], ["query_id", "vec_id", "score"])
                if i < batch.num_rows:
                    block, at = block_of(batch.slice(i, 1).to_pylist()[0]), i + 1
            at = None

    found = both.mapInArrow(searched, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
