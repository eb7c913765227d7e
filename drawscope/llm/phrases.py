"""Phrase collocation mining: exact counts of frequent phrases, and how firmly their words hold together.

Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces, and those into words at spaces
and tabs. Per language, a candidate is a phrase of 2 to 4 words that occurs at least ``least`` times within
pieces. Cut after its first k words, with a, l and r the counts of the phrase, its first part
and the rest, it scores floor(2000000 a / (l + r)); the cut with the lowest score counts, ties to the smallest k. A candidate goes if
it lies within a longer one that occurs at least 0.8 times as often.

1. *Words once.* Texts become rows of 64-bit word hashes per language, zeros where pieces end, in a written
   table; all further counting reads that.
2. *Apriori-safe candidates*, level by level: a phrase of k words is looked at only where both of its parts
   of k - 1 words may be frequent (a bitmap of fixed size, which can err only towards more work). Its
   64-bit hashes are summed map-side and by one shuffle; hashes that reach ``least`` stay. Hashes that fall
   together can only raise a sum, so no frequent phrase is lost, and all parts of a frequent one are there. The text of
   each is read where it stands among the words of least hash, so it is sent about once.
3. *Minimal perfect hash* over the candidates of all levels (bit arrays with ranks, about 4 bits a
   key, built by tasks in blocks of at most ``BLOCK`` keys), with a stored 128-bit key per slot. Mappers look up the
   occurrences, compare the stored key, and ``bincount`` slots in one numpy array a task; the arrays are
   summed as a tree of ``FAN`` at a time. Several blocks take a pass each.
4. Counts of phrases and of both sides of every cut are read by slot. Scores, containment and ranks
   are DataFrame operations in exact decimals.

A phrase is known by two 64-bit hashes of its language's and its words' hashes; two candidates that agree
in both but not in their text stop the job. Nothing but the bitmaps (8 MB) and one block of slots at a time
(25 bytes a key, at most ``BLOCK`` keys) is sent to the workers.

Defined cases: a null text is empty, a null language is ``und``; an empty or null text, an empty table and one without a
frequent phrase give no rows; repeated rows count as often as they occur; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialise, release
from . import textbytes
from .joins import few

LONGEST = 4
SCALE = 2_000_000
UNKNOWN = "und"
#: Buckets of the bitmap of a level.
BITS = 26
#: Keys of one minimal perfect hash, and slots of one row of counts.
BLOCK, SLOTS = 1 << 21, 1 << 15
FAN = 32
#: Rows of text looked at together, bytes of text behind one row of stored words, phrases summed at a time.
ROWS, STORED, TOGETHER = 512, 1 << 17, 1 << 19
#: Rows of stored words looked at together.
WORD_ROWS = 64
#: Words on either side that tell occurrences of a phrase apart.
AROUND = 3

_codes = np.arange(256)
ENDS = np.isin(_codes, [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
IS_WORD = ~ENDS & (_codes != 32) & (_codes != 9)
SECOND = np.uint64(0xD1342543DE82EF95)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started within read and send at most ``rows`` rows of a table to a Python worker at a time: stored words are long
    rows, and Spark's Parquet reader would hold 4096 of them in each task."""
    arrow, reader = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {key: spark.conf.get(key) for key in (arrow, reader)}
    for key, value in before.items():
        spark.conf.set(key, str(min(rows, int(value)) if int(value) > 0 else rows))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def seed_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def by_language(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, bytes, offsets) of stretches of about ``limit`` bytes of rows of (lang, text)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            some = batch.slice(lo, ROWS)
            langs = pc.fill_null(some.column(0), UNKNOWN).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                for _, _, data, offsets in textbytes.chunks(pc.filter(some.column(1), pc.equal(langs.indices, code)), limit):
                    yield lang, data, offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, textbytes.Words]:
    """(hashes of the words in a row with a zero wherever a piece ends, the words' places in it, the words). Texts
    are ``AROUND`` zeros apart, so what stands around a word is the same however texts are put together."""
    words = textbytes.words(data, offsets, IS_WORD)
    n = len(words.start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), words
    piece = np.cumsum(ENDS[data])[words.start]
    ends = np.zeros(n, np.int64)
    ends[1:] = piece[1:] != piece[:-1]
    first = words.first[1:-1]
    first = first[(first > 0) & (first < n)]
    ends[first] = AROUND
    place = np.arange(n) + np.cumsum(ends)
    out = np.zeros(place[-1] + 1, np.uint64)
    out[place] = np.maximum(words.hash, np.uint64(1))
    return out, place, words


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def levels(words: np.ndarray, seed: np.uint64, bits: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of the phrases of k words whose parts of k - 1 words are all marked in ``bits``."""
    at = np.flatnonzero(words)
    hashes = textbytes.mix(words[at] ^ seed)
    yield 1, at, hashes
    for k, known in enumerate(bits[: LONGEST - 1], 2):
        keep = marked(known, hashes)
        there = np.zeros(len(words) + 1, bool)
        there[at[keep]] = True
        keep &= there[at + 1]
        at = at[keep]
        hashes = textbytes.mix(hashes[keep] * textbytes.BASE + words[at + k - 1])
        yield k, at, hashes


def second_hashes(words: np.ndarray, seed: np.uint64, at: np.ndarray, k: int) -> np.ndarray:
    out = textbytes.mix(words[at] ^ seed, 0xB0B)
    for j in range(1, k):
        out = textbytes.mix(out * SECOND + words[at + j], 0xB0B)
    return out


def tokenised(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, n, words): stretches of texts of one language."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data, offsets in by_language(batches, STORED):
            hashes, place, _ = word_hashes(data, offsets)
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(place)], pa.int64()), pa.array([hashes.astype("<u8").tobytes()], pa.binary())], ["lang", "n", "words"])

    with small_batches(docs.sparkSession, ROWS):
        return materialise(_texts(docs, text, lang).mapInArrow(cut, "lang string, n bigint, words binary"), "words")


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.uint64, np.ndarray]]:
    for batch in batches:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield seed_of(name), np.frombuffer(raw.as_buffer(), "<u8")


def surroundings(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the AROUND words before each place, and of those from it on (one place more than words)."""
    padded = np.concatenate([np.zeros(AROUND, np.uint64), words, np.zeros(AROUND, np.uint64)])
    n = len(words) + 1
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(AROUND):
        before = before * textbytes.BASE + padded[j : j + n]
        after = after * textbytes.BASE + padded[AROUND + j : AROUND + j + n]
    return before, after


def context(around: tuple[np.ndarray, np.ndarray], at: np.ndarray, k: int) -> np.ndarray:
    """What tells an occurrence of a phrase from others: 31 bits of a hash of the words around it."""
    return textbytes.mix(around[0][at] * SECOND + around[1][at + k]) >> np.uint64(33)


def frequent(words: DataFrame, k: int, bits: list[np.ndarray], least: int) -> DataFrame:
    """(h, c) of phrases of k words that occur ``least`` times, written: their hash, and the least context of their occurrences."""
    sent = words.sparkSession.sparkContext.broadcast(bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> Iterator[pa.RecordBatch]:
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h)
            h, c = h[order], c[order].view(np.int64)
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            n, c = np.diff(np.append(first, len(h))), np.minimum.reduceat(c, first) if len(h) else c
            for lo in range(0, len(first), SLOTS):
                part = slice(lo, lo + SLOTS)
                yield pa.RecordBatch.from_arrays([pa.array(h[first[part]].view(np.int64)), pa.array(n[part]), pa.array(c[part])], ["h", "n", "c"])

        for seed, row in _stretches(batches):
            *_, (level, at, hashes) = levels(row, seed, sent.value)
            if level == k:
                held.append((hashes, context(surroundings(row), at, k)))
            if sum(len(h) for h, _ in held) >= TOGETHER:
                yield from summed()
        if held:
            yield from summed()

    rows = words.select("lang", "words").mapInArrow(counted, "h bigint, n bigint, c bigint")
    with small_batches(words.sparkSession, WORD_ROWS):
        return materialise(rows.groupBy("h").agg(F.sum("n").alias("n"), F.min("c").alias("c")).where(F.col("n") >= least).select("h", "c"), f"level-{k}")


def homes(hashes: DataFrame) -> DataFrame:
    """(h,): one hash of each (h, c), as ``home_hash`` makes it in numpy."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(home_hash(h, c).view(np.int64))], ["h"])

    return hashes.select("h", "c").mapInArrow(joined, "h bigint")


def home_hash(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return textbytes.mix(h ^ textbytes.mix(c, 0x40E))


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Which of 2**BITS buckets hold a hash: put together by tasks, of fixed size whatever their number."""
    part = 16

    def packed(table: pa.Table) -> pa.Table:
        at = table["h"].to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
        bits = np.zeros(1 << part, np.uint8)
        bits[(at & np.uint64((1 << part) - 1)).astype(np.int64)] = 1
        return pa.table({"b": pa.array([int(at[0]) >> part], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    # Equal buckets are one row before they are gathered, so a group has at most 2**16 rows.
    bucket = F.shiftrightunsigned("h", 64 - BITS)
    rows = hashes.groupBy(bucket.alias("u")).agg(F.first("h").alias("h")).groupBy(F.shiftright("u", part).alias("g")).applyInArrow(packed, "b int, bits binary").collect()
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in rows:
        out[r.b << part - 3 : (r.b + 1) << part - 3] = np.frombuffer(r.bits, np.uint8)
    return out


def candidates(docs: DataFrame, text: str, lang: str, bits: list[np.ndarray], home: np.ndarray) -> DataFrame:
    """(h, g, lang, k, phrase, parts) of every phrase that is marked in its level's bitmap, from the occurrence with the least
    context (marked in ``home``), and from few others: rows follow from the phrases, not from their occurrences or the tasks.
    parts: for each cut the hashes (h, g) of both sides."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    sent_home = docs.sparkSession.sparkContext.broadcast(home)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data, offsets in by_language(batches, textbytes.CHUNK_BYTES):
            row, place, words = word_hashes(data, offsets)
            if not len(place):
                continue
            seed, size = seed_of(name), words.end - words.start
            # The words with one space after each: a phrase is a slice of this.
            after = np.cumsum(size + 1)
            flat = np.full(after[-1], 32, np.uint8)
            start = after - size - 1
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            flat[inner + np.repeat(start, size)] = textbytes.LOWER[data[inner + np.repeat(words.start, size)]]
            number = np.zeros(len(row) + 1, np.int64)
            number[place] = np.arange(len(place))
            h, g = np.zeros((LONGEST, len(row)), np.uint64), np.zeros((LONGEST, len(row)), np.uint64)
            around = surroundings(row)
            for k, at, hashes in levels(row, seed, sent.value):
                there = marked(sent.value[k - 1], hashes)
                at, hashes = at[there], hashes[there]
                h[k - 1, at], g[k - 1, at] = hashes, second_hashes(row, seed, at, k)
                here = marked(sent_home.value, home_hash(hashes, context(around, at, k)))
                at = at[here][np.unique(hashes[here], return_index=True)[1]]
                if not len(at):
                    continue
                lo, hi = start[number[at]], after[number[at + k - 1]] - 1
                ends = np.concatenate(([0], np.cumsum(hi - lo)))
                take = flat[np.repeat(lo - ends[:-1], hi - lo) + np.arange(ends[-1])]
                parts = np.stack([x for j in range(1, k) for x in (h[j - 1, at], g[j - 1, at], h[k - j - 1, at + j], g[k - j - 1, at + j])], axis=1) if k > 1 else np.zeros((len(at), 0), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[k - 1, at].view(np.int64)),
                        pa.array(g[k - 1, at].view(np.int64)),
                        pa.array([name] * len(at)),
                        pa.array(np.full(len(at), k, np.int32)),
                        pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(take.tobytes())).cast(pa.string()),
                        pa.array([p.tobytes() for p in parts.astype("<u8")], pa.binary()),
                    ],
                    ["h", "g", "lang", "k", "phrase", "parts"],
                )

    return _texts(docs, text, lang).mapInArrow(found, "h bigint, g bigint, lang string, k int, phrase string, parts binary")


@dataclass
class PerfectHash:
    """A minimal perfect hash of (h, g) pairs, and the pair that is stored in each slot."""

    sizes: list[int]  # bits of each round
    bits: np.ndarray  # all rounds' bits in 64-bit words
    before: np.ndarray  # set bits before each word
    h: np.ndarray
    g: np.ndarray

    @staticmethod
    def _place(h: np.ndarray, g: np.ndarray, turn: int, size: int) -> np.ndarray:
        return textbytes.mix(h ^ (g * SECOND), 0x9E37 + turn) % np.uint64(size)

    @classmethod
    def build(cls, h: np.ndarray, g: np.ndarray) -> PerfectHash:
        """A key keeps its bit in the first round in which no other key left falls on it."""
        sizes, words, left, homes = [], [], np.arange(len(h)), np.zeros(len(h), np.int64)
        base = 0
        while len(left):
            if len(sizes) > 200:
                raise ValueError("keys of a minimal perfect hash repeat")
            size = -(-2 * len(left) // 64) * 64
            at = cls._place(h[left], g[left], len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            settled = alone[at]
            homes[left[settled]] = base + at[settled]
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            base += size
            left = left[~settled]
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))[:-1]
        order = np.argsort(homes)  # slots follow the places of bits
        return cls(sizes, bits, before, h[order], g[order])

    def slots(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for pairs that are not stored."""
        out = np.full(len(h), -1, np.int64)
        left, base = np.arange(len(h)), 0
        for turn, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self._place(h[left], g[left], turn, size) + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            value = self.bits[word]
            hit = (value >> bit) & np.uint64(1) == 1
            low = value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(low)
            left, base = left[~hit], base + size
        some = np.flatnonzero(out >= 0)
        wrong = some[(self.h[out[some]] != h[some]) | (self.g[out[some]] != g[some])]
        out[wrong] = -1
        return out

    def packed(self) -> bytes:
        head = np.array([len(self.sizes), len(self.bits), len(self.h), *self.sizes], "<u8")
        return b"".join(x.astype("<u8").tobytes() for x in (head, self.bits, self.h, self.g))

    @classmethod
    def unpacked(cls, raw: bytes) -> PerfectHash:
        x = np.frombuffer(raw, "<u8")
        rounds, n_bits, n = (int(v) for v in x[:3])
        sizes, rest = [int(v) for v in x[3 : 3 + rounds]], x[3 + rounds :]
        bits = rest[:n_bits]
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))[:-1]
        return cls(sizes, bits, before, rest[n_bits : n_bits + n], rest[n_bits + n :])


def perfect_hashes(keys: DataFrame) -> DataFrame:
    """(block, raw) a block of (block, h, g)."""

    def built(table: pa.Table) -> pa.Table:
        h, g = (table[c].to_numpy().view(np.uint64) for c in ("h", "g"))
        return pa.table({"block": table["block"][:1], "raw": pa.array([PerfectHash.build(h, g).packed()], pa.large_binary()).cast(pa.binary())})

    return materialise(keys.select("block", "h", "g").groupBy("block").applyInArrow(built, "block bigint, raw binary"), "perfect-hashes")


def tree_sum(rows: DataFrame) -> DataFrame:
    """(piece, counts) from (piece, part, counts): arrays of a piece summed ``FAN`` parts at a time."""

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), "<i8") for x in table["counts"]], axis=0)
        return pa.table({"piece": table["piece"][:1], "part": pa.array([table["part"][0].as_py() // FAN], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    parts = rows.rdd.getNumPartitions()
    while True:
        rows = rows.groupBy("piece", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(added, "piece int, part int, counts binary")
        parts = -(-parts // FAN)
        if parts == 1:
            return rows.select("piece", "counts")


def count_slots(words: DataFrame, bits, slots) -> np.ndarray:
    """How often the phrase of each slot occurs. bits, slots: broadcasts of the bitmaps and a block's perfect hash."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = slots.value
        total = np.zeros(len(known.h), np.int64)
        for seed, row in _stretches(batches):
            for k, at, hashes in levels(row, seed, bits.value):
                there = marked(bits.value[k - 1], hashes)
                at, hashes = at[there], hashes[there]
                slot = known.slots(hashes, second_hashes(row, seed, at, k))
                total += np.bincount(slot[slot >= 0], minlength=len(total))
        part = TaskContext.get().partitionId()
        for piece in range(-(-len(total) // SLOTS)):
            some = total[piece * SLOTS : (piece + 1) * SLOTS]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part], pa.int32()), pa.array([some.astype("<i8").tobytes()], pa.binary())], ["piece", "part", "counts"])

    out = np.zeros(len(slots.value.h), np.int64)
    with small_batches(words.sparkSession, WORD_ROWS):
        found = tree_sum(words.select("lang", "words").mapInArrow(counted, "piece int, part int, counts binary")).collect()  # 8 bytes a slot of the block
    for r in found:
        out[r.piece * SLOTS : (r.piece + 1) * SLOTS] = np.frombuffer(r.counts, "<i8")
    return out


SEEN = ["a", "l1", "r1", "l2", "r2", "l3", "r3"]


def read_cuts(rows: DataFrame, slots, counts) -> DataFrame:
    """``rows`` with the counts of their phrase and of both sides of each cut added, as far as this block has them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = slots.value, counts.value
        look = lambda h, g: np.where((s := known.slots(h, g)) >= 0, total[s], 0)
        for batch in batches:
            k = batch.column(batch.schema.get_field_index("k")).to_numpy()
            added = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in SEEN])
            h, g = (batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in ("h", "g"))
            added[0] += look(h, g)
            parts = batch.column(batch.schema.get_field_index("parts"))
            for size in range(2, LONGEST + 1):
                at = np.flatnonzero(k == size)
                if len(at):
                    cuts = np.frombuffer(b"".join(parts.take(pa.array(at)).to_pylist()), "<u8").reshape(len(at), size - 1, 2, 2)
                    for j in range(size - 1):
                        for side in range(2):
                            added[1 + 2 * j + side, at] += look(cuts[:, j, side, 0], cuts[:, j, side, 1])
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(added[SEEN.index(c)]) if c in SEEN else batch.column(i) for i, c in enumerate(names)], names)

    return rows.mapInArrow(read, rows.schema)


def counted_phrases(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, a, l1, r1, ...) of the phrases of 2 to 4 words that occur at least ``least`` times, (lang, n) words in all)."""
    spark = docs.sparkSession
    words = tokenised(docs, text, lang)
    bits: list[np.ndarray] = []
    found = []
    for k in range(1, LONGEST + 1):
        found.append(frequent(words, k, bits, least))
        bits.append(bitmap(found[-1]))
    hashes = found[0]
    for more in found[1:]:
        hashes = hashes.unionByName(more)
    raw = candidates(docs, text, lang, bits, bitmap(homes(hashes))).groupBy("h", "g").agg(*(F.first(c).alias(c) for c in ("lang", "k", "phrase", "parts")), F.min("phrase").alias("low"), F.max("phrase").alias("high"))
    # A bucket may be marked for another hash; only hashes that reached the threshold stay.
    sure = F.when(F.col("low") == F.col("high"), F.col("phrase")).otherwise(F.raise_error(F.lit("two phrases have one hash")))
    with small_batches(spark, ROWS):
        keys = materialise(raw.join(hashes, "h", "left_semi").select("h", "g", "lang", "k", sure.alias("phrase"), "parts"), "phrases")
    n = keys.count()
    if n != hashes.count():
        raise ValueError("a frequent phrase was not met again: the texts changed between two passes")
    blocks = max(1, -(-n // BLOCK))
    made = perfect_hashes(keys.select("h", "g", F.pmod("g", F.lit(blocks)).alias("block")))
    rows = materialise(keys.where("k > 1").select("*", *(F.lit(0).cast("long").alias(c) for c in SEEN)), "cuts")
    sent_bits = spark.sparkContext.broadcast(bits)
    for block in range(blocks):
        one = made.where(F.col("block") == block).first()
        if one is None:
            continue
        sent = spark.sparkContext.broadcast(PerfectHash.unpacked(one.raw))
        totals = spark.sparkContext.broadcast(count_slots(words, sent_bits, sent))
        before, rows = rows, materialise(read_cuts(rows, sent, totals), "cuts")
        release(before)
        sent.destroy()
        totals.destroy()
    total = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    release(words, keys, made, *found)
    return rows.where(F.col("a") >= least).drop("h", "g", "parts"), total


def mine(docs: DataFrame, least: int = 30, top: int = 2000, keep_under: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations. keep_under: per cent of
    a phrase's occurrences that a longer candidate which holds it must stay below."""
    rows, total = counted_phrases(docs, least, text, lang)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = []
    for j in range(1, LONGEST):
        score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l{j} as decimal(20,0)) + cast(r{j} as decimal(20,0)))")
        cuts.append(F.when(F.col("k") > j, F.struct(score.alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r"))))
    scored = rows.select("lang", "k", "phrase", "a", F.least(*cuts).alias("c"))
    within = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' ', -1), i, m), ' '))))")
    longer = scored.where("k > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest_a"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longest_a").isNull() | (F.lit(100).cast("decimal(10,0)") * big("longest_a") < F.lit(keep_under).cast("decimal(10,0)") * big("a")))
    ranked = kept.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("c.score").desc(), F.col("a").desc(), F.col("phrase"))).alias("rank")).where(F.col("rank") <= top)
    return ranked.join(few(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").cast("long").alias("score"))
