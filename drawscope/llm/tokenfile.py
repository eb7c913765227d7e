"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (0: most frequent), so most need one byte. A
document's ranks are coded as two streams: control bytes, each with four two-bit lengths
(bytes of a rank, less one), and the data bytes, least significant first. Decoding looks a
control byte up in a table of 256 rows of four lengths and gathers bytes with numpy; no loop
over ids.

File format. A set of files is a Parquet folder (so any store that Spark writes to will do, with
its commit protocol: a lost executor or a repeated task leaves no half file). Files follow
each other in ascending order of ``doc_id``; each row is one block:

====================  =======================================================================
shard, block          number of the file, and of the block in it
first_doc             least document id of the block
base                  ids of the file before the block
n_tokens              ids in the block
doc_ids, counts       little-endian int64 per document (``INT64_MIN``: null id): its id and number of ids
controls, data        the documents' control bytes and data bytes, one document after another
====================  =======================================================================

The rank table (ids by rank) is one row of ``<folder>/ranks``. Its size is bounded by the
vocabulary. ``read_back`` returns documents with their position in the whole stream.

Files are ranges of (id, hash of the ids), so an id that a third of all rows share, or no id, is
dealt to many files like any other. Their number follows from the ids there are: about
``FILE_BYTES`` of them a file.

Defined cases: a null or empty text is its end token alone; documents that share an id
follow each other, ordered by the hash of their ids; null ids come first; an empty table gives
an empty set of files, which reads back as no documents; further columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialise, release
from . import tokens

BLOCK_TOKENS = 1 << 20
FILE_BYTES = 32 << 20
NULL_ID = -(1 << 63)

#: Lengths of the four ranks of a control byte.
LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.uint8)
#: Ids that a task counts at a time.
COUNTED = 1 << 18


def _used(length: np.ndarray) -> np.ndarray:
    """Which bytes of ranks, two or four bytes wide as the longest needs, are written; ``length`` is the bytes of each."""
    width = 4 if len(length) and length.max() > 2 else 2
    used = np.ones((len(length), width), bool)
    for k in range(1, width):
        np.greater(length, k, out=used[:, k])
    return used


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    n = len(ranks)
    more = np.zeros(-(-n // 4) * 4, np.uint8)  # bytes of each rank, less one
    top = int(ranks.max()) if n else 0
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        if top > limit:
            more[:n] += ranks > limit
    four = more.view("<u4")
    control = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8)
    used = _used(more[:n] + np.uint8(1))
    return control.tobytes(), ranks.astype(f"<u{used.shape[1]}").view(np.uint8)[used.ravel()].tobytes()


def decode(controls: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """(n ranks, data bytes used)."""
    length = LENGTHS[controls].ravel()[:n]
    used, size = _used(length), int(length.sum())
    out = np.zeros(used.size, np.uint8)
    out[used.ravel()] = data[:size]
    return out.view(f"<u{used.shape[1]}").astype(np.uint32), size


def tokenise(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = tokens.END_ID) -> DataFrame:
    """(doc_id, ids, counts): a row a document, with its ids as two- or four-byte integers, and at each task's
    end a row that has only ``counts``, how often each id came in the task (int64, by id)."""
    names = ["doc_id", "ids", "counts"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids: list[bytes] = []
            open_, size = [], 0
            for x in tokens.encoder(tokenizer).encode(batch.column(1)):
                ids.append((ended := tokens.with_end(x, end_id)).tobytes())
                open_.append(ended)
                size += len(ended)
                if size >= COUNTED:
                    total, open_, size = _sum(total, np.bincount(np.concatenate(open_))), [], 0
            if open_:
                total = _sum(total, np.bincount(np.concatenate(open_)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encoded, "doc_id bigint, ids binary, counts binary")


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays, the shorter of them followed by zeros."""
    if len(a) < len(b):
        a, b = b, a
    a[: len(b)] += b
    return a


def ranking(counts: DataFrame) -> tuple[np.ndarray, int]:
    """(ids that occur, by falling frequency over the whole corpus, ties to the smaller id; how many ids there are)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total = _sum(total, np.frombuffer(x.as_buffer(), "<i8").copy())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = counts.mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64), int(rows["n"].sum())


BLOCKS = "shard int, block int, first_doc bigint, base bigint, n_tokens bigint, doc_ids binary, counts binary, controls binary, data binary"


def _blocks(documents: Iterator[tuple[int | None, np.ndarray]], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """``documents``: (doc_id, ranks), in the order of the file."""
    shard, block, base = TaskContext.get().partitionId(), 0, 0
    part: list[tuple[int, int, bytes, bytes]] = []
    size = 0

    def closed() -> pa.RecordBatch:
        row = [shard, block, part[0][0], base, size, *(np.array([p[i] for p in part], "<i8").tobytes() for i in (0, 1)), *(b"".join(p[i] for p in part) for i in (2, 3))]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

    for doc, ranks in documents:
        part.append((NULL_ID if doc is None else doc, len(ranks), *encode(ranks)))
        size += len(ranks)
        if size >= block_tokens:
            yield closed()
            block, base, part, size = block + 1, base + size, [], 0
    if part:
        yield closed()


def write_files(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id", files: int | None = None, block_tokens: int = BLOCK_TOKENS, end_id: int = tokens.END_ID) -> None:
    """Encode ``docs`` into a new set of files. Texts are read and tokenised once, and their ids counted on
    the way; the only large shuffle is that of ids by ranges of ``doc_id``, and each document is coded once, after it."""
    spark = docs.sparkSession
    found = materialise(tokenise(docs, tokenizer, text, key, end_id), "token-ids")
    ids = found.where("ids is not null").select("doc_id", "ids")
    dtype = tokens.encoder(tokenizer).dtype
    by_rank, total = ranking(found.where("counts is not null").select("counts"))
    spark.createDataFrame([(bytearray(by_rank.astype("<u4").tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    sent = spark.sparkContext.broadcast(rank)  # four bytes an id of the vocabulary

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, sent.value[np.frombuffer(x.as_buffer(), dtype)]) for batch in batches for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        return _blocks(rows, block_tokens)

    size = total * dtype.itemsize
    some = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (1 << 20)))
    n = files or max(1, some, -(-size // FILE_BYTES))
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    ids.repartitionByRange(n, *place).sortWithinPartitions(*place, "ids").mapInArrow(coded, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    release(found)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with ``start``, the number of ids before them in the whole set."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # One row a file: so few that a window over all of them is nothing.
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("b"))
    return blocks.join(before, "shard").withColumn("start", F.coalesce("b", F.lit(0)) + F.col("base")).drop("b")


def documents_of(row: dict, by_rank: np.ndarray) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of the documents of a block."""
    controls, data = np.frombuffer(row["controls"], np.uint8), np.frombuffer(row["data"], np.uint8)
    start, c, d = row["start"], 0, 0
    for doc, n in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), np.frombuffer(row["counts"], "<i8").tolist(), strict=True):
        ranks, used = decode(controls[c : c + -(-n // 4)], data[d:], n)
        yield None if doc == NULL_ID else doc, start, by_rank[ranks]
        start, c, d = start + n, c + -(-n // 4), d + used


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    stored = spark.read.schema("ids binary").parquet(f"{folder}/ranks").first()
    sent = spark.sparkContext.broadcast(np.frombuffer(stored.ids, "<u4"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = [(doc, start, len(ids), zlib.crc32(ids.tobytes())) for doc, start, ids in documents_of(row, sent.value)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_blocks(spark, folder).mapInArrow(decoded, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
