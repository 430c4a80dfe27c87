"""Documents dealt into chunks: rows that hold some MB of documents as a compressed Arrow stream.

A chunk table is written once below the shared folder; every later pass reads the same documents in
the same order under the same chunk_id, so passes can answer each other by chunk and position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnspark.llm.common import Scratch, input_bytes, parts, trimmed

#: Most documents of a chunk, so that a document's place in its chunk has 14 bits.
MOST_DOCS = 1 << 14
CHUNKS = "chunk_id long, n_bytes long, n_docs long, docs binary"
#: Numbers from which a task takes the ids of its chunks: with a place of 14 bits, ids of two million tasks fit a long.
TASK_IDS = 1 << 28
#: Spark makes no more buckets than this unless told to.
MOST_BUCKETS = 100_000


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after another, with each text's start and end."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of longs (Murmur3 with its usual seed), by which rows go to buckets."""
    turned = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    h = np.full(len(x), 42, np.uint32)
    for word in (x.astype(np.uint64) & np.uint64(0xFFFFFFFF), x.astype(np.uint64) >> np.uint64(32)):
        k = turned(word.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turned(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).astype(np.int32)


def chunk_ids(task: int, n_buckets: int) -> Iterator[int]:
    """Ids of a task's chunks, all of which go to one bucket, so that the task writes one file; tasks take buckets in turn."""
    for lo in range(0, TASK_IDS, 1 << 16):
        some = (task * TASK_IDS + lo) + np.arange(1 << 16, dtype=np.int64)
        yield from some[spark_hash(some).astype(np.int64) % n_buckets == task % n_buckets].tolist()


def chunked(docs: DataFrame, scratch: Scratch, text_col: str = "text", chunk_bytes: int = 4 << 20, name: str = "chunks") -> DataFrame:
    """Write docs as chunks of about chunk_bytes of text; a text is never cut, every column is kept.

    The table is bucketed by chunk_id: what is known of the chunks is joined to it without moving them.
    There are more buckets where there is more to read; a task's chunks are one file.
    """
    at, n_buckets = docs.columns.index(text_col), buckets(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids(TaskContext.get().partitionId(), n_buckets)
        for batch in batches:
            _, starts, ends = text_bytes(batch.column(at))
            lo = 0
            while lo < len(starts):
                hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + chunk_bytes, side="right")))
                hi = min(hi, lo + MOST_DOCS)
                yield pa.RecordBatch.from_pydict({"chunk_id": [next(ids)], "n_bytes": [int(ends[hi - 1] - starts[lo])], "n_docs": [hi - lo], "docs": [packed(batch.slice(lo, hi - lo))]})
                lo = hi

    return scratch.keep_bucketed(docs.mapInArrow(trimmed(run), CHUNKS), name, "chunk_id", n_buckets)


def buckets(docs: DataFrame, per_bytes: int = 64 << 20) -> int:
    """Buckets for the chunks of docs and for what goes with them."""
    return max(parts(docs.sparkSession), min(MOST_BUCKETS, -(-input_bytes(docs) // per_bytes)))


def shares(chunks: DataFrame, per_bytes: int = 32 << 20) -> int:
    """Partitions for what is gathered from the chunks: as the text grows, so do they."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(parts(chunks.sparkSession), -(-total // per_bytes))
