"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnspark.llm.common import trimmed

PLACED = "doc_id long, piece int, start long, length long, bin_id long, capacity int, offset int"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("bin_id", pa.int64()), ("capacity", pa.int32()), ("offset", pa.int32())])


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths, and what one costs: its tokens, its pairs of tokens, and itself."""

    permitted: tuple[int, ...] = (512, 1024, 2048, 4096)
    per_pair: float = 1 / 16384
    per_bin: float = 32.0

    def cost(self, length):
        return self.per_bin + length + self.per_pair * length * length


def packed(sizes: np.ndarray, lengths: Lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each size (1 up to the largest length): its bin, its offset there, and the capacities of the bins.

    Sizes are placed largest first, each into the open bin that it leaves least room in, whatever
    that bin's length. If it fits in none, a bin opens with the length that costs least for each
    token it can hope for: the size itself and what is still to come that fits beside it. In the
    end each bin shrinks to the least permitted length that holds its contents.
    """
    permitted = np.array(sorted(lengths.permitted))
    largest = int(permitted[-1])
    order = np.argsort(-sizes, kind="stable")
    left = np.bincount(sizes, minlength=largest + 1) * np.arange(largest + 1)
    coming = np.cumsum(left)
    costs = [float(lengths.cost(int(c))) for c in permitted]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room_of: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(largest + 1)]
    rooms = 0  # bit r: a bin with room r is open
    chosen, n_opened, capacity, used = {}, 0, [], []
    for k in order.tolist():
        size = int(sizes[k])
        above = rooms >> size
        if above:
            room = size + ((above & -above).bit_length() - 1)
            bin_ = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            if n_opened % 64 == 0:
                coming, chosen = np.cumsum(left), {}
            n_opened += 1
            best = chosen.get(size)
            if best is None:
                hopes = [size + min(int(c) - size, int(coming[min(int(c) - size, size)])) for c in permitted if c >= size]
                at = len(permitted) - len(hopes)
                best = chosen[size] = int(permitted[at + min(range(len(hopes)), key=lambda i: (costs[at + i] / hopes[i], i))])
            room, bin_ = best, len(room_of)
            room_of.append(0)
            capacity.append(best)
            used.append(0)
        left[size] -= size
        bins[k], offsets[k] = bin_, used[bin_]
        used[bin_] += size
        room -= size
        if room:
            with_room[room].append(bin_)
            rooms |= 1 << room
    return bins, offsets, permitted[np.searchsorted(permitted, np.array(used, np.int64))]


def pieces(sizes: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and length of each piece: as many whole sequences as a text fills, then the rest."""
    n = np.maximum(1, -(-sizes // largest))
    row = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, number, np.minimum(largest, sizes[row] - number * largest)


def n_words(text: Column) -> Column:
    """Words between ASCII blanks, counted without Python."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(out, " "), "")).cast("long")


def pack_documents(docs: DataFrame, length: Column | None = None, lengths: Lengths = Lengths(), id_col: str = "doc_id", pool: int = 100_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, capacity, offset.

    length: tokens of a document, its words unless given. A document longer than the largest length
    is cut into pieces; whole ones fill a bin each. Documents are pooled as they are read, `pool` to
    a pool, and each pool is packed on its own: no shuffle, and memory of some MB, whatever the
    data. A pool stays in one task, so bin ids (task, then number) never meet.

    Documents without tokens (null or empty) have one row of length 0, with null bin_id, capacity
    and offset. Null ids and repeated rows are packed like any other; other columns are not read.
    """
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(n_words(F.col("text")) if length is None else length.cast("long"), F.lit(0)).alias("size"))
    largest = max(lengths.permitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n = TaskContext.get().partitionId() << 36, [], 0

        def flush() -> tuple[pa.RecordBatch, int]:
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table.column("size").to_numpy()
            row, number, size = pieces(sizes, largest)
            bins, offsets, capacities = packed(size[size > 0], lengths)
            place = [np.zeros(len(row), np.int64) for _ in range(3)]
            for x, own in zip(place, (bins + first, capacities[bins] if len(bins) else bins, offsets), strict=True):
                x[size > 0] = own
            columns = [table.column("doc_id").take(pa.array(row)).combine_chunks(), number, number * largest, size, *place]
            empty = size == 0
            arrays = [columns[0], *(pa.array(c, f.type, mask=empty if f.name in ("bin_id", "capacity", "offset") else None) for c, f in zip(columns[1:], list(SCHEMA)[1:], strict=True))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA), len(capacities)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= pool:
                out, opened = flush()
                yield out
                first, n = first + opened, 0
        if n:
            yield flush()[0]

    return counted.mapInArrow(trimmed(run), PLACED)


SEQUENCES = "bin_id long, capacity int, ids array<int>, doc_ids array<long>, starts array<int>"


def pack_sequences(encoded: DataFrame, lengths: Lengths = Lengths(), id_col: str = "doc_id", ids_col: str = "ids", pool_tokens: int = 1 << 22) -> DataFrame:
    """One row per sequence: bin_id, capacity, ids (what it holds of it), and for each piece its doc_id and where it starts.

    encoded has token ids as ``bpe.encode_documents`` gives them. Documents are pooled as they are read until a pool has
    pool_tokens; the pieces of a pool are placed as in pack_documents. Attention masks and position ids follow from
    starts. A document longer than the largest length is cut into pieces, one document at a time, so a very long one
    is a pool of its own. Null and empty id lists are in no sequence, null ids within one are dropped; a null doc_id
    stays null. Other columns are not read; an empty table gives an empty one.
    """
    own = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.array_compact(F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))).alias("ids"))
    largest = max(lengths.permitted)
    schema = pa.schema([("bin_id", pa.int64()), ("capacity", pa.int32()), ("ids", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n = TaskContext.get().partitionId() << 36, [], 0

        def flush() -> tuple[pa.RecordBatch, int]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = table.column("ids").combine_chunks()
            sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, begin = ids.flatten().to_numpy(), np.cumsum(sizes) - sizes
            row, number, size = pieces(sizes, largest)
            row, number, size = (x[size > 0] for x in (row, number, size))
            bins, offsets, capacities = packed(size, lengths)
            order = np.lexsort((offsets, bins))
            row, size, bins = row[order], size[order], bins[order]
            source = begin[row] + number[order] * largest
            tokens = flat[np.repeat(source - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            edge = np.searchsorted(bins, np.arange(len(capacities) + 1)).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(size)])[edge].astype(np.int32)
            lists = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            return pa.RecordBatch.from_arrays([
                pa.array(first + np.arange(len(capacities))), pa.array(capacities, pa.int32()), lists(pa.array(tokens, pa.int32()), ends),
                lists(table.column("doc_id").combine_chunks().take(pa.array(row)), edge), lists(pa.array(offsets[order], pa.int32()), edge),
            ], schema=schema), len(capacities)

        for batch in batches:
            at = 0
            while at < len(batch):
                total = np.cumsum(batch.column("ids").slice(at).value_lengths().to_numpy(zero_copy_only=False))
                take = max(1, int(np.searchsorted(total, pool_tokens - n, side="left")) + 1) if len(total) else 1
                take = min(take, len(batch) - at)
                held.append(batch.slice(at, take))
                n, at = n + int(total[take - 1]), at + take
                if n >= pool_tokens:
                    out, opened = flush()
                    yield out
                    first, n = first + opened, 0
        if held:
            yield flush()[0]

    return own.mapInArrow(trimmed(run), SEQUENCES)
