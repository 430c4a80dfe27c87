"""Removal of every byte that lies in a window of `length` bytes found anywhere else.

A depth-limited radix sort over suffixes: digits are compared pass by pass, a suffix whose digits so
far are nobody else's drops out, and after the last digit equal groups are the repeated windows.

The first digit is not the window's first bytes but its least `gram`-byte string (by hash): equal
windows have it at the same place, and neighbouring windows share it. So pass 1 sorts one entry for
each run of windows with a common least string (one in 60 or so), by that string and by the whole
stretch the run covers. A run whose stretch is found again is settled at once. Only runs whose least
string is found again in another stretch go on to pass 2, where their windows are compared in full.
Windows are compared by two 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnspark.llm import repeats
from firnspark.llm.chunks import chunked, shares, text_bytes, unpacked
from firnspark.llm.common import Scratch, trimmed
from firnspark.llm.rolling import Rolling, U, mix, sliding_min

GRAM, STRETCH, WINDOW = 0, repeats.WHOLE, repeats.WHOLE + 1
PASS1 = repeats.MESSAGES + ", runs binary"
PLAN = "chunk_id long, settled binary, open binary, known binary"
RESULT = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("spans", T.ArrayType(T.ArrayType(T.LongType()))), ("kept", T.BinaryType())]


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int, block: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Runs of windows with a common least string: its hash, first and last window, hash words of the stretch.

    Works block by block, so memory doesn't depend on how long a text is; a run cut by a block's
    edge is two runs. Least hashes are small numbers; they are mixed once more, so that ranges of them are even.
    """
    enters = np.zeros(len(data) + 1, np.int8)
    enters[starts[ends - starts >= length]] += 1
    enters[ends[ends - starts >= length] - length + 1] -= 1
    inside = np.cumsum(enters, dtype=np.int8) > 0
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(data), block):
        own = data[at : at + block + length - 1]
        if len(own) < length:
            break
        one = Rolling(own, 0)
        grams = one.all(gram)
        mask = (U(1) << U(int(len(own)).bit_length())) - U(1)
        least = (sliding_min((grams & ~mask) | np.arange(len(grams), dtype=U), length - gram + 1) & mask).astype(np.int64)
        least[~inside[at : at + len(least)]] = -1
        lo = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        hi = np.append(lo[1:], len(least)) - 1
        ok = least[lo] >= 0
        lo, hi = lo[ok], hi[ok]
        found.append((mix(grams[least[lo]]), lo + at, hi + at, one.spans(lo, hi + length), Rolling(own, 1).spans(lo, hi + length)))
    if not found:
        return tuple(np.empty(0, t) for t in (U, np.int64, np.int64, U, U))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def window_keys(data: np.ndarray, at: np.ndarray, length: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the windows that start at `at` (in order)."""
    first, second = np.empty(len(at), U), np.empty(len(at), U)
    for lo in range(0, len(data), block):
        a, b = np.searchsorted(at, (lo, lo + block))
        if a < b:
            own, here = data[lo : lo + block + length - 1], at[a:b] - lo
            first[a:b] = Rolling(own, 0).spans(here, here + length)
            second[a:b] = Rolling(own, 1).spans(here, here + length)
    return first, second


def each_window(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All positions of the runs lo to hi."""
    n = hi - lo + 1
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def covered(size: int, lo: np.ndarray, hi: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which bytes the runs lo to hi and the single windows cover."""
    change = np.zeros(size + 1, np.int64)
    for start, end in ((lo, hi + length), (windows, windows + length)):
        change += np.bincount(start, minlength=size + 1)
        change -= np.bincount(end, minlength=size + 1)
    return np.cumsum(change[:-1]) > 0


def _binary(x: np.ndarray) -> bytes:
    return x.astype(np.int64).tobytes()


def _ints(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", np.int64)


def find_repeats(docs: DataFrame, scratch: Scratch, text_col: str = "text", length: int = 200, gram: int = 64, chunk_bytes: int = 4 << 20, as_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans ([start, end) in bytes) and kept (remaining bytes).

    Removed is each byte of the UTF-8 text covered by a string of `length` bytes that also starts
    anywhere else, in the same row or another; overlaps count and all is judged on the input.
    Matches never cross rows. A null text is an empty one; texts shorter than `length` stay whole.
    Repeated rows are copies of each other, so both lose what they share. Other columns are kept;
    those named like the results are replaced. An empty table gives an empty one. as_text: kept is a
    string, without bytes of characters that were cut in two.
    """
    docs = docs.drop(*[n for n, _ in RESULT])
    at = docs.columns.index(text_col)
    chunks = chunked(docs, scratch, text_col, chunk_bytes)
    partitions = shares(chunks)
    to = repeats.places(docs.sparkSession, partitions)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = repeats.SCHEMA.append(pa.field("runs", pa.binary()))
        for batch in batches:
            for chunk_id, held in zip(batch.column("chunk_id"), batch.column("docs"), strict=True):
                own = chunk_id.as_py()
                data, starts, ends = text_bytes(unpacked(held.as_buffer()).column(at))
                grams, lo, hi, one, two = runs(data, starts, ends, length, gram)
                places = []
                for kind, a, b in ((GRAM, grams, one), (STRETCH, one, two)):
                    first, second, marks, place = repeats.distinct(a, b, kind >= repeats.WHOLE)
                    places.append(place)
                    sent = repeats.messages(own, kind, first, second, marks, to)
                    yield pa.RecordBatch.from_arrays([*sent.columns, pa.nulls(len(sent), pa.binary())], schema=schema)
                state = np.stack([lo, hi - lo, *places]).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_pylist([{"chunk_id": own, "kind": -1, "runs": state}], schema)

    pass1 = scratch.keep(chunks.select("chunk_id", "docs").mapInArrow(trimmed(first_pass), PASS1), "pass1")
    answers = repeats.answered(pass1.where("kind >= 0").drop("runs"), partitions)
    by_chunk = lambda x: x.groupBy("chunk_id").agg(F.collect_list(F.struct("kind", "bucket", "n", "again", "varied")).alias("answers"))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lo, span, gram_at, stretch_at = np.frombuffer(row["runs"], np.int32).reshape(4, -1).astype(np.int64)
                got = row["answers"] or []
                again, varied = (repeats.bits(got, GRAM, x)[gram_at] for x in ("again", "varied"))
                settled = repeats.bits(got, STRETCH, "again")[stretch_at]
                todo = again & ~settled
                # A settled stretch still stands for its windows where its least string is in others too.
                out = [np.stack([lo[x], lo[x] + span[x]]) for x in (settled, todo, settled & varied)]
                yield pa.RecordBatch.from_pydict({"chunk_id": [row["chunk_id"]]} | {k: [_binary(x)] for k, x in zip(("settled", "open", "known"), out, strict=True)})

    asked = pass1.where("kind = -1").select("chunk_id", "runs").join(by_chunk(answers), "chunk_id", "left").select("chunk_id", "runs", "answers")
    plan = scratch.keep(asked.mapInArrow(trimmed(planned), PLAN), "plan")
    scratch.drop("pass1")
    del pass1, answers, asked
    scratch.free()

    def sorted_windows(held: pa.Scalar, open_runs: bytes, known_runs: bytes) -> tuple[np.ndarray, ...]:
        """The windows of a chunk's unsettled runs, then those of settled ones, and their distinct keys."""
        data, _, _ = text_bytes(unpacked(held.as_buffer()).column(at))
        todo, known = (each_window(*_ints(x).reshape(2, -1)) for x in (open_runs, known_runs))
        keys = [np.concatenate(x) for x in zip(window_keys(data, todo, length), window_keys(data, known, length), strict=True)]
        first, second, marks, place = repeats.distinct(*keys, True)
        marks[place[len(todo) :]] |= repeats.AGAIN
        return todo, first, second, marks, place[: len(todo)]

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, held, todo, known in zip(*batch.columns, strict=True):
                _, first, second, marks, _ = sorted_windows(held, todo.as_py(), known.as_py())
                yield repeats.messages(chunk_id.as_py(), WINDOW, first, second, marks, to)

    both = chunks.select("chunk_id", "docs").join(plan, "chunk_id")
    sent = both.where("length(open) > 0 OR length(known) > 0").select("chunk_id", "docs", "open", "known").mapInArrow(trimmed(second_pass), repeats.MESSAGES)
    answers = scratch.keep(by_chunk(repeats.answered(sent, partitions)), "answers")
    del both, sent
    scratch.free()

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.StringType() if as_text and n == "kept" else t) for n, t in RESULT)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, settled, todo_runs, known, got in zip(*batch.columns, strict=True):
                own = unpacked(held.as_buffer())
                data, starts, ends = text_bytes(own.column(at))
                again = np.empty(0, np.int64)
                if len(todo_runs.as_py()):
                    todo, _, _, marks, place = sorted_windows(held, todo_runs.as_py(), known.as_py())
                    again = todo[(repeats.bits(got.as_py() or [], WINDOW, "again") | (marks & repeats.AGAIN > 0))[place]]
                lost = covered(len(data), *_ints(settled.as_py()).reshape(2, -1), again, length)
                yield pa.RecordBatch.from_arrays([*own.columns, *_results(data, starts, ends, lost, as_text)], names=[*own.schema.names, *(n for n, _ in RESULT)])

    rest = chunks.select("chunk_id", "docs").join(plan, "chunk_id").join(answers, "chunk_id", "left")
    return rest.select("docs", "settled", "open", "known", "answers").mapInArrow(trimmed(cut), schema)


def _results(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lost: np.ndarray, as_text: bool = False) -> list[pa.Array]:
    before = np.concatenate([[0], np.cumsum(lost)])
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = lost
    edge[1:-1] &= ~lost[:-1]
    edge[starts[starts < len(data)]] |= lost[starts[starts < len(data)]]
    n_before = np.concatenate([[0], np.cumsum(edge[:-1])])
    first = np.flatnonzero(edge[:-1])
    last = np.append(np.flatnonzero(~lost), len(data))
    spans, kept = [], []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if before[e] == before[s]:
            spans.append([])
            kept.append(data[s:e].tobytes())
            continue
        own = first[np.searchsorted(first, s) : np.searchsorted(first, e)]
        stop = np.minimum(last[np.searchsorted(last, own)], e)
        spans.append(np.stack([own - s, stop - s], axis=1).tolist())
        kept.append(data[s:e][~lost[s:e]].tobytes())
    number = lambda x: pa.array(x, pa.int64())
    return [number(ends - starts), number(before[ends] - before[starts]), number(n_before[ends] - n_before[starts]), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]


def digests(docs: DataFrame, scratch: Scratch, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = find_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch, length=length)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, scratch: Scratch, length: int = 200, text_col: str = "text") -> DataFrame:
    """docs whose text has lost its repeated strings; bytes of characters cut in two go too.

    Documents are all kept, if need be with an empty text; null texts stay null.
    """
    found = find_repeats(docs, scratch, text_col, length, as_text=True)
    text = F.when(F.col(text_col).isNull(), None).otherwise(F.col("kept"))
    return found.select(*[(text if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])
