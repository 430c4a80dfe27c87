"""Which keys occur in more than one place: the test that every digit pass of the suffix sort uses.

A chunk sends each of its distinct keys once, marked if it holds the key several times, so a key
that a third of all rows have is one entry per chunk. What gets the keys answers in bits, in the
order in which the chunk sent them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnspark.llm.common import trimmed

MESSAGES = "chunk_id long, kind int, bucket int, place int, n long, first binary, second binary, marks binary"
ANSWERS = "chunk_id long, kind int, bucket int, n long, again binary, varied binary"
SCHEMA = pa.schema([("chunk_id", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("marks", pa.binary())])
#: Kinds below WHOLE compare the first word alone and tell whether the second ones vary.
WHOLE = 100
#: Kinds from ALONE have no second words.
ALONE = 200
AGAIN, VARIED = 1, 2


def distinct(first: np.ndarray, second: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, each once: first and second words, marks, and for every input row the place of its key."""
    if not len(first):
        return first, second, np.empty(0, np.uint8), np.empty(0, np.int64)
    order = np.lexsort((second, first)) if whole else np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if whole:
        new[1:] |= b[1:] != b[:-1]
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    sizes = np.diff(np.append(at, len(a)))
    marks = np.where(sizes > 1, AGAIN, 0).astype(np.uint8)
    if not whole:
        marks[np.minimum.reduceat(b, at) != np.maximum.reduceat(b, at)] |= VARIED
    place = np.empty(len(a), np.int64)
    place[order] = group
    return a[at], b[at], marks, place


def places(spark: SparkSession, partitions: int) -> list[int]:
    """For each partition a number that Spark's hash sends there, so that equal ranges of keys fill equal partitions."""
    numbers = spark.range(40 * partitions).select(F.col("id").cast("int").alias("id"))
    found = numbers.groupBy(F.pmod(F.hash("id"), F.lit(partitions)).alias("p")).agg(F.min("id").alias("id")).collect()
    known = {r.p: r.id for r in found}
    return [known.get(p, p) for p in range(partitions)]


def messages(chunk_id: int, kind: int, first: np.ndarray, second: np.ndarray, marks: np.ndarray, to: list[int]) -> pa.RecordBatch:
    """What a chunk sends of its distinct keys, cut by ranges of the first word; range k goes to to[k]."""
    buckets = len(to)
    edges = [(k << 64) // buckets for k in range(1, buckets)]
    cuts = [0, *np.searchsorted(first, np.array(edges, np.uint64)).tolist(), len(first)]
    rows = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk_id] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array([k for k, _, _ in rows], pa.int32()), pa.array([to[k] for k, _, _ in rows], pa.int32()), pa.array([hi - lo for _, lo, hi in rows], pa.int64())]
        + [pa.array([x[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()) for x in (first, second, marks)],
        schema=SCHEMA,
    )


def answered(sent: DataFrame, partitions: int) -> DataFrame:
    """ANSWERS to the messages: for every key whether it is anywhere again, and whether second words vary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["kind"], []).append(row)
        for kind in sorted(held):
            rows = held.pop(kind)
            first = np.concatenate([np.frombuffer(r["first"], np.uint64) for r in rows])
            second = np.concatenate([np.frombuffer(r["second"], np.uint64) for r in rows]) if kind < ALONE else np.zeros(len(first), np.uint64)
            marks = np.concatenate([np.frombuffer(r["marks"], np.uint8) for r in rows])
            order = np.lexsort((second, first)) if kind >= WHOLE else np.argsort(first, kind="stable")
            a, b = first[order], second[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | ((b[1:] != b[:-1]) if kind >= WHOLE else False)
            at = np.flatnonzero(new)
            sizes = np.diff(np.append(at, len(a)))
            said = np.bitwise_or.reduceat(marks[order], at)
            again = (sizes > 1) | (said & AGAIN > 0)
            varied = (said & VARIED > 0) | ((np.minimum.reduceat(b, at) != np.maximum.reduceat(b, at)) if kind < WHOLE else False)
            out = [np.empty(len(a), bool) for _ in range(2)]
            for x, y in zip(out, (again, varied), strict=True):
                x[order] = np.repeat(y, sizes)
            ends = np.cumsum([r["n"] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["chunk_id"] for r in rows], pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array([r["bucket"] for r in rows], pa.int32()), pa.array([r["n"] for r in rows], pa.int64())]
                + [pa.array([np.packbits(x[e - r["n"] : e]).tobytes() for r, e in zip(rows, ends, strict=True)], pa.binary()) for x in out],
                ["chunk_id", "kind", "bucket", "n", "again", "varied"],
            )

    return sent.repartition(partitions, "place").mapInArrow(trimmed(run), ANSWERS)


def bits(answers: list[dict], kind: int, which: str) -> np.ndarray:
    """A chunk's answers of a kind, in the order of its keys."""
    own = sorted((r for r in answers if r["kind"] == kind), key=lambda r: r["bucket"])
    return np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(r[which], np.uint8), count=r["n"]).astype(bool) for r in own)])
