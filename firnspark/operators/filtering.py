"""Zero-phase Butterworth low-pass over each segment, from public filter theory in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def butterworth(order: int, w: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients b, a of a digital low-pass with cutoff w (share of Nyquist): analog poles, pre-warped, bilinear."""
    warped = 4 * math.tan(math.pi * w / 2)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    digital = (4 + poles) / (4 - poles)
    gain = (warped**order / np.prod(4 - poles)).real
    return gain * np.poly(-np.ones(order)).real, np.poly(digital).real


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Delays that a constant input of 1 leaves unchanged."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def run(b: np.ndarray, a: np.ndarray, x: np.ndarray, delays: np.ndarray) -> np.ndarray:
    """The difference equation over each row of x, in transposed direct form.

    All arguments have a row for each series; one step takes the next sample of all of them.
    """
    z, out, last = [delays[:, j] for j in range(delays.shape[1])], np.empty_like(x), delays.shape[1] - 1
    for k in range(x.shape[1]):
        v = x[:, k]
        y = b[:, 0] * v + z[0]
        for j in range(last):
            z[j] = z[j + 1] + b[:, j + 1] * v - a[:, j + 1] * y
        z[last] = b[:, last + 1] * v - a[:, last + 1] * y
        out[:, k] = y
    return out


def zero_phase_all(series: list[np.ndarray], order: int, widths: list[float]) -> list[np.ndarray]:
    """Each series forward and backward, mirrored oddly beyond its ends by three filter lengths.

    Series of any lengths are stepped together; each must be longer than the mirrored part.
    """
    if not series:
        return []
    known = {w: butterworth(order, w) for w in set(widths)}
    starts = {w: steady_state(b, a) for w, (b, a) in known.items()}
    b, a, start = (np.stack([f(w) for w in widths]) for f in (lambda w: known[w][0], lambda w: known[w][1], starts.get))
    pad = 3 * (order + 1)
    wide = [np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) for x in series]
    n = [len(x) for x in wide]

    def passed(rows: list[np.ndarray]) -> np.ndarray:
        aligned = np.zeros((len(rows), max(n)))
        for own, x in zip(aligned, rows, strict=True):
            own[: len(x)] = x
        return run(b, a, aligned, start * aligned[:, :1])

    there = passed(wide)
    back = passed([there[r, : n[r]][::-1] for r in range(len(n))])
    return [back[r, : n[r]][::-1][pad:-pad] for r in range(len(n))]


def zero_phase(x: np.ndarray, order: int, w: float) -> np.ndarray:
    """One series, filtered; too short a one is an error."""
    if len(x) <= 3 * (order + 1):
        raise ValueError(f"{len(x)} samples can't be filtered, {3 * (order + 1) + 1} are needed")
    return zero_phase_all([x], order, [w])[0]


def interpolated(v: np.ndarray) -> np.ndarray:
    """Gaps filled linearly by position, ends held."""
    known = np.flatnonzero(np.isfinite(v))
    if len(known) in (0, len(v)):
        return v
    at = np.arange(len(v))
    after = np.searchsorted(known, at)
    a, z = known[np.maximum(after - 1, 0)], known[np.minimum(after, len(known) - 1)]
    with np.errstate(invalid="ignore"):
        inner = v[a] + (v[z] - v[a]) * (at - a) / np.where(z > a, z - a, 1)
    return np.where(np.isfinite(v), v, np.where(z > at, np.where(a < at, inner, v[z]), v[a]))


#: Samples filtered together, whole segments at a time.
TOGETHER = 1 << 18


def low_passed(profile: DataFrame, columns: dict[str, tuple[str, float]], order: int = 5) -> DataFrame:
    """profile (with dx) with filtered columns: out -> (column, wavelength in km).

    The recursion is the only step that can't be a column expression; it steps many segments at once.
    Other columns pass through as Arrow buffers. Segments too short for the filter, all missing, or with
    a spacing too wide for the wavelength get NULL. A segment must fit a task.
    """
    schema = T.StructType([*profile.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])
    least = 3 * (order + 1) + 1

    def filtered(whole: pa.Table) -> pa.Table:
        key = whole.column("segment_id").combine_chunks()
        edges = edges_of(key)
        dx = whole.column("dx").to_numpy()[edges[:-1]]
        for name, (column, wavelength) in columns.items():
            value, out = whole.column(column).to_numpy(), np.full(len(whole), np.nan)
            rows, widths, at = [], [], []
            for lo, hi, step in zip(edges, edges[1:], dx, strict=False):
                w = 2 * step / wavelength
                if hi - lo >= least and 0 < w < 1 and np.isfinite(own := interpolated(value[lo:hi])).all():
                    rows.append(own)
                    widths.append(w)
                    at.append((lo, hi))
            for (lo, hi), found in zip(at, zero_phase_all(rows, order, widths), strict=True):
                out[lo:hi] = found
            whole = whole.append_column(name, pa.array(out, from_pandas=True))
        return whole

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_segments(batches, "segment_id", TOGETHER):
            yield from filtered(whole).to_batches()

    return profile.repartition("segment_id").sortWithinPartitions("segment_id", "i").mapInArrow(each, schema)


def edges_of(key: pa.Array) -> list[int]:
    """Where runs of equal keys begin, and the end."""
    codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)] if len(codes) else [0]


def whole_segments(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of at least so many rows, where there are, that never cut a segment."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = edges_of(table.column(key).combine_chunks())[-2]
            if cut:
                yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
