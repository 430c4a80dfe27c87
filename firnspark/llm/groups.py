"""Groups of rows in Python: whole ones from sorted batches, and large ones dealt into pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables that never cut a group."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch.column(key).to_numpy()
        if rest and rest[-1].column(key)[-1].as_py() == k[-1]:
            rest.append(batch)
            continue
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut or rest:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def bounds(*keys: np.ndarray) -> list[int]:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), n]


def first_pairs(rows: DataFrame, block: int) -> DataFrame:
    """rows (tile, row, size) with pair, side and label: each tile in blocks of about `block`, every other block with the first.

    A tile of one block is one pair. pair is a hash of the tile and its block, side 2 (all rows meet all), label the row.
    """
    out = rows.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("row", "tile"), F.col("blocks")).cast("int"))
    with_all = F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("own") == 0, F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1)))).otherwise(F.array("own"))
    out = out.withColumn("other", F.explode(with_all))
    return out.select("tile", "row", F.xxhash64("tile", "other").alias("pair"), F.lit(2).alias("side"), F.col("row").alias("label"))


def _labelled(rows: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """rows of tiles of more than one block, labelled by their components in found (node, component)."""
    return rows.where(F.col("size") > block).join(found.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("label", F.coalesce("component", "row"))


def open_tiles(rows: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """(tile, major, high, wide): tiles of more than one block that are not one component of found, that of most rows, and blocks."""
    sizes = _labelled(rows, found, block).groupBy("tile", "label").agg(F.count(F.lit(1)).alias("n"))
    tiles = sizes.groupBy("tile").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).where(F.col("top.n") < F.col("all"))
    return tiles.select("tile", F.col("top.label").alias("major"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("high"), F.ceil(F.col("all") / block).cast("int").alias("wide"))


def rest_pairs(rows: DataFrame, found: DataFrame, block: int, tiles: DataFrame | None = None) -> DataFrame:
    """What first_pairs has left open of tiles of more than one block, given the components (node, component) of what it found.

    Rows of a tile's largest component need no more comparing among themselves: the other rows (side 0) meet all
    rows (side 1) of another label, every block of the ones with every block of the others. A crowd that is joined already
    costs nothing here. tiles: open_tiles of the same, where they are written already.
    """
    known = _labelled(rows, found, block).join(open_tiles(rows, found, block) if tiles is None else tiles, "tile")
    own = lambda k: F.pmod(F.xxhash64("row", "tile"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    minor = known.where(F.col("label") != F.col("major")).select("tile", "row", "label", F.lit(0).alias("side"), own("high").alias("a"), each("wide").alias("b"))
    every = known.select("tile", "row", "label", F.lit(1).alias("side"), own("wide").alias("b"), each("high").alias("a"))
    return minor.unionByName(every).select("tile", "row", F.xxhash64("tile", "a", "b", F.lit("rest")).alias("pair"), "side", "label")


def may_meet(row: np.ndarray, side: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which two rows of a pair of blocks are to be compared."""
    return (label[:, None] != label[None, :]) & (row[:, None] != row[None, :]) & ((side[:, None] == 2) | (side[:, None] != side[None, :]))
