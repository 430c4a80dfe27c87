"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

The graph starts from cells of equal random signs and is refined until lists hardly change. Lists that are
saturated (full, and all of it at the threshold or above) are doubled and refined again, as often as the
settings let them. What is saturated even then lies in a crowd: crowds are cut into balls so narrow that
any two members are linked for certain, so members are counted, not compared; only what lies near a ball
but not in it is compared with its members, block by block. Threshold edges, verified in double precision,
give links and components. Recall is audited by brute force for a fixed number of queries: the share of those
with links that have every link. Starts go on from new cells while it is too low; if it stays so, all
vectors are compared in blocks.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnspark.llm.common import Scratch, parts, trimmed
from firnspark.llm.components import connected_components
from firnspark.llm.groups import bounds, whole_groups

LOG = logging.getLogger(__name__)
EDGES = "u long, v long, sim float"
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float32())])
#: The group of crowded vectors that no ball holds: they are compared with all others.
REST = -1
#: Up to so many vectors the shuffle files of all turns are small, and are left to Spark's own cleaning.
FEW = 20_000


@dataclass(frozen=True)
class Settings:
    """neighbours: length of a list; saturated ones are doubled up to `longest`. A cell has about `cell` vectors, and
    more than `block` are compared in blocks of that size. missed: chance that a pair at the threshold shares none
    of a start's cells, which sets the number of sign tables unless `signs` does. rounds: at most, ended
    earlier by fewer changes than `settled` of all list entries. audit: number of queries, from ids divisible by 50.
    pivots, turns: balls that a turn tries, and turns.
    """

    neighbours: int = 10
    longest: int = 20
    signs: int | None = None
    cell: int = 128
    block: int = 256
    missed: float = 0.01
    rounds: int = 4
    settled: float = 0.02
    audit: int = 1000
    recall: float = 0.98
    starts: int = 3
    pivots: int = 64
    turns: int = 3


def unit(values: np.ndarray | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it has none."""
    return units_of(pa.array([None if values is None else list(values)], pa.list_(pa.float64())))[1][0]


def units_of(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors have a direction (not null, empty, zero, or with null or non-finite components), and those at length 1."""
    column = column.cast(pa.large_list(pa.float64()))
    ok, out = np.zeros(len(column), bool), [None] * len(column)
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False) if len(flat) else np.empty(0)
    start = np.cumsum(n) - n
    for size in np.unique(n[n > 0]):
        own = np.flatnonzero(n == size)
        x = values[start[own][:, None] + np.arange(size)]
        most = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (most > 0)
        own, x = own[good], x[good] / most[good, None]
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        ok[own] = True
        for k, row in zip(own.tolist(), x, strict=True):
            out[k] = row
    return ok, out


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _by_length(x: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length, with their matrix."""
    size = np.array([len(v) for v in x])
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        yield own, np.stack([x[k] for k in own])


def _top(ids: np.ndarray, sims: np.ndarray, least: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, ...]:
    """Edges of a block: for each row its best columns above `least`, and its first one above the threshold.

    The first ones tie rows that the lists of a crowded block would leave apart.
    """
    np.fill_diagonal(sims, -2)
    n = len(ids)
    k = min(most, n - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    u, v = np.repeat(np.arange(n), k), best.ravel()
    good = sims[u, v] > least[u]
    above = sims >= threshold
    tied = np.flatnonzero(above.any(axis=1))
    u, v = np.concatenate([u[good], tied]), np.concatenate([v[good], above.argmax(axis=1)[tied]])
    return ids[u], ids[v], sims[u, v]


def _edges(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, EDGE.types, strict=True)], schema=EDGE)


def tables(n: int, threshold: float, s: Settings) -> tuple[int, int]:
    """Signs of a cell, and how many tables of them a start takes."""
    bits = max(1, math.ceil(math.log2(max(2, n / s.cell))))
    if s.signs:
        return bits, s.signs
    shared = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(s.missed) / math.log1p(-min(shared, 1 - 1e-9))))


def started(nodes: DataFrame, n: int, seed: int, threshold: float, s: Settings) -> DataFrame:
    """EDGES of vectors in equal cells, a cell being the signs of random projections."""
    bits, count = tables(n, threshold, s)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            held = batch.column("v32")
            for own, x in _by_length(_matrix(held, np.float32)):
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng((seed, d)).standard_normal((d, count * bits)).astype(np.float32)
                code = ((x @ planes[d] > 0).reshape(len(own), count, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                at = pa.array(own)
                node, vector = batch.column("node").take(at), held.take(at)
                for k in range(count):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k), pa.int32()), pa.array(np.full(len(own), d), pa.int32()), pa.array(code[:, k]), node, vector], ["table", "size", "code", "u", "v32"])

    dealt = nodes.select("node", "v32").mapInArrow(trimmed(cells), "table int, size int, code long, u long, v32 binary")
    dealt = dealt.select(F.xxhash64("table", "size", "code").alias("cell"), "u", "v32")
    # A cell as large as a third of all vectors is many blocks: its members are dealt by hash, in numbers known beforehand.
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n_in"))
    dealt = dealt.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("u", F.lit(seed)), F.ceil(F.col("n_in") / s.block)))
    dealt = dealt.where("n_in > 1").select(F.xxhash64("cell", "part").alias("cell"), "u", "v32")
    p = max(parts(nodes.sparkSession), n * count // 200_000)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            cell, u, found = table.column("cell").to_numpy(), table.column("u").to_numpy(), []
            x = _matrix(table.column("v32"), np.float32)
            edges = bounds(cell)
            for lo, hi in zip(edges, edges[1:], strict=False):
                for at in range(lo, hi, 4 * s.block):  # hashed cells that meet in one number stay small blocks
                    own = x[at : min(hi, at + 4 * s.block)]
                    if len(own) > 1 and len({len(v) for v in own}) == 1:
                        m = np.stack(own)
                        found.append(_top(u[at : at + len(own)], m @ m.T, np.full(len(own), -2.0), threshold, s.neighbours))
            yield _edges(found)

    return dealt.repartition(p, "cell").sortWithinPartitions("cell", "u").mapInArrow(trimmed(compare), EDGES)


def _with_length(df: DataFrame, lengths: DataFrame, s: Settings) -> DataFrame:
    return df.join(lengths, "u", "left").withColumn("length", F.coalesce("length", F.lit(s.neighbours)))


def best_lists(edges: DataFrame, lengths: DataFrame, s: Settings) -> DataFrame:
    """(u, v, sim): the best edges of each u, as many as its list is long; both directions of an edge count.

    Rows are first cut down to the best per u and per hundredth of all v, so no u is one large group.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).groupBy("u", "v").agg(F.max("sim").alias("sim"))
    both = _with_length(both, lengths, s)
    for key in (["u", F.pmod(F.xxhash64("v"), F.lit(100))], ["u"]):
        both = both.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("sim"), "v"))).where(F.col("rank") <= F.col("length")).drop("rank")
    return both.drop("length")


def saturated(lists: DataFrame, lengths: DataFrame, length: int, least: float, s: Settings) -> DataFrame:
    """(u) of lists of this length that are full and hold nothing below `least`."""
    full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("sim")).where((F.col("n") >= length) & (F.col("sim") >= least))
    return _with_length(full, lengths, s).where(F.col("length") == length).select("u")


def refined(lists: DataFrame, fresh: DataFrame, nodes: DataFrame, lengths: DataFrame, n: int, turn: int, threshold: float, s: Settings, most: int = 5) -> DataFrame:
    """EDGES between the neighbours of each vector in `fresh`, better than what they have: for each at least its best `most`.

    Around a vector there may be more than three lists' worth of others that have it in theirs; each turn takes
    others of them.
    """
    worst = _with_length(lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("sim")), lengths, s)
    worst = worst.select(F.col("u").alias("v"), F.when(F.col("n") >= F.col("length"), F.col("sim")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    targets = nodes.select(F.col("node").alias("v"), "v32").join(worst, "v", "left")
    around = lists.select("u", "v").union(lists.select("v", "u")).distinct().join(fresh, "u", "left_semi")
    around = _with_length(around, lengths, s).withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v", F.lit(turn))))).where(F.col("rank") <= 3 * F.col("length"))
    p = max(parts(nodes.sparkSession), n * s.neighbours // 200_000)

    def local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "u"):
            u, v, found = table.column("u").to_numpy(), table.column("v").to_numpy(), []
            least = table.column("least").to_numpy()
            x = _matrix(table.column("v32"), np.float32)
            edges = bounds(u)
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi - lo > 1:
                    m = np.stack(x[lo:hi])
                    # As many as a list could take of them, a third of what is around.
                    found.append(_top(v[lo:hi], m @ m.T, np.nan_to_num(least[lo:hi], nan=-2.0), threshold, max(most, (hi - lo) // 3)))
            yield _edges(found)

    joined = around.select("u", "v").join(targets, "v").select("u", "v", "least", "v32")
    return joined.repartition(p, "u").sortWithinPartitions("u").mapInArrow(trimmed(local_join), EDGES)


def _double(nodes: DataFrame, node: str, x: str) -> DataFrame:
    return nodes.select(F.col("node").alias(node), F.col("x").alias(x))


def _cosine_at_least(threshold: float):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(p) == len(q) and float(np.frombuffer(p) @ np.frombuffer(q)) >= threshold for p, q in zip(a, b, strict=True)], dtype=bool)

    return linked


def _narrow():
    @F.pandas_udf("binary")
    def narrow(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.frombuffer(v).astype(np.float32).tobytes())

    return narrow


def _forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a spanning forest of the links between rows and columns."""
    rows, columns = close.any(axis=1), np.ones(close.shape[1], bool)
    found = [(np.empty(0, np.int64),) * 2]
    for first in np.flatnonzero(rows):
        queue = [first] if rows[first] else []
        rows[first] = False
        while queue:
            r = queue.pop()
            new = np.flatnonzero(close[r] & columns)
            columns[new] = False
            found.append((np.full(len(new), r), new))
            for c in new:
                tied = np.flatnonzero(rows & close[:, c])
                rows[tied] = False
                found.append((tied, np.full(len(tied), c)))
                queue.extend(tied)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def balls(crowded: DataFrame, nodes: DataFrame, threshold: float, s: Settings, scratch: Scratch, name: str) -> tuple[DataFrame, list[tuple[int, bytes]]]:
    """crowded (u) as (node, weight, x, ball), and the balls' middles (node, vector).

    Within half the threshold's angle of a middle any two members are linked, so a ball needs no comparing
    inside. Middles are a bounded sample (pivots x turns); who is in none has the ball REST.
    """
    half = math.cos(math.acos(threshold) / 2) + 1e-7
    left = scratch.keep(nodes.join(crowded.select(F.col("u").alias("node")), "node", "left_semi").select("node", "weight", "x"), f"{name}-crowd")
    middles: list[tuple[int, bytes]] = []
    if threshold > 0:
        for turn in range(s.turns):
            known = tuple(middles)
            open_ = left.select("node", "x").mapInArrow(trimmed(_nearest_middle(known, half)), "node long, ball long") if known else left.select("node", F.lit(REST).cast("long").alias("ball"))
            some = open_.where(F.col("ball") == REST).join(left.select("node", "x"), "node").orderBy(F.xxhash64("node", F.lit(turn)), "node").limit(s.pivots).collect()
            if not some:
                break
            middles += [(r.node, bytes(r.x)) for r in some]
    placed = left.select("node", "x").mapInArrow(trimmed(_nearest_middle(tuple(middles), half)), "node long, ball long")
    return scratch.keep(left.join(placed, "node"), f"{name}-balls"), middles


def _nearest_middle(middles: tuple[tuple[int, bytes], ...], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(np.array([middles[k][0] for k in own]), m) for own, m in _by_length([np.frombuffer(x) for _, x in middles])] if middles else []
        for batch in batches:
            ball = np.full(len(batch), REST, np.int64)
            for own, x in _by_length(_matrix(batch.column("x"), np.float64)):
                for ids, m in known:
                    if m.shape[1] == x.shape[1]:
                        sims = x @ m.T
                        best = sims.argmax(axis=1)
                        ball[own] = np.where(sims[np.arange(len(own)), best] >= least, ids[best], REST)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(ball)], ["node", "ball"])

    return run


def near_balls(nodes: DataFrame, middles: list[tuple[int, bytes]], threshold: float) -> DataFrame:
    """nodes (node, weight, x, crowded, ball) with grp, once for each ball that they are near but not in, and once for REST."""
    reach = math.cos(min(math.pi, 1.5 * math.acos(threshold))) - 1e-7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(np.array([middles[k][0] for k in own]), m) for own, m in _by_length([np.frombuffer(x) for _, x in middles])] if middles else []
        for batch in batches:
            own_ball = batch.column("ball").to_numpy()
            yield batch.append_column("grp", pa.array(np.full(len(batch), REST, np.int64)))
            for own, x in _by_length(_matrix(batch.column("x"), np.float64)):
                for ids, m in known:
                    if m.shape[1] == x.shape[1]:
                        r, c = np.nonzero(x @ m.T >= reach)
                        r = own[r]
                        other = own_ball[r] != ids[c]
                        yield batch.take(pa.array(r[other])).append_column("grp", pa.array(ids[c][other]))

    return nodes.mapInArrow(trimmed(run), "node long, weight long, x binary, crowded boolean, ball long, grp long")


CROSSED = "u long, v long, n long"


def crossed(left: DataFrame, right: DataFrame, n: int, threshold: float, block: int = 4096) -> DataFrame:
    """CROSSED rows for the links between left and right rows of equal grp, in double precision: (u, null, weight linked with u)
    for every left row and every right row that isn't crowded, and (u, v, null) for a spanning forest of them.

    left: grp, node, weight, x. right: also crowded. Every block of a group's left rows meets every block of its right ones.
    """
    sizes = left.groupBy("grp").agg(F.count(F.lit(1)).alias("nl")).join(right.groupBy("grp").agg(F.count(F.lit(1)).alias("nr")), "grp")
    sizes = sizes.select("grp", F.ceil(F.col("nl") / block).cast("long").alias("high"), F.ceil(F.col("nr") / block).cast("long").alias("wide"))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    own = lambda k: F.pmod(F.xxhash64("node", "grp"), F.col(k))
    a = left.join(sizes, "grp").select("grp", "node", "weight", "x", F.lit(True).alias("crowded"), F.lit(0).alias("side"), own("high").alias("a"), each("wide").alias("b"))
    b = right.join(sizes, "grp").select("grp", "node", "weight", "x", "crowded", F.lit(1).alias("side"), own("wide").alias("b"), each("high").alias("a"))
    dealt = a.unionByName(b).withColumn("pair", F.xxhash64("grp", "a", "b")).drop("a", "b")
    p = max(parts(left.sparkSession), n // 50_000)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "pair"):
            pair, grp, side, node, weight = (table.column(c).to_numpy() for c in ("pair", "grp", "side", "node", "weight"))
            free = ~table.column("crowded").to_numpy()
            x, out = _matrix(table.column("x"), np.float64), []
            edges = bounds(pair, grp)
            for lo, hi in zip(edges, edges[1:], strict=False):
                for at, m in _by_length(x[lo:hi]):
                    at = at + lo
                    ours, theirs = side[at] == 0, side[at] == 1
                    if not ours.any() or not theirs.any():
                        continue
                    other, whose = m[theirs].T, at[theirs]
                    mine = np.flatnonzero(ours)
                    for k in range(0, len(mine), 1024):
                        rows = at[mine[k : k + 1024]]
                        close = (m[mine[k : k + 1024]] @ other >= threshold) & (node[rows][:, None] != node[whose])
                        if not close.any():
                            continue
                        r, c = _forest(close)
                        blank = np.full(len(r), np.nan)
                        out.append((node[rows], np.full(len(rows), np.nan), close @ weight[whose]))
                        counted = free[whose] & close.any(axis=0)
                        out.append((node[whose][counted], np.full(counted.sum(), np.nan), weight[rows] @ close[:, counted]))
                        out.append((node[rows[r]], node[whose[c]], blank))
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(np.asarray(o[j]), from_pandas=True).cast(pa.int64()) for o in out]) for j in range(3)], ["u", "v", "n"])

    return dealt.repartition(p, "pair").sortWithinPartitions("pair", "grp").mapInArrow(trimmed(compare), CROSSED)


def audited(nodes: DataFrame, queries: DataFrame, degrees: DataFrame, threshold: float, most: int) -> tuple[int, int, int, int]:
    """By brute force, for at most `most` of the queries (node): their links, how many degrees (node, degree) has; the
    queries that have links, and how many have all of them."""
    asked = nodes.join(queries, "node", "left_semi").orderBy(F.xxhash64("node", F.lit("audit")), "node").limit(most).select("node", "x").collect()
    if not asked:
        return 0, 0, 0, 0
    own = nodes.sparkSession.sparkContext.broadcast([(r.node, bytes(r.x)) for r in asked])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([k for k, _ in own.value])
        known = list(_by_length([np.frombuffer(x) for _, x in own.value]))
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            node, weight = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
            for at, x in _by_length(_matrix(batch.column("x"), np.float64)):
                for q, m in known:
                    if m.shape[1] == x.shape[1]:
                        close = (x @ m.T >= threshold) & (node[at][:, None] != ids[q])
                        total[q] += weight[at] @ close
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], ["node", "links"])

    by_hand = nodes.select("node", "weight", "x").mapInArrow(trimmed(search), "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    seen = by_hand.join(degrees, "node", "left").select("links", F.coalesce("degree", F.lit(0)).alias("found"))
    return tuple(int(v or 0) for v in seen.agg(F.sum("links"), F.sum("found"), F.count(F.lit(1)), F.count_if(F.col("links") == F.col("found"))).first())


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = 0.95, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict]:
    """(vec_id, n_links, component_id, kept) of every row, and the audit: starts, rounds, links, found, recall, compared.

    Rows link if the cosine of their vectors, in double precision, reaches the threshold. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. component_id is the least vec_id reached, kept tells the row of
    that id. Equal directions are one vertex with a weight, so exact copies make no edges. Rows are
    told apart even if ids are null or repeated. Other columns are not read; an empty table gives
    an empty one. Labels are never read. recall is None where no query had links to judge by; all starts are
    made then.
    """
    spark, s = vectors.sparkSession, settings
    rows = scratch.keep(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e")), "rows")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, found = units_of(batch.column("e"))
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(ok)), pa.array([x.tobytes() for x in found if x is not None], pa.binary())], ["row", "x"])

    usable = scratch.keep(rows.select("row", "e").mapInArrow(trimmed(units), "row long, x binary"), "units")
    nodes = usable.groupBy("x").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"))
    nodes = scratch.keep(nodes.select("node", "weight", "x", _narrow()("x").alias("v32")), "nodes")
    n = nodes.count()
    queries = rows.where("vec_id % 50 = 0").select("row").join(usable, "row").join(nodes.select("x", "node"), "x").select("node").distinct()
    audit = {"starts": 0, "rounds": 0, "links": 0, "found": 0, "recall": None, "compared": 0}
    least = threshold - 1e-4
    near = F.col("sim") >= least
    linked = _cosine_at_least(threshold)
    none = spark.createDataFrame([], "u long, length int")
    lists, pairs, lengths = spark.createDataFrame([], EDGES), spark.createDataFrame([], "a long, b long"), none
    degrees = links = None

    def resolved(crowded: DataFrame, known: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Degrees of the nodes and links that join what is joined, from known pairs (a, b) and what lies in crowds."""
        inside, middles = balls(crowded, nodes, threshold, s, scratch, name)
        audit["compared"] = inside.where(F.col("ball") == REST).count()
        everyone = nodes.select("node", "weight", "x").join(inside.select("node", "ball", F.lit(True).alias("crowded")), "node", "left")
        everyone = everyone.select("node", "weight", "x", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.coalesce("ball", F.lit(REST - 1)).alias("ball"))
        left = inside.withColumnRenamed("ball", "grp")
        right = near_balls(everyone, middles, threshold).join(left.select("grp").distinct(), "grp", "left_semi")
        met = scratch.keep(crossed(left, right, n, threshold), f"{name}-crossed")
        free = nodes.select("node", "weight").join(inside.select("node"), "node", "left_anti")
        both = known.select(F.col("a").alias("node"), F.col("b").alias("other")).union(known.select("b", "a"))
        both = both.join(free.select("node"), "node").join(free.select(F.col("node").alias("other"), "weight"), "other")
        held = inside.where(F.col("ball") != REST)
        total = held.groupBy("ball").agg(F.sum("weight").alias("all"))
        found = both.groupBy("node").agg(F.sum("weight").alias("degree")).union(met.where("v IS NULL").groupBy("u").agg(F.sum("n")))
        found = found.union(held.join(total, "ball").select("node", F.col("all") - F.col("weight")))
        stars = held.where(F.col("node") != F.col("ball")).select(F.greatest("node", "ball").alias("a"), F.least("node", "ball").alias("b"))
        joined = known.union(met.where("v IS NOT NULL").select(F.greatest("u", "v"), F.least("u", "v"))).union(stars)
        return scratch.keep(found.groupBy("node").agg(F.sum("degree").alias("degree")), f"{name}-degrees"), joined

    reached = False
    for start in range(s.starts):
        audit["starts"] += 1
        made = scratch.keep(started(nodes, n, 11 + start, threshold, s), f"start-{start}")
        ties = made.where(near)
        before, lists = lists, scratch.keep(best_lists(lists.union(made), lengths, s), f"lists-{start}-0")
        step = 0

        def turn(fresh: DataFrame, most: int = 5):
            nonlocal lists, ties, step
            made = scratch.keep(refined(lists, fresh, nodes, lengths, n, 100 * start + step, threshold, s, most), f"made-{start}-{step}")
            ties = ties.union(made.where(near))
            step += 1
            lists = scratch.keep(best_lists(lists.union(made), lengths, s), f"lists-{start}-{step}")
            audit["rounds"] += 1
            if n > FEW:
                scratch.free()

        for _ in range(s.rounds):
            fresh = lists.join(before, ["u", "v"], "left_anti").select("u").distinct()
            before = lists
            turn(fresh)
            if lists.join(before, ["u", "v"], "left_anti").count() <= s.settled * s.neighbours * n:
                break
        # What has links goes on until no new one is found: few vectors, whose neighbours' neighbours matter most.
        for _ in range(s.rounds):
            before = lists
            turn(lists.where(near).select("u").distinct())
            if lists.where(near).join(before, ["u", "v"], "left_anti").isEmpty():
                break
        length = s.neighbours
        while length < s.longest:
            full = scratch.keep(saturated(lists, lengths, length, least, s), f"saturated-{start}-{length}")
            length *= 2
            if not full.isEmpty():
                lengths = scratch.keep(lengths.join(full, "u", "left_anti").union(full.select("u", F.lit(length))), f"lengths-{start}-{length}")
                # A whole list from each place: of a group hardly larger than a list, a third would be its same nearest each time.
                for _ in range(2):
                    turn(full, length)
        crowded = scratch.keep(saturated(lists, lengths, length, least, s), f"saturated-{start}-{length}")
        seen = ties.union(lists.where(near)).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        # Links of crowded vectors are counted with their crowd; the graph's edges stand for the others.
        for end in ("a", "b"):
            seen = seen.join(crowded.select(F.col("u").alias(end)), end, "left_anti")
        seen = seen.join(_double(nodes, "a", "xa"), "a").join(_double(nodes, "b", "xb"), "b").where(linked("xa", "xb")).select("a", "b")
        pairs = scratch.keep(pairs.union(seen), f"pairs-{start}")
        degrees, links = resolved(crowded, pairs, f"resolved-{start}")
        audit["links"], audit["found"], asked, complete = audited(nodes, queries, degrees, threshold, s.audit)
        audit["recall"] = complete / asked if asked else None
        LOG.debug("start %s: %s of %s queries with links have all", start, complete, asked)
        if asked and (reached := audit["recall"] >= s.recall):
            break
    if not reached and audit["recall"] is not None:
        degrees, links = resolved(nodes.select(F.col("node").alias("u")), pairs.limit(0), "resolved-all")
        audit["found"], audit["recall"] = audit["links"], 1.0
    LOG.info("NN-descent audit: %s", audit)

    components = scratch.keep(connected_components(links.distinct(), scratch, "component"), "components")
    of_node = nodes.select("node", "weight", "x").join(components, "node", "left").join(degrees, "node", "left")
    of_node = of_node.select("x", F.coalesce("component", "node").alias("component"), (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    placed = usable.join(of_node, "x").select("row", "component", "n_links")
    out = rows.select("row", "vec_id").join(placed, "row", "left")
    first = out.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = out.join(first, "component", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")), audit
