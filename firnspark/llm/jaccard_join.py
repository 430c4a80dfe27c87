"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Sets are compared only within tiles: a tile is a shingle among the first ones of both sets (in an
order that puts widespread shingles last; similar sets must share one) and a band of set sizes. In
a tile, signatures bound the overlap from above by bit counts; what passes is intersected exactly,
as sorted arrays.

Pairs are never listed. A tile gives a least spanning forest of the pairs that size and signature let be
linked: no more pairs than rows. The components of these forests hold every link; within each,
pairs that pass the bound are intersected, unless they are joined already, which again gives a spanning
forest. Large tiles and components are dealt into blocks: every block meets the first one, and what
that leaves apart from the largest component meets all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnspark.llm import repeats, shingles
from firnspark.llm.chunks import buckets, chunked, packed, shares, text_bytes, unpacked
from firnspark.llm.common import Scratch, trimmed
from firnspark.llm.components import connected_components, stars
from firnspark.llm.groups import bounds, first_pairs, may_meet, open_tiles, rest_pairs, whole_groups

KEY = repeats.ALONE
#: The order's list of widespread shingles has a fixed bound, so it can be broadcast: 2^17 words.
MOST_WIDESPREAD = 1 << 17
DOCS = "row long, doc_id long, n long, set0 long, set1 long"


@dataclass(frozen=True)
class Similarity:
    """Linked where bottom * |intersection| >= top * |union|."""

    top: int = 4
    bottom: int = 5
    words: int = 5

    def enough(self, n: int) -> int:
        """Least overlap of a set of n shingles with any partner."""
        return -(-self.top * n // self.bottom)

    def linked(self, n, m, common):
        return self.bottom * common >= self.top * (n + m - common)

    def may_be(self, n, m, apart):
        """Whether sets that differ in `apart` elements or more can be linked: with I = (n + m - apart) / 2."""
        return (self.bottom - self.top) * (n + m) >= (self.bottom + self.top) * apart

    def bits(self) -> float:
        """Least signature bits for each shingle: twice the bits in which linked sets of equal size may differ
        are still fewer than the half of them in which unrelated ones do."""
        return 8 * (self.bottom - self.top) / (self.bottom + self.top)


def _ordered(keys: np.ndarray, edges: np.ndarray, rank_of: np.ndarray, ranks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first[d] shingles of each set d: those that aren't widespread by hash, then those that are, rarest first.

    rank_of holds the widespread ones sorted by hash, ranks their places from rare to frequent.
    """
    hashes = keys & shingles.HASH
    doc = np.repeat(np.arange(len(first)), np.diff(edges))
    last = np.zeros(len(keys), bool)
    if len(rank_of):
        at = np.minimum(np.searchsorted(rank_of, hashes), len(rank_of) - 1)
        last = rank_of[at] == hashes
    plain = np.flatnonzero(~last)
    seen = np.concatenate([[0], np.cumsum(~last)])
    n_plain = seen[edges[1:]] - seen[edges[:-1]]
    chosen = [plain[seen[plain] - seen[edges[:-1]][doc[plain]] < first[doc[plain]]]] if len(plain) else []
    rest = np.flatnonzero(last & (n_plain < first)[doc]) if len(keys) else plain
    if len(rest):
        rest = rest[np.lexsort((ranks[at[rest]], doc[rest]))]
        begin = np.searchsorted(doc[rest], doc[rest], side="left")
        chosen.append(rest[np.arange(len(rest)) - begin < (first - n_plain)[doc[rest]]])
    return np.sort(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)


def widespread(chunks: DataFrame, size: int, at: int, least: int = 8) -> DataFrame:
    """(shingle, n): the shingles that most documents have, at most MOST_WIDESPREAD of them.

    Every chunk counts all of its texts, equal sets once, and passes on the shingles that `least` of its
    documents or more have. Only the order of comparing depends on the list: a shingle that is missed makes a
    larger tile, not a lost link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0):
                data, starts, ends = text_bytes(unpacked(held.as_buffer()).column(at))
                keys, edges = shingles.shingle_sets(data, starts, ends, size)
                a, b = shingles.set_hashes(keys, edges)
                _, once = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)
                own = np.zeros(len(starts), bool)
                own[once] = True
                found = np.sort((keys & shingles.HASH)[np.repeat(own, np.diff(edges))])
                new = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.empty(0, np.int64)
                n = np.diff(np.append(new, len(found)))
                yield pa.RecordBatch.from_arrays([pa.array(found[new][n >= least].astype(np.int64)), pa.array(n[n >= least], pa.int64())], ["shingle", "n"])

    return chunks.select("docs").mapInArrow(trimmed(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(MOST_WIDESPREAD)


def joined(docs: DataFrame, scratch: Scratch, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) for every row of docs.

    component_id is the least doc_id reachable by links. Words are runs of anything but the six
    ASCII blanks, A-Z lower-cased; a text with fewer words than a shingle has one shingle, all of
    them. Texts without words (null, empty) have no shingles and no links. Rows are told apart even
    if ids are null or repeated; equal sets are one vertex of the graph. A component of null ids
    alone has a null component_id. Other columns are not read. An empty table gives an empty one.
    Shingles are compared by 50-bit hash.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found, _ = _classes(own, scratch, similarity, chunk_bytes)
    ids = found.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return found.join(ids, "class").select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id")


def _classes(docs: DataFrame, scratch: Scratch, similarity: Similarity, chunk_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n, class) of docs, which has a long doc_id and a text, and its chunks; a row's chunk is row div MOST_DOCS."""
    spark, size = docs.sparkSession, similarity.words
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    chunks = chunked(docs, scratch, "text", chunk_bytes)
    partitions = shares(chunks)
    to = repeats.places(docs.sparkSession, partitions)
    common = scratch.keep(widespread(chunks, size, text_at), "widespread").orderBy("n", "shingle").toPandas()
    order = np.argsort(common["shingle"].to_numpy(np.int64), kind="stable")
    last = spark.sparkContext.broadcast((common["shingle"].to_numpy(np.int64)[order].astype(np.uint64), order))

    def sets(held: pa.Scalar, places: list[int] | None = None):
        texts = unpacked(held.as_buffer()).column(text_at)
        return shingles.shingle_sets(*text_bytes(texts if places is None else texts.take(pa.array(places))), size)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*repeats.SCHEMA, pa.field("docs", pa.binary())])
        for batch in batches:
            for chunk_id, held in zip(*batch.columns, strict=True):
                own = chunk_id.as_py()
                ids = unpacked(held.as_buffer()).column(id_at)
                keys, edges = sets(held)
                n = np.diff(edges)
                first = np.where(n > 0, n - -(-similarity.top * n // similarity.bottom) + 1, 0)
                at = _ordered(keys, edges, *last.value, first)
                doc, tile = (keys[at] >> np.uint64(shingles.HASH_BITS)).astype(np.int64), keys[at] & shingles.HASH
                spread = shingles.mix(tile)
                distinct, zero, marks, place = repeats.distinct(spread, np.zeros(len(spread), np.uint32), True)
                sent = repeats.messages(own, KEY, distinct, zero[:0], marks, to)
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.nulls(len(sent), pa.binary())], schema=schema)
                a, b = shingles.set_hashes(keys, edges)
                hashes = keys & shingles.HASH
                each = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                signs = pa.array([shingles.signature(hashes[lo:hi], similarity.bits()) for lo, hi in each], pa.binary())
                starts = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
                rows = pa.table({
                    "doc_id": ids, "n": n, "set0": a.astype(np.int64), "set1": b.astype(np.int64), "signature": signs,
                    "tiles": pa.ListArray.from_arrays(starts, pa.array(tile.astype(np.int64))), "places": pa.ListArray.from_arrays(starts, pa.array(place)),
                })
                yield pa.RecordBatch.from_pylist([{"chunk_id": own, "kind": -1, "docs": packed(rows.combine_chunks().to_batches()[0])}], schema)

    # Bucketed by chunk like the chunks: what is asked of a chunk's rows goes to them, and they are sent on once.
    keyed_sets = scratch.keep_bucketed(chunks.select("chunk_id", "docs").mapInArrow(trimmed(keyed), repeats.MESSAGES + ", docs binary"), "keyed", "chunk_id", buckets(docs))
    answers = repeats.answered(keyed_sets.where("kind >= 0").drop("docs"), partitions)
    by_chunk = answers.groupBy("chunk_id").agg(F.collect_list(F.struct("kind", "bucket", "n", "again", "varied")).alias("answers"))
    held_rows = keyed_sets.where("kind = -1").select("chunk_id", "docs")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, held in zip(*batch.columns, strict=True):
                t = unpacked(held.as_buffer())
                row = pa.array(chunk_id.as_py() * shingles.MOST_DOCS + np.arange(len(t)), pa.int64())
                yield pa.RecordBatch.from_arrays([row, *(t.column(c) for c in ("doc_id", "n", "set0", "set1"))], ["row", "doc_id", "n", "set0", "set1"])

    rows = scratch.keep(held_rows.mapInArrow(trimmed(rows_of), DOCS), "rows")
    # Equal sets are one vertex: the least of their rows.
    some = rows.where("n > 0")
    least = some.groupBy("n", "set0", "set1").agg(F.min("row").alias("vertex"), F.count(F.lit(1)).alias("copies"))
    copies = scratch.keep(some.join(least.where("copies > 1"), ["n", "set0", "set1"]).where("row <> vertex").select("row", "vertex"), "copies")
    surplus = copies.groupBy(_chunk().alias("chunk_id")).agg(F.collect_list(_place()).alias("surplus"))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles of each vertex that any other row is in too.

        A tile takes a band of sizes and the next one, so that sets of similar size meet in one at least.
        """
        for batch in batches:
            for chunk_id, held, got, drop in zip(*batch.columns, strict=True):
                t = unpacked(held.as_buffer())
                again = repeats.bits(got.as_py() or [], KEY, "again")
                tiles, places = t.column("tiles"), t.column("places")
                doc = np.repeat(np.arange(len(t)), np.diff(np.frombuffer(tiles.buffers()[1], np.int32)[: len(t) + 1]))
                kept = again[places.values.to_numpy()] if len(doc) else np.empty(0, bool)
                kept &= ~np.isin(doc, np.array(drop.as_py() or [], np.int64))
                doc, tile = doc[kept], tiles.values.to_numpy()[kept].astype(np.uint64)
                band = np.floor(np.log(np.maximum(1, t.column("n").to_numpy()[doc])) / np.log(similarity.bottom / similarity.top)).astype(np.int64)
                row = chunk_id.as_py() * shingles.MOST_DOCS + doc
                ids = [shingles.mix(tile ^ shingles.mix((band - k).astype(np.uint64))).astype(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate([row, row]), pa.int64())], ["tile", "row"])

    members = scratch.keep(held_rows.join(by_chunk, "chunk_id").join(surplus, "chunk_id", "left").select("chunk_id", "docs", "answers", "surplus").mapInArrow(trimmed(tiled), "tile long, row long"), "members")
    tiles = scratch.keep(_sized(members), "tiles")
    scratch.drop("members")
    del members, some, least, by_chunk, answers
    scratch.free()

    proposed = _spanned(tiles, lambda dealt: _proposed_pairs(dealt, held_rows, similarity, partitions), scratch, "proposed")
    # Whatever is linked is in one component of the pairs that may be; there sets are intersected exactly.
    groups = proposed.select(F.col("node").alias("row"), F.col("component").alias("tile"))
    groups = scratch.keep(groups.join(groups.groupBy("tile").agg(F.count(F.lit(1)).alias("size")), "tile"), "sized")
    del tiles, held_rows, keyed_sets, proposed
    scratch.drop("keyed", "tiles", "widespread", "proposed", "proposed-known")
    scratch.free()
    classes = _spanned(groups, lambda dealt: _linked(dealt, chunks, sets, similarity, partitions), scratch, "links")
    del groups
    scratch.drop("sized")
    scratch.free()

    of_row = rows.select("row", "doc_id", "n").join(copies, "row", "left").withColumn("vertex", F.coalesce("vertex", "row"))
    of_row = of_row.join(classes.select(F.col("node").alias("vertex"), "component"), "vertex", "left")
    return of_row.withColumn("class", F.coalesce("component", "vertex")).drop("component", "vertex"), chunks


def _sized(members: DataFrame) -> DataFrame:
    """members (tile, row) with the size of each tile, tiles of one row left out, and of tiles with the same rows all but one."""
    sizes = members.groupBy("tile").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("row")).alias("all"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("also"))
    return members.join(sizes.where("size > 1").groupBy("size", "all", "also").agg(F.min("tile").alias("tile")).select("tile", "size"), "tile")


def _chunk():
    return F.expr(f"row div {shingles.MOST_DOCS}")


def _place():
    return F.expr(f"CAST(row % {shingles.MOST_DOCS} AS INT)")


def _spanned(groups: DataFrame, compare, scratch: Scratch, name: str, block: int = 1024) -> DataFrame:
    """(node, component) of what compare joins in groups (tile, row, size), in two goes if the first leaves groups of
    more than one block apart. The second starts from the stars of the first."""
    found = scratch.keep(compare(first_pairs(groups, block)).distinct(), f"{name}-first")
    known = scratch.keep(connected_components(found, scratch, f"{name}-so-far"), f"{name}-known")
    scratch.drop(f"{name}-first")
    if not groups.where(F.col("size") > block).isEmpty():
        still = scratch.keep(open_tiles(groups, known, block), f"{name}-open")
        if not still.isEmpty():
            rest = scratch.keep(compare(rest_pairs(groups, known, block, still)).distinct(), f"{name}-rest")
            both = known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest)
            known = scratch.keep(connected_components(both, scratch, f"{name}-in-all"), name)
            scratch.drop(f"{name}-known", f"{name}-rest")
        scratch.drop(f"{name}-open")
    return known


def _asked(dealt: DataFrame) -> DataFrame:
    """(chunk_id, asked): for each chunk its rows' places, and where they are wanted."""
    return dealt.groupBy(_chunk().alias("chunk_id")).agg(F.collect_list(F.struct(_place().alias("place"), "pair", "tile", "side", "label")).alias("asked"))


WANTED = "pair long, tile long, side int, label long, row long"


def _wanted(asked: pa.Scalar, chunk_id: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Places in order, and where they are wanted."""
    found = asked.values
    place = found.field("place").to_numpy()
    order = np.argsort(place, kind="stable")
    place = place[order].astype(np.int64)
    columns = {c: found.field(c).take(pa.array(order)) for c in ("pair", "tile", "side", "label")}
    return place, columns | {"row": pa.array(chunk_id * shingles.MOST_DOCS + place, pa.int64())}


def _each_meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]]:
    """Tables of whole pairs of blocks, with the bounds, rows, labels and mask of each of them."""
    for table in whole_groups(batches, "pair"):
        pair, tile, side, label, row = (table.column(c).to_numpy() for c in ("pair", "tile", "side", "label", "row"))
        edges = bounds(pair, tile)
        yield table, [(lo, hi, row[lo:hi], label[lo:hi], may_meet(row[lo:hi], side[lo:hi], label[lo:hi])) for lo, hi in zip(edges, edges[1:], strict=False) if hi - lo > 1]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    """What the found pairs join, as stars: fewer rounds join those of different tasks."""
    columns = list(zip(*stars(found), strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _proposed_pairs(dealt: DataFrame, held_rows: DataFrame, similarity: Similarity, partitions: int) -> DataFrame:
    """(a, b): pairs that may be linked by size and signature, a least spanning forest of them for each pair of blocks.

    The rows' signatures are taken from their chunks and shuffled once, to where their tile is looked at.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, held, asked in zip(*batch.columns, strict=True):
                place, where = _wanted(asked, chunk_id.as_py())
                own = unpacked(held.as_buffer()).select(["n", "signature"]).take(pa.array(place))
                yield pa.RecordBatch.from_arrays([*where.values(), *own.columns], [*where, "n", "signature"])

    sent = held_rows.join(_asked(dealt), "chunk_id").select("chunk_id", "docs", "asked").mapInArrow(trimmed(signed), WANTED + ", n long, signature binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, meetings in _each_meeting(batches):
            n, signs, found = table.column("n").to_numpy(), table.column("signature"), []
            for lo, hi, row, label, meet in meetings:
                apart = shingles.least_differences([signs[k].as_buffer().to_pybytes() for k in range(lo, hi)])
                cost = np.where(meet & similarity.may_be(n[lo:hi, None], n[None, lo:hi], apart), apart + 1, np.where(label[:, None] == label[None, :], 0, -1))
                found += _named(row, shingles.forest(cost))
            yield _pairs(found)

    return sent.repartition(partitions, "pair").sortWithinPartitions("pair", "tile", "row").mapInArrow(trimmed(run), "a long, b long")


def _named(row: np.ndarray, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(int(row[a]), int(row[b])) for a, b in edges]


def _linked(dealt: DataFrame, chunks: DataFrame, sets, similarity: Similarity, partitions: int) -> DataFrame:
    """(a, b): links, a spanning forest of them for each pair of blocks.

    Signatures bound the overlap once more, for the pairs that no tile has judged; what passes is intersected
    as sorted arrays. The arrays are made again from the rows' chunks and shuffled once.
    """

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, held, asked in zip(*batch.columns, strict=True):
                place, where = _wanted(asked, chunk_id.as_py())
                for lo in range(0, len(place), 256):
                    rows, at = np.unique(place[lo : lo + 256], return_inverse=True)
                    keys, edges = sets(held, rows.tolist())
                    own = [(keys & shingles.HASH)[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, 256) for c in where.values()), pa.array([own[k] for k in at], pa.binary())], [*where, "sorted"])

    sent = chunks.select("chunk_id", "docs").join(_asked(dealt), "chunk_id").select("chunk_id", "docs", "asked").mapInArrow(trimmed(arrays), WANTED + ", sorted binary")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, meetings in _each_meeting(batches):
            arrays, found = table.column("sorted"), []
            for lo, hi, row, label, meet in meetings:
                held = [np.frombuffer(arrays[k].as_buffer(), np.uint64) for k in range(lo, hi)]
                n = np.array([len(x) for x in held])
                apart = shingles.least_differences([shingles.signature(x, similarity.bits()) for x in held])
                may = meet & similarity.may_be(n[:, None], n[None, :], apart)
                found += _named(row, shingles.joined(held, may, label, similarity.linked))
            yield _pairs(found)

    return sent.repartition(partitions, "pair").sortWithinPartitions("pair", "tile", "row").mapInArrow(trimmed(link), "a long, b long")


def one_of_each(docs: DataFrame, scratch: Scratch, similarity: Similarity = Similarity()) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, of equal ids the first as read.

    A row with a null id stays if its component has no other. All columns are kept. Documents are
    taken from their chunks, so only places are shuffled.
    """
    own = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    found, chunks = _classes(own, scratch, similarity)
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    places = first.groupBy(_chunk().alias("chunk_id")).agg(F.collect_list(_place()).alias("places"))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, kept in zip(*batch.columns, strict=True):
                yield unpacked(held.as_buffer()).take(pa.array(sorted(kept.as_py())))

    return chunks.select("chunk_id", "docs").join(places, "chunk_id").select("docs", "places").mapInArrow(trimmed(taken), own.schema)
