"""Near-duplicate joins, suffix sort, neighbour graph and pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from firnspark.llm import chunks, jaccard_join, nn_descent, rolling, shingles, suffix_dedup
from firnspark.llm.common import Scratch
from firnspark.llm.components import connected_components, stars
from firnspark.llm.queries import QUERIES


def test_chunk_ids_go_to_one_bucket(spark):
    ids = [k for task in (0, 3, 51, 70_000) for k, _ in zip(chunks.chunk_ids(task, 51), range(9))]
    assert len(set(ids)) == 36 and max(ids) < 1 << 49
    found = spark.createDataFrame([(k,) for k in ids], "id long").select("id", F.hash("id").alias("h"), F.expr("pmod(hash(id), 51)").alias("b")).collect()
    assert chunks.spark_hash(np.array([r.id for r in found])).tolist() == [r.h for r in found]
    assert {r.id: r.b for r in found} == {k: task % 51 for task, own in zip((0, 3, 51, 70_000), np.split(np.array(ids), 4)) for k in own.tolist()}


def test_a_task_writes_one_file_of_chunks(spark):
    df = spark.range(4000).select("id", F.repeat(F.lit("word "), 500).alias("text")).repartition(3)
    scratch = Scratch(spark, "t")
    table = chunks.chunked(df, scratch, chunk_bytes=1 << 19)
    assert table.count() > 12 and len(table.inputFiles()) == 3
    scratch.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in (n for n in scratch.tables.values())] and not scratch.tables


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(200)] + [(5, 5)] + [(2000, 2001 + k) for k in range(300)]
    want = components({n for e in links for n in e}, links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


class Named(Scratch):
    """Remembers what was written."""

    def __init__(self, spark):
        super().__init__(spark, "t")
        self.names = []

    def keep(self, df, name):
        self.names.append(name)
        return super().keep(df, name)


def test_components_end_when_all_are_stars(spark):
    """No round follows only to see that nothing moves; chains take more than one."""
    links = [(k, k % 10) for k in range(10, 200)] + [(k, k % 10) for k in range(10, 90)]
    found = connected_components(spark.createDataFrame(links, "a long, b long"), scratch := Named(spark), "c")
    assert {r.node: r.component for r in found.collect()} == {k: k % 10 for k in range(200)} and scratch.names == ["c-0"]
    chain = [(k, k + 1) for k in range(50)] + [(50, 200), (200, 60), (60, 199), (199, 55)]
    found = connected_components(spark.createDataFrame(chain, "a long, b long"), scratch := Named(spark), "c")
    assert {r.component for r in found.collect()} == {0} and len(scratch.names) > 1


def test_stars_join_what_links_join():
    rng = random.Random(6)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k + 1, k) for k in range(500, 900)] + [(2000, k) for k in range(1000, 1100)] + [(7, 7)]
    want = components({n for e in links for n in e}, links)
    got = stars(links)
    assert dict(got) == {n: c for n, c in want.items() if n != c} and len(got) == len(dict(got))
    assert stars([]) == []


# Shingles

def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def jaccard_components(docs, top, bottom, k):
    sets = {i: shingle_set(t, k) for i, t in docs}
    having = defaultdict(list)
    links = []
    for i, s in sets.items():
        n = Counter(j for g in s for j in having[g])
        links += [(i, j) for j, m in n.items() if bottom * m >= top * (len(s) + len(sets[j]) - m)]
        for g in s:
            having[g].append(i)
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


def made_documents(n, seed=1):
    """Copies and near copies about the threshold, chains, short texts, and a line that most share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    docs, bases = [], [[word() for _ in range(rng.choice([3, 8, 30, 60, 120]))] for _ in range(n // 6)]
    common = [word() for _ in range(25)]
    for k in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            text[rng.randrange(len(text))] = word()
        if rng.random() < 0.5:
            text = common + text
        docs.append((k, " ".join(text).upper() if k % 7 == 0 else " ".join(text)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "  "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "long " + " ".join(f"x{k}" for k in range(30000))), (n + 6, "long " + " ".join(f"x{k}" for k in range(30000)) + " end")]


@pytest.mark.parametrize("top,bottom,k,chunk", [(85, 100, 4, 4 << 20), (4, 5, 5, 3000)])
def test_jaccard_join_is_exact(spark, top, bottom, k, chunk):
    docs = made_documents(500)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string").repartition(3)
    found = jaccard_join.joined(df, Scratch(spark, "t"), jaccard_join.Similarity(top, bottom, k), chunk_bytes=chunk)
    want = jaccard_components(docs, top, bottom, k)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == want and len({c for _, c in want.values()}) < len(want) * 0.8


def test_jaccard_join_with_null_and_repeated_ids(spark):
    text = " ".join(f"a{k}" for k in range(40))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (3, text + " b"), (None, "alone here now too far"), (9, "unlike")], "doc_id long, text string")
    rows = jaccard_join.joined(df, Scratch(spark, "t")).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter({(5, 3): 2, (None, 3): 1, (3, 3): 1, (None, None): 1, (9, 9): 1})
    assert jaccard_join.joined(df.limit(0), Scratch(spark, "t")).count() == 0
    kept = sorted((r.doc_id or -1) for r in jaccard_join.one_of_each(df, Scratch(spark, "t")).collect())
    assert kept == [-1, 3, 9]


def test_blocks_of_a_large_tile(spark, monkeypatch):
    """One group larger than a block of 1024 rows, its members' links found across blocks."""
    rng = random.Random(2)
    base = [f"v{k}" for k in range(60)]
    docs = []
    for k in range(1300):
        text = list(base)
        text[rng.randrange(60)] = f"n{k}"
        docs.append((k, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = jaccard_join.joined(df, Scratch(spark, "t"), jaccard_join.Similarity(4, 5, 5))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == jaccard_components(docs, 4, 5, 5)


def test_a_crowd_that_the_first_block_joins_is_not_compared_again(spark):
    """Near copies in several blocks, all joined to the first: no second go, and one round for each graph."""
    rng = random.Random(9)
    base = [f"v{k}" for k in range(200)]
    docs = [(k, " ".join(f"n{k}" if j == at else w for j, w in enumerate(base))) for k, at in enumerate(rng.randrange(200) for _ in range(1300))]
    found = jaccard_join.joined(spark.createDataFrame(docs, "doc_id long, text string"), scratch := Named(spark))
    assert {r.doc_id: r.component_id for r in found.collect()} == dict.fromkeys(range(1300), 0)
    assert "links-open" in scratch.names and not [n for n in scratch.names if n.endswith(("-rest", "-1"))]


def test_signatures_bound_differences():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 50, n, dtype=np.uint64)) for n in (5, 60, 70, 500)]
    sets += [np.unique(np.concatenate([sets[1][3:], sets[0]])), sets[2]]
    for per in (0.5, 8):
        bound = shingles.least_differences([shingles.signature(s, per) for s in sets])
        true = np.array([[len(np.setxor1d(a, b)) for b in sets] for a in sets])
        assert (bound <= true).all() and bound[2, 5] == 0
    for a in sets:
        if len(a):
            assert (shingles.common(a, full := [b for b in sets if len(b)]) == [len(np.intersect1d(a, b)) for b in full]).all()


def test_window_hashes():
    data = np.frombuffer(b"abcabcabd" * 50, np.uint8)
    h = rolling.Rolling(data, 0).all(7)
    same = defaultdict(set)
    for k in range(len(h)):
        same[int(h[k])].add(bytes(data[k : k + 7]))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({bytes(data[k : k + 7]) for k in range(len(h))})
    v = np.random.default_rng(1).integers(0, 99, 200)
    assert all((rolling.sliding_min(v, w) == [v[k : k + w].min() for k in range(200 - w + 1)]).all() for w in (1, 2, 3, 7, 64, 137))


# Suffixes

def brute_repeats(rows, length):
    seen = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        lost = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                lost[k : k + length] = b"\1" * length
        out.append((i, len(t), sum(lost), len(re.findall(b"\1+", bytes(lost))), hashlib.sha256(bytes(c for c, x in zip(t, lost) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,chunk", [(40, 12, 1000), (40, 12, 1 << 20), (25, 8, 400)])
def test_suffix_dedup_is_exact(spark, length, gram, chunk):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("ab cdé") for _ in range(n))
    shared = [text(rng.randrange(20, 200)) for _ in range(12)]
    docs = []
    for k in range(150):
        parts = [text(rng.randrange(0, 120))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s)), len(s) if rng.random() < 0.6 else rng.randrange(len(s))))
            parts += [s[a:b], text(rng.randrange(0, 60))]
        docs.append((k, "".join(parts)))
    docs += [(200, None), (201, ""), (202, "x" * 500), (203, "ab" * 300), (204, docs[3][1]), (204, docs[3][1]), (None, "short"), (205, "x" * length), (206, text(5000))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_bytes int").repartition(3)
    found = suffix_dedup.find_repeats(df, Scratch(spark, "t"), length=length, gram=gram, chunk_bytes=chunk)
    rows = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"), "spans", "kept", "text").collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(brute_repeats([(i, (t or "").encode()) for i, t in docs], length))
    for r in rows:
        whole = (r.text or "").encode()
        assert len(r.spans) == r.n_spans and sum(b - a for a, b in r.spans) == r.n_removed
        cut = b"".join(whole[a:b] for a, b in zip([0, *(e for _, e in r.spans)], [*(s for s, _ in r.spans), len(whole)]))
        assert cut == bytes(r.kept)
    assert suffix_dedup.find_repeats(df.limit(0), Scratch(spark, "t")).count() == 0


def test_op5_on_its_table(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op5_suffix_dedup"](spark, SF).collect()]
    assert Counter(got) == Counter(brute_repeats(rows, 200)) and any(g[2] for g in got)


def test_texts_without_repeats_stay(spark):
    passage = "ü" * 30 + "".join(chr(97 + k * k % 26) for k in range(230))
    df = spark.createDataFrame([(1, "head é" + passage, "a"), (2, passage + "tail", "b"), (3, None, "c"), (4, "clean text", None)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(df, Scratch(spark, "t")).collect()}
    assert got[1].text == "head é" and got[2].text == "tail" and got[3].text is None and got[4].text == "clean text" and got[2].source == "b"


# Vectors

def brute_vectors(rows, threshold):
    units = {k: nn_descent.unit(None if v is None or None in v else v) for k, v in enumerate(v for _, v in rows)}
    ok = [k for k, u in units.items() if u is not None]
    links = [(a, b) for a in ok for b in ok if a < b and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= threshold]
    return links, ok


def test_nn_descent(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (c := centres[k % 12]) + rng.normal(size=16) * 0.02 if k < 400 else rng.normal(size=16)) for k in range(900)]
    rows = [(k, [float(x) for x in v]) for k, v in rows]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (1004, [float("inf")] + [1.0] * 15), (1005, []), (1006, rows[0][1]), (1007, [2 * x for x in rows[0][1]]), (1008, [1.0, 0.0]), (1009, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, n_links int").repartition(3)
    found, audit = nn_descent.near_duplicates(df, Scratch(spark, "t"))
    links, _ = brute_vectors(rows, 0.95)
    n = Counter(k for e in links for k in e)
    ids = [k for k, _ in rows]
    want = {i: (n[k], c := components(range(len(rows)), links)[k]) for k, i in enumerate(ids)}
    got = {r.vec_id: r for r in found.collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (m, ids[c], ids[c] == i) for i, (m, c) in want.items()}
    assert audit["recall"] == 1.0 and len(got) == len(rows)


def test_sparse_links_between_crowded_groups(spark):
    """Every list is full of its own group, and few vectors of two groups link."""
    rng = np.random.default_rng(4)
    base, rows = np.eye(24), []
    for g in range(6):
        own, angle = base[4 * g : 4 * g + 2], np.arccos(0.934)
        for centre in (own[0], np.cos(angle) * own[0] + np.sin(angle) * own[1]):
            rows += [(len(rows) + k, (centre + rng.normal(size=24) * 0.016).tolist()) for k in range(60)]
    links, _ = brute_vectors(rows, 0.95)
    across = [(a, b) for a, b in links if a // 60 != b // 60]
    assert across and len(across) < 0.02 * len(links)
    found = nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t"), settings=nn_descent.Settings(neighbours=5, signs=2, cell=8, rounds=2, starts=1))[0]
    n, least = Counter(k for e in links for k in e), components(range(len(rows)), links)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == {k: (n[k], least[k]) for k in range(len(rows))}


def test_audit_sees_small_groups_beside_a_large_one(spark):
    """Nearly all links are the large group's, so a recall over links hides the pairs that a thin search loses."""
    rng = np.random.default_rng(6)
    rows = [c + rng.normal(size=16) * 0.01 for c in [rng.normal(size=16)] for _ in range(200)]
    rows += [c + rng.normal(size=16) * 0.2 for c in rng.normal(size=(150, 16)) for _ in range(2)]
    rows = [(k, v.tolist()) for k, v in enumerate(rows)]
    links, _ = brute_vectors(rows, 0.95)
    n, least = Counter(k for e in links for k in e), components(range(len(rows)), links)
    found, audit = nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t"), settings=nn_descent.Settings(signs=1, cell=2, rounds=1, starts=1))
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == {k: (n[k], least[k]) for k in range(len(rows))}
    assert audit["recall"] == 1.0


def test_nn_descent_finds_all_links_of_groups_hardly_larger_than_a_list(spark):
    """Groups of 16 to 29, all of whose pairs link, by one start and without audit (no id is divisible by 50)."""
    rng = np.random.default_rng(21)
    groups = [rng.standard_normal(64) + 0.19 * rng.standard_normal((16 + k % 14, 64)) for k in range(42)]
    x = np.concatenate([*groups, rng.standard_normal((1500, 64))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = u @ u.T >= 0.95
    want = close.sum(axis=1) - 1
    ids = [k + k // 49 + 1 for k in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    found, audit = nn_descent.near_duplicates(df, Scratch(spark, "t"), settings=nn_descent.Settings(starts=1))
    assert audit["recall"] is None and (want > 10).sum() > 500
    assert {r.vec_id: r.n_links for r in found.collect()} == dict(zip(ids, want.tolist()))


def test_nn_descent_edge_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nn_descent.near_duplicates(empty, Scratch(spark, "t"))[0].count() == 0
    one = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in nn_descent.near_duplicates(one, Scratch(spark, "t"))[0].collect()) == Counter({(None, 2, 4, False): 1, (4, 2, 4, True): 2})


def test_crossed_counts_and_joins_across_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 8)) * 0.2 + np.ones(8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight = [1 + k % 2 for k in range(90)]
    right = spark.createDataFrame([(7, k, weight[k], bytearray(v.tobytes()), k < 40) for k, v in enumerate(x)], "grp long, node long, weight long, x binary, crowded boolean")
    met = nn_descent.crossed(right.where("crowded").drop("crowded"), right, 90, 0.95, block=16).collect()
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    close[40:, 40:] = False
    got = Counter()
    for r in met:
        if r.v is None:
            got[r.u] += r.n
    assert {k: got[k] for k in range(90)} == {k: int(v) for k, v in enumerate(close @ np.array(weight))}
    links = [(a, b) for a in range(90) for b in range(a) if close[a, b]]
    assert components(range(90), [(r.u, r.v) for r in met if r.v is not None]) == components(range(90), links)


def test_crowds_are_counted_in_balls(spark):
    """A tight group of a third of all rows, vectors around its edge, and pairs: every link, without comparing the group."""
    rng = np.random.default_rng(8)
    middle = np.eye(24)[0]
    rows = [middle + rng.normal(size=24) * 0.012 for _ in range(300)]
    rows += [middle + (v := rng.normal(size=24)) / np.linalg.norm(v) * r for r in np.linspace(0.15, 0.6, 150)]
    rows += [c + rng.normal(size=24) * 0.1 for c in rng.normal(size=(225, 24)) for _ in range(2)]
    rows = [(k, v.tolist()) for k, v in enumerate(rows)]
    links, _ = brute_vectors(rows, 0.95)
    n, least = Counter(k for e in links for k in e), components(range(len(rows)), links)
    found, audit = nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == {k: (n[k], least[k]) for k in range(len(rows))}
    assert audit["compared"] < 100


def test_blocks_join_what_all_pairs_join(spark):
    """Groups of several blocks: a crowd that joins at once, strangers that join it by one link, and nothing else."""
    from firnspark.llm.groups import first_pairs, may_meet, rest_pairs

    rng = np.random.default_rng(3)
    links = {(a, b) for a in range(60) for b in range(a) if rng.random() < 0.2} | {(70, 65), (75, 59), (75, 70), (78, 77)}
    groups = spark.createDataFrame([(5, k, 80) for k in range(80)] + [(6, 100, 2), (6, 101, 2)], "tile long, row long, size long")
    linked = lambda a, b: (max(a, b), min(a, b)) in links or {a, b} == {100, 101}

    def compare(dealt):
        by, seen = {}, set()
        for r in dealt.collect():
            by.setdefault((r.pair, r.tile), []).append(r)
        for rows in by.values():
            meet = may_meet(*(np.array([r[c] for r in rows]) for c in ("row", "side", "label")))
            seen |= {(rows[a].row, rows[b].row) for a, b in zip(*np.nonzero(meet)) if linked(rows[a].row, rows[b].row)}
        return seen

    first = compare(first_pairs(groups, 16))
    so_far = components(range(102), first)
    known = spark.createDataFrame([(k, so_far[k]) for k in range(102)], "node long, component long")
    rest = rest_pairs(groups, known, 16)
    assert components(range(102), first | compare(rest)) == components(range(102), links | {(101, 100)})
    assert rest.where("side = 0").select("row").distinct().count() < 40


# Pipeline

def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark, "t")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.keep(stage(spark, docs, SF), f"s{k}")
        out.append(docs)
    good, ruled, single, cut, packed = ({r.doc_id: r for r in x.collect()} for x in out)
    assert all(x.columns == list(corpus_pipeline.COLUMNS) for x in out[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum((d in good) == bool(q) for d, q in labels.items()) >= 0.93 * len(labels)
    assert set(ruled) <= set(good) and set(single) <= set(ruled) and set(cut) == set(single) == set(packed)
    want = jaccard_components([(i, r.text) for i, r in ruled.items()], 4, 5, 5)
    assert set(single) == {c for _, c in want.values()}
    for i, n_bytes, removed, _, digest in brute_repeats([(i, r.text.encode()) for i, r in single.items()], 200):
        assert removed or cut[i].text == single[i].text
        assert removed == 0 or len(cut[i].text.encode()) <= n_bytes - removed
        assert cut[i].n_chars == len(cut[i].text)
    assert {r.doc_id: r.n for r in out[-1].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(r.text.split()) for i, r in cut.items()}
    assert len(corpus_pipeline.run(spark, SF).columns) == 7


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with the steps' names, and no rows at all."""
    import corpus_pipeline

    text = "Here is one plain sentence of several common words, and here is another one that says a little more about it. "
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text + "Tail of its own.", None, None, None), (2, None, "en", "a", 1), (3, "", "en", "a", 0), (4, "word " * 30_000, "de", "b", 9), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(*r, 3, "x") for r in rows], schema + ", _n int, score string")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, SF)
            found = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == list(corpus_pipeline.COLUMNS)
            assert bool(found) <= bool(docs.count())
        if name == "quality rules":
            assert not any(r.text in (None, "") for r in stage(spark, odd, SF).collect())
        if name == "n-gram Jaccard join":
            got = Counter((r.doc_id, r.text) for r in stage(spark, odd, SF).collect())
            assert got[1, text] == 1 and got[2, None] == 1 and got[3, ""] == 1 and got[None, None] == 1 and got[4, "word " * 30_000] == 1
        if name == "suffix-array dedup":
            got = Counter((r.doc_id, r.text, r.n_chars) for r in stage(spark, odd, SF).collect())
            assert got[2, None, None] == 1 and got[3, "", 0] == 1 and sum(got.values()) == len(rows)
        if name == "best-fit packing":
            assert {r.doc_id for r in stage(spark, odd, SF).collect()} == {1, 2, 3, 4, None}
