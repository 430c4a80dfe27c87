"""URL filter, WARC, quality model and rules, packing, BPE and licences on small tables."""

import base64
import hashlib
import json
import math
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from firnspark.llm import bpe, license_scan, packing, quality_model, quality_rules, url_filter, warc
from firnspark.llm.common import Scratch
from firnspark.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return Counter(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    rows = [tuple(r) for r in found.collect()]
    assert rows and bag(found.columns, rows) == bag(want.columns, want.fetchall())


# URLs

URLS = [
    (1, "http://Sub.Example.COM/en/7x?q=1"), (2, "https://example.com/en/8"), (3, "https://a.example.net/de/80#x"), (4, "http://b.net/de/"), (5, "http://x.org/es/"),
    (6, "http://m.casino-win.x/"), (7, "http://casinos.x/"), (8, "http://ads-track.y/a"), (9, "http://ads.y/ads"), (10, "no scheme"), (11, None), (12, ""), (13, "a://b://c/d"),
    (14, "http://notexample.com/en/7"), (15, "http://h/" + "z" * 50000 + "/casino"), (6, "http://m.casino-win.x/"), (None, "http://xxx.q/"),
]


def test_url_rules_and_vocabulary(spark):
    df = spark.createDataFrame([(*u, "x") for u in URLS], "page_id long, url string, verdict string")
    rows = url_filter.judge_urls(df).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(URLS)
    assert [got[k].rule for k in (1, 2, 3, 4, 5, 14)] == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", "org/es/", "com/en/"]
    assert [got[k].verdict for k in (1, 2, 3, 4, 5)] == ["allow", "block", "block", "allow", "block"]
    assert [got[k].verdict for k in (6, 7, 8, 9, 15, None)] == ["block", "allow", "block", "allow", "block", "block"]
    assert all(got[k].host == "" and got[k].path == "" and got[k].verdict == "allow" for k in (10, 11, 12))
    assert got[1].host == "sub.example.com" and got[1].path == "/en/7x" and got[13].host == "b:" and got[13].path == "//c/d"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_whole_urls_are_searched(spark):
    urls = ["http://x.com/search?q=porn", "http://x.com/p#XXX", "casino.example/viagra", "http://x.com/?a=free&b=bonus", "http://x.com/?a=free&b=free", "http://x.com/pornographer", "/just/a/path?track=1&win=2", ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert [got[k].verdict for k in range(8)] == ["block", "block", "block", "block", "allow", "allow", "block", "allow"]
    assert got[2].host == "" and got[2].n_strict == 2 and got[3].n_soft == 2 and got[4].n_soft == 1


def test_vocabulary_file(tmp_path):
    (path := tmp_path / "terms.tsv").write_text("# mine\nfoo\tstrict\n\nbar\tsoft\n")
    assert url_filter.read_vocabulary(str(path)) == url_filter.Vocabulary(("foo",), ("bar",))
    path.write_text("foo\n")
    with pytest.raises(ValueError):
        url_filter.read_vocabulary(str(path))


# WARC

def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "same"), (2, "http://b/", "same"), (7, None, "same"), (3, "http://c/\n x", "ü" * 70000), (4, "http://d/", None), (5, "http://e/", ""), (6, "http://f/", "other"), (6, "http://f/", "other"), (None, "http://g/", "same")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, refers_to int")
    scratch = Scratch(spark, "t")
    manifest = warc.write_archives(df.repartition(2), scratch.path("a"), scratch, archive_bytes=60000)
    rows = warc.read_archives(manifest, scratch.path("a")).collect()
    assert len(rows) == len(pages) and all(r.intact for r in rows) and manifest.agg(F.sum("records")).first()[0] == len(pages)
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    for page_id, _, html in pages:
        body = (html or "").encode()
        for r in by[page_id]:
            assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    assert {k: (by[k][0].record_type, by[k][0].refers_to) for k in (1, 2, 7, 4, 5)} == {1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 4: ("revisit", 5), 5: ("response", None)}
    assert [r.record_type for r in by[6]] == ["response"] * 2 and by[None][0].record_type == "response"
    small = warc.write_archives(df, scratch.path("b"), scratch, min_bytes=5)
    assert {r.page_id for r in warc.read_archives(small, scratch.path("b")).where("record_type = 'revisit'").collect()} == set()
    none = warc.write_archives(df.limit(0), scratch.path("c"), scratch)
    assert warc.read_archives(none, scratch.path("c")).count() == 0


def test_archive_starts_with_its_dictionary():
    records = [warc.record(k, f"http://x/{k}", f"<html><body>page {k} of the same layout</body></html>".encode() * 9, None, "2024-01-01T00:00:00Z") for k in range(300)]
    data = warc.archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICT_FRAME and list(warc.frames(data)) == records and len(data) < sum(map(len, records)) / 5
    assert list(warc.frames(warc.archive(records[:1]))) == records[:1]
    with pytest.raises(ValueError):
        list(warc.frames(data[:-5]))


def test_op1_refers_to_the_largest_equal_page(spark):
    rows = {r.page_id: r for r in QUERIES["op1_warc"](spark, SF).collect()}
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    last = {}
    for k, body in sorted(pages.items()):
        last[body] = k
    for k, body in pages.items():
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *(("response", None) if last[body] == k else ("revisit", last[body])))
        assert tuple(rows[k])[1:] == want


# Quality

def test_quality_model_on_held_out_labels(spark):
    rows = QUERIES["op3_quality_model"](spark, "/root/testdata/sf0.1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert rows.count() == docs.count()
    held = rows.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(held) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in held)


def test_rules_compile_to_what_they_score(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (800, len(quality_model.FEATURES)))
    y = ((x[:, 2] > 0.4) & (x[:, 4] < 0.7)).astype(int)
    model = quality_model.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97 and 0 < len(model.rules) < 60
    df = spark.createDataFrame([(k, tuple(map(float, r))) for k, r in enumerate(x[:50])], f"k int, features struct<{','.join(f'{f}:double' for f in quality_model.FEATURES)}>")
    assert np.allclose([r.s for r in df.select("k", model.column().alias("s")).orderBy("k").collect()], model.score(x[:50]))
    assert quality_model.fit(x[:0], y[:0]).score(x[:1])[0] == 0.5 and quality_model.fit(x, y * 0 + 1).score(x[:1])[0] > 0.9


def brute_features(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    n, chars = len(words), sum(map(len, words))
    share = lambda a, b: a / b if b else 0.0
    count = lambda s: sum(text.count(c) for c in s)
    return [
        math.log1p(n), share(chars, n), share(len(set(words)), n), share(len(re.findall("[A-Z]", text)), chars), share(count("|"), n), share(count("!"), n), share(count("#*$%&<>{}"), n),
        share(len(re.findall("[0-9]", text)), chars), share(count("."), n), share(count(","), n), share(n, len(lines)), 1 - len(set(lines)) / len(lines) if lines else 0.0,
    ]


def test_quality_scores_against_brute_force(spark):
    """Every statistic from the text, every rule from its bounds, and the score from the weights of the rules that hold."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    got = {r.doc_id: r for r in quality_model.judged(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert set(got) == set(texts) and model.rules
    for k, text in texts.items():
        x = dict(zip(quality_model.FEATURES, brute_features(text)))
        total = model.bias + sum(w for rule, w in model.rules if all(low < x[f] <= high for f, low, high in rule.bounds))
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) and got[k].predicted == int(got[k].score >= 0.3)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)


def test_steps_and_columns_do_not_meet(spark):
    names = ["_n", "_w", "_l", "_words", "_h", "_near", "_sorted", "own", "_label", "n_lines"]
    df = spark.createDataFrame([(1, "a b c\nd e", *range(7, 17))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    model = quality_model.Ensemble(0.5)
    for out in (quality_model.scored(df, model), quality_rules.with_bits(df)):
        row = out.first()
        assert all(row[n] == 7 + k for k, n in enumerate(names) if n != "n_lines") and row.text == "a b c\nd e"
    assert quality_rules.with_bits(df).first().n_lines == 2


def test_training_takes_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(k, "word " * (5 + k % 7)) for k in range(60)] + [(3, "word " * (5 + k % 50)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality long")
    a, b = (quality_model.train(d, labels, 50) for d in (docs, docs.repartition(7).orderBy(F.rand(3))))
    assert a == b


def test_quality_model_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (3, "a " * 60000, 0.3), (None, "x y", 0.4), (1, None, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_model.judged(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and quality_model.judged(docs.limit(0), labels).count() == 0


TEXTS = [None, "", " \n\t ", "a b c d e f", "one two three four five one two three four five x", "a\x0bb\x0cc\rd", "é ü|x #*\n\nsame line\nsame line\nsame", "w " * 30, "\xa0nbsp stays\u3000inside", "a a a a a a a a\n" * 4]


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n, again = Counter(grams), set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            again.update(range(k, k + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_rule_ledger(spark):
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    rows = quality_rules.judged(df).orderBy("doc_id").collect()
    for r, t in zip(rows, TEXTS):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert quality_rules.judged(df.limit(0)).count() == 0


def test_ledger_of_long_and_repeated_rows(spark):
    long = " ".join(f"w{k * 7919 % 3001}" for k in range(60_000)) + "\n" + "\n".join(["same line"] * 50 + ["x" * 200_000])
    rows = [(1, long), (1, long), (1, "a b"), (None, None)]
    got = sorted((tuple(r)[:6] for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str)
    assert got == sorted(((k, *brute_rules(t)) for k, t in rows), key=str)


def test_ablations_read_the_bits(spark):
    found = quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    bits = [r.failed_bits for r in found.collect()]
    got = {(r.policy, r.rule): (r.failed, r.failed_alone) for r in quality_rules.ablations(found).collect()}
    for version, policy in quality_rules.POLICIES.items():
        m = quality_rules.mask(policy)
        for rule in quality_rules.RULES:
            if rule.name in policy.rules:
                assert got[version, rule.name] == (sum(b >> rule.bit & 1 for b in bits), sum(b & m == 1 << rule.bit for b in bits))
    assert {r.failed for r in quality_rules.ablations(found.limit(0)).collect()} == {0}


# Packing

def test_packing_places_every_token_once(spark):
    docs = [(k, "w " * n) for k, n in enumerate([0, 1, 511, 512, 513, 4096, 4097, 9000, 300, 300, 200, 50] + [37 * k % 700 + 1 for k in range(300)])] + [(900, None), (None, "a b"), (1, "w")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, capacity int").repartition(3)
    rows = packing.pack_documents(df).collect()
    want = Counter()
    for k, t in docs:
        want[k] += len((t or "").split())
    have = Counter()
    bins = {}
    for r in rows:
        have[r.doc_id] += r.length
        if r.length == 0:
            assert r.bin_id is None and r.capacity is None and r.offset is None
        else:
            bins.setdefault(r.bin_id, []).append(r)
    assert +want == +have and {r.doc_id for r in rows} == {d[0] for d in docs}
    sizes = packing.Lengths().permitted
    for own in bins.values():
        used = sum(r.length for r in own)
        assert {r.capacity for r in own} == {min(c for c in sizes if c >= used)}
        spans = sorted((r.offset, r.offset + r.length) for r in own)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    total = sum(r.length for r in rows)
    assert total / sum(own[0].capacity for own in bins.values()) > 0.95
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, capacities = packing.packed(np.array([300, 400, 200, 110]), packing.Lengths((512,), 0, 0))
    assert bins[3] == bins[1] and bins[2] == bins[0] and list(capacities) == [512, 512]


def brute_packed(sizes, lengths):
    """The same rule by looking at every open bin for every piece: least room that holds it, the bin last touched of equal ones."""
    largest = max(lengths.permitted)
    left = [s * sizes.count(s) for s in range(largest + 1)]
    coming, opened, clock, bins, placed = [sum(left[: k + 1]) for k in range(largest + 1)], 0, 0, [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size, clock = sizes[k], clock + 1
        fit = [b for b in bins if b["room"] >= size]
        if fit:
            b = min(fit, key=lambda b: (b["room"], -b["touched"]))
        else:
            if opened % 64 == 0:
                coming = [sum(left[: j + 1]) for j in range(largest + 1)]
            opened += 1
            price = lambda c: lengths.cost(c) / (size + min(c - size, coming[min(c - size, size)]))  # noqa: E731, B023
            best = min((c for c in sorted(lengths.permitted) if c >= size), key=lambda c: (price(c), c))
            bins.append(b := {"at": len(bins), "room": best, "used": 0})
        left[size] -= size
        placed[k] = (b["at"], b["used"])
        b["used"] += size
        b["room"] -= size
        b["touched"] = clock
    return placed, [min(c for c in lengths.permitted if c >= b["used"]) for b in bins]


@pytest.mark.parametrize("seed", range(4))
def test_placement_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = packing.Lengths((64, 128, 256), 1 / 512, 8.0)
    sizes = rng.integers(1, 257, size=150) if seed % 2 else np.minimum(256, 1 + rng.geometric(0.02, size=300))
    bins, offsets, capacities = packing.packed(sizes, lengths)
    placed, want = brute_packed(sizes.tolist(), lengths)
    assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [placed[k] for k in range(len(sizes))]
    assert capacities.tolist() == want


def test_sequences_hold_the_documents_tokens(spark):
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 50_000, size=n).tolist()) for k, n in enumerate([0, 1, 16, 17, 40, 100, *rng.integers(1, 30, size=60).tolist()])] + [(None, [7, 8]), (90, None), (91, [5, None, 6]), (1, [3])]
    df = spark.createDataFrame([(*d, 2) for d in docs], "doc_id long, ids array<int>, bin_id int").repartition(3)
    lengths = packing.Lengths((8, 16), 0.0, 1.0)
    for pool in (1 << 22, 64):
        rows = packing.pack_sequences(df, lengths, pool_tokens=pool).collect()
        assert len({r.bin_id for r in rows}) == len(rows) and all(len(r.ids) <= r.capacity and r.capacity == min(c for c in (8, 16) if c >= len(r.ids)) for r in rows)
        got = Counter()
        for r in rows:
            assert r.starts[0] == 0 and list(r.starts) == sorted(set(r.starts))
            for doc, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.ids)]):
                got[doc, tuple(r.ids[a:b])] += 1
        want = Counter()
        for doc, ids in docs:
            ids = [x for x in ids or [] if x is not None]
            for a in range(0, len(ids), 16):
                want[doc, tuple(ids[a : a + 16])] += 1
        assert got == want
    assert packing.pack_sequences(df.limit(0)).count() == 0


# BPE

@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


ODD = ["", " ", "don't we'LL 've <|startoftext|>x<|endoftext|> y", "aaaaaaaaaaaaaaa", "İstanbul ΣΑΣ é \x1c a\u200bb 12345 ²½ 日本語 😀 naïve\xa0x", "!" * 40 + "?", "z" * 3000, "\x85a b", "K Å ﬁ ß"]


def test_bpe_equals_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary)
    lib.no_truncation()
    lib.no_padding()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD + [None]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in bpe.token_digests(df, vocabulary).collect()}
    ids = {r.doc_id: r for r in bpe.encode_documents(df, vocabulary).collect()}
    back = {r.doc_id: r.decoded for r in bpe.decode_ids(bpe.encode_documents(df, vocabulary), vocabulary).collect()}
    for k, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(want, skip_special_tokens=False)
        assert got[k] == (len(want), sha(" ".join(map(str, want))), sha(text))
        assert ids[k].ids == want and ids[k].decoded == text == back[k]
    assert bpe.token_digests(df.limit(0), vocabulary).count() == 0


def test_automaton_equals_plain_merging():
    """Against merging by rank, on a vocabulary with repeated letters and overlapping merges."""
    letters = bpe.byte_letters()
    merges = [("a", "a"), ("b", "a"), ("aa", "a"), ("a", "b"), ("aa", "b</w>"), ("ba", "ba"), ("b", "b</w>"), ("aa", "aa"), ("ba", "b</w>"), ("aaa", "ba"), ("a", "a</w>")]
    vocab = {s: k for k, s in enumerate([*letters, *(c + "</w>" for c in letters), *(x + y for x, y in merges)])}
    own = bpe.Automaton({"model": {"vocab": vocab, "end_of_word_suffix": "</w>", "merges": [list(m) for m in merges]}, "added_tokens": []}, max_states=7)
    rank = {m: k for k, m in enumerate(merges)}

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            best = min((rank.get(p, math.inf), k) for k, p in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (math.inf, 0)
            if best[0] == math.inf:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = np.random.default_rng(5)
    for _ in range(3000):
        word = "".join(rng.choice(list("aab"), rng.integers(1, 14)))
        assert own.emit(own.ids_of(word)).split() == plain(word), word


# Licences

def test_license_scan_inherits_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        (1, "r/LICENSE", mit), (2, "r/a.txt", "no header"), (3, "r/s/b.txt", f"x\n{apache}\ny"), (4, "r/s/t/c.txt", ""), (5, "r/s/COPYING.md", apache), (6, "q/d.txt", None),
        (7, None, mit), (8, "e.txt", "released under the mit license"), (9, "r/s/LICENSE", "some licensed words that are like no template at all, however long"), (2, "r/a.txt", "no header"), (10, "r/s/t/LICENSE", ""), (11, "r/long.txt", "word " * 30000),
    ]
    df = spark.createDataFrame([(*f, "z") for f in files], "doc_id long, path string, text string, license string")
    rows = license_scan.scan(df, Scratch(spark, "t")).collect()
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in rows}
    assert len(rows) == len(files)
    assert got[1] == ("MIT", "own", None) and got[2] == ("MIT", "inherited", "r") and got[3] == ("Apache-2.0", "own", None) and got[4] == ("Apache-2.0", "inherited", "r/s")
    assert got[6] == (None, "none", None) and got[7] == ("MIT", "own", None) and got[8] == ("MIT", "own", None) and got[10] == ("Apache-2.0", "inherited", "r/s") and got[11][0] == "MIT"
    assert license_scan.scan(df.limit(0), Scratch(spark, "t")).count() == 0


def test_cosine_is_that_of_the_definition(spark):
    w = license_scan.Weights()
    text = "Released under the MIT License, mostly"
    own = Counter(re.findall(license_scan.TOKEN, text.lower()))
    idf = w.idf()
    vec = {t: n * idf.get(t, w.other()) for t, n in own.items()}
    norm = math.sqrt(sum(v * v for v in vec.values()))
    dots = Counter()
    for template, _, t, x in w.rows():
        dots[template] += vec.get(t, 0) * x / norm
    best = max(dots.values())
    found = license_scan.scan(spark.createDataFrame([(1, "a", text)], "doc_id long, path string, text string"), Scratch(spark, "t"), least=0.1).first()
    assert found.license == "MIT" and found.score == pytest.approx(best, abs=1e-6)


def test_license_scan_leaves_out_nothing_that_reaches_the_threshold(spark):
    """Every line against every template by hand; the notices name their licences without any anchor."""
    rng, w = np.random.default_rng(8), license_scan.Weights()
    idf, words = w.idf(), sorted(w.idf())
    lines = [t for _, t in w.templates if "\n" not in t and "." not in t] + ["Mit", "Released under the GPLv3", "permission to use copy modify", ""]
    lines += [" ".join([*rng.permutation(t.split())[: rng.integers(1, 12)], *rng.choice(words, rng.integers(0, 3))]).replace(".", " ") for _, t in w.templates for _ in range(2)]
    vectors = {}
    for k, name, t, x in w.rows():
        vectors.setdefault((k, name), {})[t] = x
    want = {}
    for k, text in enumerate(lines):
        own = {t: n * idf.get(t, w.other()) for t, n in Counter(re.findall(license_scan.TOKEN, text.lower())).items()}
        norm = math.sqrt(sum(v * v for v in own.values())) or 1.0
        score, name = min((-round(sum(v * x.get(t, 0.0) for t, v in own.items()) / norm, 6), name) for (_, name), x in vectors.items())
        want[k] = (name if -score >= 0.8 else None, score)
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame([(k, f"d{k}.txt", t) for k, t in enumerate(lines)], "doc_id long, path string, text string"), Scratch(spark, "t")).collect()}
    clear = {k: name for k, (name, score) in want.items() if abs(score + 0.8) > 2e-6}
    assert len(clear) > 500 and got[lines.index("GPLv3")] == got[lines.index("Released under the GPLv3")] == "GPL-3.0"
    assert {k: got[k] is None for k in clear} == {k: name is None for k, name in clear.items()}


def test_real_notices_are_found(spark):
    full = dict(reversed([t for t in license_scan.TEMPLATES if len(t[1]) > 600]))
    mit = full["MIT"].replace("Copyright (c)", "Copyright (c) 2021 Jane Q. Public and others")
    apache = ["Copyright 2019 The Example Authors.", "", *textwrap.wrap(full["Apache-2.0"], 60)]
    files = {
        "a/LICENSE": (mit, "MIT"), "b.py": ("\n".join(f"# {x}".rstrip() for x in apache) + "\n\nimport os\n", "Apache-2.0"),
        "c.c": ("/*\n" + "\n".join(f" * {x}".rstrip() for x in apache) + "\n */\nint main;\n", "Apache-2.0"), "d.rs": ("// SPDX-License-Identifier: GPL-3.0-or-later\nfn main() {}", "GPL-3.0"),
        "e/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n", "GPL-3.0"),
        "f.md": ("Copyright 2020 Foo. Licensed under the MIT License. Have fun.", "MIT"), "g.md": ("This file is released under the MIT License, see LICENSE for details.", "MIT"),
        "h.txt": ("I was licensed to drive in the public domain of my home town, after a redistribution of seats.", None), "i/LICENSE": (full["BSD-3-Clause"], "BSD-3-Clause"), "j/LICENSE": (full["ISC"], "ISC"),
        "k.txt": ("License: BSD 2-Clause License " * 3 + "x" * 100_000, None),
    }
    df = spark.createDataFrame([(k, path, text) for k, (path, (text, _)) in enumerate(files.items())], "doc_id long, path string, text string")
    got = {r.path: (r.license, r.origin) for r in license_scan.scan(df, Scratch(spark, "t")).collect()}
    assert {p: got[p][0] for p in files if p != "k.txt"} == {p: name for p, (_, name) in files.items() if p != "k.txt"}


def test_vocabulary_file_is_a_parameter(spark, tmp_path, vocabulary):
    copy = tmp_path / "v.json"
    copy.write_text(json.dumps(json.load(open(vocabulary))))
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    assert bpe.encode_documents(df, str(copy)).first().ids == bpe.encode_documents(df, vocabulary).first().ids
