"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import bwt, decontaminate, graph, lm, minhash, packing, quality, sharding, suffix, tokens, toxicity, urls
from codeloom.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, component_id string, score string"


def _texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [line(r.randint(30, 300)) for _ in range(20)]
    shared = line(120)
    out = [None, "", "   \n\t", "one", "One", "two words", "a b c d", "A b  c D", "a b c d e", "x " * 700, "é" * 900]
    for b in base:
        out.append(b)
        w = b.split()
        for k in range(3):
            v = list(w)
            for _ in range(k):
                v[r.randrange(len(v))] = "changed"
            out.append(" ".join(v).upper() if k == 1 else " ".join(v))
    out += [f"{line(20)}\n{shared}\n{line(20)}" for _ in range(6)] + [f"{line(30)} {shared} {shared}"]
    return out


TEXTS = _texts()
ROWS = [(i, t, None, "s", None, "clash", "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "null id text with some words", None, None, 1, None, None, None), (30, TEXTS[30], None, "s", None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t, lower=True):
    w = WORD.findall((t or "").translate(LOWER) if lower else t or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, none):
    by: dict = {}
    for r in ROWS:
        if r[0] is not None:
            by[r[0]] = shingles(r[1])
    parent = {i: i for i in by}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in by:
        for b in by:
            n = len(by[a] & by[b])
            if a < b and n and 100 * n >= 75 * len(by[a] | by[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = find(r["doc_id"]) if r["doc_id"] is not None else None
        assert r["component_id"] == want and r["kept"] == (r["doc_id"] == want)
        assert r["doc_id"] is None or r["n_shingles"] == len(by[r["doc_id"]])
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect() if r[0] is not None) == sorted({find(i) for i in by})


def test_near_duplicates_of_thousands_of_rows_with_one_id(spark):
    r = random.Random(15)
    words = [f"w{i}" for i in range(300)]
    one, other = (" ".join(r.choices(words, k=200)) for _ in range(2))
    rows = [(7, one)] * 3000 + [(9, one + " more")] * 1500 + [(3, other)] * 2 + [(None, one)] * 500 + [(11, one)]
    got = collections.Counter(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()))
    n = [len(shingles(x)) for x in (one, one + " more", other)]
    assert got == {(7, n[0], 7, True): 3000, (9, n[1], 7, False): 1500, (3, n[2], 3, True): 2, (None, n[0], None, True): 500, (11, n[0], 7, False): 1}


def test_prefix_filter_finds_what_all_pairs_do(spark):
    r = random.Random(5)
    boiler = [f"b{i}" for i in range(60)]
    texts = {i: " ".join(boiler[: r.randint(40, 60)] + [f"u{i % 9}x{k}" for k in range(r.randint(0, 16))]) for i in range(60)}
    import zstandard

    z = spark.createDataFrame([(i, bytearray(zstandard.compress(t.encode()))) for i, t in texts.items()], "doc_id long, m_z binary")
    of = spark.createDataFrame([(i, i) for i in texts], "doc_id long, m_comp long")
    got = {tuple(x) for x in minhash._prefixes(z, of, 75, Scratch(spark, "test")).collect()}
    s = {i: shingles(t) for i, t in texts.items()}
    want = {(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])}
    assert want and want <= got and len(got) < 60 * 59 / 2


def test_prefix_filter_over_sets_of_many_sizes(spark):
    import zstandard

    r = random.Random(6)
    boiler = [f"b{i}" for i in range(400)]
    texts = {i: " ".join(boiler[r.randint(0, 60) : r.randint(70, 400)] + [f"u{r.randint(0, 30)}x{k}" for k in range(r.randint(0, 40))]) for i in range(70)} | {1000 + i: " ".join(f"s{k}" for k in range(5 + i % 3)) for i in range(6)}
    z = spark.createDataFrame([(i, bytearray(zstandard.compress(t.encode()))) for i, t in texts.items()], "doc_id long, m_z binary")
    of = spark.createDataFrame([(i, i) for i in texts], "doc_id long, m_comp long")
    for percent in (50, 75, 90):
        got = {tuple(x) for x in minhash._prefixes(z, of, percent, Scratch(spark, "test")).collect()}
        s = {i: shingles(t) for i, t in texts.items()}
        want = {(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])}
        assert want and want <= got


def test_estimate_is_corrected():
    a = [minhash.registers(minhash.shingle_set(" ".join(f"w{k}" for k in range(s, s + 500)))) for s in (0, 60)]
    n = np.array([496.0])
    assert abs(minhash.estimate(a[0][None], a[1][None], n, n)[0] - 436 / 556) < 0.2
    assert 0 < minhash.collision(n, n)[0] < 1e-3


def test_components(spark):
    r = random.Random(1)
    e = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(e, "u long, v long"), Scratch(spark, "test")).collect()))
    import itertools

    p = {x: x for x in itertools.chain(*e)}
    for _ in range(300):
        for a, b in e:
            p[a] = p[b] = min(p[a], p[b])
    assert all(got.get(x, x) == p[x] for x in p)


def _cut(texts, window=400, passage=200):
    data = [(t or "").encode() for t in texts]

    def gone(w):
        at = collections.Counter(d[k : k + w] for d in data for k in range(len(d) - w + 1))
        out = []
        for d in data:
            g = bytearray(len(d))
            for k in range(len(d) - w + 1):
                if at[d[k : k + w]] > 1:
                    g[k : k + w] = b"\1" * w
            out.append(bytes(g))
        return out

    out = []
    for d, g, p in zip(data, gone(window), gone(passage)):
        out.append((len(d), sum(g), len(re.findall(rb"\x01+", g)), hashlib.sha256(bytes(x for x, y in zip(d, g) if not y)).hexdigest(), sum(p)))
    return out


def test_repeats(docs, none, spark, monkeypatch):
    want = collections.Counter((r[0], *w) for r, w in zip(ROWS, _cut([r[1] for r in ROWS])))
    assert any(w[2] for w in want) and any(w[2] < w[5] for w in want)
    assert collections.Counter(map(tuple, suffix.remove_repeats(docs).collect())) == want
    monkeypatch.setattr(suffix, "HOT", 1)  # the distributed count of windows gives the same
    assert collections.Counter(map(tuple, suffix.remove_repeats(docs).collect())) == want
    monkeypatch.setattr(suffix, "HOT", 1000)
    monkeypatch.setattr(suffix, "BATCH", 2)  # many batches, anchors with a batch of their own
    assert collections.Counter(map(tuple, suffix.remove_repeats(docs).collect())) == want
    assert suffix.remove_repeats(none).count() == 0
    rows = suffix.without_repeats(docs)
    assert rows.columns == docs.columns and rows.count() == len(ROWS)
    assert [r[0] for r in suffix.without_repeats(none).collect()] == []


def _passages(n=40):
    """Documents that share passages of 51 to 80 words in pairs, and documents that share nothing."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.choice((1, 2, 3, 4, 5, 6, 8, 11))))
    line = lambda k: " ".join(word() for _ in range(k))
    rows, planted = [], {}
    for k in range(n):
        p = line(51 + k % 30)
        for i in (3 * k, 3 * k + 1):
            before, after = line(r.randint(0, 60)), line(r.randint(0, 60))
            rows.append((i, f"{before} {p} {after}"))
            planted[i] = (before, after)
        rows.append((3 * k + 2, line(r.randint(40, 120)) + " This work is licensed under the terms of a general public license."))
    return rows, planted


def test_passages_of_over_fifty_words(spark):
    rows, planted = _passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in suffix.without_repeats(docs, window=200).collect()}
    for i, text in rows:
        if i in planted:
            assert [x.strip() for x in planted[i]] == [planted[i][0], planted[i][1]] and len(got[i]) <= sum(map(len, planted[i])) + 2
        else:
            assert got[i] == text
    found = {r["doc_id"]: r["n_passage_bytes"] for r in suffix.remove_repeats(docs).collect()}
    assert {i for i, n in found.items() if n} == set(planted)


def test_repeats_of_many_copies(spark):
    """Ten thousand rows of one long text under one id, other ids and none, and one near copy."""
    r = random.Random(9)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(700))
    near = "changed" + text[7:]
    rows = [(i if i % 4 == 1 else 5 if i % 2 else None, text) for i in range(10_000)] + [(1 << 40, near), (2, "short"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    n, none = len(text), hashlib.sha256(b"").hexdigest()
    out = suffix.remove_repeats(docs).groupBy("n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    got = {tuple(x)[:4]: x[4] for x in out}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(n, n, 1, none): 10_000, (n, n - 7, 1, digest(b"changed")): 1, (5, 0, 0, digest(b"short")): 1, (0, 0, 0, none): 1}


def test_repeats_of_a_very_long_text(spark, monkeypatch):
    r = random.Random(10)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(300_000))
    long = long[:200_000] + long[50_000:51_000] + long[200_000:]
    docs = spark.createDataFrame([(1, long), (2, "x" + long[100_000:100_450])], "doc_id long, text string")
    got = {x["doc_id"]: x for x in suffix.remove_repeats(docs).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"]) == (2000 + 450, 3, 450)


def test_anchor_chunks(monkeypatch):
    r = random.Random(2)
    data = bytes(r.choice(b"ab") for _ in range(5000)) * 2
    whole = suffix.anchors(data)
    monkeypatch.setattr(suffix, "CHUNK", 700)
    for a, b in zip(whole, suffix.anchors(data)):
        assert np.array_equal(a, b)
    gaps = np.diff(np.concatenate([[-1], whole[0], [len(data) - 99]]))
    assert gaps.max() <= 101


def test_bwt_against_counts():
    r = np.random.default_rng(1)
    text = lambda n: bytes(r.integers(0, 2, r.integers(0, n + 1)).astype(np.uint8))
    for _ in range(150):
        m, side = int(r.integers(0, 14)), int(r.integers(1, 6))
        least = [int(x) for x in r.integers(side, 9, 2)]
        g, left, right = r.integers(0, 3, m), [text(side) for _ in range(m)], [text(max(least)) for _ in range(m)]
        got = bwt.repeated_windows(g, left, right, side, least, memory=int(r.integers(0, 2)) * 1000)
        for n, hit in zip(least, got):
            w = {(d, i): (g[i], d, left[i][len(left[i]) - d :], right[i][: n - d]) for i in range(m) for d in range(side + 1) if d <= len(left[i]) and n - d <= len(right[i])}
            c = collections.Counter(w.values())
            assert all(hit[d, i] == ((d, i) in w and c[w[d, i]] > 1) for i in range(m) for d in range(side + 1))


def _ids(texts):
    t = tokens.load(tokens.tokenizer_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts(docs, none):
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(i), len(i) > 100) for r, i in zip(ROWS, _ids([r[1] for r in ROWS])))
    assert collections.Counter(map(tuple, tokens.token_counts(docs, limit=100).collect())) == want
    assert tokens.token_counts(none).count() == 0


def test_chunks_encode_as_the_library_does():
    r = random.Random(1)
    al = "aAbzéÉßæŒİıſ ²½ªº  \t\n\r\x0b\x0c'`s.<|>0123,;-_😀漢字é̀\x01\x1c\x85 Σς"
    texts = ["".join(r.choice(al) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a<|endoftext|>b <|startoftext|>", "don't I'LL can't'S"]
    path = tokens.tokenizer_path()
    ids, counts = tokens.IdCache(path), tokens.CountCache(path, tokens.proven_whole_tokens(path))
    want = _ids(texts)
    import pyarrow as pa

    assert [np.frombuffer(b, "<u4").tolist() for b in ids.encode_all(pa.array(texts))] == want
    assert ids.encode_all(pa.array([], pa.string())) == [] and ids.encode_all(pa.array(["", " \n"])) == [b"", b""]
    part = pa.array(["skipped words", "one two", "", "three"]).slice(1)
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.encode_all(part)] == _ids(["one two", "", "three"])
    assert counts.count_all(texts) == [len(w) for w in want]


def test_packing(docs, none):
    want = collections.Counter((r[0], tuple(i) + (1,)) for r, i in zip(ROWS, _ids([r[1] for r in ROWS])))
    got = packing.pack(docs, capacity=64, batch_tokens=3000).collect()
    seqs = collections.defaultdict(list)
    for p in got:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    assert sum(p["length"] for p in got) == sum(len(i) * c for (_, i), c in want.items()) >= 0.95 * 64 * len(seqs)
    crc = {(d, s, n): zlib.crc32(np.array(i, "<u4")[s : s + n].tobytes()) for (d, i) in want for s in range(len(i)) for n in {p["length"] for p in got if p["doc_id"] == d and p["start"] == s}}
    assert all(p["ids_crc32"] == crc[p["doc_id"], p["start"], p["length"]] for p in got if p["doc_id"] is not None)
    assert packing.pack(none).count() == 0
    costs = collections.Counter()
    for i, s, n, q, o in packing.place([9, 8, 7, 6, 5, 4], 64, 1.0, 0.1):
        costs[q] += n
    assert sum(costs.values()) == 39 and len(costs) == 1


def test_packing_takes_the_cheapest_sequence_of_all_that_have_room():
    r = random.Random(11)
    for _ in range(30):
        capacity = r.choice((16, 50, 64))
        lengths = [r.randint(0, 2 * capacity) for _ in range(r.randint(0, 60))]
        got = packing.place(lengths, capacity, 1.0, 0.01)
        at, cost = collections.Counter(), collections.Counter()
        open_ = -(-sum(n % capacity for n in lengths) // capacity)
        first = sum(n // capacity for n in lengths)
        for i, start, n, seq, offset in got:
            assert offset == at[seq] and offset + n <= capacity
            if n < capacity and seq >= first:
                left = lengths[i] - start
                room = [s for s in range(first, first + open_) if capacity - at[s] >= left] or [s for s in range(first, first + open_) if at[s] < capacity]
                assert seq == min(room, key=lambda s: (cost[s], s)) and n == min(left, capacity - at[seq])  # cut only where no sequence holds it
                cost[seq] += n + 0.01 * n * n
            at[seq] += n
        pieces = collections.defaultdict(list)
        for i, start, n, *_ in got:
            pieces[i].append((start, n))
        for i, n in enumerate(lengths):
            assert [x for s, k in sorted(pieces[i]) for x in range(s, s + k)] == list(range(n))


def test_decontamination(docs, none, spark):
    items = [(1, TEXTS[11]), (2, " ".join(TEXTS[15].split()[:40])), (3, "one"), (4, ""), (5, None), (6, "not in any document at all"), (2, " ".join(TEXTS[15].split()[:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t, *_ in ROWS:
        for i, x in items:
            s = shingles(x)
            n = len(s & shingles(t))
            if s and n >= 0.75 * len(s):
                want.add((d, i, len(s), n))
    got = [tuple(r)[:4] for r in decontaminate.contaminated(docs, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    bad = {w[0] for w in want}
    assert {r[0] for r in decontaminate.clean(docs, bench).collect() if r[0] is not None} == {r[0] for r in ROWS if r[0] is not None} - bad
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def _base(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    rep = len({x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 8)})
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, rep, len(w) < 20 or 100 * rep > 30 * len(w)


def test_quality(docs, none, spark):
    got = collections.Counter(tuple(r)[:7] for r in quality.quality(docs).collect())
    assert got == collections.Counter((r[0], *_base(r[1])) for r in ROWS)
    assert all(not r["kept"] for r in quality.quality(docs).where("base_failed").collect())
    assert quality.quality(none).count() == 0
    text = "a#|\n\nb\n b\nb\n" + "w w w w w w w w w " * 3
    assert tuple(quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first())[1:7] == _base(text)
    assert quality.fit([])[1] == [[]] and abs(sum(quality.fit([((-1, 0), 10), ((0, 1), 90), ((0, 0), 20)])[0]) - 1) < 1e-9


def _prose(r, n, comma=True):
    words = [r.choice("bcdfgklmnprst") + r.choice("aeiou") + "".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 5))) for _ in range(n)]
    out = []
    for k, w in enumerate(words):
        out.append(w.capitalize() if k % 9 == 0 else w + "." if k % 9 == 8 else w + "," if comma and k % 9 == 4 else w)
    return " ".join(out)


def test_a_lone_weak_fault_is_outvoted_and_agreeing_faults_are_not(spark):
    r = random.Random(12)
    good = [(i, _prose(r, r.randint(60, 200))) for i in range(400)]
    bare = [(1000 + i, _prose(r, r.randint(60, 200), comma=False)) for i in range(12)]  # one rule votes low
    junk = [(2000 + i, " ".join(w + r.choice("#$%&") * 3 for w in _prose(r, 120).split())) for i in range(30)]  # several rules do, of one kind
    loud = [(3000 + i, " ".join(w.upper() + "!!" for w in _prose(r, 120).split())) for i in range(30)]
    docs = spark.createDataFrame(good + bare + junk + loud, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in quality.quality(docs).collect()}
    assert all(got[i]["kept"] and got[i]["n_low_votes"] == 1 for i, _ in bare) and all(got[i]["n_low_votes"] > 1 for i, _ in junk + loud)
    assert sum(got[i]["kept"] for i, _ in good) >= 396 and not any(got[i]["kept"] for i, _ in junk + loud)
    differ = [x for x in got.values() if not x["base_failed"] and x["kept"] != (x["n_low_votes"] == 0)]
    assert len(differ) >= len(bare)  # verdicts that all-must-pass filtering would not give


def test_sharding(docs, none):
    got = sharding.shard(docs, block_rows=10).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(by[s]) for s in range(16)} <= {len(ROWS) // 16, len(ROWS) // 16 + 1}
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.shard(docs.repartition(5), block_rows=10).collect()), key=str)
    assert sharding.shard(none).count() == 0
    m = sharding.draw_matrix([5, 0, 9, 2], [6, 5, 5], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9, 2] and m.sum(axis=0).tolist() == [6, 5, 5] and (m >= 0).all()


def test_sharding_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 100)
    rows = [(1, "same")] * 5000 + [(i, f"t{i}") for i in range(300)] + [(None, None)] * 250
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_rows=200, least_blocks=4).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == 5550 and all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {346, 347}
    copies = collections.Counter(r["shard"] for r in got if r["doc_id"] == 1)
    assert min(copies.values()) > 250 and len(copies) == 16


def test_draws_beyond_the_range_of_numpy(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(1))
    big = [sharding.draw(rng, 3_000_000_000, 9_000_000_000, 10_000) for _ in range(400)]
    assert abs(np.mean(big) - 2500) < 12 and abs(np.std(big) - np.sqrt(10_000 * 0.25 * 0.75)) < 6
    monkeypatch.setattr(sharding, "LARGE", 1)  # the same law as numpy's where both can draw
    own = [sharding.draw(rng, 40, 60, 30) for _ in range(4000)]
    theirs = rng.hypergeometric(40, 60, 30, 4000)
    assert abs(np.mean(own) - theirs.mean()) < 0.2 and abs(np.std(own) - theirs.std()) < 0.2 and 0 <= min(own) and max(own) <= 30
    assert [sharding.draw(rng, g, b, n) for g, b, n in ((0, 5, 3), (5, 0, 3), (5, 5, 0), (3, 2, 5))] == [0, 3, 0, 3]


def test_urls(spark):
    rows = ["https://a.Example.NET/en/x?q=1", "http://example.net/fr/", "https://b.example.org/fr/1", "https://example.org/de/", "ftp://x.example.com/de/1#f", "http://notexample.com/de/", None, "no scheme", "http://net", "x://org/fr/"]
    p = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(rows)] * 30 + [(None, None, None, None)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in urls.judge(p).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(10)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/fr/", "net/"), ("b.example.org", "/fr/1", "org/fr/"), ("example.org", "/de/", None), ("x.example.com", "/de/1", "example.com/de/"),
        ("notexample.com", "/de/", None), ("", "", None), ("", "", None), ("net", "", None), ("org", "/fr/", "org/fr/"),
    ]
    assert [got[i]["verdict"] for i in (0, 1, 2, 4)] == ["allow", "block", "allow", "block"] and {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert urls.judge(p).count() == 301 and urls.judge(p.limit(0)).count() == 0
    x = np.array([[float(i % 7), float(i)] for i in range(400)])
    base, trees = urls.boost(["a", "b"], x, (x[:, 0] > 3).astype(float))
    assert (((base + sum(t.predict(["a", "b"], x) for t in trees)) > 0) == (x[:, 0] > 3)).mean() > 0.99


def test_trees_score_alike_as_columns_and_in_numpy(spark):
    r = np.random.default_rng(3)
    urls_ = [None, "", "x", "https://" + "a." * 3000 + "org/" + "p/" * 5000 + "?" + "k=v&" * 4000] + [f"{p}://{h}.{t}/{'d/' * int(k)}p{int(k) * 37}?a={k}{'&b=1' * int(k % 3)}{'#f' * int(k % 2)}" for k, p, h, t in zip(range(300), r.choice(["http", "https"], 300), r.choice(["a-b", "shop24", "news"], 300), r.choice(["org", "net", "com", "example.com"], 300))]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls_)], "page_id long, u_url string")
    host, path = urls.host_and_path(F.col("u_url"))
    df = df.withColumn("host", host).withColumn("path", path)
    cols = urls.features(F.col("u_url"), F.col("host"), F.col("path"), {"suffix": {"": 0.5, "org": 0.2, "com": 0.8}, "section": {"d": 0.7}})
    df = df.select("page_id", *[c.alias(k) for k, c in cols.items()])
    rows = df.orderBy("page_id").collect()
    x = np.array([[row[k] for k in cols] for row in rows], dtype=float)
    y = (x[:, [*cols].index("depth")] > 3).astype(float)
    base, trees = urls.boost([*cols], x, y, trees=8)
    want = base + sum(t.predict([*cols], x) for t in trees)
    total = F.lit(base)
    for t in trees:
        total = total + t.column({k: F.col(k) for k in cols})
    got = [row[0] for row in df.orderBy("page_id").select(total).collect()]
    assert np.allclose(got, want) and len({round(v, 6) for v in got}) > 1
    long = x[3]
    assert long[[*cols].index("length")] == len(urls_[3]) and long[[*cols].index("parameters")] == 4001 and long[[*cols].index("depth")] == 5001


def test_trees_judge_labelled_urls_that_they_were_not_trained_on():
    pages = "/root/testdata/sf0.01/pages.parquet"
    import duckdb

    def parts(u):
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u).groups()
        return host.lower(), path

    rows = []
    for (u,) in duckdb.sql(f"SELECT DISTINCT url FROM '{pages}' WHERE contains(url, '://') ORDER BY 1").fetchall():
        host, path = parts(u)
        fits = [(len(h + p), v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            ends = {"suffix": host.split(".")[-1], "section": (re.match(r"/([^/]*)/", path) or [None, ""])[1]}
            rows.append((ends, float(max(fits)[1] == "block"), len(u), path.count("/"), sum(c.isdigit() for c in u) / len(u)))
    train, held = rows[::2], rows[1::2]
    shares = urls.shares_of([r[:2] for r in train], least=5)
    table = lambda rs: np.array([[*r[2:], *(shares[k].get(r[0][k], shares[k][""]) for k in ("suffix", "section"))] for r in rs])
    names = ["length", "depth", "digits", "suffix", "section"]
    base, trees = urls.boost(names, table(train), np.array([r[1] for r in train]), least=3)
    right = np.mean([(s > 0) == (r[1] > 0) for s, r in zip(base + sum(t.predict(names, table(held)) for t in trees), held)])
    assert len(held) > 40 and right > 0.9


def test_matching_is_that_of_a_naive_search():
    r = random.Random(14)
    for _ in range(300):
        words = ["".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 12))]
        body = " " + " ".join(words) + " " if words else " "
        lexicon = {t: r.choice((1.0, 2.5, 3.0)) for t in {r.choice((" {} ", " {}")).format("".join(r.choice("ab") for _ in range(r.randint(2, 4)))) for _ in range(5)}}
        exceptions = [f" {r.choice(words)} {r.choice(words)} " for _ in range(2)] if words else []
        spared = [(k, k + len(e) - 1) for e in exceptions if e not in lexicon for k in range(len(body)) if body.startswith(e, k)]
        best = {}
        for k in range(len(body)):
            for t, w in lexicon.items():
                if body.startswith(t, k) and not any(a <= k < b for a, b in spared):
                    best[k] = max(w, best.get(k, 0.0))
        total, n = toxicity.hits(toxicity._machine(lexicon, exceptions), body)
        assert n == len(best) and abs(total - sum(best.values())) < 1e-9


def test_toxicity_scores_are_those_of_the_model(spark):
    r = random.Random(16)
    w = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    text = lambda i: " ".join(r.choice(w) for _ in range(50)) + (" vile rotten " if i % 4 == 0 else "")
    rows = [(i, text(i), "clash", 0.5) for i in range(300)] + [(5, text(0), None, None), (1000, text(4) + " filler" * 50_000, "", 1.0), (None, text(8), "", 1.0), (1001, None, "", None), (1002, "  \n", "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert any("vile" in t for t in model["lexicon"])
    got = collections.Counter((x["doc_id"], x["score"]) for x in toxicity.score(docs, labels).collect())
    import math

    want = collections.Counter()
    for i, t, *_ in rows:
        body = toxicity.folded(t)
        found = {}
        for k in range(len(body)):
            for term, weight in model["lexicon"].items():
                if body.startswith(term, k):
                    found[k] = max(weight, found.get(k, 0.0))
        for e in model["exceptions"]:
            for k in range(len(body)):
                if body.startswith(e, k):
                    found = {p: v for p, v in found.items() if not k <= p < k + len(e) - 1}
        z = (sum(found.values()) / math.sqrt(max(25, body.count(" ") - 1)) - model["cut"]) / model["scale"] + math.log(0.3 / 0.7)
        want[i, round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 9) if found else 0.0] += 1
    assert got == want


def test_toxicity(spark, none):
    r = random.Random(4)
    w = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    clean = lambda: " ".join(r.choice(w) for _ in range(60))
    rows = [(i, clean() + (" villainy badness " if i % 4 == 0 else ""), 1 if i % 4 == 0 else 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "v1ll\u0430iny " + clean()), (None, None), (1001, ""), (1002, clean())], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(docs, labels).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert all(got[i]["held_out"] and got[i]["predicted"] == y for i, _, y in held) and len(held) > 50
    assert got[1000]["score"] > 0 and got[None]["score"] == got[1001]["score"] == 0 and got[1002]["predicted"] == 0
    assert toxicity.without_toxic(docs, labels).count() < docs.count()
    assert toxicity.score(none, labels).count() == 0 and toxicity.score(docs, labels.limit(0)).where("score > 0").count() == 0
    assert toxicity.folded("1D10T, 2024 Caf\u00e9!") == " idiot 2024 cafe "


CAT = "the cat sat on a mat "


def test_lm_prefers_the_order_it_has_seen(spark, none):
    r = random.Random(6)
    docs = [(i, CAT * 8, "clash") for i in range(150)] + [(1000, "mat a on sat cat the " * 8, None), (1001, None, "x"), (None, "odd", ""), (1002, " ".join(r.sample((CAT * 8).split(), 48)), ""), (1003, "", ""), (5, CAT * 8, ""), (1004, CAT * 20_000, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, n_tokens string").repartition(4)
    rows = lm.score(docs).collect()
    got = {x["doc_id"]: x for x in rows}
    assert len(rows) == 157 and len({x["sum_logprob"] for x in rows if x["doc_id"] == 5}) == 1
    assert got[0]["mean_logprob"] > got[1000]["mean_logprob"] + 0.2 and got[0]["mean_logprob"] > got[1002]["mean_logprob"]
    assert all((got[i]["n_tokens"], got[i]["sum_logprob"], got[i]["mean_logprob"]) == (0, 0.0, None) for i in (1001, 1003)) and got[None]["n_tokens"] == 1
    assert got[1004]["n_tokens"] == 120_000 and abs(got[1004]["mean_logprob"] - got[0]["mean_logprob"]) < 0.3
    assert lm.score(none).count() == 0


def test_lm_beats_unigrams_on_documents_it_has_not_seen(spark):
    r = random.Random(7)
    words = [f"{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    after = {w: r.sample(words, 3) for w in words}

    def text():
        out = [r.choice(words)]
        while len(out) < 120:
            out.append(r.choice(after[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string").repartition(2)
    coded, model = lm.fitted(docs, Scratch(spark, "test"), passes=6)
    start = {x["doc_id"]: np.frombuffer(x["l_s"], np.int16) for x in coded.collect()}
    count = np.ones(lm.SYMBOLS)
    for s in start.values():
        np.add.at(count, s, 1)
    share = np.log(count / count.sum())
    of = dict(zip((w for d in docs.collect() for w in d["text"].split()), (x for d in docs.collect() for x in start[d["doc_id"]])))
    held = [np.array([of[w] for w in text().split()], np.int16) for _ in range(50)]
    n = sum(map(len, held))
    assert lm.log_probabilities(model, held).sum() / n > sum(share[h].sum() for h in held) / n + 0.2


def test_lm_probabilities_of_all_words_add_up_to_one():
    r = np.random.default_rng(0)
    p = lm.initial(1, np.full(lm.SYMBOLS, 1 / lm.SYMBOLS))
    p = lm.train(p, [r.integers(0, lm.SYMBOLS, 300).astype(np.int16)])
    x = r.integers(0, lm.SYMBOLS, 9).astype(np.int16)
    alone = []
    for s in range(lm.SYMBOLS):  # the middle word varies; the others keep their own factors, each with its window
        alone.append(np.concatenate([x[:4], [s], x[5:]]).astype(np.int16))
    total = 0.0
    for d in alone:
        q = np.concatenate([np.full(4, lm.PAD), d, np.full(4, lm.PAD)])
        h = np.tanh(sum(p["E"][q[4 + 4 + o - 4]] @ p["W"][o] for o in range(lm.SPAN) if o != lm.SIDE) + p["b"])
        z, k = h @ p["C"] + p["c"], d[4] // lm.MEMBERS
        y = h @ p["V"][k] + p["v"][k]
        total += np.exp(z[k] - np.log(np.exp(z).sum()) + y[d[4] % lm.MEMBERS] - np.log(np.exp(y).sum()))
    assert abs(total - 1) < 1e-4


def test_lm_remembers_what_the_rest_of_the_corpus_says(spark):
    import xxhash

    r = random.Random(31)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 250))) for _ in range(60)]
    once = [" ".join(f"u{i}x{k}" for k in range(300)) for i in range(10)]
    rows = [(i, t) for i, t in enumerate(texts + once)] + [(100 + k, once[k]) for k in range(5)] + [(200, "a b"), (201, "  "), (202, None), (None, " x ".join(once[9].split()[:2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in lm.score(docs).collect()}
    held = collections.defaultdict(lambda: (0, 0))
    two, three, each = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for i, t in rows:
        ws = (t or "").split()
        place, *_ = lm.contexts(np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in ws], np.uint64), np.zeros(len(ws)))
        for k in place:
            c = ws[k - 1], ws[k + 1]
            two[c] += 1
            three[c, ws[k]] += 1
            each[i].append((k, c, ws[k]))
    for i, found in each.items():
        held[i] = len(found), sum(three[c, w] > 1 for _, c, w in found)
    assert {i: (x["n_contexts"], x["n_remembered"]) for i, x in got.items()} == {i: held[i] for i, _ in rows}
    assert 60 < sum(n for n, _ in held.values()) and all(got[60 + k]["n_remembered"] == got[60 + k]["n_contexts"] > 5 for k in range(5)) and not any(got[60 + k]["n_remembered"] for k in range(5, 9))
    # documents that occur twice score apart, and each score is the network's with the remembered shares mixed in
    assert min(got[60 + k]["mean_logprob"] for k in range(5)) > max(got[60 + k]["mean_logprob"] for k in range(5, 9)) + 0.1
    coded, model = lm.fitted(docs, Scratch(spark, "test"))
    for x in coded.collect():
        s = np.frombuffer(x["l_s"], np.int16)
        total = lm.log_probabilities(model, [s])[0] + x["l_share"]
        log, _ = lm.token_log_probabilities(model, [s])
        own = dict(zip(x["l_at"], x["l_own"]))
        for k, c, w in each[x["doc_id"]]:
            if two[c] > 1:
                p = np.exp(log[k] + own[k])
                total += np.log(0.7 * p + 0.3 * (three[c, w] - 1) / (two[c] - 1)) - np.log(p)
        assert abs(total - got[x["doc_id"]]["sum_logprob"]) < 1e-2 + 1e-4 * abs(total), x["doc_id"]


def test_lm_counts_every_context(spark, monkeypatch):
    monkeypatch.setattr(lm, "RANGE", 50)  # many ranges
    r = random.Random(32)
    pairs = [f"left{i} word{i} right{i}" for i in range(200)]
    hot = [" ".join(["a"] * 400), " ".join(f"a n{i} a" for i in range(300))]
    rows = [(i, t) for i, t in enumerate(pairs + pairs + hot + [" ".join(r.choices("a b c d".split(), k=r.randint(0, 90))) for _ in range(60)] + ["", "a", "a b", None])]
    got = {x["doc_id"]: x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert all((got[i]["n_contexts"], got[i]["n_remembered"]) == (1, 1) for i in range(400))
    three = collections.Counter(x for _, t in rows for ws in [(t or "").split()] for x in zip(ws, ws[1:], ws[2:]))
    for i, t in rows:
        held = [*zip(ws := (t or "").split(), ws[1:], ws[2:])]
        assert (got[i]["n_contexts"], got[i]["n_remembered"]) == (len(held), sum(three[x] > 1 for x in held))


def test_lm_packs_and_groups_numbers():
    r = np.random.default_rng(3)
    for h in (np.zeros(0, np.uint64), np.array([5, 3, 5, 3, 4], np.uint64), r.integers(0, 300, 1000, np.uint64) << np.uint64(50)):
        assert (lm.unpacked(lm.packed(h), len(h), np.uint64) == h).all()
        if len(h):
            o, group = lm.grouped(h)
            assert (h[o] == np.sort(h)).all() and (group == np.unique(h[o], return_inverse=True)[1]).all()


def _loss(p, docs):
    return -lm.log_probabilities(p, docs).sum() / sum(map(len, docs))


def test_lm_scores_and_gradients_are_those_of_the_network():
    r = np.random.default_rng(0)
    p = lm.initial(1, np.full(lm.SYMBOLS, 1 / lm.SYMBOLS))
    docs = [r.integers(0, lm.SYMBOLS, n).astype(np.int16) for n in (5, 0, 30, 90)]
    got = lm.log_probabilities(p, docs, block=7)
    for d, g in zip(docs, got):
        x = np.concatenate([np.full(4, lm.PAD), d, np.full(4, lm.PAD)])
        total = 0.0
        for i in range(len(d)):
            h = np.tanh(sum(p["E"][x[i + o]] @ p["W"][o] for o in range(lm.SPAN)) + p["b"])
            z, k = h @ p["C"] + p["c"], d[i] // lm.MEMBERS
            y = h @ p["V"][k] + p["v"][k]
            total += z[k] - np.log(np.exp(z).sum()) + y[d[i] % lm.MEMBERS] - np.log(np.exp(y).sum())
        assert abs(total - g) < 1e-2
    # one batch: an Adagrad step gives the gradient back, which differences of the loss confirm
    before, after = lm.flat(p).astype(float), lm.flat(lm.train(p, docs, rate=1.0)).astype(float)
    step = np.clip(before - after, -1 + 1e-9, 1 - 1e-9)
    gradient = step * np.sqrt(1e-3) / np.sqrt(1 - step * step)
    largest = np.argsort(-np.abs(gradient))
    for i in [*largest[:20], *largest[200:2000:300]]:
        up, down = before.copy(), before.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        slope = (_loss(lm.shaped(up), docs) - _loss(lm.shaped(down), docs)) / 2e-2
        assert abs(slope - gradient[i]) < 0.03 * abs(gradient[largest[0]]) + 0.02 * abs(slope)


def test_lm_words_of_a_bucket_share_it_whole(spark):
    times = lambda i: 3 if i % 3 == 0 else 1
    rows = [(0, "common " * 50)] + [(i, f"x{i}end " * times(i)) for i in range(1, 6000)]
    coded, _ = lm.fitted(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test"), vocabulary=2.0, rounds=0)
    by, seen = collections.defaultdict(float), set()
    for x in coded.where("doc_id > 0").collect():
        s = int(np.frombuffer(x["l_s"], np.int16)[0])
        if s >= lm.FREQUENT:
            by[s] += np.exp(x["l_share"] / times(x["doc_id"]))
            seen.add(round(x["l_share"] / times(x["doc_id"]), 6))
    assert by and all(abs(v - 1) < 1e-6 for v in by.values()) and len(seen) >= 2


def test_very_long_texts_in_every_operator(spark):
    """A text of a million characters, a near copy of it with a benchmark item inside, and a short one."""
    r = random.Random(30)
    words = ["".join(r.choice("abcdefghijé") for _ in range(r.randint(1, 9))) for _ in range(30_000)]
    many = r.choices(words, k=170_000)
    item = [f"item{i}" for i in range(40)]
    long, near = " ".join(many), " ".join([*many[:1000], *item, *many[1010:]])
    assert len(long) > 950_000
    rows = [(1, long), (2, near), (3, "short text")]
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "doc_id long, text string, n_tokens string, kept string")
    sets = {i: shingles(t) for i, t in rows}
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs).collect()}
    assert {i: x["n_shingles"] for i, x in got.items()} == {i: len(s) for i, s in sets.items()} and [got[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 3]
    ids = dict(zip((1, 2, 3), _ids([t for _, t in rows])))
    assert {x["doc_id"]: x["n_tokens"] for x in tokens.token_counts(docs).collect()} == {i: len(v) for i, v in ids.items()}
    held = collections.defaultdict(list)
    for p in packing.pack(docs).collect():
        assert zlib.crc32(np.array(ids[p["doc_id"]] + [1], "<u4")[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        held[p["doc_id"]] += [*range(p["start"], p["start"] + p["length"])]
    assert all(sorted(held[i]) == [*range(len(v) + 1)] for i, v in ids.items())
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [tuple(x)[:4] for x in decontaminate.contaminated(docs, bench).collect()] == [(2, 7, 36, 36)]
    assert {x["doc_id"]: tuple(x)[1:7] for x in quality.quality(docs).collect()} == {i: _base(t) for i, t in rows}
    assert {x["doc_id"]: x["size"] for x in sharding.shard(docs, least_blocks=2).collect()} == {i: len(t.encode()) + 1 for i, t in rows}
    at = near.encode().index(b"item0")
    gone = {x["doc_id"]: x["n_removed"] for x in suffix.remove_repeats(docs).collect()}
    assert gone[3] == 0 and gone[1] > 0.99 * len(long.encode()) and gone[2] == len(near.encode()) - len(" ".join(item).encode()) and at
