"""The pipeline's stages and their chain against brute force on a small table with nulls, empty and very long texts, ties, repeats and clashing columns."""

import collections
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from codeloom.llm import common, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstué") for _ in range(r.randint(2, 9))) for _ in range(900)]
    line = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, items = line(60), [line(20) for _ in range(4)]
    texts = [line(r.randint(30, 200)) for _ in range(60)]  # clean
    texts += [line(60) + " vile rotten scum " + line(20) for _ in range(40)]  # toxic
    texts += [texts[k] for k in (0, 0, 1)] + [texts[2] + " and one more", texts[3].upper()]  # copies, near copies
    texts += [f"{line(30)} {passage} {line(30)}" for _ in range(5)]  # a repeated passage
    texts += [f"{line(40)} {items[k % 4]} {line(40)}" for k in range(6)]  # benchmark items
    texts += [None, "", "  \n", "two words", line(15_000)]
    rows = [(i, t, r.choice(("en", None)), "hot" if i % 3 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, line(50), None, None, None), (None, None, None, None, None)]
    labels = [(i, 1, int(60 <= i < 100)) for i in range(100)] + [(None, 1, 1), (3, None, None)]
    return rows, [*enumerate(items), (9, None), (10, ""), (0, items[0])], labels


ROWS, ITEMS, LABELS = _rows()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('pipeline')}"
    spark.createDataFrame(ROWS, SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return at


def _set(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _toxicity(rows, spark, sf):
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    return [x for x in rows if toxicity.scores(model, [x[1]], 0.3)[0] < 0.3]


def _near(rows, *_):
    by = {x[0]: _set(x[1]) for x in rows if x[0] is not None}
    up = {i: i for i in by}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in by:
        for b in by:
            n = len(by[a] & by[b])
            if a < b and n and 100 * n >= 75 * len(by[a] | by[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    out, seen = [], set()
    for x in rows:
        if x[0] is None or (find(x[0]) == x[0] and x[0] not in seen):
            out.append(x)
            seen.add(x[0])
    return out


def _repeats(rows, *_, w=200):
    data = [(x[1] or "").encode() for x in rows]
    at = collections.Counter(d[k : k + w] for d in data for k in range(len(d) - w + 1))
    out = []
    for x, d in zip(rows, data):
        gone = bytearray(len(d))
        for k in range(len(d) - w + 1):
            if at[d[k : k + w]] > 1:
                gone[k : k + w] = b"\1" * w
        # a character stays unless all its bytes go
        text = "".join(c for c, b in _characters(x[1] or "") if not all(gone[b : b + len(c.encode())]))
        text = None if x[1] is None else text
        out.append((x[0], text, x[2], x[3], None if text is None else len(text)))
    return out


def _characters(text):
    at = 0
    for c in text:
        yield c, at
        at += len(c.encode())


def _decontamination(rows, *_):
    items = [s for s in (_set(t) for _, t in ITEMS) if s]
    return [x for x in rows if not any(len(s & _set(x[1])) >= 0.75 * len(s) for s in items)]


BRUTE = {"toxicity": _toxicity, "near_duplicates": _near, "repeated_passages": _repeats, "decontamination": _decontamination}


def _packed(rows):
    """(doc_id, its token ids) of every row, counted."""
    tok = tokens.load(tokens.tokenizer_path())
    return collections.Counter((x[0], tuple(tok.encode(x[1] or "", add_special_tokens=False).ids) + (1,)) for x in rows)


def _holds(pieces, rows):
    """The pieces cut the rows' tokens, each token once, into gapless sequences."""
    want = _packed(rows)
    known = collections.defaultdict(list)
    for (doc, ids), n in want.items():
        known[doc, len(ids)].append((ids, n))
    starts = collections.defaultdict(list)
    for p in pieces:
        starts[p["sequence_id"]].append((p["offset"], p["length"]))
        assert any(zlib.crc32(np.array(i, "<u4")[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for i, _ in known[p["doc_id"], p["doc_tokens"]])
    for v in starts.values():
        ends = np.cumsum([0] + [n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == ends[:-1].tolist() and ends[-1] <= 2048
    held = collections.Counter()
    for p in pieces:
        held[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert held == collections.Counter({k: k[1] * sum(n for _, n in v) for k, v in known.items()})


def test_each_stage_and_the_whole_chain(spark, sf):
    cols = [f.split()[0] for f in SCHEMA.split(", ")]
    scratch, docs, rows, sizes = common.Scratch(spark, "test"), spark.read.parquet(f"{sf}/documents.parquet"), list(ROWS), [len(ROWS)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf), name)
        rows = BRUTE[name](rows, spark, sf)
        assert docs.columns == cols
        assert collections.Counter(map(tuple, docs.collect())) == collections.Counter(rows), name
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 60  # every filter takes effect, and clean documents stay
    kept = {x[0]: x[1] for x in rows}
    assert all(kept[i] == ROWS[i][1] for i in range(60)) and not any(i in kept for i in range(60, 100))
    _holds(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), rows)
    _holds(corpus_pipeline.run(spark, sf).collect(), rows)
    scratch.release()


def test_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_other_columns_pass_whatever_their_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'a' AS s_k", "1 AS m_rep", "array(1) AS d_t", "named_struct('x', 2) AS s_text", "'z' AS t_score", "true AS kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.where("s_k <> 'a' or m_rep <> 1 or d_t[0] <> 1 or s_text.x <> 2 or t_score <> 'z' or not kept").count() == 0, name


def test_a_run_leaves_other_results_alone(spark, sf):
    from codeloom.llm import quality

    before = quality.quality(spark.read.parquet(f"{sf}/documents.parquet"))
    corpus_pipeline.run(spark, sf).count()
    assert before.count() == len(ROWS)
