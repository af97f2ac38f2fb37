"""Removal of every byte run that repeats elsewhere in the collection (``window`` bytes or longer; 400 by default).

A window repeats if it also starts anywhere else, in the same document or another. The collection's sorted suffixes with common prefixes
answer that, and they are built column by column (see ``bwt``): one symbol a string and round. A round a byte over whole documents
would take as many rounds as the longest has bytes, so the strings are first made short, without losing a repeat:

1. Texts are taken once each. A text that occurs twice has all its windows repeated, and one of its copies stands for all below, so
   a group of copies of any size is one row a task.
2. Anchors: strings of ``passage - 100`` bytes chosen by the least hash among 101 neighbours. Every window of ``passage`` bytes holds one, every longer window
   holds one that starts in its first 101 bytes, and equal windows hold it in the same place. Windows whose anchors occur once do not repeat.
3. Contexts (100 bytes before an anchor, ``window`` from its start) that occur twice, by 128 bits of hash, have all their windows repeated;
   one of them goes on. The contexts of a repeated anchor become strings of up to 100 bytes, the anchor and up to ``window - passage + 100`` bytes.
   Anchors are dealt to tasks in batches of a bounded number of strings, and the column-wise construction runs on each
   batch. Anchors are compared by 128 bits of a cryptographic hash, the bytes around them as they are.
4. An anchor with more than ``HOT`` different contexts would not fit a batch: the windows of its contexts are counted by
   a distributed aggregation of 128-bit hashes instead, with the same result.

Repeats of ``passage`` bytes or longer (200 by default, about 32 words) are found on the way and reported, not removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, PASSAGE = 400, 200
#: Bytes that a window can hold before its anchor.
SIDE = 100
HOT, BATCH, TASKS = 65_536, 16_000, 100_000
CHUNK = 1 << 20
_U = np.uint64
# Odd multipliers of the two rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
common.caches("suffix", _powers.clear)


def _power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, up to n."""
    if k not in _powers or len(_powers[k][0]) <= n:
        size = max(n + 1, 1 << 17)
        both = []
        for b in (_BASES[k], pow(_BASES[k], -1, 1 << 64)):
            p = np.full(size, _U(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[k] = (both[0], both[1])
    return _powers[k]


def _sums(a: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(a) + 1, _U)
    np.cumsum(a * _power(k, len(a))[0][: len(a)], out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over every run of w neighbours."""
    s = 1
    while 2 * s <= w:
        a = f(a[:-s], a[s:])
        s *= 2
    return f(a[: len(a) - (w - s)], a[w - s :]) if s < w else a


def anchors(data: bytes, window: int = WINDOW, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, anchor hash, context hash) of a text's anchors. Shorter texts than a passage have none. Memory is bounded by a chunk."""
    n, gram = len(data), passage - SIDE
    if n < passage:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    w, last = SIDE + 1, n - gram  # last place of an anchor
    found = []
    for lo in range(0, last + 1, CHUNK):
        hi = min(lo + CHUNK, last + 1)
        first, end = max(0, lo - SIDE), min(last + 1, hi + SIDE)  # places that share a passage with [lo, hi)
        byte0 = max(0, first - SIDE)
        a = np.frombuffer(data, np.uint8, min(n, end + window) - byte0, byte0).astype(_U) + _U(1)
        s = _sums(a, 0)
        place = np.arange(first - byte0, end - byte0)
        h = _mix((s[place[0] + gram : place[-1] + gram + 1] - s[place[0] : place[-1] + 1]) * _power(0, len(a))[1][place[0] : place[-1] + 1])
        low = _slide(h, w, np.minimum)
        edge = np.zeros(SIDE, _U)
        q = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), w, np.maximum) == h)
        q = q[(q + first >= lo) & (q + first < hi)]
        s = _sums(a, 1)
        at = q + first
        left, right = np.maximum(at - SIDE, 0), np.minimum(at + window, n)
        c = (s[right - byte0] - s[left - byte0]) * _power(1, len(a))[1][left - byte0]
        c = _mix(c ^ _mix(((at - left) * 100_000 + (right - at)).astype(_U)))
        found.append((at, h[q], c))
    return tuple(np.concatenate(x) for x in zip(*found))


def spans(windows: list[tuple[int, int]], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal byte runs [start, end) covered by windows that start in the given closed ranges."""
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + window)
        else:
            out.append([a, b + window])
    return [(a, b) for a, b in out]


def cut(data: bytes, runs: list[tuple[int, int]], whole: bool = False) -> bytes:
    """The bytes outside the runs. ``whole``: a character that is cut in part is kept, so that the rest stays UTF-8."""
    parts, at = [], 0
    for a, b in runs:
        if whole:
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _texts(docs: DataFrame, passage: int, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(packed: s_id, s_k, s_k2, s_n, s_sha, s_z of each row; texts: s_t, s_k, s_k2, s_n, s_twice, s_sha, s_z of each different text that holds a passage).

    Texts are told apart by 128 bits of hash and their length. They move packed (``s_z``) from here on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data, n = b.column("s_data").to_pylist(), b.column("s_n").to_pylist()
            sha = pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string())
            z = pa.array([pack.compress(d) if k >= passage else None for d, k in zip(data, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("s_id", "s_k", "s_k2", "s_n")], sha, z], ["s_id", "s_k", "s_k2", "s_n", "s_sha", "s_z"])

    t = docs.select(F.col("doc_id").cast("long").alias("s_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("s_text"))
    t = t.select("s_id", *_key("s_text"), F.col("s_text").cast("binary").alias("s_data"))
    packed = scratch.save(t.mapInArrow(common.worker("suffix", run), "s_id long, s_k long, s_k2 long, s_n long, s_sha string, s_z binary"), "packed")
    once = packed.where(F.col("s_n") >= passage).groupBy("s_k", "s_k2", "s_n").agg(F.first("s_z").alias("s_z"), F.first("s_sha").alias("s_sha"), F.count("*").alias("s_c"))
    texts = once.select(F.monotonically_increasing_id().alias("s_t"), "s_k", "s_k2", "s_n", (F.col("s_c") > 1).alias("s_twice"), "s_sha", "s_z")
    return packed, scratch.save(texts, "texts")


def _slices(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about ``most`` bytes of text, one row at least, with the unpacked texts."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    at = size = 0
    for i, n in enumerate([*b.column("s_n").to_pylist(), most + 1]):
        if i > at and size + n > most:
            part = b.slice(at, i - at)
            yield part, [unpack.decompress(z) for z in part.column("s_z").to_pylist()]
            at, size = i, 0
        size += n


def _key(text: str) -> list[Column]:
    c = F.col(text)
    return [F.xxhash64(c).alias("s_k"), F.xxhash64(F.lit(1), c).alias("s_k2"), F.octet_length(c).cast("long").alias("s_n")]


def _places(texts: DataFrame, counts: bool, window: int, passage: int) -> DataFrame:
    """Anchors of all texts: (s_h, s_c) counted within a slice, or (s_h, s_c, s_t, s_twice, s_q) one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.llm import suffix as m

        for b in batches:
            for part, data in m._slices(b):
                got = [m.anchors(d, window, passage) for d in data]
                sizes = np.array([len(g[0]) for g in got])
                h = np.concatenate([g[1] for g in got])
                if counts:
                    u, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["s_h", "s_c"])
                else:
                    row = pa.array(np.repeat(np.arange(len(got)), sizes))
                    c, q = np.concatenate([g[2] for g in got]), np.concatenate([g[0] for g in got])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), part.column("s_t").take(row), part.column("s_twice").take(row), pa.array(q.astype(np.int32))], ["s_h", "s_c", "s_t", "s_twice", "s_q"])

    return texts.select("s_t", "s_twice", "s_n", "s_z").mapInArrow(common.worker("suffix", run), "s_h long, s_c long" if counts else "s_h long, s_c long, s_t long, s_twice boolean, s_q int")


_CONTEXT = "s_t long, s_q int, s_h long, s_k long, s_left binary, s_right binary, s_gram binary"
_RANGES = "s_t long, s_a int, s_b int, s_kind int"


def _contexts_repeated(ctx: DataFrame, window: int, passage: int, scratch: common.Scratch) -> DataFrame:
    """(s_t, s_a, s_b, s_kind): ranges of window starts that repeat, for contexts of anchors that have several. Kind 0: ``window``, 1: ``passage``."""
    least = [window - passage + SIDE] if window == passage else [window - passage + SIDE, SIDE]  # symbols beside the anchor

    def build(table: pa.Table) -> pa.Table:
        from codeloom.llm import bwt, common

        common.enter("suffix")
        grams: dict[bytes, int] = {}
        group = np.array([grams.setdefault(g, len(grams)) for g in table.column("s_gram").to_pylist()])
        hits = bwt.repeated_windows(group, table.column("s_left").to_pylist(), table.column("s_right").to_pylist(), SIDE, least)
        q, parts = table.column("s_q").to_numpy(), []
        for kind, hit in enumerate(hits):
            edge = np.diff(np.pad(hit.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)  # runs of offsets, string by string
            (i, d1), (_, d2) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            parts.append((i, q[i] - (d2 - 1), q[i] - d1, np.full(len(i), kind)))
        i, a, b, kind = (np.concatenate(x) for x in zip(*parts))
        return pa.table([table.column("s_t").take(pa.array(i)), *[pa.array(x.astype(np.int32)) for x in (a, b, kind)]], names=["s_t", "s_a", "s_b", "s_kind"])

    cold = ctx.where(F.col("s_k") <= HOT)
    # A task for each batch, up to as many tasks as a driver can run; past that a task builds several, one after another. An
    # anchor that would fill half a batch has one of its own.
    n_batches = max(1, -(-cold.count() // BATCH))
    batch = F.when(F.col("s_k") > BATCH // 2, F.col("s_h")).otherwise(F.pmod(F.xxhash64("s_h"), F.lit(n_batches)))
    found = cold.withColumn("s_batch", batch).repartition(min(n_batches, TASKS), "s_batch").groupBy("s_batch").applyInArrow(build, _RANGES)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                left, right, g = (b.column(c)[i].as_py() for c in ("s_left", "s_right", "s_gram"))
                for kind, n in enumerate(least):
                    ds = range(max(0, n - len(right)), len(left) + 1)
                    key = [hashlib.blake2b(g + left[len(left) - d :] + b"|" + right[: n - d] + bytes([d, kind]), digest_size=16).digest() for d in ds]
                    row = pa.array(np.full(len(key), i))
                    at = pa.array(np.array([b.column("s_q")[i].as_py() - d for d in ds], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([b.column("s_t").take(row), at, pa.array(np.full(len(key), kind, np.int32)), pa.array(key, pa.binary())], ["s_t", "s_a", "s_kind", "s_w"])

    hot = ctx.where(F.col("s_k") > HOT)
    if hot.isEmpty():
        return found
    each = scratch.save(hot.mapInArrow(common.worker("suffix", windows), "s_t long, s_a int, s_kind int, s_w binary"), "windows")
    twice = each.groupBy("s_w").count().where("count > 1").drop("count")
    return found.union(each.join(twice, "s_w").select("s_t", "s_a", F.col("s_a").alias("s_b"), "s_kind"))


def _marked(texts: DataFrame, window: int, passage: int, scratch: common.Scratch) -> DataFrame:
    """(s_t, s_z, s_g): the packed text and the repeated ranges of every text, among those that occur once, that may hold a repeat."""
    twice = _places(texts, True, window, passage).groupBy("s_h").agg(F.sum("s_c").alias("s_c")).where("s_c > 1").select("s_h")
    # narrow rows; a frequent anchor is a skewed key of a plain join, which adaptive execution splits (only where no
    # aggregate stands between exchange and join, hence the tables)
    twice = scratch.save(twice, "twice")
    occ = scratch.save(_places(texts, False, window, passage).join(twice, "s_h"), "anchors")
    ctx = occ.groupBy("s_h", "s_c").agg(F.count("*").alias("s_c2"), F.min(F.struct("s_t", "s_q")).alias("s_rep"))
    ctx = scratch.save(ctx, "contexts")
    several = ctx.groupBy("s_h").agg(F.count("*").alias("s_k")).where("s_k > 1")
    several = scratch.save(several, "several")
    whole = occ.where(~F.col("s_twice")).join(ctx.where("s_c2 > 1").select("s_h", "s_c"), ["s_h", "s_c"])
    none = F.lit(None).cast("long")
    marks = whole.select("s_t", F.struct("s_q", none.alias("s_h"), none.alias("s_k")).alias("m"))
    need = ctx.join(several, "s_h").select("s_rep.s_t", F.struct(F.col("s_rep.s_q"), "s_h", "s_k").alias("m"))
    # what one text has, a bounded group
    marks = marks.union(need).groupBy("s_t").agg(F.collect_list("m").alias("s_m"))
    ranges = "s_g array<struct<a:int,b:int,kind:int>>"
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.int32())]))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text that occurs once, and a row for each context that has to be compared."""
        from codeloom.llm import suffix as m

        gram = passage - m.SIDE
        for b in batches:
            for part, texts_ in m._slices(b):
                known = []
                ctx: dict[str, list] = {n: [] for n in ("row", "s_q", "s_h", "s_k", "s_left", "s_right", "s_gram")}
                for i, (data, mark, again) in enumerate(zip(texts_, part.column("s_m").to_pylist(), part.column("s_twice").to_pylist())):
                    n, g = len(data), []
                    for x in mark:
                        q = x["s_q"]
                        if x["s_h"] is None:
                            g += [{"a": max(0, q - m.SIDE), "b": min(q, n - w), "kind": k} for k, w in enumerate((window, passage)) if n >= w and q - m.SIDE <= n - w]
                        else:
                            key = hashlib.blake2b(data[q : q + gram], digest_size=16).digest()
                            for c, v in zip(ctx.values(), (i, q, x["s_h"], x["s_k"], data[max(0, q - m.SIDE) : q], data[q + gram : q + window], key)):
                                c.append(v)
                    known.append(None if again else g)
                row = pa.array(ctx.pop("row"), pa.int64())
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                names = ["s_t", "s_z", "s_g", *ctx]
                packed = [None if g is None else z for z, g in zip(part.column("s_z").to_pylist(), known)]
                yield pa.RecordBatch.from_arrays([part.column("s_t"), pa.array(packed, pa.binary()), pa.array(known, kind), *[pa.nulls(part.num_rows, k) for k in kinds]], names)
                if len(row):
                    yield pa.RecordBatch.from_arrays([part.column("s_t").take(row), pa.nulls(len(row), pa.binary()), pa.nulls(len(row), kind), *[pa.array(v, k) for v, k in zip(ctx.values(), kinds)]], names)

    joined = texts.select("s_t", "s_twice", "s_n", "s_z").join(marks, "s_t")
    table = scratch.save(joined.mapInArrow(common.worker("suffix", first), f"s_t long, s_z binary, {ranges}, {_CONTEXT.split(', ', 1)[1]}"), "first")
    scratch.drop(occ, ctx, twice, several)
    got = _contexts_repeated(table.where("s_q is not null").drop("s_z", "s_g"), window, passage, scratch)
    got = scratch.save(got, "repeated").groupBy("s_t").agg(F.collect_list(F.struct(F.col("s_a").alias("a"), F.col("s_b").alias("b"), F.col("s_kind").alias("kind"))).alias("s_f"))
    done = table.where("s_z is not null").select("s_t", "s_z", "s_g").join(got, "s_t", "left")
    return done.select("s_t", "s_z", F.concat("s_g", F.coalesce("s_f", F.array().cast("array<struct<a:int,b:int,kind:int>>"))).alias("s_g"))


def _unpacked(b: pa.RecordBatch, window: int, passage: int) -> Iterator[tuple[bytes, list[tuple[int, int]], int]]:
    """(bytes, runs to remove, bytes in repeats of a passage) of each row."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for z, g in zip(b.column("s_z").to_pylist(), b.column("s_g").to_pylist()):
        runs = spans([(x["a"], x["b"]) for x in g if x["kind"] == 0], window)
        short = runs if window == passage else spans([(x["a"], x["b"]) for x in g if x["kind"]], passage)
        yield unpack.decompress(z), runs, sum(e - s for s, e in short)


def remove_repeats(docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes: a row for every row of ``docs``.

    Bytes covered by a ``window``-byte string that also starts elsewhere are removed; those covered by such a string of ``passage``
    bytes (from 101 to ``window``) are counted in ``n_passage_bytes``. Null texts count as empty; shorter texts than a passage hold no repeat; very long ones are
    read in chunks. Repeated rows, with one doc_id, others or null, repeat each other, so texts of ``window`` bytes or more in them go whole.
    An empty table gives no rows; names of other columns do not matter.
    """
    common.ship(docs.sparkSession)
    scratch = common.Scratch(docs.sparkSession, "suffix")
    packed, texts = _texts(docs, passage, scratch)
    rows = scratch.save(packed.drop("s_z"), "rows")  # narrow; the packed texts of all rows are not needed any more
    scratch.drop(packed)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.llm import suffix as m

        for b in batches:
            out = []
            for data, runs, n in m._unpacked(b, window, passage):
                kept = m.cut(data, runs)
                out.append((len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), n))
            cols = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("s_t"), *cols], ["s_t", "s_removed", "s_spans", "s_kept", "s_short"])

    found = _marked(texts, window, passage, scratch).mapInArrow(common.worker("suffix", last), "s_t long, s_removed long, s_spans long, s_kept string, s_short long")
    found = scratch.save(found, "found")
    all_ = F.col("s_twice") & (F.col("s_n") >= window)
    each = texts.drop("s_z").join(found, "s_t", "left").select(
        "s_k", "s_k2", "s_n", F.when(all_, F.col("s_n")).otherwise(F.coalesce("s_removed", F.lit(0))).alias("s_removed"), F.when(all_, 1).otherwise(F.coalesce("s_spans", F.lit(0))).alias("s_spans"),
        F.when(all_, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("s_kept", "s_sha")).alias("s_kept"), F.when(F.col("s_twice"), F.col("s_n")).otherwise(F.coalesce("s_short", F.lit(0))).alias("s_short"),
    )
    each = scratch.save(each, "each")
    # a text with many copies is a skewed key of a plain join of narrow rows: adaptive execution splits it
    out = rows.join(each, ["s_k", "s_k2", "s_n"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(F.col("s_id").alias("doc_id"), F.col("s_n").alias("n_bytes"), zero("s_removed").alias("n_removed"), zero("s_spans").alias("n_spans"), F.coalesce("s_kept", "s_sha").alias("kept_sha256"), zero("s_short").alias("n_passage_bytes"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with repeats of ``window`` bytes (from 101) cut from ``text``; characters that would be cut in part stay whole.

    No row goes: a text that repeats whole becomes empty, null texts stay null. Other columns stay as they are.
    """
    common.ship(docs.sparkSession)
    scratch = common.Scratch(docs.sparkSession, "suffix")
    packed, texts = _texts(docs, window, scratch)
    scratch.drop(packed)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.llm import suffix as m

        for b in batches:
            out = [m.cut(data, runs, whole=True).decode("utf-8", "replace") if runs else None for data, runs, _ in m._unpacked(b, window, window)]
            yield pa.RecordBatch.from_arrays([b.column("s_t"), pa.array(out, pa.string())], ["s_t", "s_cut"])

    found = _marked(texts, window, window, scratch).mapInArrow(common.worker("suffix", last), "s_t long, s_cut string").where("s_cut is not null")
    found = scratch.save(found, "found")
    changed = texts.drop("s_z").join(found, "s_t", "left").where("s_twice or s_cut is not null").select("s_k", "s_k2", "s_n", F.coalesce("s_cut", F.lit("")).alias("s_cut"))
    changed = scratch.save(changed, "changed")
    named = docs.select(*[F.col(f"`{c}`").alias(f"s_x{i}") for i, c in enumerate(docs.columns)])
    text = f"s_x{docs.columns.index('text')}"
    named = named.withColumn("s_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).select("*", *_key("s_text")).drop("s_text")
    out = named.join(changed, ["s_k", "s_k2", "s_n"], "left")
    return out.select(*[(F.coalesce("s_cut", F.col(text).cast("string")) if f"s_x{i}" == text else F.col(f"s_x{i}")).alias(c) for i, c in enumerate(docs.columns)])
