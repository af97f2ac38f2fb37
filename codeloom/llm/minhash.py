"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct five-word shingles, hashed to 64 bits. Each of 128 registers keeps, of the smallest value of its own
hash function over the set, the number of leading zeros (6 bits) and the next 10 bits. Four registers make a band; documents
that agree in a band are candidates. A candidate pair is estimated from its registers, with the expected number of chance
agreements taken off, and pairs that could reach the threshold are confirmed on their full sets.

Groups are never expanded into pairs:

1. Documents with equal sets form a class, kept by its smallest id; only class representatives go on.
2. In each band bucket every member is held against one centre, and confirmed pairs are joined into components.
3. Buckets whose members then all lie in one component are done. In the others, small buckets compare the members of different
   components. Documents of large ones go through an exact prefix filter instead (rare shingles first, with length
   and position bounds), so a common passage does not make all pairs, and no link is dropped.

A pair at the threshold of 0.75 shares no band with a probability of about 5e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graph

REGISTERS, BAND, MANTISSA, WIDTH = 128, 4, 10, 5
#: Members up to which a bucket with several components compares them directly.
SMALL = 24
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_rng = np.random.Generator(np.random.PCG64(20240501))
_SEEDS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_MULTS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, WIDTH + 1, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    """word -> 64-bit hash, for the words seen lately."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Words()
common.caches("minhash", _words.clear)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes. Fewer than ``width`` words: their sequence as one; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < width:
        h = np.array([n], np.uint64) * _PLACE[width]
        for x in w:
            h = _mix(h ^ x) * _PLACE[0]
        return h
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h += w[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(_mix(h))


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits. The set is not empty."""
    low = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        np.minimum(low, ((part[None, :] ^ _SEEDS[:, None]) * _MULTS[:, None]).min(axis=1), out=low)
    zeros = np.clip(64 - np.frexp(low.astype(np.float64))[1], 0, 63).astype(np.uint64)
    mantissa = (low << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype("<u2")


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of two unrelated sets of n and m elements agree."""
    z = np.arange(64)
    a, b = 2.0 ** -(z + 1.0), 2.0**-z
    s = np.maximum(n + m - 1.0, 1.0)[:, None]
    with np.errstate(divide="ignore"):
        mass = np.exp(s * np.log1p(-a)) - np.where(b < 1, np.exp(s * np.log1p(-np.minimum(b, 1 - 1e-16))), 0.0)
    return np.minimum(0.5, (n * m / s[:, 0]) * (mass * 2.0 ** -(z + 1.0 + MANTISSA)).sum(axis=1))


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    share, c = (a == b).mean(axis=1), collision(n.astype(float), m.astype(float))
    return (share - c) / (1 - c)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a set fingerprint (m_f1, m_f2) and m_regs (null for empty sets) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.llm import minhash as m
        from codeloom.llm import tokens

        for b in batches:
            for part in tokens.slices(b, "m_text"):
                n, f1, f2, regs = [], [], [], []
                for text in part.column("m_text").to_pylist():
                    h = m.shingle_set(text)
                    n.append(len(h))
                    f1.append(int(h.sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0)
                    f2.append(int(np.bitwise_xor.reduce(m._mix(h * m._PLACE[1])).astype(np.int64)) if len(h) else 0)
                    regs.append(m.registers(h).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "m_f1", "m_f2", "m_regs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("m_text")).mapInArrow(common.worker("minhash", run), "doc_id long, n_shingles long, m_f1 long, m_f2 long, m_regs binary")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose corrected estimate reaches ``least``."""
    side = lambda x: classes.select(F.col("m_rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("m_regs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.llm import minhash as m

        for b in batches:
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, m.REGISTERS) for c in ("ra", "rb"))
                ok = m.estimate(ra, rb, b.column("na").to_numpy(), b.column("nb").to_numpy()) >= least
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(common.worker("minhash", run), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) linked on their full sets."""
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("m_z").alias(f"z{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from functools import lru_cache

        import zstandard

        from codeloom.llm import minhash as m

        unpack = zstandard.ZstdDecompressor()
        sets = lru_cache(64)(lambda z: m.shingle_set(unpack.decompress(z).decode("utf-8", "surrogatepass")))
        for b in batches:
            ok = []
            for za, zb in zip(b.column("za").to_pylist(), b.column("zb").to_pylist()):
                x, y = sets(za), sets(zb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "za", "zb").mapInArrow(common.worker("minhash", run), "a long, b long").distinct()


def _prefixes(texts: DataFrame, of: DataFrame, percent: int, scratch: common.Scratch) -> DataFrame:
    """Candidate pairs (a, b) across components among the documents ``of`` (doc_id, m_comp), by an exact prefix filter.

    With shingles ordered by how many of these documents hold them, two sets that reach the threshold share a shingle within
    the first n - ceil(t n) + 1 of the longer one and the first n - ceil(2t/(1+t) n) + 1 of the shorter one.
    """
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        from codeloom.llm import minhash as m

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                h = m.shingle_set(unpack.decompress(b.column("m_z")[i].as_py()).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), b.column("doc_id")[i].as_py())), pa.array(np.full(len(h), b.column("m_comp")[i].as_py())), pa.array(np.full(len(h), len(h))), pa.array(h.astype(np.int64))], ["doc_id", "m_comp", "m_n", "m_s"])

    rows = texts.join(of, "doc_id").select("doc_id", "m_comp", "m_z").mapInArrow(common.worker("minhash", run), "doc_id long, m_comp long, m_n long, m_s long")
    rows = scratch.save(rows, "hot-shingles")
    held = rows.groupBy("m_s").agg(F.count("*").alias("m_df"))
    # a document's own shingles in one row, a bounded group: they are one text's
    ordered = rows.join(held, "m_s").groupBy("doc_id", "m_comp", "m_n").agg(F.sort_array(F.collect_list(F.struct("m_df", "m_s"))).alias("m_l"))
    most = (F.col("m_n") - F.ceil(F.lit(t) * F.col("m_n")) + 1).cast("int")
    short = (F.col("m_n") - F.ceil(F.lit(2 * t / (1 + t)) * F.col("m_n") - 1e-9) + 1).cast("int")
    pre = ordered.select("doc_id", "m_comp", "m_n", short.alias("m_short"), F.posexplode(F.slice("m_l", 1, most)).alias("m_p", "m_e"))
    pre = scratch.save(pre.select("doc_id", "m_comp", "m_n", "m_short", "m_p", F.col("m_e.m_s").alias("m_s")), "prefixes")
    mixed = pre.groupBy("m_s").agg(F.min("m_comp").alias("lo"), F.max("m_comp").alias("hi")).where("lo < hi").select("m_s")
    pre = pre.join(mixed, "m_s")
    # The place of a shared shingle bounds the partner's size too: a longer set with p shingles before it looks for sizes from t n to (n - p) (1 + t) / t - n
    # only. Sizes are joined by classes, so sets of one family that share a late shingle do not meet at all.
    size = lambda n: F.floor(F.log(n.cast("double")) / F.lit(math.log(1.05))).cast("int")
    least, greatest = F.ceil(F.lit(t) * F.col("m_n") - 1e-9), F.least(F.col("m_n"), F.floor((F.col("m_n") - F.col("m_p")) * F.lit((1 + t) / t) - F.col("m_n") + 1e-6))
    x = pre.where(least <= greatest).withColumn("m_class", F.explode(F.sequence(size(least), size(greatest)))).alias("x")
    y = pre.where(F.col("m_p") < F.col("m_short")).withColumn("m_class", size(F.col("m_n"))).alias("y")  # the shorter one
    c = lambda s: F.col(s)
    need = F.lit(t / (1 + t)) * (c("x.m_n") + c("y.m_n")) - 1e-9
    fits = (c("x.m_comp") != c("y.m_comp")) & ((c("y.m_n") < c("x.m_n")) | ((c("y.m_n") == c("x.m_n")) & (c("y.doc_id") < c("x.doc_id")))) & (c("y.m_n") >= t * c("x.m_n") - 1e-9)
    # at the first shared shingle, what follows bounds the overlap; a pair that reaches the threshold has it in both prefixes
    fits = fits & (F.least(c("x.m_n") - c("x.m_p"), c("y.m_n") - c("y.m_p")) >= need)
    return x.join(y, (c("x.m_s") == c("y.m_s")) & (c("x.m_class") == c("y.m_class")) & fits).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for every row of ``docs``.

    Documents are linked if 100 * shared >= percent * union of their shingle sets. Texts without words are linked with nothing.
    A row with a null doc_id cannot be named, so it is linked with nothing: component_id is null and it is kept. Rows with
    one doc_id are one document; repeated rows, however many, give repeated rows and are compared once. Very long texts are one set
    like others, whose registers are taken in blocks. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "minhash")
    sketches = scratch.save(sketch(docs), "sketches")
    key = ["n_shingles", "m_f1", "m_f2"]
    classes = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy(*key).agg(F.min("doc_id").alias("m_rep"), F.first("m_regs").alias("m_regs"), F.count("*").alias("m_c"))
    classes = scratch.save(classes, "classes")

    # buckets: bands of registers with two members or more
    n_bands = REGISTERS // BAND
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.struct(i.alias("i"), F.xxhash64(i, F.substr("m_regs", i * (2 * BAND) + 1, F.lit(2 * BAND))).alias("k"))))
    banded = classes.select(F.col("m_rep"), band.alias("m_b")).select("m_rep", F.col("m_b.k").alias("m_k"), (F.col("m_b.i") % 3).alias("m_t"))
    centre = F.min(F.struct(F.xxhash64("m_rep", "m_t").alias("h"), F.col("m_rep").alias("c")))  # one of three, not always the smallest id
    buckets = banded.groupBy("m_k").agg(centre.alias("m_c"), F.count("*").alias("m_size")).where("m_size > 1").select("m_k", F.col("m_c.c").alias("m_centre"), "m_size")
    buckets = scratch.save(buckets, "buckets")  # a plain side of the join, so that a hot bucket can be split
    members = scratch.save(banded.select("m_k", "m_rep").join(buckets, "m_k"), "members")
    wanted = members.select(F.col("m_rep").alias("doc_id")).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        c, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("m_text").to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                key = (i, xxhash.xxh3_128_intdigest(data))
                if i is None or key in seen:  # repeated rows go in their task already, the rest of them after the join
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                rows.append((i, c.compress(data)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "m_z"])

    # one move of the texts: the candidates' texts, packed, serve both rounds. Each text of an id is kept once.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("m_text")).mapInArrow(common.worker("minhash", pack), "doc_id long, m_z binary")
    texts = scratch.save(texts.join(wanted, "doc_id").distinct(), "texts")

    # a pair at the threshold falls below this bound with a probability of 2e-8 (5.5 deviations)
    t = percent / 100
    least = t - 5.5 * math.sqrt(t * (1 - t) / REGISTERS)
    star = members.where("m_rep != m_centre").select(F.least("m_rep", "m_centre").alias("a"), F.greatest("m_rep", "m_centre").alias("b")).distinct()
    star = scratch.save(_estimated(star, classes, least), "star")
    first = scratch.save(_confirmed(star, texts, percent), "links")
    found = scratch.save(graph.components(first.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "found")

    placed = members.join(found.withColumnRenamed("node", "m_rep"), "m_rep", "left").select("m_k", "m_rep", F.coalesce("component", "m_rep").alias("m_comp"))
    placed = scratch.save(placed, "placed")
    mixed = placed.groupBy("m_k").agg(F.min("m_comp").alias("lo"), F.max("m_comp").alias("hi"), F.count("*").alias("m_size")).where("lo < hi").select("m_k", "m_size")
    open_ = scratch.save(placed.join(mixed, "m_k"), "open")
    few, many = open_.where(F.col("m_size") <= SMALL), open_.where(F.col("m_size") > SMALL)
    x, y = few.alias("x"), few.alias("y")
    cross = x.join(y, (F.col("x.m_k") == F.col("y.m_k")) & (F.col("x.m_rep") < F.col("y.m_rep")) & (F.col("x.m_comp") != F.col("y.m_comp")))
    cross = cross.select(F.col("x.m_rep").alias("a"), F.col("y.m_rep").alias("b")).distinct()
    more = scratch.save(_estimated(cross.join(star, ["a", "b"], "left_anti"), classes, least), "cross")
    hot = many.select(F.col("m_rep").alias("doc_id"), "m_comp").distinct()
    if not hot.isEmpty():
        more = scratch.save(more.union(_prefixes(texts, hot, percent, scratch)).distinct(), "more")
    second = scratch.save(_confirmed(more, texts, percent), "links")
    links = first.union(second)
    found = scratch.save(graph.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "components")
    scratch.drop(texts, members, placed, open_)

    final = classes.join(found.withColumnRenamed("node", "m_rep"), "m_rep", "left").select(*key, F.coalesce("component", "m_rep").alias("m_comp"))
    # a large class is a skewed key of a plain join of narrow rows: adaptive execution splits it
    out = sketches.select("doc_id", *key).join(final, key, "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("m_comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: the document with the smallest id of each group stays, once.

    Rows with a null doc_id stay. Of rows with one doc_id one stays; only such rows are grouped, so texts of others move once at most.
    """
    fate = near_duplicates(docs, percent).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("kept").alias("m_kept"), F.count("*").alias("m_c"))
    fate = fate.where(~F.col("m_kept") | (F.col("m_c") > 1)).select(F.col("doc_id").alias("m_id"), "m_kept")
    fate = common.Scratch(docs.sparkSession, "one-of-each").save(fate, "fate")
    id_ = F.col("doc_id").cast("long")
    once = docs.join(fate, id_ == fate["m_id"], "left_anti")  # null ids match nothing and stay
    again = fate.where("m_kept")
    if again.isEmpty():
        return once
    return once.union(docs.join(again, id_ == again["m_id"], "left_semi").dropDuplicates(["doc_id"]))
