"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are grouped into many small source blocks by a hash. The driver draws how many rows of each block go to each shard
(multivariate hypergeometric, so every way to deal the rows is as likely as in a full permutation), each block permutes
its own rows and cuts them by those counts, the rows are exchanged, and each shard permutes what it got.

Law ``rows``: shard sizes differ by one at most. The driver holds only blocks x shards counts; the number of
blocks follows the number of rows (``block_rows`` a block), so no task sorts more than a block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_COLS = ["doc_id", "size", "text_crc32", "sh_n"]


#: Copies of one row that are numbered together.
COPIES = 10_000
#: Below this, numpy draws hypergeometric numbers itself.
LARGE = 1_000_000_000


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number: how many of ``n`` draws are good."""
    if not n or not good:
        return 0
    if not bad:
        return n
    if good < LARGE and bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    # populations beyond numpy's range: inversion over all counts within 14 deviations of the mean, outside which less than 1e-40 lies
    total = good + bad
    mean = n * good / total
    width = 14 * np.sqrt(mean * (bad / total) * max(1.0, (total - n) / max(1, total - 1))) + 20
    k = np.arange(max(0, n - bad, int(mean - width)), min(n, good, int(mean + width)) + 1, dtype=float)
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    log = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(log - log.max()))
    return int(k[min(np.searchsorted(mass, rng.random() * mass[-1], side="right"), len(k) - 1)])


def draw_matrix(counts: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """blocks x shards counts with the given row and column sums, drawn without replacement."""
    if sum(counts) != sum(capacities):
        raise ValueError("counts and capacities differ in total")
    rng, left = np.random.Generator(np.random.PCG64(seed)), [int(c) for c in capacities]
    out = np.zeros((len(counts), len(capacities)), dtype=np.int64)
    for i, n in enumerate(counts):
        remaining = sum(left)
        for j, c in enumerate(left[:-1]):  # one hypergeometric draw a shard; the last gets the rest
            remaining -= c
            out[i, j] = draw(rng, c, remaining, n)
            n -= int(out[i, j])
        out[i, -1] = n
        left = [c - int(x) for c, x in zip(left, out[i])]
    return out


def _bounds(df: DataFrame, key: str) -> dict[tuple, int]:
    return {tuple(r)[:-1]: r[-1] for r in df.groupBy(*key.split()).count().collect()}


def shard(docs: DataFrame, n_shards: int = 16, seed: int = 7, block_rows: int = 200_000, least_blocks: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for every row of ``docs``.

    Null text counts as empty (size 1, crc 0); null doc_ids, repeated rows and equal texts are dealt like any others
    (identical rows are interchangeable, and any number of them is split over tasks); texts of any length only count by their size;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # The digest is a few bytes a row; it is kept so that every later pass sees the same rows.
    scratch = common.Scratch(spark, "sharding")
    rows = scratch.save(rows, "rows")
    n = rows.count()
    n_blocks = max(least_blocks, -(-n // block_rows))
    # Identical rows are spread by their number among themselves: a table of one repeated row still splits. That number is
    # only needed where a digest repeats, and is taken by salt: hash of the row's place is not stable, so a counter is.
    spread = F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed))
    repeated = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("sh_c"))
    # One row for each distinct digest; copies are made again by explode, each with its own number. Many copies are first cut into
    # runs of a bounded number, which are dealt to tasks by their own key.
    repeated = scratch.save(repeated, "digests")
    few = repeated.where(F.col("sh_c") <= COPIES).withColumn("sh_n", F.explode(F.sequence(F.lit(1).cast("long"), "sh_c")))
    runs = repeated.where(F.col("sh_c") > COPIES).withColumn("sh_r", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(sh_c - 1) div {COPIES}"))))
    runs = runs.repartition("doc_id", "size", "text_crc32", "sh_r")
    many = runs.withColumn("sh_n", F.explode(F.sequence(F.col("sh_r") * COPIES + 1, F.least("sh_c", (F.col("sh_r") + 1) * COPIES)))).drop("sh_r")
    rows = few.unionByName(many).drop("sh_c")
    rows = rows.withColumn("sh_block", F.pmod(F.xxhash64(spread, "sh_n"), F.lit(n_blocks)).cast("int"))
    counts = _bounds(rows, "sh_block")
    at = [counts.get((b,), 0) for b in range(n_blocks)]
    capacities = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = draw_matrix(at, capacities, seed)
    ends = matrix.cumsum(axis=1)
    cut = spark.createDataFrame([(b, [int(x) for x in ends[b]]) for b in range(n_blocks)], "sh_block int, sh_ends array<long>")
    # blocks x shards counts, a block for every block_rows rows: broadcast as long as these bytes are few
    cut = common.small(cut, n_blocks, 8 * n_shards + 48)
    order = [F.xxhash64(spread, "sh_n", F.lit("first")), *_COLS]
    place = F.row_number().over(Window.partitionBy("sh_block").orderBy(*order))
    dealt = rows.withColumn("sh_place", place).join(cut, "sh_block")
    dealt = dealt.withColumn("shard", F.size(F.filter("sh_ends", lambda e: e < F.col("sh_place"))).cast("int"))
    # Permute again inside each shard. Ranges of a random key make sub-blocks, whose counts give each one's first slot.
    n_sub = max(4, -(-n // (n_shards * block_rows)))
    dealt = dealt.withColumn("sh_key", F.xxhash64(spread, "sh_n", F.lit("second")))
    dealt = dealt.withColumn("sh_sub", F.pmod(F.shiftrightunsigned("sh_key", 20), F.lit(n_sub)).cast("int"))
    dealt = scratch.save(dealt.select(*_COLS, "shard", "sh_key", "sh_sub"), "dealt")
    counts = _bounds(dealt, "shard sh_sub")
    first = []
    for s in range(n_shards):
        k = 0
        for b in range(n_sub):
            first.append((s, b, k))
            k += counts.get((s, b), 0)
    starts = spark.createDataFrame(first, "shard int, sh_sub int, sh_first long")
    starts = common.small(starts, len(first), 48)
    slot = F.row_number().over(Window.partitionBy("shard", "sh_sub").orderBy("sh_key", *_COLS))
    out = dealt.withColumn("sh_slot", slot).join(starts, ["shard", "sh_sub"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("sh_first") + F.col("sh_slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
