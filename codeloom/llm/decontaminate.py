"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Items are short and documents long, so Jaccard sketches of whole documents say nothing about containment. The sketch is
taken of the item: its ``k`` shingles that are smallest under ``k`` hash functions. Each of them lies in a document that holds
a share ``t`` of the item with probability ``t``, whatever the document's length, so a document that holds none of them holds
the item with probability ``(1 - t) ** k`` only. Items are partitioned by the size of their shingle set: each
size class has its own ``k`` (small sets use every shingle, which leaves no miss) and skips the documents too small for it.
Candidates are verified by comparing whole shingles.

Only built-in functions run. A document's shingles are joined where they are read and never shuffled; what
leaves a task is the distinct (document, item) candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5


def shingles(words: str, width: int = WIDTH) -> Column:
    """Distinct shingles as text; shorter texts give their whole word sequence, no words none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(n >= width, F.array_distinct(many)).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def _hashed(width: int = WIDTH) -> Column:
    """The same shingles as 64-bit hashes of their words' hashes: no strings are built."""
    n = F.size("d_hash")
    many = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(*[F.element_at("d_hash", i + k) for k in range(width)]))
    return F.when(n >= width, F.array_distinct(many)).when(n > 0, F.array(F.xxhash64("d_hash"))).otherwise(F.array().cast("array<bigint>"))


def _with_hashes(t: DataFrame, words: str) -> DataFrame:
    return t.withColumn("d_hash", F.transform(words, lambda w: F.xxhash64(w))).withColumn("d_set", _hashed()).drop("d_hash")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75, miss: float = 1e-9) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment for every document that holds ``threshold`` of an item. See ``matches``."""
    out = matches(docs, items, threshold, miss)
    out = out.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("d_n")).alias("c"), "n_shared", F.col("d_n").alias("n"))).alias("m"))
    return out.select("doc_id", "item_id", F.col("m.n").cast("long").alias("n_item_shingles"), F.col("m.n_shared").cast("long").alias("n_shared"), F.col("m.c").alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged."""
    bad = matches(docs, items, threshold).select(F.col("doc_id").alias("d_bid"), F.col("d_t").alias("d_bt")).distinct()
    bad = common.Scratch(docs.sparkSession, "decontaminate").save(bad, "bad")
    bad = common.small(bad, bad.count(), 32)
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("d_bid")) & (F.xxhash64(F.col("text").cast("string")) == F.col("d_bt")), "left_anti")


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.75, miss: float = 1e-9) -> DataFrame:
    """doc_id, d_t (hash of the text), d_item, item_id, d_n (the item's shingles) and n_shared of every match.

    ``miss`` bounds the chance that a pair at the threshold is not a candidate. Null or empty texts hold nothing and items
    without words are in no document. Documents with a null doc_id are reported with it; repeated documents or
    items give one row for each distinct pair of ids; very long texts are probed whole; empty tables give no rows; other columns are ignored.
    An item of fewer than five words is one shingle, its whole sequence: only a text of exactly these words holds it, a longer one never.
    """
    import math

    spark = docs.sparkSession
    scratch = common.Scratch(spark, "decontaminate")
    words = lambda c: common.words_of(common.ascii_lower(F.col(c).cast("string")))
    it = items.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("d_words")).where(F.size("d_words") > 0).distinct()
    it = _with_hashes(it, "d_words").withColumn("d_n", F.size("d_set")).select(F.monotonically_increasing_id().alias("d_item"), "item_id", "d_words", "d_set", "d_n")
    it = scratch.save(it, "items")
    # size classes by powers of two; samples for the class: enough for the bound on misses, never more than the set
    k = max(1, math.ceil(math.log(miss) / math.log(1 - threshold))) if threshold < 1 else 1
    sample = it.withColumn("d_class", F.floor(F.log2(F.col("d_n").cast("double"))).cast("int"))
    # class c holds sets of 2**c to 2**(c+1)-1 shingles; sets up to 2k are sampled whole
    mins = F.array_distinct(F.array(*[F.array_min(F.transform("d_set", lambda h, s=s: F.struct(F.xxhash64(h, F.lit(s)).alias("a"), h.alias("h"))))["h"] for s in range(k)]))
    sample = sample.withColumn("d_keys", F.when(F.lit(2.0) ** (F.col("d_class") + 1) <= 2 * k, F.col("d_set")).otherwise(mins))
    keys = scratch.save(sample.select("d_item", F.ceil(F.lit(threshold) * F.col("d_n")).cast("long").alias("d_need"), F.explode("d_keys").alias("d_key")), "keys")
    n_keys = keys.count()
    dt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("d_text"))
    # Two steps: what stands beside explode() is carried by each of its rows, so only narrow columns may. explode_outer, as
    # the filter that Spark infers for explode() would build every set a second time; its null rows join nothing.
    sets = _with_hashes(dt.withColumn("d_dwords", words("d_text")), "d_dwords").select("doc_id", F.xxhash64("d_text").alias("d_t"), F.size("d_set").alias("d_dn"), "d_set")
    sets = sets.select("doc_id", "d_t", "d_dn", F.explode_outer("d_set").alias("d_key"))
    hits = sets.join(common.small(keys, n_keys, 48), "d_key").where(F.col("d_dn") >= F.col("d_need")).select("doc_id", "d_t", "d_item").distinct()
    hits = scratch.save(hits, "candidates")
    # verification: whole shingles of candidate documents against whole shingles of their items
    n_hit = hits.count()
    wanted = hits.groupBy("doc_id", "d_t").agg(F.count("*").alias("d_c")).drop("d_c").withColumnRenamed("doc_id", "d_wid").withColumnRenamed("d_t", "d_wt")
    wanted = common.small(wanted, n_hit, 32)
    found = dt.withColumn("d_t", F.xxhash64("d_text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("d_wid")) & (F.col("d_t") == F.col("d_wt")), "left_semi")
    found = found.withColumn("d_dwords", words("d_text"))  # only candidates are split again
    found = found.select("doc_id", "d_t", F.explode_outer(shingles("d_dwords")).alias("d_s"))
    item_s = it.select("d_item", "item_id", "d_n", F.explode(shingles("d_words")).alias("d_s"))
    # a word stands in five shingles at most; a row has some fixed bytes besides
    n_item, n_bytes = it.agg(F.coalesce(F.sum("d_n"), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.array_join("d_words", " ")) + 1), F.lit(0))).first()
    shared = found.join(common.small(item_s, 1, 64 * n_item + WIDTH * n_bytes), "d_s").groupBy("doc_id", "d_t", "d_item", "item_id", "d_n").agg(F.count_distinct("d_s").alias("n_shared"))
    shared = shared.where(F.col("n_shared") >= F.lit(threshold) * F.col("d_n"))
    # the candidates decide: a pair that the search did not propose is not reported
    h = hits.select(F.col("doc_id").alias("d_hid"), F.col("d_t").alias("d_ht"), F.col("d_item").alias("d_hitem"))
    return shared.join(h, F.col("doc_id").eqNullSafe(F.col("d_hid")) & (F.col("d_t") == F.col("d_ht")) & (F.col("d_item") == F.col("d_hitem")), "left_semi")
