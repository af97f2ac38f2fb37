"""Weak supervision for text quality: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Everything is built-in column functions. Each text is read once into a narrow table of counts. Votes are -1 (low), 0 (abstain)
or 1 (high); documents with equal votes are one pattern, so EM on the driver sees at most ``3 ** n_rules`` patterns however
many documents there are (177,147 for eleven rules), and their posteriors go back as a table of that size.

Bad text comes in kinds (symbols, shouting, repetition...), each of which breaks the few rules that look at it and pleases the others. With
a single low class EM takes the largest kind for it and counts the others as high. So there is one high class and, for each
rule, one kind of low text that this rule speaks against; every class has its own accuracy of every rule, and the posterior of
quality is that of the high class. Two votes against a text that agree as a kind outweigh any number for it; a lone vote against it is
weighed by how often that rule errs on text that the others approve.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _windows(n: Column) -> Column:
    """A hash for each 8-word window, from the hashes of its words in ``q_hash``."""
    one = lambda i: F.xxhash64(*[F.element_at("q_hash", i + k) for k in range(WINDOW)])
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), one)).otherwise(F.array().cast("array<bigint>"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read. Null text has no words; null doc_ids and repeated rows are kept."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("q_text"))
    t = t.withColumn("q_words", common.words_of(F.col("q_text")))
    t = t.withColumn("q_hash", F.transform("q_words", lambda w: F.xxhash64(w)))
    t = t.withColumn("q_win", _windows(F.size("q_words")))
    # windows found twice or more are equal neighbours in sorted order; only texts that have some are sorted
    t = t.withColumn("q_twice", F.size(F.array_distinct("q_win")) < F.size("q_win"))
    place = F.transform(F.col("q_win"), lambda h, i: F.struct(h.alias("h"), (i + 0).alias("i")))
    t = t.withColumn("q_sorted", F.when(F.col("q_twice"), F.sort_array(place)))
    hit = F.filter("q_sorted", lambda x, i: (F.get("q_sorted", i - 1)["h"] == x["h"]) | (F.get("q_sorted", i + 1)["h"] == x["h"]))
    t = t.withColumn("q_starts", F.when(F.col("q_twice"), F.sort_array(F.transform(hit, lambda x: x["i"]))))
    gaps = F.transform("q_starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("q_starts", k + 1) - p, F.lit(WINDOW))))
    t = t.withColumn("n_repeat_words", F.when(F.col("q_twice"), F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long"))
    t = t.withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda s: s.rlike(common.WORD)))
    t = t.withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
    n_words = F.size("q_words").cast("long")
    chars = F.char_length(F.regexp_replace("q_text", common.WHITE + "+", "")).cast("long")
    symbols = (F.char_length("q_text") - F.char_length(F.translate("q_text", SYMBOLS, ""))).cast("long")
    marks = (F.char_length("q_text") - F.char_length(F.translate("q_text", ".!?", ""))).cast("long")
    upper = (F.char_length("q_text") - F.char_length(F.translate("q_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long")
    kept = F.char_length(F.regexp_replace("q_text", r"[^\p{L}]+", "")).cast("long")
    commas = (F.char_length("q_text") - F.char_length(F.replace("q_text", F.lit(","), F.lit("")))).cast("long")
    stutter = F.size(F.filter("q_hash", lambda h, i: h == F.get("q_hash", i - 1))).cast("long")
    return t.select(
        "doc_id", n_words.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.size("q_lines").cast("long").alias("q_n_lines"), marks.alias("q_marks"), upper.alias("q_upper"), F.size(F.array_distinct("q_hash")).cast("long").alias("q_distinct"),
        kept.alias("q_letters"), commas.alias("q_commas"), stutter.alias("q_stutter"),
    )


def _vote(low: Column, high: Column) -> Column:
    """-1 where ``low`` holds, 1 where ``high`` does, else an abstention."""
    return F.when(F.coalesce(low, F.lit(False)), -1).when(F.coalesce(high, F.lit(False)), 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The labelling rules. Each looks at one property, votes low or high where that is clear, and abstains between."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    mean, symbols, letters = F.col("word_chars") / n, F.col("n_symbols") / n, F.col("q_letters") / chars
    dup, rep = F.col("n_dup_lines") / F.greatest(F.col("q_n_lines"), F.lit(1)), F.col("n_repeat_words") / n
    marks, upper, variety = F.col("q_marks") / n, F.col("q_upper") / chars, F.col("q_distinct") / n
    stutter, commas = F.col("q_stutter") / n, F.col("q_commas") / n
    return {
        "length": _vote(n < 20, n >= 50),
        "mean_word": _vote((mean < 3.5) | (mean > 6.5), (mean >= 4.2) & (mean <= 6)),
        "symbols": _vote(symbols > 0.1, symbols <= 0.01),
        "letters": _vote(letters < 0.9, letters >= 0.94),
        "duplicate_lines": _vote((dup > 0.3) & (F.col("n_dup_lines") >= 3), F.col("n_dup_lines") == 0),
        "repeated_words": _vote(rep > 0.2, rep == 0),
        "sentences": _vote((marks < 0.02) | (marks > 0.5), (marks >= 0.04) & (marks <= 0.3)),
        "capitals": _vote(upper > 0.2, upper <= 0.06),
        "variety": _vote(variety < 0.45, variety >= 0.6),
        "stutter": _vote(stutter > 0.1, stutter < 0.02),
        "commas": _vote((commas < 0.005) & (n >= 50), (commas >= 0.015) & (commas <= 0.15)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[list[float], list[list[float]]]:
    """EM over vote patterns: shares of the classes, and per class the share of high votes among each rule's votes.

    Class 0 is high, class r + 1 the kind of low text that rule r speaks against. A pattern without a low vote starts as high, one with
    a single low vote in doubt, and one with more as low, of the kinds of its low votes. Ten votes stand for what is expected of
    an accuracy before any text is seen: nine high votes of ten on high text, one of ten where the class is the rule's own, five
    elsewhere. Abstentions say nothing. No patterns leave these.
    """
    k, total = (len(patterns[0][0]) if patterns else 0), sum(c for _, c in patterns)
    votes = np.array([p for p, _ in patterns], dtype=float).reshape(len(patterns), k)
    count = np.array([c for _, c in patterns], dtype=float)
    low, high = votes < 0, votes > 0
    against = low.sum(axis=1)
    start = np.where(against == 0, 0.99, np.where(against == 1, 0.6, 0.01))
    kinds = np.where(against[:, None] > 0, low, 1.0) / np.where(against > 0, against, max(k, 1))[:, None]
    post = np.concatenate([start[:, None], (1 - start)[:, None] * kinds], axis=1)
    expected = np.full((k + 1, k), 5.0)
    expected[0], expected[np.arange(1, k + 1), np.arange(k)] = 9.0, 1.0
    prior = np.array([9.0] + [1.0] * k)
    for _ in range(rounds):
        mass = post * count[:, None]
        share = (mass.sum(axis=0) + prior) / (total + prior.sum())
        up, down = mass.T @ high, mass.T @ low
        accuracy = (up + expected) / (up + down + 10)
        log = np.log(share) + high @ np.log(accuracy).T + low @ np.log(1 - accuracy).T
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
    return share.tolist(), accuracy.tolist()


def posterior(pattern: tuple[int, ...], shares: list[float], accuracies: list[list[float]]) -> float:
    """Probability that a text with these votes is of high quality."""
    log = [math.log(s) + sum(math.log(a if v > 0 else 1 - a) for a, v in zip(row, pattern) if v) for s, row in zip(shares, accuracies)]
    return 1 / sum(math.exp(x - log[0]) for x in log)


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the posterior probability of high quality and n_low_votes, a row for each row.

    ``n_low_votes``: rules that vote low; all-must-pass filtering would reject a text with any. Empty and null texts fail the base rule (fewer
    than 20 words); very long texts are one row like others; null doc_ids and repeated rows are kept, equal texts get equal verdicts. An
    empty table gives no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    scratch = common.Scratch(docs.sparkSession, "quality")
    d = scratch.save(digest(docs), "digest")  # tens of bytes a document: texts are parsed once
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    votes = rules()
    code = F.lit(0)
    for v in votes.values():
        code = code * 3 + v + 1
    low = sum((F.when(v < 0, 1).otherwise(0) for v in votes.values()), F.lit(0))
    d = d.withColumn("q_code", code.cast("int")).withColumn("n_low_votes", low)
    k = len(votes)
    found = [(tuple(r[0] // 3 ** (k - 1 - i) % 3 - 1 for i in range(k)), *r) for r in d.groupBy("q_code").count().collect()]  # at most 3 ** k rows
    model = fit(sorted((p, c) for p, _, c in found))
    weighed = docs.sparkSession.createDataFrame([(c, round(posterior(p, *model), 9)) for p, c, _ in found], "q_code int, posterior double")
    d = d.join(F.broadcast(weighed), "q_code", "left")
    out = d.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "n_low_votes")
