"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: compatibility forms and accents go, Cyrillic and Greek look-alikes and digits or signs used as letters
become Latin letters. The lexicon is learned from labelled documents: whole words and word beginnings that toxic documents hold far
more often than clean ones, weighted by their smoothed log-odds. Exception phrases (a term with a neighbouring word)
seen in clean documents only take the term's weight away again. A score is the matched weight per root of the words.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Look-alikes of Latin letters (Cyrillic, Greek, others), then digits and signs used as letters.
HOMOGLYPHS = str.maketrans("асеорхуікмтнвіјѕԁɡαβεικνορτυχ", "aceopxyikmthbijsdgabeiknoptux")
DIGITS = str.maketrans("013457@$!", "oieastasi")

SHORTEST, LONGEST = 4, 10


def fold(text: str) -> str:
    """Lower case, no accents or joiners, look-alikes replaced."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(HOMOGLYPHS)
    return text


def fold_word(word: str) -> str:
    """A word's folded letters. Digits and signs count as letters only beside letters, so numbers stay numbers."""
    word = fold(word)
    if word.isalpha():
        return word
    core = word.strip(".,;:?!\"'()[]{} ")
    if not any(c.isalpha() for c in core):
        return core.replace(" ", "")
    return "".join(c for c in core.translate(DIGITS) if c.isalnum())


class _Folds(dict):
    """word -> folded word, for the words seen lately."""

    def __missing__(self, w: str) -> str:
        if len(self) > 150_000:
            self.clear()
        f = self[w] = fold_word(w)
        return f


_folds = _Folds()


def folded(text: str | None) -> str:
    """The folded words, each between single spaces: ``" w1 w2 "``. No words: one space."""
    words = [f for f in map(_folds.__getitem__, (text or "").split()) if f]
    return " " + " ".join(words) + " " if words else " "


def terms(body: str) -> set[str]:
    """Lexicon candidates of a folded text: whole words (both spaces) and word beginnings (one)."""
    out: set[str] = set()
    for w in set(body.split()):
        if len(w) <= 40:
            out.add(f" {w} ")
        for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
            out.add(" " + w[:n])
    return out


def _machine(lexicon: dict[str, float], exceptions: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t, w in lexicon.items():
        a.add_word(t, (t, w))
    for t in exceptions:
        if t not in lexicon:
            a.add_word(t, (t, None))
    if len(a):
        a.make_automaton()
    return a


def hits(machine, body: str) -> tuple[float, int]:
    """(summed weights, matches). A word counts once, with its heaviest term, and not inside an exception."""
    if not len(machine):
        return 0.0, 0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (t, w) in machine.iter(body):
        start = end - len(t) + 1
        if w is None:
            spared.append((start, end))
        else:
            best[start] = max(w, best.get(start, 0.0))
    keep = [w for s, w in best.items() if not any(a <= s < b for a, b in spared)] if spared else list(best.values())
    return sum(keep), len(keep)


def raw_score(machine, body: str) -> float:
    """Matched weight, normalised by the root of the number of words: longer texts hold more chance matches."""
    return hits(machine, body)[0] / length_of(body)


def length_of(body: str) -> float:
    return math.sqrt(max(25, body.count(" ") - 1))


def learn(sample: DataFrame, max_terms: int = 4000, max_candidates: int = 50_000, least: int = 3) -> dict:
    """Lexicon, exceptions and calibration from (t_text, t_y) rows. ``sample`` is bounded by its maker.

    The lexicon's size is a parameter of the model, as is the sample's: it holds the ``max_terms`` terms that tell the classes
    best apart, of the ``max_candidates`` that most toxic documents hold, in ``least`` of them or more, and as many exceptions. Whole words
    over 40 letters are no terms (their beginnings are). Scoring reads whole texts, whatever their length.
    """

    def counted(of: int, among: frozenset | None):
        """A function that counts, in how many documents of a class, the terms that are ``among`` some (none given: all)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from collections import Counter

            from codeloom.llm import toxicity

            count, docs = Counter(), 0
            for b in batches:
                for text, y in zip(*(b.column(c).to_pylist() for c in ("t_text", "t_y"))):
                    if int(y) == of:
                        found = toxicity.terms(toxicity.folded(text))
                        count.update(found if among is None else found & among)
                        docs += 1
                    if len(count) > 200_000:  # counts add up, so memory stays bounded
                        yield pa.RecordBatch.from_pydict({"t_term": pa.array([*count], pa.string()), "t_n": pa.array([*count.values()], pa.int64())})
                        count = Counter()
            yield pa.RecordBatch.from_pydict({"t_term": pa.array(["", *count], pa.string()), "t_n": pa.array([docs, *count.values()], pa.int64())})

        return run

    def table(of: int, among: frozenset | None, name: str) -> DataFrame:
        return sample.mapInArrow(common.worker("toxicity", counted(of, among)), "t_term string, t_n long").groupBy("t_term").agg(F.sum("t_n").alias(name))

    # terms of toxic documents first; only the most frequent ``max_candidates`` are counted in clean ones
    found = table(1, None, "t_toxic").where((F.col("t_toxic") >= least) | (F.col("t_term") == "")).orderBy(F.col("t_toxic").desc(), "t_term").limit(max_candidates).collect()
    toxic = {r["t_term"]: r["t_toxic"] for r in found}
    n_toxic = toxic.pop("", 0)
    clean = {r["t_term"]: r["t_clean"] for r in table(0, frozenset(toxic), "t_clean").collect()}
    n_clean = clean.pop("", 0)
    if not n_toxic or not n_clean:
        return {"lexicon": {}, "exceptions": [], "cut": 0.0, "scale": 1.0}
    weigh = lambda t: math.log((toxic[t] + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))
    weights = {t: w for t in toxic if (w := weigh(t)) > 2.5}
    top = sorted(weights, key=lambda t: (-weights[t] * math.sqrt(toxic[t]), t))[:max_terms]
    lexicon: dict[str, float] = {}
    for t in sorted(top, key=lambda t: (len(t.rstrip()), t)):
        # a term that a kept beginning already matches adds nothing, unless it weighs more
        if any(t[:k] in lexicon and lexicon[t[:k]] >= weights[t] - 1e-9 for k in range(1 + SHORTEST, len(t))):
            continue
        lexicon[t] = round(weights[t], 6)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of the sample, and the two-word phrases around matches, for exceptions and calibration."""
        from collections import Counter

        from codeloom.llm import toxicity

        machine = toxicity._machine(lexicon, [])
        for b in batches:
            rows: list[tuple] = []
            for text, y in zip(*(b.column(c).to_pylist() for c in ("t_text", "t_y"))):
                body = toxicity.folded(text)
                near: Counter = Counter()
                for end, (t, _) in machine.iter(body) if len(machine) else ():
                    start = end - len(t) + 1
                    stop = body.index(" ", start + 1)
                    before, after = body.rfind(" ", 0, start), body.find(" ", stop + 1)
                    if before >= 0:
                        near[body[before : stop + 1]] += 1
                    if after >= 0:
                        near[body[start : after + 1]] += 1
                rows += [(p, int(y), None) for p in near]
                rows.append((None, int(y), toxicity.raw_score(machine, body)))
            kinds = {"t_phrase": pa.string(), "t_y": pa.int32(), "t_raw": pa.float64()}
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(kinds.items())})

    seen = sample.mapInArrow(common.worker("toxicity", phrases), "t_phrase string, t_y int, t_raw double")
    clean = seen.where(F.col("t_phrase").isNotNull()).groupBy("t_phrase").agg(F.sum(F.col("t_y")).alias("t_toxic"), F.count("*").alias("t_all"))
    exceptions = [r[0] for r in clean.where((F.col("t_toxic") == 0) & (F.col("t_all") >= least)).orderBy(F.col("t_all").desc(), "t_phrase").limit(max_terms).collect()]
    # calibration: the cut between the classes' scores, on the bounded sample
    raw = seen.where(F.col("t_raw").isNotNull()).select("t_y", F.round("t_raw", 6).alias("t_raw")).groupBy("t_raw").agg(F.sum("t_y").alias("u"), F.count("*").alias("c")).orderBy("t_raw").collect()
    n_up, n_all = sum(r["u"] for r in raw), sum(r["c"] for r in raw)
    best, cut, up, below = -1.0, 0.0, 0, 0  # up, below: toxic and all rows under the cut
    for i, r in enumerate(raw):
        tp, fp = n_up - up, (n_all - n_up) - (below - up)
        if (f1 := 2 * tp / max(1, 2 * tp + fp + up)) > best:
            best, cut = f1, (r["t_raw"] + (raw[i - 1]["t_raw"] if i else 0.0)) / 2
        up, below = up + r["u"], below + r["c"]
    scale = max(0.05, cut / 4)
    return {"lexicon": lexicon, "exceptions": exceptions, "cut": cut, "scale": scale}


def _third(c: str):
    return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 10_000, hold_out: bool = True) -> dict:
    """The model. Labels count from rows whose ``crc32(doc_id as text) mod 4`` is not 2 (unless ``hold_out`` is off), at most
    ``max_train`` of them: those with the smallest hashes, the bound of the sample. Conflicting labels count as toxic.
    """
    common.ship(docs.sparkSession)
    y = labels.select(F.col("doc_id").cast("long").alias("t_id"), F.col("toxic").cast("int").alias("t_y")).where(F.col("t_id").isNotNull() & F.col("t_y").isin(0, 1))
    if hold_out:
        y = y.where(_third("t_id") != 2)
    y = y.groupBy("t_id").agg(F.max("t_y").alias("t_y")).orderBy(F.xxhash64("t_id"), "t_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("t_doc"), F.col("text").cast("string").alias("t_text"))
    scratch = common.Scratch(docs.sparkSession, "toxicity")
    # max_train narrow rows are a proven bound for the broadcast; the texts stay where they are read
    sample = scratch.save(rows.join(F.broadcast(y), F.col("t_doc") == F.col("t_id")).repartition(24, "t_doc").select("t_text", "t_y"), "sample")
    try:
        return learn(sample)
    finally:
        scratch.release()


def scorer(spark, model: dict, threshold: float = 0.3):
    """A column function: text -> score from 0 to 1. The cut between the classes lies at ``threshold``; no match gives 0."""
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most max_terms terms and as many exceptions

    @F.arrow_udf("double")
    def toxic_score(texts: pa.Array) -> pa.Array:
        from codeloom.llm import common, toxicity

        common.enter("toxicity")
        return pa.array(toxicity.scores(shared.value, texts.to_pylist(), threshold), pa.float64())

    return toxic_score


_machines: dict = {}


def _forget() -> None:
    _folds.clear()
    _machines.clear()


common.caches("toxicity", _forget)


def scores(model: dict, texts, threshold: float) -> list[float]:
    if _machines.get("of") is not model:
        _machines.update(of=model, machine=_machine(model["lexicon"], model["exceptions"]))
    machine, out = _machines["machine"], []
    for text in texts:
        body = folded(text)
        total, n = hits(machine, body)
        z = (total / length_of(body) - model["cut"]) / model["scale"] + math.log(threshold / (1 - threshold))
        out.append(round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 9) if n else 0.0)
    return out


def score(docs: DataFrame, labels: DataFrame, max_train: int = 10_000, threshold: float = 0.3, hold_out: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for every row of ``docs``.

    Null and empty texts match nothing and score 0; very long texts are matched whole; a null doc_id is held in; without labels of both classes every score is 0;
    repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    rate = scorer(docs.sparkSession, fit(docs, labels, max_train, hold_out), threshold)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rate(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", F.coalesce(_third("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, unchanged."""
    rate = scorer(docs.sparkSession, fit(docs, labels), threshold)
    return docs.where(rate(F.col("text").cast("string")) < threshold)
