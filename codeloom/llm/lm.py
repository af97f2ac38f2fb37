"""Document scores by masked pseudo-likelihood under a small bidirectional window network.

Every token is predicted from the four tokens on either side of it, with itself left out; a document's score is the sum of the
conditional log-probabilities. A token's probability has three factors: its class given the window, its symbol given class and
window, and its word given the symbol. The first two are the network's (a softmax over 32 classes, and one over the 32 symbols of
the class, so that 1024 symbols cost as much as 64); the last is counted over the whole corpus.

Symbols are the 960 most frequent words, in classes of equal rank, and 64 buckets for the rest, by the ending of the word (its last three
bytes), which says more about a word's neighbours than a hash would. Words of a bucket share it by their counts: ``vocabulary`` words
are known by name, a number that grows with the corpus (eight times the root of its tokens), and the others of a bucket share what is left evenly.

The corpus is also remembered as such, beyond what so small a network holds: for every context (a word before and a word after), how often each
word stood between them. Where a context occurs more than once, the network's probability is mixed with the share of the word among the other
occurrences. The occurrence that is scored never counts, so only what the corpus says twice is remembered.

Texts are kept in pools, each with the different words in it. A pool sends each different context, and each different context with its word, once
with its count, as runs of sorted 64-bit hashes; ranges of hashes are counted, and each pool gets its totals back in the order in which it sent
them. So no context, however frequent, has more than one entry a pool, and texts move once.

The network is numpy: embeddings, a tanh layer over the window and the two softmaxes. It is trained on every document (``passes`` times, once by default): in each of a few rounds,
every task trains a copy on its share of that round's documents from the same start, and copies are averaged by their number of
tokens. Only the averaged parameters, some 30,000 numbers, reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

SIDE, EMBED, HIDDEN = 4, 8, 16
CLASSES, MEMBERS = 32, 32
SYMBOLS = CLASSES * MEMBERS
BUCKETS = 64
FREQUENT = SYMBOLS - BUCKETS
PAD = SYMBOLS
SPAN = 2 * SIDE + 1
#: Tokens in a row that are taken together in training, and such runs in a batch.
RUN, RUNS = 64, 64
#: Weight of what is remembered.
RECALL = 0.3
#: Bytes of text in a pool, tokens whose contexts one range of hashes holds: bound a task's working memory, never results.
POOL, RANGE = 8 << 20, 2_000_000
_SHAPES = {"E": (SYMBOLS + 1, EMBED), "W": (SPAN, EMBED, HIDDEN), "b": (HIDDEN,), "C": (HIDDEN, CLASSES), "c": (CLASSES,), "V": (CLASSES, HIDDEN, MEMBERS), "v": (CLASSES, MEMBERS)}


def split(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(which of the different words stands at each place of all texts, the different words, end of each text among the places).

    Words are lower-cased (A-Z only). The empty word marks white space at the ends of a text and is no word.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = parts.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist(), np.cumsum(pc.list_value_length(parts).to_numpy(), dtype=np.int64)


def bucket(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-3:]) % BUCKETS


class Symbols(dict):
    """word -> (symbol, log share of the word in it), with the unnamed words seen lately."""

    def __init__(self, named: dict[bytes, tuple[int, float]], rest: np.ndarray):
        super().__init__(named)
        self.named, self.rest = named, rest

    def __missing__(self, w: bytes) -> tuple[int, float]:
        if len(self) > len(self.named) + 150_000:
            self.clear()
            self.update(self.named)
        b = bucket(w)
        s = self[w] = (b, float(self.rest[b - FREQUENT]))
        return s

    def pool(self, ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        """One row of ``_POOLED``: all texts in the different words among them."""
        import xxhash

        which, different, ends = split(texts)
        pairs = [self[w] if w else (-1, 0.0) for w in different]
        symbol, own = np.array([x for x, _ in pairs], np.int16), np.array([x for _, x in pairs], float)
        name = np.array([xxhash.xxh3_64_intdigest(w) for w in different], np.uint64)
        real = (symbol >= 0)[which]  # empty words are none
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        which = which[real].astype(np.int32)
        shares, of = np.unique(own, return_inverse=True)  # few: words of a count, or of a bucket, have the same
        row = [ids, ends, len(which), len(different), *map(packed, (which, symbol, name)), shares, packed(of.astype(np.int32))]
        return [pa.array([x.to_pylist() if isinstance(x, pa.Array) else x], t.type) for x, t in zip(row, _POOLED)]


#: Columns of a pool: doc_ids, ends of the texts, how many tokens and different words; (packed) words of the tokens, symbols and names of the
#: words; the different log shares, and (packed) which a word has.
_POOLED = pa.schema(
    [("l_ids", pa.list_(pa.int64())), ("l_ends", pa.list_(pa.int64())), ("l_n", pa.int64()), ("l_d", pa.int64())]
    + [(k, pa.binary()) for k in ("l_which", "l_symbol", "l_name")]
    + [("l_shares", pa.list_(pa.float64())), ("l_of", pa.binary())]
)
_POOLED_SQL = "l_ids array<long>, l_ends array<long>, l_n long, l_d long, l_which binary, l_symbol binary, l_name binary, l_shares array<double>, l_of binary"


def packed(x: np.ndarray) -> bytes:
    """Numbers as bytes: all lowest bytes first, then all second ones and so on, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


class Pool:
    """A row of ``_POOLED``, by its columns."""

    def __init__(self, row: dict):
        self.ids, self.ends, self.n, self.row = row["l_ids"], np.array(row["l_ends"], np.int64), row["l_n"], row
        self.which, self.sizes = unpacked(row["l_which"], self.n, np.int32), np.diff(self.ends, prepend=0)

    def symbols(self) -> list[np.ndarray]:
        """Every text's symbols."""
        all_ = unpacked(self.row["l_symbol"], self.row["l_d"], np.int16)[self.which]
        return [all_[i:j] for i, j in zip([0, *self.ends.tolist()], self.ends.tolist())]

    def own(self) -> np.ndarray:
        """Every token's log share in its symbol."""
        return np.array(self.row["l_shares"], float)[unpacked(self.row["l_of"], self.row["l_d"], np.int32)][self.which]

    def texts(self) -> np.ndarray:
        """Every token's text."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return contexts(unpacked(self.row["l_name"], self.row["l_d"], np.uint64)[self.which], self.texts())

    def totals(self, hashes: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
        """Every context's total, from the totals of the different ones in the order of their hashes."""
        out = np.zeros(len(hashes), np.int64)
        if len(hashes):
            o, group = grouped(hashes)
            out[o] = np.concatenate(held)[group]
        return out


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts some hashes, number of each sorted one's group of equals)."""
    bits = np.uint64(len(h).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    # a sort of numbers is several times as fast as one of places: hashes with places in their low bits, right if the high bits tell them apart
    o = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).view(np.int64)
    s = h[o]
    if (s[1:] < s[:-1]).any():
        o = np.argsort(h)
        s = h[o]
    return o, np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))


def lowest(ranges: int) -> np.ndarray:
    """The least hash of each range."""
    return np.array([-(-(k << 32) // ranges) << 32 for k in range(ranges)], np.uint64)


def contexts(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, context, context with its word) of all contexts, from the hashes of the words of some texts. ``text``: whose word it is."""
    if len(names) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    u = np.uint64
    around = names[:-2] * u(0x9E3779B97F4A7C15) + (names[2:] ^ (names[2:] >> u(29))) * u(0xBF58476D1CE4E5B9)
    around = (around ^ (around >> u(32))) * u(0x94D049BB133111EB)
    around ^= around >> u(31)
    at = np.flatnonzero(text[:-2] == text[2:])
    around = around[at]
    whole = (around ^ names[1:-1][at]) * u(0xD6E8FEB86659FD93)
    whole ^= whole >> u(32)
    return at + 1, around, whole


def initial(seed: int, unigram: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters to start from: small random weights, and biases that make it a unigram model. ``unigram``: shares of the symbols."""
    rng = np.random.Generator(np.random.PCG64(seed))
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in _SHAPES.items()}
    p["b"][:] = 0
    p["W"][SIDE] = 0  # a token does not see itself
    u = unigram.reshape(CLASSES, MEMBERS)
    p["c"] = np.log(u.sum(axis=1)).astype(np.float32)
    p["v"] = np.log(u / u.sum(axis=1, keepdims=True)).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def _views(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k], at = v[at : at + n].reshape(s), at + n
    return out


def shaped(v: np.ndarray) -> dict[str, np.ndarray]:
    return _views(v.astype(np.float32))


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with padding around each document, places of the real tokens)."""
    gap = np.full(SIDE, PAD, np.int16)
    parts, keep = [gap], [np.zeros(SIDE, bool)]
    for d in docs:
        parts += [d, gap]
        keep += [np.ones(len(d), bool), np.zeros(SIDE, bool)]
    return np.concatenate(parts), np.flatnonzero(np.concatenate(keep))


_ONES = np.ones((max(CLASSES, MEMBERS), 1), np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place. One greatest value serves all rows; what lies 80 or more below it counts as 80 below."""
    z -= z.max()
    np.maximum(z, -80, out=z)
    np.exp(z, out=z)
    z /= z @ _ONES[: z.shape[1]]  # row sums; sums along short rows are slow
    return z


def _by_class(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, rows, members) for each class among some symbols."""
    o = np.argsort(symbols, kind="stable")
    s = symbols[o]
    ends = np.searchsorted(s, np.arange(CLASSES + 1) * MEMBERS)
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), o[ends[k] : ends[k + 1]], s[ends[k] : ends[k + 1]] - k * MEMBERS


def _hidden(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, hidden layer) of all middle places of rows of symbols."""
    e = p["E"][x].reshape(len(x), -1)
    win = np.lib.stride_tricks.sliding_window_view(e, SPAN * EMBED, axis=1)[:, ::EMBED].reshape(-1, SPAN * EMBED)
    return win, np.tanh(win @ p["W"].reshape(-1, HIDDEN) + p["b"])


def train(p: dict[str, np.ndarray], docs: list[np.ndarray], rate: float = 0.3, seed: int = 0, state: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """One pass of Adagrad over the tokens of some documents, in runs of neighbours. ``state``: squared gradients so far, added to."""
    x, _ = padded(docs)
    n_runs = -(-(len(x) - 2 * SIDE) // RUN)
    x = np.concatenate([x, np.full(n_runs * RUN + 2 * SIDE - len(x), PAD, np.int16)])
    runs = np.lib.stride_tricks.sliding_window_view(x, RUN + 2 * SIDE)[::RUN]
    v = flat(p)
    size = np.full_like(v, 1e-3) if state is None else state
    p, grad = _views(v), np.zeros_like(v)
    g = _views(grad)
    W, column = p["W"].reshape(-1, HIDDEN), np.arange(EMBED)
    order = np.random.Generator(np.random.PCG64(seed)).permutation(n_runs)
    for at in range(0, n_runs, RUNS):
        part = runs[order[at : at + RUNS]].astype(np.int64)
        win, h = _hidden(p, part)
        target = part[:, SIDE:-SIDE].ravel()
        real = target != PAD
        n = max(1, int(real.sum()))
        grad[:] = 0
        # padding has a place in the runs but is predicted by none
        z = _softmax(h @ p["C"] + p["c"])
        z[np.flatnonzero(real), target[real] // MEMBERS] -= 1
        z *= (real / np.float32(n))[:, None].astype(np.float32)
        g["C"][:], g["c"][:] = h.T @ z, z.sum(0)
        dh = z @ p["C"].T
        for k, rows, member in _by_class(target):
            hk = h[rows]
            y = _softmax(hk @ p["V"][k] + p["v"][k])
            y[np.arange(len(rows)), member] -= 1
            y *= np.float32(1 / n)
            g["V"][k], g["v"][k] = hk.T @ y, y.sum(0)
            dh[rows] += y @ p["V"][k].T
        dh *= 1 - h * h
        g["W"].reshape(-1, HIDDEN)[:] = win.T @ dh
        g["W"][SIDE] = 0
        g["b"][:] = dh.sum(0)
        # what each place gets from the windows it lies in, then what each symbol gets
        dw = (dh @ W.T).reshape(len(part), RUN, SPAN, EMBED)
        de = np.zeros((len(part), RUN + 2 * SIDE, EMBED), np.float32)
        for o in range(SPAN):
            de[:, o : o + RUN] += dw[:, :, o]
        g["E"][:] = np.bincount((part[:, :, None] * EMBED + column).ravel(), de.ravel(), g["E"].size).reshape(-1, EMBED)
        size += grad * grad
        grad *= rate
        grad /= np.sqrt(size)
        v -= grad
    return p


def log_probabilities(p: dict[str, np.ndarray], docs: list[np.ndarray], block: int = 8192) -> np.ndarray:
    """Summed conditional log-probability of each document's symbols."""
    each, ends = token_log_probabilities(p, docs, block)
    total = np.concatenate([[0.0], np.cumsum(each)])
    return total[ends] - total[ends - np.array([len(d) for d in docs], dtype=np.int64)]


def token_log_probabilities(p: dict[str, np.ndarray], docs: list[np.ndarray], block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(conditional log-probability of every symbol of all documents, end of each document among them)."""
    x, places = padded(docs)
    out = np.zeros(len(x))
    for at in range(SIDE, len(x) - SIDE, block):
        end = min(at + block, len(x) - SIDE)
        _, h = _hidden(p, x[None, at - SIDE : end + SIDE])
        target = x[at:end].astype(np.int64)
        z = h @ p["C"] + p["c"]
        own = z[np.arange(len(z)), np.minimum(target // MEMBERS, CLASSES - 1)]
        got = own - np.log(np.exp(z, out=z).sum(axis=1))
        for k, rows, member in _by_class(target):
            y = h[rows] @ p["V"][k] + p["v"][k]
            own = y[np.arange(len(rows)), member]
            got[rows] += own - np.log(np.exp(y, out=y).sum(axis=1))
        out[at:end] = got
    return out[places], np.cumsum([len(d) for d in docs], dtype=np.int64)


def recall(log_probability: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What mixing in the remembered share of a word adds to its log-probability under the network."""
    out = np.full(len(share), np.log(1 - RECALL))
    k = share > 0
    x = log_probability[k]
    out[k] = np.log((1 - RECALL) * np.exp(x) + RECALL * share[k]) - x
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts within pools of a task's rows."""
    from codeloom.llm import lm, tokens

    for b in tokens.pooled(batches, "l_text"):
        which, different, _ = lm.split(b.column("l_text"))
        n = np.bincount(which, minlength=len(different))
        keep = [i for i, w in enumerate(different) if w]
        yield pa.RecordBatch.from_arrays([pa.array([different[i] for i in keep], pa.binary()), pa.array(n[keep], pa.int64())], ["l_w", "l_c"])


def fitted(docs: DataFrame, scratch: common.Scratch, vocabulary: float = 8.0, rounds: int = 2, passes: int = 1, seed: int = 11) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(doc_id, l_s, l_share, l_at, l_own: every row's symbols, summed log shares, places of contexts and log shares of their words; the trained parameters)."""
    pools, model, _ = learned(docs, scratch, vocabulary, rounds, passes, seed)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.llm import lm

        for b in batches:
            for row in b.to_pylist():
                pool = lm.Pool(row)
                own, ends = pool.own(), pool.ends.tolist()
                parts = [own[i:j] for i, j in zip([0, *ends], ends)]
                held = [pa.array([s.tobytes() for s in pool.symbols()], pa.binary()), pa.array([x.sum() for x in parts], pa.float64())]
                places = pa.array([[*range(1, len(x) - 1)] for x in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(pool.ids, pa.int64()), *held, places, pa.array([x[1:-1] for x in parts], pa.list_(pa.float64()))], ["doc_id", "l_s", "l_share", "l_at", "l_own"])

    return pools.mapInArrow(common.worker("lm", rows), "doc_id long, l_s binary, l_share double, l_at array<int>, l_own array<double>"), model


def learned(docs: DataFrame, scratch: common.Scratch, vocabulary: float, rounds: int, passes: int, seed: int) -> tuple[DataFrame, dict[str, np.ndarray], int]:
    """(l_pool and ``_POOLED``: all rows in pools; the trained parameters; how many tokens there are)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("l_text"))
    counts = base.select("l_text").mapInArrow(common.worker("lm", _counts), "l_w binary, l_c long").groupBy("l_w").agg(F.sum("l_c").alias("l_c"))
    counts = scratch.save(counts, "words")
    common.forget(spark)
    total = counts.agg(F.sum("l_c")).first()[0] or 0
    # the root of the corpus: 72,000 names for 0.5 GB, half a million for 30 GB, some tens of millions of bytes for all
    n_named = FREQUENT + int(vocabulary * total**0.5)
    top = counts.orderBy(F.col("l_c").desc(), "l_w").limit(n_named).toArrow()
    found, held = [bytes(w) for w in top.column("l_w").to_pylist()], top.column("l_c").to_pylist()
    in_bucket = F.pmod(F.crc32(F.substring("l_w", -3, 3)), F.lit(BUCKETS))
    per = {r[0]: r for r in counts.groupBy(in_bucket.alias("b")).agg(F.sum("l_c").alias("c"), F.count("*").alias("n")).collect()}
    unigram, mass, types = np.ones(SYMBOLS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r in per.items():
        mass[b], types[b] = r["c"], r["n"]
    for i, (w, c) in enumerate(zip(found[:FREQUENT], held)):
        unigram[i] += c
        mass[bucket(w) - FREQUENT] -= c
        types[bucket(w) - FREQUENT] -= 1
    unigram[FREQUENT:] += mass
    left, others = mass.copy(), types.copy()
    named = {w: (i, 0.0) for i, w in enumerate(found[:FREQUENT])}
    for w, c in zip(found[FREQUENT:], held[FREQUENT:]):
        b = bucket(w)
        named[w] = (b, float(np.log(c / mass[b - FREQUENT])))
        left[b - FREQUENT] -= c
        others[b - FREQUENT] -= 1
    rest = np.log(np.maximum(left, 1) / np.maximum(mass, 1) / np.maximum(others, 1))
    scratch.drop(counts)
    known = spark.sparkContext.broadcast((named, rest))  # n_named words

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.llm import lm, tokens

        symbols = lm.Symbols(*known.value)
        for b in tokens.pooled(batches, "l_text", lm.POOL):
            yield pa.RecordBatch.from_arrays(symbols.pool(b.column("doc_id"), b.column("l_text")), schema=lm._POOLED)

    # words are looked up once: training and scoring read the pools; a pool's number is fixed once it is written
    pools = base.mapInArrow(common.worker("lm", encode), _POOLED_SQL).withColumn("l_pool", F.monotonically_increasing_id())
    pools = scratch.save(pools, "pools")
    model = initial(seed, unigram / unigram.sum())
    for k in range(rounds * passes):
        start = spark.sparkContext.broadcast(flat(model))  # a fixed size

        def local(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            from codeloom.llm import lm

            p, n, state = lm.shaped(start.value), 0, np.full(len(start.value), 1e-3, np.float32)
            for b in batches:
                for row in b.to_pylist():
                    pool = lm.Pool(row)
                    mine = [s for s, i in zip(pool.symbols(), pool.ids) if lm.turn(s, i) % rounds == k % rounds]
                    for at in range(0, len(mine), 500):
                        part = mine[at : at + 500]
                        if m := sum(map(len, part)):
                            p, n = lm.train(p, part, rate=0.3 / (k + 1), seed=k, state=state), n + m
            if n:
                v = lm.flat(p).astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v) + 1)), pa.array(np.append(v, n))], ["l_i", "l_v"])

        got = {r[0]: r[1] for r in pools.select("l_ids", "l_ends", "l_n", "l_d", "l_which", "l_symbol").mapInArrow(common.worker("lm", local), "l_i long, l_v double").groupBy("l_i").agg(F.sum("l_v")).collect()}
        if got:
            v = np.array([got[i] for i in range(len(got))])
            model = shaped(v[:-1] / v[-1])
    return pools, model, total


def turn(symbols: np.ndarray, doc_id: int | None) -> int:
    """A number that says in which round a row trains."""
    import xxhash

    return xxhash.xxh3_64_intdigest(symbols.tobytes(), (doc_id or 0) & (1 << 64) - 1)


def remembered(pools: DataFrame, scratch: common.Scratch, ranges: int, kind: int) -> DataFrame:
    """(l_pool, l_range, l_m, l_total): how often the different contexts of each pool occur in all of them (``kind`` 0), or those with their words (1).

    ``l_total`` has the ``l_m`` totals (packed) of what the pool has in that range of hashes, in the order of the hashes. Ranges of kind 1 are numbered
    on from those of kind 0.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.llm import lm

        least = lm.lowest(ranges)
        for b in batches:
            for row in b.to_pylist():
                h, out = np.sort(lm.Pool(row).contexts()[1 + kind]), []
                first = np.flatnonzero(np.concatenate([[len(h) > 0], h[1:] != h[:-1]])[: len(h)])
                n, h = np.diff(first, append=len(h)), h[first]
                cuts = np.append(np.searchsorted(h, least), len(h)).tolist()
                for r, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if i < j:
                        out.append((row["l_pool"], kind * ranges + r, j - i, lm.packed(np.diff(h[i:j], prepend=least[r])), lm.packed(n[i:j])))
                for at in range(0, len(out), 100):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 100]), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["l_pool", "l_range", "l_m", "l_h", "l_c"])

    def count(table: pa.Table) -> pa.Table:
        from codeloom.llm import common, lm

        common.enter("lm")
        m = table.column("l_m").to_pylist()
        least = lm.lowest(ranges)[table.column("l_range")[0].as_py() % ranges]
        h = np.concatenate([least + np.cumsum(lm.unpacked(x.as_py(), n, np.uint64)) for x, n in zip(table.column("l_h"), m)])
        c = np.concatenate([lm.unpacked(x.as_py(), n, np.int64) for x, n in zip(table.column("l_c"), m)])
        o, group = lm.grouped(h)
        c[o] = np.bincount(group, c[o]).astype(np.int64)[group]
        ends = np.cumsum(m).tolist()
        return table.select(["l_pool", "l_range", "l_m"]).append_column("l_total", pa.array([lm.packed(c[i:j]) for i, j in zip([0, *ends], ends)], pa.binary()))

    sent = pools.select("l_pool", "l_ids", "l_ends", "l_n", "l_d", "l_which", "l_name").mapInArrow(common.worker("lm", send), "l_pool long, l_range long, l_m long, l_h binary, l_c binary")
    # a range has as many entries as tokens at most, ``RANGE`` of them by the evenness of hashes
    out = scratch.save(sent.groupBy("l_range").applyInArrow(count, "l_pool long, l_range long, l_m long, l_total binary"), f"totals{kind}")
    del sent
    common.forget(pools.sparkSession)
    return out


def score(docs: DataFrame, vocabulary: float = 8.0, rounds: int = 2, passes: int = 1, seed: int = 11) -> DataFrame:
    """doc_id, n_tokens, sum_logprob, mean_logprob, n_contexts, n_remembered: a row for every row of ``docs``.

    ``n_contexts`` words of a text stand between two others, ``n_remembered`` of them between the same two elsewhere too. Words are ASCII-lower-cased runs without white space. Texts
    without words score 0.0 with a null mean; very long ones are scored in blocks; null doc_ids and repeated rows are kept, equal texts score
    alike up to rounding; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "lm")
    pools, model, total = learned(docs, scratch, vocabulary, rounds, passes, seed)
    ranges = max(1, -(-total // RANGE))
    # one kind after the other: the shuffle files of the first are gone when the second is sent
    totals = remembered(pools, scratch, ranges, 0).unionAll(remembered(pools, scratch, ranges, 1))
    final = spark.sparkContext.broadcast(flat(model))

    def run(table: pa.Table, held: pa.Table) -> pa.Table:
        from codeloom.llm import common, lm

        common.enter("lm")
        p = lm.shaped(final.value)
        got = sorted(zip(held.column("l_range").to_pylist(), held.column("l_m").to_pylist(), held.column("l_total").to_pylist()), key=lambda x: x[0])
        pool = lm.Pool(table.to_pylist()[0])
        at, *both = pool.contexts()
        two, three = (pool.totals(h, [lm.unpacked(x, n, np.int64) for r, n, x in got if r // ranges == kind]) for kind, h in enumerate(both))
        again = two > 1
        at, share = at[again], (three[again] - 1) / (two[again] - 1)
        own, docs_, of = pool.own(), pool.symbols(), pool.texts()
        each = np.concatenate([np.zeros(0), *(lm.token_log_probabilities(p, docs_[i : i + 1000])[0] for i in range(0, len(docs_), 1000))]) + own
        sums = np.bincount(of, each, len(docs_)) + np.bincount(of[at], lm.recall(each[at], share), len(docs_))
        n = pool.sizes
        columns = [pa.array(pool.ids, pa.int64()), pa.array(n), pa.array(np.round(sums, 4)), pa.array(np.maximum(n - 2, 0)), pa.array(np.bincount(of[at], share > 0, len(docs_)).astype(np.int64))]
        return pa.table(columns, names=["doc_id", "n_tokens", "sum_logprob", "n_contexts", "n_remembered"])

    both = pools.groupBy("l_pool").cogroup(totals.groupBy("l_pool"))
    out = both.applyInArrow(run, "doc_id long, n_tokens long, sum_logprob double, n_contexts long, n_remembered long")
    return out.withColumn("mean_logprob", F.when(F.col("n_tokens") > 0, F.col("sum_logprob") / F.col("n_tokens")))
