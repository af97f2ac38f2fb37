"""Exact token counts and ids of whole texts for the word-end BPE vocabulary.

The vocabulary's pre-tokenizer drops white space and never spans it, so a text's tokens are those of its
white-space separated chunks in order. Chunks repeat (Zipf), so each worker keeps what a chunk encodes to.

Counts use the whole-token shortcut: offline, every vocabulary string with a word end is encoded alone, and
those that give exactly one token are proven. A pre-token in that set counts one without any merging; only
the rest run the merges.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries that a worker's cache holds before it starts anew: bounds memory, never results.
CACHE = 100_000
#: Bytes of text that are encoded together: bounds a task's working memory, never results.
POOL = 5 << 20
_state: dict = {}
common.caches("tokens", _state.clear)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    key = ("tokenizer", path)
    if key not in _state:
        _state[key] = Tokenizer.from_file(path)
    return _state[key]


def proven_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (byte-level form, without the word end) that encode alone as one token."""
    tok, out = load(path), set()
    for s, i in tok.get_vocab(with_added_tokens=False).items():
        if s.endswith("</w>"):
            got = tok.model.tokenize(s[:-4])
            if len(got) == 1 and got[0].id == i:
                out.add(s[:-4])
    return frozenset(out)


def chunks(text: str) -> list[str]:
    """Split at white space on which every reader agrees; other kinds stay inside for the library."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


END = "\x01"  # marks the end of a word; chunks that hold it go to the library
# Code points up to U+017F whose classes and lower case are the same everywhere (U+0130 lower-cases to two characters)
_PLAIN = re.compile("[\n!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]+").fullmatch
_wide = [chr(c) for c in range(0xA1, 0x180)]
_LETTERS = "a-z" + "".join(c for c in _wide if unicodedata.category(c)[0] == "L")
_DIGITS = "0-9" + "".join(c for c in _wide if unicodedata.category(c)[0] == "N")
# Fixed value: the vocabulary's pre-tokens, for the code points above. A line feed parts one chunk from the next.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|\n|[^\n{_LETTERS}{_DIGITS}]+").findall


class Merger:
    """The vocabulary's merges run by the rank-based engine, several times as fast as word by word in the library.

    That engine merges neighbours whenever their concatenation is a token, the vocabulary only by the token's own rule. The
    two agree on every token that its own rules build when it stands alone: what merges inside a token's bytes does not
    depend on its neighbours as long as nothing merges across its edge, so its last two parts are always those of its rule. Tokens for which
    that does not hold are found once (``unproven``); a word in which one comes up is given to the library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path) as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # the byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 and up
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        to_byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        sign = {b: c for c, b in to_byte.items()}

        def raw(t: str) -> bytes:
            end = t.endswith("</w>")
            return bytes(to_byte[c] for c in (t[:-4] if end else t)) + (END.encode() if end else b"")

        names = [sign[b] for b in range(256)] + [sign[b] + "</w>" for b in range(256)] + [a + b for a, b in merges]
        ranks: dict[bytes, int] = {}
        ids = []
        for t in names:
            if (r := raw(t)) not in ranks:
                ranks[r] = len(ids)
                ids.append(vocab.get(t, -1))
        self.to_byte, self.last = to_byte, np.array([r.endswith(END.encode()) for r in ranks])
        self.ids, self.feed = np.array(ids, "<i8").astype("<u4"), ranks[b"\n" + END.encode()]
        rank = {m: i for i, m in reversed([*enumerate(merges)])}
        self.unproven = {ranks[raw(a + b)] for a, b in merges if not _builds(a + b, rank)} | {i for i, t in enumerate(ids) if t < 0}
        self.bad = np.array(sorted(self.unproven), np.int64)
        self.engine = tiktoken.Encoding("merges", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})

    def text(self, token: str) -> str:
        """The text of a byte-level string; bytes that are no text give one that matches nothing."""
        return bytes(self.to_byte[c] for c in token).decode("utf-8", "replace")

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of plain pre-tokens; -1 where the library has to look."""
        if not pieces:
            return []
        got = self.engine.encode_to_numpy(END.join([*pieces, ""]))
        n = np.diff(np.flatnonzero(self.last[got]), prepend=-1)
        if len(self.bad):
            n[np.searchsorted(np.flatnonzero(self.last[got]), np.flatnonzero(np.isin(got, self.bad)))] = -1
        return n.tolist()

    def encode(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of plain chunks as bytes; None where the library has to look."""
        if not chunks:
            return []
        text = END.join(_PIECES("\n".join([*chunks, ""]).lower())) + END
        got = self.engine.encode_to_numpy(text)
        to = np.flatnonzero(got == self.feed)
        data = self.ids[got].tobytes()
        out: list[bytes | None] = [data[4 * a : 4 * b] for a, b in zip([0, *(to[:-1] + 1).tolist()], to.tolist())]
        if len(self.bad):
            for k in np.flatnonzero(np.isin(got, self.bad)):
                out[int(np.searchsorted(to, k))] = None
        return out


def _builds(token: str, rank: dict[tuple[str, str], int]) -> bool:
    """Whether the merges, in their order, build a token out of its characters."""
    end = token.endswith("</w>")
    parts = list(token[:-4] if end else token)
    if end:
        parts[-1] += "</w>"
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get((parts[i], parts[i + 1]), 1 << 30), i))
        if (parts[best], parts[best + 1]) not in rank:
            return False
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return True


class IdCache(dict):
    """chunk -> its ids as little-endian 32-bit bytes. Two generations: what was used lately survives a clearing."""

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.path, self.merger, self.old = path, Merger(path), {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:  # the library is loaded where a chunk needs it
            got = np.array(load(self.path).encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[chunk] = got
        return got

    def learn(self, chunks: list[str]) -> None:
        """Encode all unknown ones of some different chunks at once."""
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        new, old = [], self.old
        for w in chunks:
            if w not in self:
                if (b := old.get(w)) is not None:
                    self[w] = b
                else:
                    new.append(w)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            text = "\n".join(part)
            if "<|" in text or not _PLAIN(text):
                part = [w for w in part if "<|" not in w and _PLAIN(w)]
            for w, b in zip(part, self.merger.encode(part)):
                if b is not None:
                    self[w] = b

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Chunks are told apart and put together again in whole columns; only different ones are looked up."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        which, different = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        self.learn(different)
        held = list(map(self.__getitem__, different))
        n = np.fromiter(map(len, held), np.int32, len(held)) // 4
        ids, per = np.frombuffer(b"".join(held), "<u4"), n[which]
        ends = np.cumsum(per, dtype=np.int32)  # a pool is small
        # every chunk's ids, one after another: a run of places in ``ids`` for each
        place = np.repeat((np.cumsum(n, dtype=np.int32) - n)[which] - (ends - per), per)
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])].tolist()
        del which, different, held, coded, per, ends
        place += np.arange(len(place), dtype=np.int32)
        ids = ids[place]
        del place
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


class CountCache(dict):
    """chunk -> number of tokens, by the whole-token shortcut. Two generations, as for ids."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__({"": 0})
        self.tok, self.whole, self.old = load(path), whole, {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.merger = Merger(path)
        self.known = {self.merger.text(t) for t in whole}

    def __missing__(self, chunk: str) -> int:
        n = self.old.get(chunk)
        if n is None:
            if any(s in chunk for s in self.special):  # special strings inside a text: the library's default
                n = len(self.tok.encode(chunk, add_special_tokens=False).ids)
            else:
                pre = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(chunk))
                n = sum(1 if p in self.whole else len(self.tok.model.tokenize(p)) for p, _ in pre)
        self[chunk] = n
        return n

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Count all unknown chunks of some texts: proven pre-tokens at once, the rest by merging each different one."""
        split = [chunks(t) for t in texts]
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
            self[""] = 0
        missing = set().union(*split).difference(self)
        for w in missing.intersection(self.old):
            self[w] = self.old[w]
        new = [w for w in missing if w not in self.old]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            text = "\n".join(part)
            if "<|" in text or not _PLAIN(text):
                part = [w for w in part if "<|" not in w and _PLAIN(w)]
            flat = _PIECES("\n".join([*part, ""]).lower()) if part else []
            rest = [p for p in set(flat).difference(self.known) if p != "\n"]
            merged = dict(zip(rest, self.merger.counts(rest)))
            each, n, ok = iter(part), 0, True
            for p in flat:
                if p == "\n":
                    w = next(each)
                    if ok:
                        self[w] = n
                    n, ok = 0, True
                else:
                    k = merged.get(p, 1)
                    n, ok = n + k, ok and k > 0
        return split

    def count_all(self, texts: list[str]) -> list[int]:
        return [sum(map(self.__getitem__, ws)) for ws in self.learn(texts)]


def id_cache(path: str) -> IdCache:
    key = ("ids", path)
    if key not in _state:
        _state[key] = IdCache(path)
    return _state[key]


def count_cache(path: str, whole: frozenset[str]) -> CountCache:
    key = ("counts", path)
    if key not in _state:
        _state[key] = CountCache(path, whole)
    return _state[key]


def slices(batch: pa.RecordBatch, text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` characters, one row at least."""
    at = size = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > at and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def pooled(batches: Iterator[pa.RecordBatch], text: str, most: int = POOL) -> Iterator[pa.RecordBatch]:
    """Rows of several batches together, about ``most`` bytes of text, one row at least: a chunk is looked up once a pool."""
    held, size = [], 0
    for b in batches:
        for part in slices(b, text, most):
            n = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
            if held and size + n > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.concat_batches(held)


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Null text counts as empty (0 bytes, 0 tokens); null doc_id is kept; repeated rows give repeated rows; an
    empty table gives none; very long texts are counted whole; other columns are ignored. No shuffle: one narrow pass over (doc_id, text).
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    common.ship(spark)
    whole = spark.sparkContext.broadcast(proven_whole_tokens(path))  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.llm import tokens

        cache = tokens.count_cache(path, whole.value)
        for b in batches:
            for part in tokens.slices(b, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = cache.count_all(texts)
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.worker("tokens", count), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
