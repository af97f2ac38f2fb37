"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (projections and attention inside the piece). Full-length
pieces are sequences of their own. The rest of a batch goes, in descending order, to the cheapest open sequence that
still holds it; where none does, the document is cut and fills what is left, so a batch of about a
million tokens is padded by less than one sequence in all.

Every input partition packs its own rows in bounded batches: no shuffle, and a lost task packs the same rows again.
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

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def place(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) for every piece; each token lies in exactly one piece.

    Sequences are numbered from 0. Zero-length items get no piece.
    """
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # length, item, start
    n_seq = 0
    for i, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((i, k * capacity, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rest.append((n % capacity, i, full * capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    n_open = -(-sum(r[0] for r in rest) // capacity)
    cost, free = np.zeros(n_open), np.full(n_open, capacity)

    def put(s: int, item: int, start: int, n: int) -> None:
        out.append((item, start, n, n_seq + s, capacity - int(free[s])))
        free[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n, item, start in rest:
        while n:
            room = np.flatnonzero(free >= n)
            if len(room):  # the cheapest of all sequences that hold it, the first of equals
                put(int(room[cost[room].argmin()]), item, start, n)
                break
            room = np.flatnonzero(free)  # cut: the cheapest with room takes what it can
            s = int(room[cost[room].argmin()])
            k = int(free[s])
            put(s, item, start, k)
            start, n = start + k, n - k
    return out


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, path: str | None = None, batch_tokens: int = 1_000_000, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost.

    A document is its ids followed by ``end_id``, so null and empty texts are one token. Null doc_ids are packed
    like others, repeated rows once each; very long texts fill sequences of their own; an empty table gives no rows; other columns are ignored.
    """
    path = path or tokens.tokenizer_path()
    common.ship(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from codeloom.llm import packing, tokens

        cache = tokens.id_cache(path)
        base, n_seq = TaskContext.get().partitionId() << 36, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal n_seq, size
            pieces = packing.place([len(ids) // 4 for _, ids in held], capacity, linear, quadratic)
            cols: list[list] = [[] for _ in range(8)]
            for i, start, n, seq, offset in pieces:
                doc, ids = held[i]
                row = (doc, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, base + n_seq + seq, offset, linear * n + quadratic * n * n)
                for c, v in zip(cols, row):
                    c.append(v)
            n_seq += 1 + max((p[3] for p in pieces), default=-1)
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.float64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])

        for part in tokens.pooled(batches, "text"):
            ids = cache.encode_all(pc.fill_null(part.column("text"), ""))
            for doc, x in zip(part.column("doc_id").to_pylist(), ids):
                held.append((doc, x + end))
                size += len(x) // 4 + 1
                if size >= batch_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.worker("tokens", run), SCHEMA)
