"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many strings.

The strings are aligned at an anchor that they hold, and one symbol of every string is put in each round, from the right end of the
longest to the left. A round reads one column of symbols, in the order of the suffixes so far: that is the transform's next column. Sorting
it stably gives the order of the suffixes that now start with these symbols, and the common prefix of two neighbours is one more than
the least common prefix between the places of their tails. Equal windows hold the anchor in the same place, so only
suffixes of one round are ever compared and only their order is kept: a round costs a few passes over one entry a string.

The columns lie in a sequential file, one after another, when they take more than ``memory`` bytes; a round reads the next one. What stays in
memory is an order and a prefix length for each string, and a bit for each string and place.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 256
#: Strings whose symbols are laid out at a time.
PART = 8192


def _least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a:b]) for each pair, a < b. Long ranges use the minima of whole blocks."""
    out = np.empty(len(a), x.dtype)

    def ranges(v: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.empty(0, v.dtype)
        o = np.argsort(s, kind="stable")
        got = np.minimum.reduceat(np.append(v, v[-1:]), np.stack([s[o], e[o]], 1).ravel())[::2]
        back = np.empty_like(got)
        back[o] = got
        return back

    long = b - a > 4 * BLOCK
    out[~long] = ranges(x, a[~long], b[~long])
    if long.any():
        s, e = a[long], b[long]
        whole = np.minimum.reduceat(x, np.arange(0, len(x), BLOCK))
        first, last = -(-s // BLOCK), e // BLOCK
        got = ranges(whole, first, last)
        head, tail = s < first * BLOCK, last * BLOCK < e
        got[head] = np.minimum(got[head], ranges(x, s[head], first[head] * BLOCK))
        got[tail] = np.minimum(got[tail], ranges(x, last[tail] * BLOCK, e[tail]))
        out[long] = got
    return out


def _columns(parts: list[bytes], lengths: np.ndarray, width: int, memory: int, folder: str, name: str, back: bool = False) -> np.ndarray:
    """width x strings: symbols 1 to 256, 0 past a string's end. ``back``: the first column holds the last symbols."""
    shape = (width, len(parts))
    out = np.zeros(shape, np.uint16) if 2 * width * len(parts) <= memory else np.memmap(f"{folder}/{name}", np.uint16, "w+", shape=shape)
    for at in range(0, len(parts), PART):
        n = lengths[at : at + PART]
        inside = np.arange(width) < n[:, None]
        rows = np.zeros(inside.shape, np.uint16)
        rows[inside] = np.frombuffer(b"".join(p[::-1] for p in parts[at : at + PART]) if back else b"".join(parts[at : at + PART]), np.uint8)
        rows[inside] += 1
        out[:, at : at + PART] = rows.T
    return out


def repeated_windows(groups: np.ndarray, left: list[bytes], right: list[bytes], side: int, least: list[int], memory: int = 64_000_000) -> list[np.ndarray]:
    """For each number of symbols in ``least``: (side + 1) x strings, whether a window is found in another string of the group.

    The window at (d, i) starts d symbols left of string i's anchor and holds the anchor and ``least`` other symbols. Strings of one group have
    the same anchor. Windows that a string is too short for are not found.
    """
    m, reach = len(groups), max(least)
    out = [np.zeros((side + 1, m), bool) for _ in least]
    if m < 2:
        return out
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    order = np.argsort(groups, kind="stable")
    # a group's suffixes stay together in every round, so a place belongs to one group throughout
    head = np.diff(np.asarray(groups)[order], prepend=-1) != 0
    of = np.cumsum(head) - 1
    of = of.astype(np.uint16) if of[-1] < 1 << 16 else of
    common = np.zeros(m, np.uint16)
    with tempfile.TemporaryDirectory(prefix="codeloom-bwt-") as folder:
        after = _columns(right, nr, reach, memory, folder, "right")
        before = _columns(left, nl, side, memory, folder, "left", back=True)
        for j in range(reach + side + 1):
            if j >= reach:
                d = j - reach
                for hit, n in zip(out, least):
                    shared = common >= n
                    shared[:-1] |= shared[1:].copy()
                    hit[d, order] = shared
                    hit[d] &= (nl >= d) & (d + nr >= n)
                if d == side:
                    break
            symbols = np.asarray(after[reach - 1 - j] if j < reach else before[j - reach])[order]
            o = np.argsort(symbols, kind="stable")  # counting sorts of 16-bit keys: by symbol, then by group
            o = o[np.argsort(of[o], kind="stable")]
            moved = symbols[o]
            same = np.flatnonzero((moved[1:] == moved[:-1]) & ~head[1:]) + 1
            lo, hi = o[same - 1], o[same]
            value = np.zeros(m, np.uint16)
            near = hi == lo + 1
            value[same[near]] = common[hi[near]] + np.uint16(1)
            if not near.all():
                value[same[~near]] = _least(common, lo[~near] + 1, hi[~near] + 1) + np.uint16(1)
            order, common = order[o], value
        del after, before
    return out
