"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A collection of short strings of integer symbols is split into shards. Each shard's rotations are
sorted by prefix doubling, which gives its transform. The shards are then merged without sorting any
suffix again: an interleave says which shard each place of the merged transform is taken from; one
step stably sorts the places by the symbol before them, which orders the interleave by one symbol
more. Along with it go block boundaries: after d steps a block is the interval of all suffixes with
the same first d symbols, so common prefixes and repeated intervals need no pass of their own.
"""

from __future__ import annotations

import numpy as np


def transform(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotation starts in sorted order, the symbols before them) of strings that each end in symbol 0.

    ``starts`` has the first place of each string and the end of the last. Rotations stay within their string.
    """
    n = len(symbols)
    step = np.arange(1, n + 1)
    step[starts[1:] - 1] = starts[:-1]
    before = np.empty(n, np.int64)
    before[step] = np.arange(n)
    rank = symbols.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    h, longest = 1, int(np.diff(starts).max()) if n else 0
    while h < longest:
        key = rank * (int(rank.max()) + 1) + rank[step]
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = new
        if rank[order[-1]] == n - 1:
            break
        step, h = step[step], 2 * h
    return order, symbols[before[order]]


def merge(parts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, block of each place) of transforms, ordered by the first ``depth`` symbols.

    A place of the interleave is the number of a transform; its places are taken in their own order.
    """
    sizes = np.array([len(p) for p in parts])
    z = np.repeat(np.arange(len(parts), dtype=np.uint8), sizes)
    # Few symbols sort in one pass.
    kind = np.uint8 if max((int(p.max(initial=0)) for p in parts), default=0) < 256 else np.uint16
    flat = np.concatenate([p.astype(kind) for p in parts])
    block = np.zeros(len(z), np.int32)
    before = np.empty(len(z), kind)
    for _ in range(depth):
        # The symbol before each merged place: the places of every transform, in order, read it in order.
        before[np.argsort(z, kind="stable")] = flat
        order = np.argsort(before, kind="stable")
        z = z[order]
        s, b = before[order], block[order]
        new = np.zeros(len(z), np.int32)
        np.cumsum((s[1:] != s[:-1]) | (b[1:] != b[:-1]), out=new[1:])
        block = new
    return z, block


def repeated(strings: list[np.ndarray], depth: int, shards: int = 4) -> list[np.ndarray]:
    """For each string, which of its places start ``depth`` symbols that another place starts too.

    Symbols are 1 to 65,535. Prefixes that would run past the end of their string never count.
    """
    if not strings:
        return []
    lengths = np.array([len(s) for s in strings])
    split = np.array_split(np.arange(len(strings)), min(shards, len(strings)))
    sas, parts = [], []
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    whole = np.zeros(at[-1], np.int64)
    for k, s in enumerate(strings):
        whole[at[k] : at[k] + len(s)] = s
    whole = np.unique(whole, return_inverse=True)[1].reshape(-1)
    for group in split:
        lo, hi = at[group[0]], at[group[-1] + 1]
        order, last = transform(whole[lo:hi], at[group[0] : group[-1] + 2] - lo)
        sas.append(order + lo)
        parts.append(last)
    z, block = merge(parts, depth)
    where = np.empty(len(z), np.int64)
    where[np.argsort(z, kind="stable")] = np.concatenate(sas)
    owner = np.repeat(np.arange(len(strings)), lengths + 1)[where]
    fits = where + depth <= at[owner] + lengths[owner]
    counts = np.bincount(block[fits], minlength=int(block.max()) + 1)
    hit = np.zeros(len(whole), bool)
    hit[where[fits & (counts[block] > 1)]] = True
    return [hit[at[k] : at[k] + lengths[k]] for k in range(len(strings))]
