"""Suffix arrays by two-stage sorting, in numpy, for texts that one task holds.

A suffix is *rising* if it is smaller than its successor, else *falling*.
The first stage sorts the rising suffixes directly.  The second scans the
buckets of the first byte from low to high: behind each sorted suffix the
suffix one place to its left, if it is falling, goes to the end of the
falling part of its own bucket.
"""

from __future__ import annotations

import numpy as np


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data.astype(np.uint64), np.zeros(8, np.uint64)])
    n = len(data)
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + n]
    return out


def direct_order(places: np.ndarray, words: np.ndarray, depth: int, same: np.ndarray) -> np.ndarray:
    """``places`` sorted by ``depth`` bytes.

    ``same`` numbers places of which equal numbers mean equal strings of that
    depth; a group of one number needs no further bytes.
    """
    n = len(words)
    order = places[np.argsort(words[places], kind="stable")]
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(words[order[1:]] != words[order[:-1]])
    live = np.arange(len(order))
    for at in range(8, depth + 8, 8):
        if not len(live):
            break
        g = group[live]
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(starts, len(g)))
        kinds = same[order[live]]
        open_group = (sizes > 1) & (np.minimum.reduceat(kinds, starts) != np.maximum.reduceat(kinds, starts))
        live = live[np.repeat(open_group, sizes)]
        if at >= depth or not len(live):
            break
        part = order[live]
        key = words[np.minimum(part + at, n - 1)]
        g = group[live]
        inner = np.lexsort((key, g))
        order[live] = part[inner]
        key = key[inner]
        # A group keeps the number of its first slot, so numbers still rise along the array.
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))] + (1 << 40)
    return order


def two_stage_order(symbols: np.ndarray, wanted: np.ndarray, words: np.ndarray, depth: int, same: np.ndarray) -> np.ndarray:
    """The ``wanted`` places in the order of the first ``depth`` bytes behind them.

    ``symbols`` are bytes plus one; 0 ends each text and sorts first.  Every
    wanted place must have ``depth`` symbols before the 0 of its text or end
    there.  Equal strings stand side by side, in any order.
    """
    n = len(symbols)
    change = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    starts = np.concatenate([[0], change])
    after = np.append(symbols[change], 0)
    rising = np.repeat(after > symbols[starts], np.diff(np.append(starts, n)))
    rising &= symbols > 0
    # A falling place needs the places behind it, up to the next rising one or the end of its text.
    stop = np.flatnonzero(rising | (symbols == 0))
    until = stop[np.searchsorted(stop, wanted)]
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, wanted, 1)
    np.add.at(mark, until + 1, -1)
    need = np.cumsum(mark[:-1]) > 0
    # Neighbouring ranges overlap, so the sum counts covered places only where it is positive.
    direct = np.flatnonzero(need & rising)
    direct = direct_order(direct, words, depth, same) if len(direct) else direct
    heads = np.searchsorted(symbols[direct], np.arange(258))
    falling = need & ~rising & (symbols > 0)
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]
    out: list[np.ndarray] = []

    def induce(placed: np.ndarray, bucket: int) -> None:
        before = placed[placed > 0] - 1
        before = before[falling[before] & (symbols[before] > bucket)]
        if len(before):
            to = symbols[before]
            order = np.argsort(to, kind="stable")
            to, before = to[order], before[order]
            edges = np.flatnonzero(to[1:] != to[:-1]) + 1
            for part in np.split(before, edges):
                waiting[symbols[part[0]]].append(part)

    induce(np.flatnonzero(need & (symbols == 0)), 0)
    for bucket in range(1, 257):
        fell = np.concatenate(waiting[bucket]) if waiting[bucket] else np.empty(0, np.int64)
        parts, last = [fell], fell
        while len(last):  # a run of one byte falls into its own bucket
            last = last[last > 0] - 1
            last = last[falling[last] & (symbols[last] == bucket)]
            parts.append(last)
        placed = np.concatenate([*parts, direct[heads[bucket] : heads[bucket + 1]]]).astype(np.int64)
        if len(placed):
            induce(placed, bucket)
            out.append(placed)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    asked = np.zeros(n, bool)
    asked[wanted] = True
    return order[asked[order]]


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, in bytes up to ``depth`` (a multiple of 8), of each place with the one before it."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        a, b = words[order[live] + at], words[order[live - 1] + at]
        differ = a ^ b
        equal = differ == 0
        out[live[equal]] = at + 8
        rest, x = live[~equal], differ[~equal]
        lead = np.zeros(len(x), np.int64)
        for k in range(1, 8):
            lead += (x >> np.uint64(64 - 8 * k)) == 0
        out[rest] = at + lead
        live = live[equal]
        if not len(live):
            break
    return out
