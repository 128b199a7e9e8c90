"""Sets of hashed word n-grams, for many texts at a time.

Words of a batch are hashed together from running sums over its bytes, so no
Python call is made for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together; a longer word is taken whole.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: A number for each byte; in ``LOWERED`` A-Z count as a-z.
PLAIN = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
LOWERED = PLAIN.copy()
LOWERED[ord("A") : ord("Z") + 1] = PLAIN[ord("a") : ord("z") + 1]
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2))
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BACK, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [(np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return _POWERS[0]


def finished(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, first: np.ndarray, behind: np.ndarray, table: np.ndarray = LOWERED) -> np.ndarray:
    """64-bit hashes of the words ``data[first:behind]``."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(behind, first[at] + BLOCK_BYTES, side="right")))
        begin, end = int(first[at]), int(behind[to - 1])
        up, down = powers(end - begin + 1)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(table[data[begin:end]] * up[: end - begin], out=sums[1:])
        a, b = first[at:to] - begin, behind[at:to] - begin
        out[at:to] = finished((sums[b] - sums[a]) * down[a])
        at = to
    return out


def _mixed(h: np.ndarray, words: int, seed: int = 0) -> np.ndarray:
    """One hash for each run of ``words`` neighbouring word hashes."""
    n = len(h) - words + 1
    mixed = np.full(max(n, 0), seed, np.uint64)
    for k in range(words if n > 0 else 0):
        mixed ^= h[k : k + n]
        mixed *= _MULTIPLIERS[k % len(_MULTIPLIERS)]
        mixed ^= mixed >> np.uint64(31)
    return mixed


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and behind of every word, and for each text the number of words before it and in all.

    ``offsets`` parts ``data`` into texts; words never cross them.
    """
    gap = _GAP[data]
    starts = ~gap
    ends = ~gap
    if len(data):
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        edge = np.zeros(len(data) + 1, bool)
        edge[inner] = True
        starts[1:] &= gap[:-1] | edge[1:-1]
        ends[:-1] &= gap[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def joined_texts(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a string column, some texts at a time; null counts as empty."""
    import pyarrow as pa

    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def gram_sets(column, words: int) -> Iterator[np.ndarray]:
    """For each text of a string column the sorted distinct 64-bit hashes of its word n-grams.

    A-Z are lowered and words are runs without ASCII white space.  A text
    with fewer words has its whole sequence as its one n-gram; a text without
    words has none.
    """
    for data, offsets in joined_texts(column):
        first, behind, bounds = word_edges(data, offsets)
        h = word_hashes(data, first, behind)
        grams = _mixed(h, words)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                found = np.sort(grams[a : b - words + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            else:
                yield _mixed(h[a:b], b - a, seed=b - a) if b > a else np.empty(0, np.uint64)
