"""Numpy helpers for Arrow string batches, used inside tasks.

A batch is looked at as one UTF-8 byte buffer with row offsets, so that words,
n-gram hashes and window minima are array operations instead of loops over
Python strings. White space is the ASCII set 0x20, 0x09-0x0D, which never occurs
inside a multi-byte UTF-8 sequence. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, U64), _INVERSE: np.ones(1, U64)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept up to a million entries."""
    have = _powers[base]
    if len(have) < n:
        size = max(n, min(2 * len(have), 1 << 20))
        have = np.ones(size, U64)
        step = 1
        while step < size:  # doubling: the second half is the first times base**step
            end = min(2 * step, size)
            have[step:end] = have[: end - step] * U64(pow(base, step, 1 << 64))
            step *= 2
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit sums over all bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


BYTE_SYMBOL = mix(np.arange(1, 257, dtype=U64))


class Rolling:
    """Hashes of any stretch [s, e) of a symbol array by prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * _power(_BASE, n), out=self.sums[1:])
        self.inverse = _power(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def windows(self, k: int) -> np.ndarray:
        """Hash of each k symbols from every start."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, U64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes, so that arrays over them stay in cache; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of rows i..j: byte starts and ends, row of each word, first word of each row."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, n = buf, len(buf)
        word = ~SPACE[buf]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        edge = np.zeros(n, bool)
        if n:
            edge[0] = True
            np.logical_not(word[:-1], out=edge[1:])
            edge |= first[:n]
            edge &= word
        self.starts = np.flatnonzero(edge)
        last = np.ones(n, bool)
        if n:
            np.logical_not(word[1:], out=last[:-1])
            last |= first[1:]
            last &= word
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # first word of each row, and the end
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return mix(Rolling(BYTE_SYMBOL[self.buf]).of(self.starts, self.ends))


def in_order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(stable order of keys below 2**bits, the keys in that order); place and key share a word where they fit."""
    n = len(key)
    low = max(1, int(n - 1).bit_length()) if n else 1
    if bits + low > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = key.astype(U64)
    both <<= U64(low)
    both |= np.arange(n, dtype=U64)
    both.sort()
    order = (both & U64((1 << low) - 1)).astype(np.int64)
    both >>= U64(low)
    return order, both.astype(np.int64)


def suffix_ranks(symbols: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Ranks of suffixes: the place in their order, equal ones at the first place of them.

    need: how many of its symbols tell each suffix apart from all others, or end it; suffixes
    equal so far share a rank. What stands behind them doesn't count. Prefix doubling; only
    groups that aren't told apart yet are sorted again.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    bits, low = max(1, int(symbols.max()).bit_length()), max(1, int(n - 1).bit_length())
    width = max(1, (64 - low) // bits) if bits + low <= 64 else 1
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        if k < n:
            key[: n - k] |= np.where(k < need[: n - k], symbols[k:], 0)
    order, key = in_order(key, bits * width)
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    size = np.diff(np.append(first, n))
    left = order[np.repeat(size > 1, size)]  # members of groups of two or more, group by group
    while len(left):
        group = rank[left]
        head = np.ones(len(left), bool)
        head[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(left)))
        open_ = np.repeat(np.maximum.reduceat(need[left], first) > width, size)
        left, group = left[open_], group[open_]
        if not len(left):
            break
        after = np.where((need[left] > width) & (left + width < n), rank[np.minimum(left + width, n - 1)] + 1, 0)
        head = np.ones(len(left), bool)
        head[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(head)
        number = np.cumsum(head) - 1
        order, key = in_order(number << (low + 1) | after, low + 1 + max(1, int(number[-1]).bit_length()))
        left, group = left[order], group[order]
        place = group + np.arange(len(left)) - np.repeat(first, np.diff(np.append(first, len(left))))
        head = np.ones(len(left), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(left)))
        rank[left] = np.repeat(place[first], size)
        left = left[np.repeat(size > 1, size)]
        width *= 2
    return rank


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values from every start, by doubling."""
    have, width = values, 1
    while 2 * width <= w:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    rest = w - width
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def anchored(symbols: np.ndarray, bounds: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Runs of windows of `length` symbols that share one winnowed anchor.

    The anchor of a window is the k-gram in it with the least hash (the leftmost of
    equal ones), so equal windows have equal anchors at the same place, wherever they
    stand. Windows lie within one row of `bounds`. A run of consecutive windows with one
    anchor is a segment: its first symbol `lo`, its number of windows `n` (it covers
    n + length - 1 symbols), the hash `anchor` of its anchor, and the hash `body` of all
    that it covers together with `spot`, the anchor's place in it.
    """
    total, none = len(symbols), np.zeros(0, np.int64)
    if total < length:
        return {"row": none, "lo": none, "n": none, "spot": none, "anchor": none.astype(U64), "body": none.astype(U64)}
    rolling = Rolling(symbols)
    grams = mix(rolling.windows(k))
    bits = U64(max(1, int(total).bit_length()))
    mask = (U64(1) << bits) - U64(1)
    keyed = (grams & ~mask) | np.arange(len(grams), dtype=U64)
    at = (sliding_min(keyed, length - k + 1) & mask).astype(np.int64)  # of each window start
    start = np.arange(len(at))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    valid = start + length <= bounds[1:][row]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
    heads = np.flatnonzero(change)
    tails = np.append(heads[1:], len(at))
    good = valid[heads]
    heads, tails = heads[good], tails[good]
    n = tails - heads
    body = mix(rolling.of(heads, tails + length - 1) ^ (n.astype(U64) * U64(0xD6E8FEB86659FD93)) ^ ((at[heads] - heads).astype(U64) << U64(32)))
    return {"row": row[heads], "lo": heads - bounds[row[heads]], "n": n, "spot": at[heads] - heads, "anchor": grams[at[heads]], "body": body}


def covered(lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places lie in any [lo, hi)."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, lo, 1)
    np.add.at(steps, hi, -1)
    return np.cumsum(steps[:-1]) > 0
