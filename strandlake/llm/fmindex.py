"""Substring dedup by compressed FM-indexes (operator 4).

A shard's segments, as sequences of word numbers, are indexed: suffix order by prefix
doubling, the Burrows-Wheeler transform in a wavelet matrix of packed bits with block
counts. All segments are then streamed through the index at once by backward search, in
lockstep: each stretch is extended to the left while it occurs at least twice, which
gives the matching statistics from which repeated windows are read off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk
from .repeats import Kind, removed

WINDOW_WORDS = 35


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first `depth` symbols; ends sort first."""
    n = len(symbols)
    rank = tk.suffix_ranks(np.unique(symbols, return_inverse=True)[1] + 1, np.minimum(depth, np.arange(n, 0, -1)))
    return tk.in_order(rank, max(1, int(n).bit_length()))[0]


class Bits:
    """A packed bit vector with a count before each 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little")
        self.words = packed.view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts
        self.zeros = int(len(bits) - counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Counts occurrences of patterns of up to `depth` symbols; symbols are 0 to sigma - 1."""

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int):
        order = suffix_order(symbols, depth)
        bwt = symbols[order - 1]  # of suffix 0: the last symbol
        self.size, self.levels = len(symbols), []
        first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))[:-1]])
        begin = np.zeros(sigma, np.int64)
        codes = np.arange(sigma)
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            one = (bwt >> bit & 1).astype(bool)
            level = Bits(one)
            self.levels.append((bit, level))
            bwt = np.concatenate([bwt[~one], bwt[one]])
            ahead = level.rank(begin)
            begin = np.where(codes >> bit & 1, level.zeros + ahead, begin - ahead)
        self.base = first - begin  # from the last level's place to the suffix order

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after putting a symbol before each pattern."""
        n = len(lo)
        at, code = np.concatenate([lo, hi]), np.concatenate([symbol, symbol])
        for bit, level in self.levels:
            ones = level.rank(at)
            at = np.where(code >> bit & 1, level.zeros + ones, at - ones)
        at = at + self.base[code]
        return at[:n], at[n:]


def repeated_windows(index: FMIndex, symbols: np.ndarray, starts: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Flags of the n windows of each segment that occur twice or more in the index.

    A stretch that ends at the last open window's end is extended to the left while it
    occurs twice: [p + 1, end] is the longest one. Windows inside it are repeated; windows
    that hold [p, end] are not. The next end is the one before, or p's last window's if lower.
    """
    bounds = np.concatenate([[0], np.cumsum(n)])
    flags = np.zeros(bounds[-1] + 1, np.int64)
    live = np.arange(len(n))
    end = n - 1 + length - 1  # last symbol of the last open window, from the segment's first
    at = end.copy()  # symbol to put before the stretch
    lo, hi = np.zeros(len(n), np.int64), np.full(len(n), index.size, np.int64)
    while len(live):
        new_lo, new_hi = index.step(symbols[starts[live] + at[live]], lo[live], hi[live])
        more = new_hi - new_lo >= 2
        go = live[more]
        lo[go], hi[go] = new_lo[more], new_hi[more]
        at[go] -= 1
        stop = np.concatenate([live[~more], go[at[go] < 0]])
        if len(stop):
            p, e = at[stop], end[stop]  # [p, e] occurs once; p is -1 at the segment's start
            has = e - p >= length
            w = stop[has]
            flags[bounds[w] + p[has] + 1] += 1
            flags[bounds[w] + e[has] - length + 2] -= 1
            e = np.minimum(e - 1, p + length - 1)
            end[stop], at[stop] = e, e
            lo[stop], hi[stop] = 0, index.size
            live = live[end[live] >= length - 1]
    return np.cumsum(flags[:-1]) > 0


def search(segments: pa.Array, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    buf, offsets = tk.flat(segments)
    words = tk.Words(buf, offsets)
    texts = pa.Array.from_buffers(pa.binary(), len(words.starts), [None, *_as_array(buf, words)])
    codes = np.asarray(texts.dictionary_encode().indices).astype(np.int64) + 1  # 0 parts the segments
    row = words.row
    place = np.arange(len(codes)) + row
    symbols = np.zeros(len(codes) + len(n), np.int64)
    symbols[place] = codes
    starts = words.bounds[:-1] + np.arange(len(n))
    sizes = n.astype(np.int64)
    index = FMIndex(symbols, int(codes.max()) + 1 if len(codes) else 1, 2 * int(sizes.max() + WINDOW_WORDS))
    flags = np.ones(int(sizes.sum()), bool)
    single = np.flatnonzero(counts < 2)  # the windows of others are repeated as they stand
    own = np.repeat(counts < 2, sizes)
    flags[own] = repeated_windows(index, symbols, starts[single], sizes[single], WINDOW_WORDS)
    return flags


def _as_array(buf: np.ndarray, words: tk.Words) -> tuple[pa.Buffer, pa.Buffer]:
    """Offsets and data of the words alone."""
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int32)
    return pa.py_buffer(ends), pa.py_buffer(buf[~tk.SPACE[buf]])


KIND = Kind(words=True, length=WINDOW_WORDS, gram=8, shard=1 << 16, search=search)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size (words), n_removed, n_spans, kept (the words left, joined by one space, UTF-8).

    Each word goes that a window of 35 words covers whose words also start anywhere else,
    in the same document too; windows are judged on the input. A null or empty text has no
    words. Rows that repeat another row are documents of their own: all their windows are
    repeated. Other columns are not read.
    """
    return removed(docs, KIND, id_col, text_col)
