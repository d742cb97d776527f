"""Suffix-array dedup by prefix-free parsing (operator 5).

A shard's segments are parsed into phrases at rolling-hash triggers. The distinct phrases
(the dictionary) and the sequence of phrase numbers (the parse) each get a suffix order;
together they put all windows of the shard in suffix order: first by the rest of the
phrase that a window starts in, then by the parse behind it. Neighbours in that order that
agree on 200 bytes are repeats; the agreement is checked on the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk
from .repeats import Kind, removed

WINDOW_BYTES = 200
#: Bytes of a trigger, and its chance: phrases of about EVERY bytes.
TRIGGER, EVERY = 6, 24


def parse(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase starts, and the row of each: a row's first byte, and each trigger's first byte.

    A phrase runs on to the end of the next trigger, so neighbours overlap by a trigger.
    """
    grams = tk.mix(tk.Rolling(tk.BYTE_SYMBOL[text]).windows(TRIGGER))
    hit = np.zeros(len(text) + 1, bool)
    hit[: len(grams)] = grams % np.uint64(EVERY) == 0
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hit[: len(row)] &= np.arange(len(row)) + TRIGGER <= bounds[1:][row]  # whole triggers only
    hit[bounds[:-1]] = True
    starts = np.flatnonzero(hit[:-1])
    return starts, row[starts]


def window_order(text: np.ndarray, bounds: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The given places of the rows' text in suffix order (as far as 200 bytes tell)."""
    starts, row = parse(text, bounds)
    ends = np.append(starts[1:], len(text))
    last = np.append(row[1:] != row[:-1], True)
    # a phrase's bytes: up to the end of the next trigger, or the row's end
    stop = np.where(last, bounds[1:][row], np.minimum(ends + TRIGGER, bounds[1:][row]))
    size = stop - starts
    rolling = tk.Rolling(tk.BYTE_SYMBOL[text])
    ident = rolling.of(starts, stop) ^ (size.astype(np.uint64) << np.uint64(1)) ^ last.astype(np.uint64)
    _, example, phrase = np.unique(ident, return_index=True, return_inverse=True)
    # the dictionary: each phrase once, ended by a zero (the row's end: two kinds of end sort alike)
    sizes = size[example]
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.repeat(starts[example] - first[:-1], sizes + 1) + np.arange(first[-1])
    dictionary = text[np.minimum(at, len(text) - 1)].astype(np.int64) + 1
    dictionary[first[1:] - 1] = 0
    rest = np.repeat(first[1:] - 1, sizes + 1) - np.arange(first[-1])  # bytes to the terminator
    rank = tk.suffix_ranks(dictionary, np.minimum(rest, WINDOW_BYTES) + 1)
    # the parse in the order of its phrases, as far as a window or the row goes
    code = rank[first[:-1]][phrase]
    far = np.minimum(np.searchsorted(starts, starts + WINDOW_BYTES), np.flatnonzero(last)[np.cumsum(last) - last] + 1)
    code_rank = tk.suffix_ranks(np.unique(code, return_inverse=True)[1], far - np.arange(len(starts)) + 1)
    where = np.searchsorted(starts, windows, "right") - 1
    rest_rank = rank[first[phrase[where]] + windows - starts[where]]
    behind = np.append(code_rank, 0)[where + 1] + 1
    behind = np.where(last[where], 0, behind)
    bits = int(behind.max(initial=0)).bit_length()
    return tk.in_order(rest_rank << bits | behind, bits + max(1, len(dictionary).bit_length()))[0]


def agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which pairs of places have the same `length` bytes."""
    words = np.lib.stride_tricks.as_strided(text.view(np.uint8), (len(text) - 7, 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    left = np.arange(len(a))
    for k in [*range(length - 8, -1, -8), 0]:
        left = left[words[a[left] + k] == words[b[left] + k]]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def search(segments: pa.Array, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    text, bounds = tk.flat(segments)
    n = n.astype(np.int64)
    places = np.concatenate([[0], np.cumsum(n)])
    windows = np.repeat(bounds[:-1] - places[:-1], n) + np.arange(places[-1])
    order = window_order(text, bounds, windows)
    same = agree(text, windows[order[:-1]], windows[order[1:]], WINDOW_BYTES)
    flags = np.repeat(counts > 1, n)
    flags[order[:-1][same]] = True
    flags[order[1:][same]] = True
    return flags


KIND = Kind(words=False, length=WINDOW_BYTES, gram=32, shard=1 << 18, search=search)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size (bytes), n_removed, n_spans (maximal removed runs), kept (the bytes left).

    Each byte of the UTF-8 text goes that a string of 200 bytes covers that also starts
    anywhere else, in the same document too; overlaps count, and strings are judged on the
    input. What is left need not be valid UTF-8. A null text counts as empty. Rows that
    repeat another row are documents of their own. Other columns are not read.
    """
    return removed(docs, KIND, id_col, text_col)
