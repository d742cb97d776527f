"""Byte-level BPE encoding and decoding (operator 7).

The vocabulary's tokens, as Latin-1 strings of their bytes, go into an Aho-Corasick
automaton. A piece is encoded from the left with the longest token at each place; a
choice holds if the two adjacent tokens encode, as a pair, to themselves. That test
depends on the pair only, so it is memoised; a failed test moves on to the next shorter
token at the place, and places found dead are not entered again. A sequence of tokens is
the merge result exactly if all its adjacent pairs are, so the ids equal those of merging
by rank, and the work is linear in the text.

A slice of texts is cut into pieces by array operations, its distinct pieces are encoded
once each, many at a time in lockstep, and their ids are put together per text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textkernel as tk

#: Encoded pieces kept in one Python worker, in two generations of so many; longer pieces aren't kept.
MEMO, MEMO_BYTES = 100_000, 64
#: Places of the table that remembers tested pairs (a power of two).
PAIRS = 1 << 20
#: Bytes of texts looked at together.
SLICE = 1 << 19
#: Pieces still open below which they are finished one by one.
FEW = 16

NEVER = 1 << 60
OTHER, LETTER, NUMBER, SPACE = range(4)

_codecs: dict[str, Codec] = {}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes, least: int = 1) -> list[bytes]:
    """Plain merging: join the adjacent pair of least rank, again and again, down to `least` parts."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        rank, i = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NEVER:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def char_kinds() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point, as the pattern's classes have it."""
    out = np.zeros(0x110000, np.uint8)
    chars = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, cls in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(cls, chars):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def piece_starts(buf: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Byte places at which pieces of public_tokenizers.PATTERN start; pieces fill the rows.

    The pattern's pieces are runs of letters, of numbers, of other signs, each with one space
    before it, the contractions 's 't 're 've 'm 'll 'd, and what is left of white space.
    """
    if not len(buf):
        return np.zeros(0, np.int64)
    char = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(char)
    at = np.flatnonzero((buf & 0xC0) != 0x80)  # byte place of each character
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    first[n] = True
    kind = kinds[char]
    head = first[:n].copy()
    head[1:] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    tied = np.zeros(n, bool)  # heads with the space before them
    tied[1:] = head[1:] & ~first[1:n] & ~blank[1:] & (char[:-1] == 32)
    start = head & ~tied
    start[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:n]
    # contractions: an apostrophe that starts a piece, and letters behind it
    mark = np.flatnonzero((char == 39) & start)
    mark = mark[~first[mark + 1]]
    if len(mark):
        one, two = char[mark + 1], char[np.minimum(mark + 2, n - 1)]
        two = np.where(first[mark + 2], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(mark), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        hit = short | long
        mark, size = mark[hit], np.where(short, 2, 3)[hit]
        start[mark + 1] = False
        end = mark + size
        start[end[end < n]] = True
    return at[start]


class Codec:
    """Encoder and decoder of one vocabulary file of lines 'base64 rank'."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        top = max(self.ranks.values()) + 1
        self.bytes_of = {i: token for token, i in self.ranks.items()}
        self.size = np.zeros(top, np.int64)
        self.left, self.right = np.full(top, -1), np.full(top, -1)  # of a token's last merge
        self.shorter = np.full(top, -1)  # the longest token that starts it
        self.automaton = ahocorasick.Automaton()
        reached = set()
        for token, i in self.ranks.items():
            self.size[i] = len(token)
            parts = merge_by_rank(self.ranks, token, 2)
            if len(parts) == 2 and len(token) > 1:
                self.left[i], self.right[i] = (self.ranks[x] for x in parts)
            # A token that merging can't reach is never part of a result, but for a whole piece that equals it.
            if len(parts) <= 2:
                reached.add(token)
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        across = {}
        for token, i in self.ranks.items():
            for k in range(len(token) - 1, 0, -1):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    across[a << 32 | b] = i
                if self.shorter[i] < 0 and token[:k] in reached:
                    self.shorter[i] = a
        self.pairs = np.array(sorted(across), np.int64)
        self.merged = np.array([across[x] for x in self.pairs.tolist()], np.int64)
        self.seen, self.fit = np.full(PAIRS, -1), np.zeros(PAIRS, bool)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.kinds = char_kinds()
        names = [self.bytes_of.get(i, b"") for i in range(top)]
        self.token_bytes = pa.array(names, pa.binary())
        self.decimals = pa.array([b"%d " % i for i in range(top)], pa.binary())

    def pairs_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each two adjacent tokens stay as they are when merged together."""
        code = a << 32 | b
        slot = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (PAIRS.bit_length() - 1))).astype(np.int64)
        out = self.fit[slot]
        new = np.flatnonzero(self.seen[slot] != code)
        if len(new):
            fresh, place, back = np.unique(code[new], return_index=True, return_inverse=True)
            good = ~self.join(fresh >> 32, fresh & 0xFFFFFFFF)
            out[new] = good[back]
            at = slot[new[place]]
            self.fit[at] = good
            self.seen[at] = fresh
            both = self.seen[at] == fresh  # of two that share a place the last one is kept
            self.fit[at[both]] = good[both]
        return out

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b ever merges across the place between them.

        Next to that place stand, over time, the right ends of a and the left ends of b, each
        growing when the rank of its next merge comes up. Equal ranks go from left to right.
        """
        out = np.zeros(len(a), bool)
        ends, heads = [a], [b]
        while (ends[-1] >= 0).any():
            ends.append(np.where(ends[-1] >= 0, self.right[ends[-1]], -1))
        while (heads[-1] >= 0).any():
            heads.append(np.where(heads[-1] >= 0, self.left[heads[-1]], -1))
        ends, heads = np.stack(ends), np.stack(heads)
        i, j = (ends >= 0).sum(axis=0) - 1, (heads >= 0).sum(axis=0) - 1
        open_ = np.arange(len(a))
        while len(open_):
            x, y = i[open_], j[open_]
            code = ends[x, open_] << 32 | heads[y, open_]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            across = np.where(self.pairs[at] == code, self.merged[at], NEVER)
            grow_a = np.where(x > 0, ends[x - 1, open_], NEVER)
            grow_b = np.where(y > 0, heads[y - 1, open_], NEVER)
            joins = (across < grow_a) & (across <= grow_b) & (across < NEVER)
            out[open_[joins]] = True
            go_a = grow_a <= grow_b
            i[open_[go_a]] -= 1
            j[open_[~go_a]] -= 1
            open_ = open_[~joins & ((grow_a < NEVER) | (grow_b < NEVER))]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one behind the other, number of ids of each); no piece is empty."""
        joined = "Ā".join([p.decode("latin-1") for p in pieces])
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        longest = np.zeros(len(joined) + 1, np.int64)
        longest[found[:, 0] + 1 - self.size[found[:, 1]]] = found[:, 1]  # longer tokens come later
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(lengths + 1) - (lengths + 1)
        stop = first + lengths
        dead = np.zeros(len(joined) + 1, bool)
        path = np.zeros(len(joined) + 1, bool)  # where tokens of the result start
        token = np.zeros(len(joined) + 1, np.int64)
        came = np.zeros(len(joined) + 1, np.int64)
        place, last, cand, begin, end = first.copy(), np.full(len(pieces), -1), longest[first], first, stop
        while len(place) > FEW or (len(place) and len(place) == len(pieces)):
            place, last, cand, begin, end = self._advance(place, last, cand, begin, end, longest, dead, path, token, came)
        for p, l, c, b, e in zip(*(x.tolist() for x in (place, last, cand, begin, end))):
            self._finish(p, l, c, b, e, longest, dead, path, token, came)
        at = np.flatnonzero(path)
        return token[at], np.bincount(np.searchsorted(stop, at), minlength=len(pieces))

    def _advance(self, place, last, cand, begin, end, longest, dead, path, token, came):
        """One step of every open piece: take its candidate, try a shorter one, or go back."""
        some = cand >= 0
        after = np.where(some, place + self.size[cand], place)
        good = some & ~dead[after]
        test = np.flatnonzero(good & (last >= 0))
        good[test] = self.pairs_fit(last[test], cand[test])
        # the candidate holds
        p, a, c = place[good], after[good], cand[good]
        token[p], path[p], came[a] = c, True, p
        place, last = np.where(good, after, place), np.where(good, cand, last)
        # it doesn't: the next shorter token, or none is left and the token before is taken back
        less = np.where(some, self.shorter[cand], -1)
        back = ~good & (less < 0)
        dead[place[back]] = True
        before = came[place[back]]
        path[before] = False
        cand = np.where(good, longest[place], less)
        place[back] = before
        cand[back] = self.shorter[token[before]]
        last[back] = np.where(before == begin[back], -1, token[came[before]])
        left = place < end
        return place[left], last[left], cand[left], begin[left], end[left]

    def _finish(self, place, last, cand, begin, end, longest, dead, path, token, came):
        """The same for one piece, in plain steps."""
        while place < end:
            after = place + int(self.size[cand]) if cand >= 0 else place
            if cand >= 0 and not dead[after] and (last < 0 or self.pairs_fit(np.array([last]), np.array([cand]))[0]):
                token[place], path[place], came[after] = cand, True, place
                place, last, cand = after, cand, int(longest[after])
                continue
            if cand >= 0:
                cand = int(self.shorter[cand])
            if cand < 0:
                dead[place] = True
                place = int(came[place])
                path[place] = False
                cand = int(self.shorter[token[place]])
                last = -1 if place == begin else int(token[came[place]])

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 32-bit integers in a row."""
        known, older = self.known, self.older
        out = [known.get(p) for p in pieces]
        missing = []
        for k, found in enumerate(out):
            if found is None:
                p = pieces[k]
                if (found := older.get(p)) is not None:
                    out[k] = known[p] = found
                elif (whole := self.ranks.get(p)) is not None:
                    out[k] = known[p] = whole.to_bytes(4, "little")
                else:
                    missing.append(k)
        if missing:
            ids, counts = self.encode_pieces([pieces[k] for k in missing])
            data, at = ids.astype("<i4").tobytes(), 0
            for k, n in zip(missing, (4 * counts).tolist()):
                out[k] = data[at : at + n]
                at += n
                if len(pieces[k]) <= MEMO_BYTES:
                    known[pieces[k]] = out[k]
        if len(known) > MEMO:
            self.known, self.older = {}, known
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Slices of rows: (first row, end, ids of all texts in a row, where each text's ids start and the end)."""
        buf, offsets = tk.flat(column)
        for i, j in tk.slices(offsets, SLICE):
            part, rows = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts = piece_starts(part, rows, self.kinds)
            places = pa.py_buffer(np.append(starts, len(part)).astype(np.int64))
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(part)]).dictionary_encode()
            found = self.ids_of(pieces.dictionary.to_pylist())
            flat = np.frombuffer(b"".join(found), np.int32)
            counts = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            first = np.cumsum(counts) - counts
            which = np.asarray(pieces.indices)
            n = counts[which]
            ends = np.cumsum(n)
            ids = flat[np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            yield i, j, ids, np.append(0, ends)[np.searchsorted(starts, rows)]

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(bytes of all ids in a row, where each id's bytes start and the end)."""
        return _taken(self.token_bytes, ids)


def _taken(values: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    out = values.take(pa.array(ids))
    _, places, data = out.buffers()
    return memoryview(data or b""), np.frombuffer(places, np.int32)[: len(ids) + 1]


def codec(path: str) -> Codec:
    """One codec for a vocabulary in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: columns id_col, ids array<int>. A null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for i, j, ids, bounds in c.encode(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of every list of ids: columns id_col, bytes binary. Null and empty lists have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [c.decode(np.array(x.as_py() or [], np.int32))[0].tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; one row a document, in one pass and without a shuffle.

    Columns: id_col, n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 (of the decoded bytes). A null text counts as empty: no tokens and the
    digest of nothing. Repeated rows and null ids are kept as they are; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for batch in batches:
            for i, j, ids, bounds in c.encode(batch.column(1)):
                plain, plain_at = c.decode(ids)
                listed, listed_at = _taken(c.decimals, ids)
                a, b = plain_at[bounds].tolist(), listed_at[bounds].tolist()
                backs = [sha(plain[x:y]).hexdigest() for x, y in zip(a, a[1:])]
                sums = [sha(listed[x : max(x, y - 1)]).hexdigest() for x, y in zip(b, b[1:])]  # without the last space
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(sums, pa.string()), pa.array(backs, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
