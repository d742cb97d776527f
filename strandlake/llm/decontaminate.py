"""Benchmark decontamination (operator 1).

A document leaks an item if some stretch of its words is within the item's edit radius: a
fifth of its words, inserted, deleted or replaced. Words are lower-cased (A-Z) and cut at
white space and ASCII punctuation.

Item-sized windows of the documents, from every few words, and of the items, from each of
their first words, go through CGK's random walk, which turns
edits into few Hamming differences: a walk with its own random bits reads the word it stands
on at each step and moves on by a bit that depends on step and word. Sampled coordinates of
the walk are a key of locality-sensitive hashing; walks are repeated until the target recall
is reached for the agreement expected at the radius. Items and windows meet by an equi-join
on keys, and every candidate is verified exactly by bit-parallel edit distance. Of long
items each stretch of CORE words has windows of its own: some stretch holds no more than its
share of the edits.

Items so short that they must match exactly are found by the hash of all their words.

Windows that can't hold an item are dropped first, without loss: a stretch within d edits of
an item of m words keeps at least m - 1 - 2d of its word pairs, and the pairs of all items
are known from a bit table of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut
from . import textkernel as tk

RADIUS = 0.2
#: Places of the pair table are 2 to this power, at most: 16 MB whatever the number of items.
MAX_BITS = 24
#: Coordinates in a key, agreement of one expected at the radius, and the recall to reach.
SAMPLE, AGREE, RECALL = 3, 0.6, 0.99
WALKS = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLE))
GROWTH = 1.1
#: Windows of documents start this share of an item apart; items have windows from all starts in between.
STRIDE = 0.25
#: Words that a walk sees at most.
CORE = 48

FOLD = tk.LOWER.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        FOLD[_b] = 32


def size_class(m: int) -> int:
    """Items whose numbers of words differ by up to a tenth share a class."""
    return int(math.log(m) / math.log(GROWTH) + 1e-9)


def core(cls: int) -> float:
    return min(CORE, GROWTH**cls)


def stride(cls: int) -> int:
    return max(1, int(STRIDE * core(cls)))


def edits(m: int, radius: float = RADIUS) -> int:
    return int(radius * m + 1e-9)


class Walk:
    """One repetition for one size class: where it samples, and the bits it walks by."""

    def __init__(self, cls: int, rep: int):
        rng = np.random.default_rng([cls, rep, 2016])
        reach = max(SAMPLE, int(1.5 * (core(cls) - stride(cls))))  # the walk then stands before the end of the least item
        self.at = set(rng.choice(reach, SAMPLE, replace=False).tolist())
        self.odd = rng.integers(0, 1 << 62, max(self.at) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.seed = np.uint64(cls * 1000 + rep + 1)

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A key of the window from each start; beyond `ends` it reads zeros."""
        i, key = starts.copy(), np.full(len(starts), self.seed, np.uint64)
        for j, odd in enumerate(self.odd):
            word = np.where(i < ends, words[np.minimum(i, len(words) - 1)], np.uint64(0))
            if j in self.at:
                key = tk.mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
            i += ((word * odd) >> np.uint64(63)).astype(np.int64)
        return key


def walks_of(classes) -> dict[int, list[Walk]]:
    return {c: [Walk(c, r) for r in range(WALKS)] for c in classes}


def pairs(words: np.ndarray) -> np.ndarray:
    return tk.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


def whole(words: np.ndarray, length: int) -> np.ndarray:
    """A key of each `length` words, from every start."""
    return tk.mix(tk.Rolling(words).windows(length) ^ np.uint64(length))


def text_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end)."""
    found = tk.Words(FOLD[buf], offsets)
    return found.hashes(), found.bounds


def within(item: list[int], words: list[int], radius: int) -> tuple[int, int] | None:
    """(least edit distance of the item to any stretch of words, where that ends), if within the radius.

    Myers' bit-parallel recurrence; a column of the distance table is two integers.
    """
    m = len(item)
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (radius + 1, 0)
    for end, w in enumerate(words, 1):
        eq = masks.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = (minus | ~(d | plus)) & full, plus & d
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full  # distance zero may start anywhere
        plus, minus = (down | ~(d | up)) & full, up & d
        if score < best[0]:
            best = (score, end)
    return best if best[0] <= radius else None


def item_table(items: DataFrame, id_col: str, text_col: str, radius: float) -> DataFrame:
    """item, cls, words, keys, pairs of each item with a word; an item without edits has its number of words below zero as cls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[int, list[Walk]] = {}
        for batch in batches:
            buf, offsets = tk.flat(batch.column(1))
            words, bounds = text_words(buf, offsets)
            rows = [i for i in range(len(bounds) - 1) if bounds[i + 1] > bounds[i]]
            out: dict[str, list] = {"cls": [], "words": [], "keys": [], "pairs": []}
            for i in rows:
                w = words[bounds[i] : bounds[i + 1]]
                m, c = len(w), size_class(len(w))
                out["words"].append(w.view(np.int64))
                if not edits(m, radius):
                    key = whole(w, m).view(np.int64)
                    out["cls"].append(-m)
                    out["keys"].append(key)
                    out["pairs"].append(key)
                    continue
                if c not in walks:
                    walks |= walks_of([c])
                from_ = np.arange(min(m, max(0, int(m - core(c))) + stride(c) + edits(m, radius)))
                end = np.full(len(from_), m)
                out["cls"].append(c)
                out["keys"].append(np.unique(np.concatenate([walk.keys(w, from_, end) for walk in walks[c]])).view(np.int64))
                out["pairs"].append(pairs(w).view(np.int64))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out["cls"], pa.int32()), *[pa.array(out[k], lists) for k in ("words", "keys", "pairs")]], ["item", "cls", "words", "keys", "pairs"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(id_col, text_col).mapInArrow(run, f"item {kind}, cls int, words array<long>, keys array<long>, pairs array<long>")


def pair_bits(table: DataFrame) -> np.ndarray:
    """Which values of the pairs' leading bits occur in any item."""
    n = table.agg(F.sum(F.size("pairs"))).first()[0] or 0
    width = min(MAX_BITS, max(10, int(64 * n + 1).bit_length()))
    place = F.shiftrightunsigned(F.col("p"), 64 - width)
    spots = table.select(F.explode("pairs").alias("p")).select(place.alias("place")).distinct()
    words = spots.groupBy(F.shiftright("place", 5).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 31 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << width, bool)
    for k in range(32):
        out[words["at"].to_numpy(np.int64)[(words["bits"].to_numpy(np.int64) >> k & 1) == 1] * 32 + k] = True
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", radius: float = RADIUS) -> DataFrame:
    """(id_col, item_id_col, distance, item_words, word_end): each leaking document and item.

    distance is the least number of word edits between the item and any stretch found,
    word_end the place after that stretch's last word. Items too short for an edit leak where
    their words stand as they are. Null and empty texts and items leak nothing; no items give
    no rows. Documents or items that repeat an id are one document or item with all their
    texts.
    """
    table = cut(item_table(items, item_id_col, item_text_col, radius))
    spark = docs.sparkSession
    sizes = table.groupBy("cls").agg(F.min(F.size("words")).alias("least"), F.max(F.size("words")).alias("most")).collect()
    known = spark.sparkContext.broadcast(pair_bits(table))
    plan = [(r["cls"], r["most"] + edits(r["most"], radius), max(1, min(m - 1 - 2 * edits(m, radius) for m in range(r["least"], r["most"] + 1))), edits(r["most"], radius)) for r in sizes if r["cls"] >= 0]
    exact = [-r["cls"] for r in sizes if r["cls"] < 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        shift = np.uint64(64 - (len(bits).bit_length() - 1))
        walks = walks_of([c for c, *_ in plan])
        for batch in batches:
            buf, offsets = tk.flat(batch.column(1))
            # Regions that may hold an item, of all slices of the batch, one behind the other.
            picked, rows, lows, starts, size, shorts = [], [], [], {c: [] for c, *_ in plan}, 0, []
            for i, j in tk.slices(offsets):
                words, bounds = text_words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for length in exact:
                    key = whole(words, length)
                    s = np.flatnonzero(bits[key >> shift])
                    row = np.searchsorted(bounds, s, "right") - 1
                    s, row = s[s + length <= bounds[row + 1]], row[s + length <= bounds[row + 1]]
                    if len(s):  # the first place in each row
                        s = s[np.unique(np.stack([row.astype(np.uint64), key[s]]), axis=1, return_index=True)[1]]
                        row = np.searchsorted(bounds, s, "right") - 1
                        at = (s[:, None] + np.arange(length)).ravel()
                        shorts.append((batch.column(0).take(pa.array(i + row)), s - bounds[row], words[at].view(np.int64), np.arange(len(s) + 1) * length, key[s].view(np.int64)))
                if len(words) < 2:
                    continue
                hit = np.zeros(len(words), np.int32)
                hit[:-1] = bits[pairs(words) >> shift]
                inner = bounds[1:-1]
                hit[inner[inner > 0] - 1] = 0  # pairs across rows
                sums = np.zeros(len(words) + 1, np.int32)
                np.cumsum(hit, out=sums[1:])
                if sums[-1] == 0:
                    continue
                last = np.repeat(bounds[1:].astype(np.int32), np.diff(bounds))
                place = np.arange(len(words), dtype=np.int32)
                row_first = np.repeat(bounds[:-1], np.diff(bounds))
                found, los, his = {}, [], []
                for c, length, least, slack in plan:
                    s = np.flatnonzero(sums[np.minimum(place + length, last)] - sums[:-1] >= least)
                    if not len(s):
                        continue
                    los.append(np.maximum(s - slack, row_first[s]))
                    his.append(np.minimum(s + length + slack, last[s]))
                    # the grid's starts in each window that may hold an item, while a walk still fits in
                    k = stride(c)
                    near = tk.covered(s, np.minimum(s + k + max(0, int(length - core(c))), last[s]), len(words))
                    found[c] = np.flatnonzero(near & ((place - row_first) % k == 0))
                if not los:
                    continue
                inside = tk.covered(np.concatenate(los), np.concatenate(his), len(words))
                edge = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1] & (row_first[1:] == row_first[:-1])]))
                new_place = size + np.cumsum(inside) - 1
                for c, s in found.items():
                    starts[c].append(new_place[s])
                row = np.searchsorted(bounds, edge, "right") - 1
                rows.append(np.column_stack([i + row, new_place[edge]]))
                lows.append(edge - bounds[row])
                picked.append(words[inside])
                size += len(picked[-1])
            for ids, lo, part, ends, key in shorts:
                one = pa.array(np.arange(len(key) + 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lo), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(part)), pa.ListArray.from_arrays(one, pa.array(key))], ["id", "lo", "words", "keys"])
            if not size:
                continue
            words, rows = np.concatenate(picked), np.concatenate(rows)
            first = np.append(rows[:, 1], size)
            region, keys = [], []
            for c, parts in starts.items():
                if parts:
                    s = np.concatenate(parts)
                    of = np.searchsorted(first, s, "right") - 1
                    keys.append(np.stack([w.keys(words, s, first[of + 1]) for w in walks[c]], axis=1).ravel())
                    region.append(np.repeat(of, WALKS))
            keys, region = np.concatenate(keys), np.concatenate(region)
            order = np.lexsort((keys, region))
            keys, region = keys[order], region[order]
            new = np.ones(len(order), bool)
            new[1:] = (region[1:] != region[:-1]) | (keys[1:] != keys[:-1])
            keys, region = keys[new].view(np.int64), region[new]
            cuts = np.searchsorted(region, np.arange(len(first))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[:, 0])), pa.array(np.concatenate(lows)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.view(np.int64))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys))],
                ["id", "lo", "words", "keys"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_id_col].dataType.simpleString()
    regions = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lo long, words array<long>, keys array<long>")
    regions = cut(regions.withColumn("rid", F.xxhash64("id", "lo", "words")))
    item_keys = table.select("item", F.explode("keys").alias("key")).distinct()
    met = regions.select("rid", F.explode("keys").alias("key")).join(broadcast_if_small(item_keys, 200_000), "key").select("rid", "item").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, distance, end, size = [], [], [], []
            rows = zip(batch.column("lo").to_pylist(), batch.column("words").to_pylist(), batch.column("item_words").to_pylist())
            for k, (lo, words, item) in enumerate(rows):
                if best := within(item, words, edits(len(item), radius)):
                    keep.append(k)
                    distance.append(best[0])
                    end.append(lo + best[1])
                    size.append(len(item))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("item").take(at), *[pa.array(x, pa.int64()) for x in (distance, size, end)]], ["id", "item", "distance", "item_words", "word_end"])

    texts = table.select("item", F.col("words").alias("item_words"))
    cases = met.join(regions.select("rid", "id", "lo", "words"), "rid").join(broadcast_if_small(texts, 20_000), "item").select("id", "item", "lo", "words", "item_words")
    good = cases.mapInArrow(verify, f"id {kind}, item {item_kind}, distance long, item_words long, word_end long")
    best = good.groupBy("id", "item").agg(F.min(F.struct("distance", "item_words", "word_end")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "b.distance", "b.item_words", "b.word_end")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that leak an item; rows with a null id stay."""
    bad = cut(leaks(docs, items, id_col=id_col, **options).select(id_col).distinct())
    return docs.join(broadcast_if_small(bad, 1_000_000), id_col, "left_anti")
