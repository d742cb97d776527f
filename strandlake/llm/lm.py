"""Masked pseudo-likelihood scores (operator 9).

A document's score is the sum of the log-probabilities of all its words, each with the word
itself masked. A small network sees the two words before and the two behind it and decides
in several steps, each with a softmax of its own over what the network makes of both sides:
first among groups of the most frequent words and of classes of endings, then in the group,
then, below an ending, digit by digit of the word's hash. The number of digits grows with the number of different words, so
that a leaf holds a few of them at any size of the corpus; among those few the counts in all
other documents decide. The first digits start from the counts of the words below them. A
word that no other document has is spelled out.

Counts come from a grouped count over all texts. Those of the most frequent words (a bounded
number) go to all tasks; all others stay distributed, and documents' words meet their counts
by the word. Training is numpy inside tasks: documents, as class numbers, are dealt to blocks
of bounded size by a hash; in each round each block runs minibatch Adagrad over its documents
from the common weights, and the weights are averaged. Each block is in one round, so all of
the corpus is learnt from once. Nothing depends on how the input is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import stored
from . import textkernel as tk

#: Classes of frequent words and of endings; hidden units; words seen on either side.
FREQUENT, ENDINGS, HIDDEN, REACH = 96, 32, 16, 2
CLASSES = FREQUENT + ENDINGS
OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]
ROUNDS, BATCH, RATE = 2, 4096, 0.3
#: Choices of a digit and its bits, different words of a leaf (about), digits that start from counts.
FAN, BITS, LEAF, COUNTED_DIGITS = 16, 4, 4, 3
#: Groups of FAN classes, which are chosen first.
GROUPS = CLASSES // FAN
#: Words whose counts go to all tasks, at most; the counts of others stay distributed.
HELD = 200_000
#: Words counted together before they are added up.
COUNTED = 1 << 20
#: Words in a block, about.
BLOCK = 1 << 21
#: An unseen word's bytes are spelled out at this chance each.
LETTER = 1 / 32
#: Weights are summed as integers of this many parts, weighted by each so many words, so that their order doesn't matter.
PARTS, UNIT = float(1 << 20), 1024
#: Rows in which the weights of all tasks reach the driver.
SUMS = 32


def parsed(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, class of its ending, its bytes, first word of each row and the end)."""
    words = tk.Words(buf, offsets)
    rolling = tk.Rolling(tk.BYTE_SYMBOL[buf])
    ending = tk.mix(rolling.of(np.maximum(words.starts, words.ends - 3), words.ends))
    return tk.mix(rolling.of(words.starts, words.ends)), (ending % np.uint64(ENDINGS)).astype(np.int32), words.ends - words.starts, words.bounds


def _parts(column: pa.Array) -> Iterator[tuple]:
    """(first row, end, *parsed words) of slices of a text column."""
    buf, offsets = tk.flat(column)
    for i, j in tk.slices(offsets):
        yield i, j, *parsed(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (64-bit hash), ending, n over all texts, added up in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, endings, held = [], [], 0

        def counted() -> pa.RecordBatch:
            word, at, n = np.unique(np.concatenate(words), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.concatenate(endings)[at]), pa.array(n)], ["word", "ending", "n"])

        for batch in batches:
            for _, _, word, ending, _, _ in _parts(batch.column(0)):
                words.append(word)
                endings.append(ending)
                held += len(word)
                if held > COUNTED:
                    yield counted()
                    words, endings, held = [], [], 0
        if held:
            yield counted()

    return docs.select(text_col).mapInArrow(run, "word long, ending int, n long").groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


class Coder:
    """Classes of words: the place among the frequent ones (sorted hashes), or by ending."""

    def __init__(self, frequent: list[int]):
        self.frequent = np.sort(np.array(frequent, np.int64).view(np.uint64))

    def classes(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = FREQUENT + ending
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, word), len(self.frequent) - 1)
            known = self.frequent[at] == word
            out[known] = at[known]
        return out


def contexts(classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Classes around each word, one column an offset; CLASSES stands beyond the document's ends."""
    out = np.full((len(classes), len(OFFSETS)), CLASSES, np.int32)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for k, d in enumerate(OFFSETS):
        here, there = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        same = row[here] == row[there]
        out[here, k][same] = classes[there][same]
    return out


def depth_for(types: int) -> int:
    """Digits below an ending for so many different words."""
    return max(1, -(-int(np.ceil(np.log2(max(1, types) / (ENDINGS * LEAF)))) // BITS))


def priors_of(cells: np.ndarray, depth: int) -> list[np.ndarray]:
    """Log counts (and one) by prefix and digit, for each digit that starts from counts; cells: words below each ending and its first digits."""
    out = []
    for _ in range(min(depth, COUNTED_DIGITS)):
        out.append(np.log(cells.reshape(ENDINGS, FAN, -1) + 1).astype(np.float32))  # the last digit stands first within an ending
        cells = cells.reshape(ENDINGS, FAN, -1).sum(axis=1)
    return [p.transpose(0, 2, 1).reshape(-1, FAN) for p in out[::-1]]


class Net:
    """Tables of hidden inputs (one an offset), a tanh layer, a softmax over the classes, and one for each digit."""

    @staticmethod
    def shapes(depth: int) -> list[tuple[int, ...]]:
        return [(len(OFFSETS), CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (HIDDEN, CLASSES), (CLASSES,), (depth, HIDDEN, FAN), (depth, FAN)]

    @staticmethod
    def size(depth: int) -> int:
        return sum(int(np.prod(s)) for s in Net.shapes(depth))

    def __init__(self, flat: np.ndarray, depth: int, priors: list[np.ndarray]):
        self.parts, self.depth, self.priors, at = [], depth, priors, 0
        for shape in self.shapes(depth):
            size = int(np.prod(shape))
            self.parts.append(flat[at : at + size].astype(np.float32).reshape(shape))
            at += size

    @staticmethod
    def fresh(depth: int) -> np.ndarray:
        rng = np.random.default_rng(9)
        # small chance weights for the hidden layer and the classes, none for biases and digits
        return np.concatenate([rng.normal(0, 0.1, int(np.prod(s))) if k in (0, 1, 2, 4) else np.zeros(int(np.prod(s))) for k, s in enumerate(Net.shapes(depth))])

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        tables, b1 = self.parts[:2]
        out = tables[0].take(around[:, 0], axis=0)
        for k in range(1, len(OFFSETS)):
            out += tables[k].take(around[:, k], axis=0)
        out += b1
        return np.tanh(out, out=out)

    def in_group(self, g: int, hidden: np.ndarray) -> np.ndarray:
        """Logits of the classes of group g."""
        part = slice(g * FAN, (g + 1) * FAN)
        return hidden @ self.parts[4][:, part] + self.parts[5][part]

    def steps(self, hidden: np.ndarray, ending: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(digit's place, logits, the digit) for words with an ending, by the low bits of their hashes."""
        weights, bias = self.parts[6:]
        for k in range(self.depth):
            logits = hidden @ weights[k]
            logits += bias[k]
            if k < len(self.priors):
                logits += self.priors[k][(ending << (BITS * k)) + (low & ((1 << (BITS * k)) - 1))]
            yield k, logits, (low >> (BITS * k)) & (FAN - 1)

    def bounded(self) -> bool:
        """Whether no logit is so large that its exponential isn't a float32; hidden values are within 1."""
        _, _, wg, bg, w2, b2, weights, bias = self.parts
        most = max((np.abs(w).sum(axis=0) + np.abs(b)).max() for w, b in ((wg, bg), (w2, b2)))
        return bool(max(most, (np.abs(weights).sum(axis=1) + np.abs(bias)).max() + max(p.max() for p in self.priors)) < 80)

    def log_probs(self, around: np.ndarray, target: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Log-probability of each word's class and digits."""
        out, safe = np.empty(len(target)), self.bounded()
        for i in range(0, len(target), BATCH):
            t, hidden = target[i : i + BATCH], self.hidden(around[i : i + BATCH])
            found = _log_share(hidden @ self.parts[2] + self.parts[3], t // FAN, safe)
            for g, mine in _by_group(t):
                found[mine] += _log_share(self.in_group(g, hidden.take(mine, axis=0)), t[mine] - g * FAN, safe)
            plain = np.flatnonzero(t >= FREQUENT)
            for _, logits, digit in self.steps(hidden.take(plain, axis=0), t[plain] - FREQUENT, low[i + plain]):
                found[plain] += _log_share(logits, digit, safe)
            out[i : i + BATCH] = found
        return out

    def train(self, around: np.ndarray, target: np.ndarray, low: np.ndarray, squares: list[np.ndarray]) -> None:
        _, _, wg, bg, w2, _, weights, _ = self.parts
        for i in range(0, len(target), BATCH):
            c, t = around[i : i + BATCH], target[i : i + BATCH]
            n, safe, hidden = len(t), self.bounded(), self.hidden(c)
            grads = [np.zeros_like(p) for p in self.parts]
            wrong = hidden @ wg + bg
            _error(wrong, t // FAN, n, safe)
            back = wrong @ wg.T
            grads[2], grads[3] = hidden.T @ wrong, wrong.sum(axis=0)
            for g, mine in _by_group(t):
                seen, part = hidden.take(mine, axis=0), slice(g * FAN, (g + 1) * FAN)
                wrong = self.in_group(g, seen)
                _error(wrong, t[mine] - g * FAN, n, safe)
                back[mine] += wrong @ w2[:, part].T
                grads[4][:, part], grads[5][part] = seen.T @ wrong, wrong.sum(axis=0)
            plain = np.flatnonzero(t >= FREQUENT)
            seen = hidden.take(plain, axis=0)
            up = np.zeros_like(seen)
            for k, wrong, digit in self.steps(seen, t[plain] - FREQUENT, low[i + plain]):
                _error(wrong, digit, n, safe)
                up += wrong @ weights[k].T
                grads[6][k], grads[7][k] = seen.T @ wrong, wrong.sum(axis=0)
            back[plain] += up
            back *= 1 - hidden * hidden
            grads[1] = back.sum(axis=0)
            for k in range(len(OFFSETS)):
                # rows of one class together: a byte each, so that the sort is by counting
                order = np.argsort(c[:, k].astype(np.uint8), kind="stable")
                classes = c[order, k]
                starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.diff(classes)) + 1])
                grads[0][k][classes[starts]] = np.add.reduceat(back.take(order, axis=0), starts, axis=0)
            for p, g, s in zip(self.parts, grads, squares):
                s += g * g
                p -= RATE * g / (np.sqrt(s) + 1e-6)


def _by_group(classes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places of its classes)."""
    group = (classes // FAN).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for g in range(GROUPS):
        if bounds[g] < bounds[g + 1]:
            yield g, order[bounds[g] : bounds[g + 1]]


def _log_share(logits: np.ndarray, chosen: np.ndarray, safe: bool) -> np.ndarray:
    """log softmax at chosen; spoils logits. safe: none of them is large."""
    own = logits[np.arange(len(logits)), chosen]
    if not safe:
        top = logits.max(axis=1, keepdims=True)
        logits -= top
        own = own - top[:, 0]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def _error(logits: np.ndarray, chosen: np.ndarray, n: int, safe: bool) -> None:
    """Makes logits the gradient of the mean log loss over n words."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (1 / (n * (logits @ np.ones(logits.shape[1], logits.dtype))))[:, None]
    logits[np.arange(len(logits)), chosen] -= np.float32(1 / n)


@dataclass
class Model:
    """What a fit gathers for all tasks; the counts of all words stay in a table."""

    frequent: list[int]
    held: np.ndarray  # hashes of the most frequent words, sorted
    counts: np.ndarray  # of those
    whole: np.ndarray  # words and different words in the leaf of each of those
    depth: int  # digits
    priors: list[np.ndarray]
    weights: np.ndarray


def _low(word, depth: int):
    """The low bits of a word's hash (a column) that its digits are made of."""
    return word.bitwiseAND(F.lit((1 << (BITS * depth)) - 1))


def with_leaves(counts: DataFrame, frequent: list[int], depth: int) -> DataFrame:
    """The counts of all words but the frequent ones, with whole: words and different words in their leaf."""
    rest = counts.filter(~F.col("word").isin(frequent)) if frequent else counts
    leaf = Window.partitionBy("ending", _low(F.col("word"), depth))  # LEAF different words, about
    return stored(rest.withColumn("whole", F.sum("n").over(leaf) + F.count("*").over(leaf)))


def fit(docs: DataFrame, id_col: str, text_col: str, counts: DataFrame) -> tuple[Model, DataFrame]:
    """(the model, with_leaves() of counts). counts: the documents' word_counts(), read more than once."""
    frequent = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    types, total = counts.agg(F.count("*"), F.sum("n")).first()
    depth = depth_for(types)
    leaves = with_leaves(counts, frequent, depth)
    # the greatest counts that no more than HELD words have: by sizes, of which there are few
    size = F.floor(F.log2("n") * 16)
    least, have = None, 0
    for r in leaves.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        have += r["count"]
        if have > HELD:
            break
        least = r["size"]
    top = leaves.filter(size >= least if least is not None else F.lit(False)).select("word", "n", "whole").toPandas()
    order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    words, n, whole = (top[c].to_numpy(np.int64)[order] for c in ("word", "n", "whole"))
    counted = min(depth, COUNTED_DIGITS)
    cells = np.zeros(ENDINGS << (BITS * counted))
    for r in leaves.groupBy("ending", _low(F.col("word"), counted).alias("low")).agg(F.sum("n").alias("n")).collect():  # as many as there are cells
        cells[(r["ending"] << (BITS * counted)) + r["low"]] = r["n"]
    priors, blocks = priors_of(cells, depth), max(1, -(-int(total or 0) // BLOCK))
    weights = train(coded(docs, id_col, text_col, Coder(frequent), blocks, depth), depth, priors)
    return Model(frequent, words.view(np.uint64), n, whole, depth, priors, weights), leaves


def coded(docs: DataFrame, id_col: str, text_col: str, coder: Coder, blocks: int, depth: int) -> DataFrame:
    """block, key, codes, digits of every text with a word: its words' classes, a byte each, and the low bits of their hashes, some bytes each."""
    wide = -(-BITS * depth // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, word, ending, _, bounds in _parts(batch.column(2)):
                classes = coder.classes(word, ending)
                low = np.where(classes < FREQUENT, np.uint64(0), word & np.uint64((1 << (BITS * depth)) - 1)).astype("<u8")
                full = pa.array(np.flatnonzero(np.diff(bounds)))
                texts = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(classes.astype(np.uint8))])
                digits = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((bounds * wide).astype(np.int32)), pa.py_buffer(low.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes())])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).take(full) for c in (0, 1)), texts.take(full), digits.take(full)], ["block", "key", "codes", "digits"])

    key = F.xxhash64(F.col(id_col), F.col(text_col))
    block = F.pmod(F.shiftrightunsigned(key, 20), F.lit(blocks)).cast("int")
    return stored(docs.select(block.alias("block"), key.alias("key"), text_col).mapInArrow(run, "block int, key long, codes binary, digits binary"))


def decoded(digits: np.ndarray, wide: int) -> np.ndarray:
    """Low bits of hashes from `wide` bytes each."""
    out = np.zeros(len(digits) // wide, np.int64)
    for k in range(wide):
        out |= digits[k::wide].astype(np.int64) << (8 * k)
    return out


def train(texts: DataFrame, depth: int, priors: list[np.ndarray]) -> np.ndarray:
    """Weights fitted to coded texts, block by block."""
    spark, wide, size = texts.sparkSession, -(-BITS * depth // 8), Net.size(depth)
    weights, known = Net.fresh(depth), spark.sparkContext.broadcast(priors)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(weights)

        def run(table: pa.Table) -> pa.Table:
            net, seen = Net(start.value, depth, known.value), 0
            squares = [np.full_like(p, 1e-4) for p in net.parts]
            order = pa.array(np.argsort(table.column("key").to_numpy(), kind="stable"))
            buf, offsets = tk.flat(table.column("codes").combine_chunks().take(order))
            digits, _ = tk.flat(table.column("digits").combine_chunks().take(order))
            for i, j in tk.slices(offsets):
                classes = buf[offsets[i] : offsets[j]].astype(np.int32)
                net.train(contexts(classes, offsets[i : j + 1] - offsets[i]), classes, decoded(digits[offsets[i] * wide : offsets[j] * wide], wide), squares)
                seen += len(classes)
            seen = -(-seen // UNIT)
            values = np.rint(net.flat() * PARTS).astype(np.int64) * seen
            return pa.table({"seen": pa.array([seen]), "sums": pa.array([values], pa.list_(pa.int64()))})

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, sums = 0, np.zeros(size, np.int64)
            for batch in batches:
                seen += sum(batch.column("seen").to_pylist())
                sums += batch.column("sums").flatten().to_numpy().reshape(-1, size).sum(axis=0)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([sums], pa.list_(pa.int64()))], ["seen", "sums"])

        kind = "seen long, sums array<long>"
        found = texts.filter(F.pmod("block", F.lit(ROUNDS)) == turn).groupBy("block").applyInArrow(run, kind)
        found = found.mapInArrow(added, kind).repartition(SUMS).mapInArrow(added, kind).collect()
        if seen := sum(r["seen"] for r in found):
            weights = np.array([sum(x) for x in zip(*(r["sums"] for r in found))], float) / seen / PARTS
    return weights


def judged(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """id, key, n_tokens, known (log-probability without the last step of words whose count isn't held), others (those: word, n, length, own: the document's words in its leaf)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    coder = Coder(model.frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        net, mask = Net(m.weights, m.depth, m.priors), np.uint64((1 << (BITS * m.depth)) - 1)
        for batch in batches:
            for i, j, word, ending, length, bounds in _parts(batch.column(2)):
                classes = coder.classes(word, ending.copy())
                low = (word & mask).astype(np.int64)
                sums = np.concatenate([[0.0], np.cumsum(net.log_probs(contexts(classes, bounds), classes, low))])
                total = sums[bounds[1:]] - sums[bounds[:-1]]
                row = np.repeat(np.arange(j - i), np.diff(bounds))
                plain = np.flatnonzero(classes >= FREQUENT)
                # each different word of a document
                which = np.unique(word[plain], return_inverse=True)[1]
                _, at, n = np.unique(row[plain] * (len(which) + 1) + which, return_index=True, return_counts=True)
                at = plain[at]
                # the document's own words in the leaf of each
                leaf = np.unique(((ending[at].astype(np.int64) << (BITS * m.depth)) | low[at]), return_inverse=True)[1]
                cell = np.unique(row[at] * (len(leaf) + 1) + leaf, return_inverse=True)[1]
                own = np.bincount(cell, n)[cell].astype(np.int64) if len(at) else n
                place = np.minimum(np.searchsorted(m.held, word[at]), len(m.held) - 1) if len(m.held) else np.zeros(0, np.int64)
                held = m.held[place] == word[at]
                here = at[held]
                elsewhere = m.counts[place[held]] - n[held]
                last = np.where(elsewhere > 0, np.log(np.maximum(elsewhere, 1)), length[here] * np.log(LETTER)) - np.log(m.whole[place[held]] - own[held])
                total += np.bincount(row[here], n[held] * last, j - i)
                far = at[~held]
                bound = np.searchsorted(row[far], np.arange(j - i + 1)).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(word[far].view(np.int64)), pa.array(n[~held].astype(np.int32)), pa.array(length[far].astype(np.int32)), pa.array(own[~held].astype(np.int32))], ["word", "n", "length", "own"])
                others = pa.ListArray.from_arrays(pa.array(bound), fields)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(np.diff(bounds)), pa.array(total), others], ["id", "key", "n_tokens", "known", "others"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), text_col)
    return stored(rows.mapInArrow(run, f"id {kind}, key long, n_tokens long, known double, others array<struct<word:long,n:int,length:int,own:int>>"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, log_prob (summed), mean_log_prob (null without words) of every row.

    The model is fitted to the same documents; a document's own words are taken out of the
    counts that judge it. A null or empty text has no words and log_prob 0. Repeated rows
    count, and each counts as a document for the others; other columns are not read. Sums
    are rounded to four digits.
    """
    counts = stored(word_counts(docs, text_col))
    model, leaves = fit(docs, id_col, text_col, counts)
    d = judged(docs, id_col, text_col, model)
    rest = d.select("key", F.explode("others").alias("o")).select("key", "o.*")  # words beyond the HELD most frequent
    rest = rest.join(leaves.select("word", F.col("n").alias("total"), "whole"), "word").withColumn("e", F.col("total") - F.col("n"))
    value = F.col("n") * (F.when(F.col("e") > 0, F.log("e")).otherwise(F.col("length") * float(np.log(LETTER))) - F.log(F.col("whole") - F.col("own")))
    # rows that repeat another one share a key, and the sum over all of them; integers, so that their order doesn't matter
    sums = rest.groupBy("key").agg(F.sum((value * float(1 << 24)).cast("long")).alias("s"))
    same = d.groupBy("key").agg(F.count("*").alias("rows"))
    found = d.select("id", "key", "n_tokens", "known").join(sums.join(same, "key"), "key", "left")
    total = F.col("known") + F.coalesce(F.col("s") / F.col("rows") / float(1 << 24), F.lit(0.0))
    return found.select(
        F.col("id").alias(id_col), "n_tokens", F.round(total, 4).alias("log_prob"), F.when(F.col("n_tokens") > 0, F.round(total / F.col("n_tokens"), 4)).alias("mean_log_prob")
    )
