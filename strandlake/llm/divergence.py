"""Source divergence audit by a recount through minimal perfect hashes (operator 12).

The first pass counts exactly in how many documents of a language each term stands; terms
of enough documents are kept. They are dealt to shards by hash, and each shard gets a
minimal perfect hash (levels of bit arrays: a term takes the first level at which nobody
else of its shard wants its bit; its slot is the rank of that bit) with the terms
themselves stored in slot order. The shards are broadcast, in rounds of bounded size. The
second pass looks every word up, compares it with the stored term of its slot, and adds
to dense slots of its group (language and source). From the sums come smoothed shares in
billionths, in integers throughout.

Documents without a text count for their group; null languages and sources are ''.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut, stored

#: Documents of a language that a kept term stands in at least; what is added to each count; the whole of the shares.
LEAST_DOCS, PRIOR, WHOLE = 30, 5, 1_000_000_000
#: Ranks of the part `term`.
TOP = 50
#: Terms of a shard, about; bytes of shards that are broadcast at once; bytes of text, counted terms and dense slots that a task holds.
SHARD, ROUND_BYTES, SLICE, HELD_TERMS, HELD_SLOTS = 1 << 14, 64 << 20, 8 << 20, 1 << 18, 1 << 23
#: Sources and slots of a block of the pairwise sums.
SOURCES, SLOTS = 256, 2048
#: Levels after which the terms left are listed.
LEVELS = 40

#: ASCII letters in lower case; other ASCII characters part terms; all bytes of other characters stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    # not split(), which takes other control characters for white space as well; those are spaces by now
    return text.translate(TERM_BYTES).split()


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of h for every level."""
    with np.errstate(over="ignore"):
        x = h ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed(keys: list[bytes]) -> np.ndarray:
    """XXH64 with seed 42, as Spark's xxhash64."""
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))


class PerfectHash:
    """A minimal perfect hash of distinct keys with the keys in slot order."""

    def __init__(self, levels: list[np.ndarray], keys: pa.Array):
        self.levels, self.keys = levels, keys
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits, dtype=np.int64) - bits)
            before += int(bits.sum())
        #: keys that no level tells apart, such as those of one hash
        self.tail = {k: before + i for i, k in enumerate(keys.slice(before).to_pylist())}

    @staticmethod
    def build(keys: list[bytes], most: int) -> PerfectHash:
        """most: levels at most; what those don't tell apart is listed."""
        keys = sorted(keys)  # the same slots in whatever order they come
        h, left, levels, order = hashed(keys), np.arange(len(keys)), [], []
        for level in range(most):
            if not len(left):
                break
            size = 2 * len(left)
            at = (_mixed(h[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            mine = alone[at]
            levels.append(alone)
            order.append(left[mine][np.argsort(at[mine])])
            left = left[~mine]
        slots = np.concatenate([*order, left]) if len(keys) else left
        return PerfectHash(levels, pa.array([keys[i] for i in slots.tolist()], pa.binary()))

    def slots(self, keys: list[bytes], h: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for what isn't a key: its stored key differs."""
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_mixed(h[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        if len(found):
            same = pc.equal(self.keys.take(pa.array(out[found])), pa.array([keys[i] for i in found.tolist()], pa.binary()))
            out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        if self.tail:
            for i in left.tolist():
                out[i] = self.tail.get(keys[i], -1)
        return out

    def packed(self) -> dict:
        return {"sizes": [len(b) for b in self.levels], "bits": [np.packbits(b).tobytes() for b in self.levels], "keys": self.keys.to_pylist()}

    @staticmethod
    def unpacked(sizes, bits, keys) -> PerfectHash:
        return PerfectHash([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(sizes, bits)], pa.array([bytes(k) for k in keys], pa.binary()))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, ...], bytes]]:
    """(labels, text) of every row of text and labels."""
    labels = [c.to_pylist() for c in batch.columns[1:]]
    for i, text in enumerate(batch.column(0)):
        raw = text.as_buffer()
        yield tuple(c[i] for c in labels), raw.to_pybytes() if raw is not None else b""


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term (binary), n: documents of the language with the term. docs: text, lang."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(c)), pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for (lang,), text in _texts(batch):
                held.setdefault(lang, Counter()).update(set(terms(text)))
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInArrow(run, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def perfect_hashes(kept: DataFrame) -> DataFrame:
    """lang, shard, shards, base (slots of the language's earlier shards), n, and the packed hash. kept: lang, term."""
    sizes = broadcast_if_small(cut(kept.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SHARD)).cast("int").alias("shards"))))
    dealt = kept.join(sizes, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))

    def run(one: pd.DataFrame) -> pd.DataFrame:
        made = PerfectHash.build([bytes(t) for t in one["term"]], LEVELS)
        return pd.DataFrame([{"lang": one["lang"][0], "shard": one["shard"][0], "shards": one["shards"][0], "n": len(one), **made.packed()}])

    built = dealt.groupBy("lang", "shard").applyInPandas(run, "lang string, shard int, shards int, n long, sizes array<int>, bits array<binary>, keys array<binary>")
    built = stored(built)
    w = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = built.select("lang", "shard", "n").withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")  # a row a shard
    return built.join(base, ["lang", "shard"])


def group_counts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """lang, source, slot, n > 0: occurrences in each group of the terms that hashes hold. docs: text, lang, source. hashes should be stored."""
    spark = docs.sparkSession
    sizes = hashes.select("lang", "shard", (F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + F.octet_length(k) + 16) + 6 * F.col("n")).alias("bytes")).orderBy("lang", "shard").collect()  # a row a shard
    rounds: list[list] = [[]]
    held = 0
    for r in sizes:
        if held + r.bytes > ROUND_BYTES and rounds[-1]:
            rounds, held = [*rounds, []], 0
        rounds[-1].append((r.lang, r.shard))
        held += r.bytes
    out = None
    for one in rounds:
        wanted = spark.createDataFrame(one, "lang string, shard int")
        shared = spark.sparkContext.broadcast([tuple(r) for r in hashes.join(F.broadcast(wanted), ["lang", "shard"]).select("lang", "shard", "shards", "base", "n", "sizes", "bits", "keys").collect()])
        found = stored(_counted(docs, shared))
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def _counted(docs: DataFrame, shared) -> DataFrame:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("slot", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, dict] = {}
        for lang, shard, shards, base, n, *packed in shared.value:
            x = by_lang.setdefault(lang, {"shards": shards, "of": {}, "lo": base, "hi": base})
            x["of"][shard] = (base, PerfectHash.unpacked(*packed))
            x["lo"], x["hi"] = min(x["lo"], base), max(x["hi"], base + n)
        slots: dict[tuple[str, str], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), dense in slots.items():
                at = np.flatnonzero(dense)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(at)), pa.repeat(source, len(at)), pa.array(at + by_lang[lang]["lo"]), pa.array(dense[at])], schema=schema)
            slots.clear()

        def add(group: tuple[str, str], texts: list[bytes]) -> None:
            x = by_lang[group[0]]
            if group not in slots:
                slots[group] = np.zeros(x["hi"] - x["lo"], np.int64)
            c = Counter(terms(b" ".join(texts)))
            keys, n = list(c.keys()), np.fromiter(c.values(), np.int64, len(c))
            h = hashed(keys)
            shard = h.view(np.int64) % x["shards"]
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(part) and (s := int(shard[part[0]])) in x["of"]:
                    base, table = x["of"][s]
                    at = table.slots([keys[i] for i in part.tolist()], h[part])
                    slots[group][at[at >= 0] + (base - x["lo"])] += n[part[at >= 0]]  # distinct keys have distinct slots

        for batch in batches:
            waiting: dict[tuple[str, str], list[bytes]] = {}
            size: Counter = Counter()
            for group, text in _texts(batch):
                if group[0] in by_lang:
                    waiting.setdefault(group, []).append(text)
                    size[group] += len(text)
                    if size[group] > SLICE:
                        add(group, waiting.pop(group))
                        size[group] = 0
            for group, texts in waiting.items():
                add(group, texts)
                if sum(map(len, slots.values())) > HELD_SLOTS:
                    yield from flush()
        yield from flush()

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, slot long, n long")


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 n / total) for n <= total, in three steps of a thousand: exact in longs up to 9 * 10^15; null for a total of 0."""
    out, rest, total = F.lit(0).cast("long"), n.cast("long"), F.nullif(total.cast("long"), F.lit(0).cast("long"))
    for _ in range(3):
        top = rest * 1000
        out, rest = out * 1000 + F.call_function("div", top, total), top % total
    return out + 1


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how each source's words differ from its language's other sources.

    Of each language the V terms in least_docs of its documents or more are kept. A group
    (language, source) gives a kept term that occurs n times in it the share
    p = 1 + floor(10^9 (n + 5) / (N + 5 V)), N its occurrences of all kept terms; the
    language likewise q. Part `pair` has a row for each other source of the language, its
    value the summed absolute differences of the shares of all kept terms (0 where nothing
    is kept). Part `term` has the group's terms with p > q, p - q their value, up to rank
    top. Ranks go by value, descending, then by item in UTF-8.

    Null texts, languages and sources count as empty ones; an empty text still makes its
    group occur. Repeated rows are documents of their own. Ties in value have an order by
    item. Other columns are not read. No rows give no rows.
    """
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("text", text_col), ("lang", lang_col), ("source", source_col))])
    kept = stored(document_counts(d).filter(F.col("n") >= least_docs).select("lang", "term"))
    hashes = stored(perfect_hashes(kept))
    counts = stored(group_counts(d, hashes))
    groups = cut(d.select("lang", "source").distinct())
    size = hashes.groupBy("lang").agg(F.sum("n").alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(size, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "total"])
    groups = stored(groups.select("lang", "source", "v", (F.col("total") + PRIOR * F.col("v")).alias("whole")))
    return _pairs(counts, groups).unionByName(_terms(counts, groups, hashes, top))


def _terms(counts: DataFrame, groups: DataFrame, hashes: DataFrame, top: int) -> DataFrame:
    named = hashes.select("lang", "base", F.posexplode("keys").alias("k", "term")).select("lang", (F.col("base") + F.col("k")).alias("slot"), F.col("term").cast("string").alias("item"))
    langs = groups.groupBy("lang").agg((F.sum(F.col("whole") - PRIOR * F.col("v")) + PRIOR * F.first("v")).alias("whole"))
    q = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).join(broadcast_if_small(langs), "lang").join(named, ["lang", "slot"])
    q = q.select("lang", "slot", "item", share(F.col("n") + PRIOR, F.col("whole")).alias("q"))
    d = counts.join(broadcast_if_small(groups), ["lang", "source"]).join(q, ["lang", "slot"])
    d = d.select("lang", "source", "item", (share(F.col("n") + PRIOR, F.col("whole")) - F.col("q")).alias("value")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums of absolute differences, by blocks of sources on either side and of slots."""
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("blocks"))
    g = stored(groups.join(broadcast_if_small(cut(langs)), "lang").withColumn("block", block("source")).withColumn("p0", F.coalesce(share(F.lit(PRIOR), F.col("whole")), F.lit(0))))
    # a row of (p0, slots none) for every group and block of slots stands for the terms that it doesn't have
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("v") - 1) / SLOTS)).cast("int"))).alias("part")
    empty = F.array().cast("array<struct<slot:long,p:long>>")
    base = g.select("lang", "source", "block", "blocks", "v", "p0", parts)
    filled = counts.join(broadcast_if_small(g), ["lang", "source"]).select("lang", "source", F.floor(F.col("slot") / SLOTS).cast("int").alias("part"), (F.col("slot") % SLOTS).alias("slot"), share(F.col("n") + PRIOR, F.col("whole")).alias("p"))
    filled = filled.groupBy("lang", "source", "part").agg(F.collect_list(F.struct("slot", "p")).alias("shares"))  # SLOTS at most
    rows = base.join(filled, ["lang", "source", "part"], "left").withColumn("shares", F.coalesce("shares", empty))
    # each pair of blocks meets once, in the lesser block's name
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = rows.select("*", other).select("lang", "part", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "source", "v", "p0", F.col("shares.slot").alias("slots"), F.col("shares.p").alias("ps"))

    def run(one: pd.DataFrame) -> pd.DataFrame:
        width = max(0, min(SLOTS, int(one["v"][0]) - int(one["part"][0]) * SLOTS))
        dense = np.repeat(one["p0"].to_numpy(np.int64)[:, None], width, 1)
        for i, (at, p) in enumerate(zip(one["slots"], one["ps"])):
            dense[i, np.asarray(at, np.int64)] = p
        x, y = int(one["x"][0]), int(one["y"][0])
        left, right = np.flatnonzero(one["block"] == x), np.flatnonzero(one["block"] == y)
        names, found = one["source"].to_numpy(), []
        for i in left.tolist():
            others = right[right != i] if x == y else right
            found.append(pd.DataFrame({"lang": one["lang"][0], "source": names[i], "item": names[others], "value": np.abs(dense[others] - dense[i]).sum(1)}))
            if x != y:
                found.append(found[-1].rename(columns={"source": "item", "item": "source"}))
        return pd.concat(found) if found else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})

    sums = met.groupBy("lang", "part", "x", "y").applyInPandas(run, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
