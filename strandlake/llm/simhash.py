"""SimHash near-duplicates (operator 6).

A text is lower-cased (A-Z), split into words at ASCII white space and cut into shingles of
a few words; a fingerprint has each bit set that is set in over half of the shingles' hashes.

near_duplicates() links 64-bit fingerprints (XXH64, seed 42, of three-word shingles) at two or
fewer differing bits, exactly. Only distinct fingerprints are compared. Two within two bits
agree on at least two of four 16-bit blocks, so each goes under its six pairs of blocks; a
bucket that is still large is dealt again by thirds of its other bits, of which one must be
equal, and if need be by thirds of those, so that no bucket can hold more than 2**15.

similar_texts() links texts whose sets of five-word shingles have Jaccard similarity 4/5 or
more. There a fingerprint has 256 bits and a wide radius, for which no block tables are
bearable: fingerprints meet under keys of sampled shingles instead, are compared like the
others, and every pair within the radius is checked exactly.

Inside a bucket the bits are stored as vertical planes; a carry-save counter per 64
comparisons adds up the differences plane by plane, and a block of comparisons is abandoned
once all in it have passed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import component_roots
from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut
from . import textkernel as tk

RADIUS = 2
#: Fingerprints in one bucket beyond which it is dealt again by its other bits.
LARGE = 4096
#: For similar texts: 64-bit words of a fingerprint, and the differing bits at which a pair is still checked. At
#: J = 4/5 bits differ at a chance of 0.15: 39 of 256, deviation 5.7, so one pair in 2000 is farther.
WORDS, WIDE_RADIUS = 4, 58
#: Keys of a text, and sampled shingles in each. At J = 4/5 a key is shared at 0.51, one of all at 0.9998.
KEYS, SAMPLED = 12, 3
LANES = np.uint64(0x0101010101010101)
PLACES = np.arange(64, dtype=np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes; an empty group has zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    firsts = np.cumsum(sizes) - sizes
    blocks = -(-sizes // 255)  # a byte lane holds 255
    block_group = np.repeat(np.arange(len(full)), blocks)
    nth = np.arange(len(block_group)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_starts = firsts[block_group] + 255 * nth
    group_starts = np.cumsum(blocks) - blocks
    bits = np.empty((len(full), 8, 8), bool)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, block_starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), group_starts, axis=0)
        bits[:, :, k] = 2 * sums > sizes[:, None]
    out[full] = (bits.reshape(-1, 64).astype(np.uint64) << PLACES).sum(axis=1, dtype=np.uint64)
    return out


def text_shingles(column: pa.Array, shingle: int = 3) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows: (first row, end, shingle hashes one row after the other, their number by row)."""
    buf, offsets = tk.flat(column)
    digest = xxhash.xxh64_intdigest
    for i, j in tk.slices(offsets):
        part = tk.LOWER[buf[offsets[i] : offsets[j]]]
        words = tk.Words(part, offsets[i : j + 1] - offsets[i])
        if not len(words.starts):
            continue
        # every run of white space becomes one space: word k then starts at the sum of what stands before it
        lengths = words.ends - words.starts
        keep = ~tk.SPACE[part]
        gap = words.starts[1:] - 1
        keep[gap[gap >= words.ends[:-1]]] = True
        close = np.flatnonzero(words.starts[1:] == words.ends[:-1])  # rows that touch without white space
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        starts[1:] -= np.cumsum(words.starts[1:] == words.ends[:-1]) if len(close) else 0
        plain = part[keep]
        plain = np.where(tk.SPACE[plain], np.uint8(32), plain)
        if words.starts[0] and tk.SPACE[part[0]]:
            plain = plain if not tk.SPACE[plain[0]] else plain[1:]
        ends = starts + lengths
        counts = np.where(words.counts >= shingle, words.counts - shingle + 1, np.minimum(words.counts, 1))
        first = np.repeat(words.bounds[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        last = np.minimum(first + shingle, np.repeat(words.bounds[1:], counts)) - 1
        data = plain.tobytes()
        hashes = np.fromiter((digest(data[s:e], 42) for s, e in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first))
        yield i, j, hashes, counts


def text_fingerprints(column: pa.Array, shingle: int = 3) -> np.ndarray:
    out = np.zeros(len(column), np.uint64)
    for i, j, hashes, counts in text_shingles(column, shingle):
        out[i:j] = majority(hashes, counts)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id_col and fp (the fingerprint as a signed long) of every row; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = text_fingerprints(batch.column(1), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def planes_of(diff: np.ndarray) -> np.ndarray:
    """64 w x n/64 words: bit planes of n differences of one or of w words each, stored vertically."""
    n = len(diff)
    diff = diff.reshape(n, -1)
    padded = np.concatenate([diff, np.full((-n % 64, diff.shape[1]), ~np.uint64(0))])
    bits = np.unpackbits(np.ascontiguousarray(padded).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within_planes(planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bits set where at most `radius` planes have a one; blocks whose bits are all beyond it are left early."""
    width = planes.shape[1]
    alive = np.arange(width)
    digits = [np.zeros(width, np.uint64) for _ in range(max(1, int(radius + 1).bit_length()))]
    over = np.zeros(width, np.uint64)
    for k in range(len(planes)):
        carry = planes[k, alive]
        for d in digits:
            carry_next = d & carry
            d ^= carry
            carry = carry_next
        over |= carry
        if k >= radius and k % 4 == 3:
            past = over | _above(digits, radius)
            left = past != ~np.uint64(0)
            if not left.all():
                alive, over = alive[left], over[left]
                digits = [d[left] for d in digits]
                if not len(alive):
                    break
    out = np.zeros(width, np.uint64)
    out[alive] = ~(over | _above(digits, radius))
    return out


def _above(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits set where the counter, digit 0 lowest, exceeds radius."""
    above = np.zeros_like(digits[0])
    equal = ~above
    for place in range(len(digits) - 1, -1, -1):
        if radius >> place & 1:
            equal = equal & digits[place]
        else:
            above = above | (equal & digits[place])
            equal = equal & ~digits[place]
    return above


def links_between(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Indices k with left[k] and right[k] within the radius."""
    if not len(left):
        return np.zeros(0, np.int64)
    hit = within_planes(planes_of(left ^ right), radius)
    return np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")[: len(left)])


def forest(groups: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows sorted by group: (fingerprint, least linked fingerprint of its tree)."""
    n = len(fps)
    label = np.arange(n)
    same = np.ones(n, bool)
    at_once = 1 << 18
    for lag in range(1, n):
        if lag == 1:
            first = np.flatnonzero(groups[1:] == groups[:-1])
        else:
            first = first[first + lag < n]
            first = first[groups[first] == groups[first + lag]]
        if not len(first):
            break
        for i in range(0, len(first), at_once):
            u = first[i : i + at_once]
            u = u[label[u] != label[u + lag]]
            u = u[links_between(fps[u], fps[u + lag], radius)]
            while len(u):  # join the trees of u and u + lag, roots hanging below lesser roots
                a, b = label[u], label[u + lag]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label != label[label]).any():
                    label = label[label]
                u = u[label[u] != label[u + lag]]
    out = np.flatnonzero(label != np.arange(n))
    return fps[out], fps[label[out]]


def in_buckets(rows: DataFrame, keys: list[str], compare, schema: str) -> DataFrame:
    """compare(table sorted by `keys`, bucket number of each row) for whole buckets, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            change = np.zeros(len(table), np.int64)
            for c in keys:
                column = table.column(c).to_numpy()
                change[1:] |= column[1:] != column[:-1]
            yield from compare(table, np.cumsum(change))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and any(batch.column(c)[batch.num_rows - 1] != held[-1].column(c)[held[-1].num_rows - 1] for c in keys):
                # all that stands before the last bucket of this batch is complete
                last = [batch.column(c)[batch.num_rows - 1] for c in keys]
                cut_at = batch.num_rows - 1
                while cut_at and all(batch.column(c)[cut_at - 1] == v for c, v in zip(keys, last)):
                    cut_at -= 1
                yield from flush(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
                held = [batch.slice(cut_at)]
            else:
                held.append(batch)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def link_buckets(keyed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """keyed: bucket (any columns), fp. Links (a, b) that span each bucket's linked parts."""

    def compare(table: pa.Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = forest(bucket, table.column("fp").to_numpy().view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return in_buckets(keyed, [c for c in keyed.columns if c != "fp"], compare, "a long, b long")


def _bits(fp, at: int, width: int):
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _dealt_again(keyed: DataFrame, name: str, widths: tuple[int, int, int]) -> DataFrame:
    """keyed: bucket columns, rest, fp. Members of buckets of over LARGE go under each third of their `rest`, which becomes the other two thirds; others stay. The bucket has one more column."""
    bucket = [c for c in keyed.columns if c not in ("rest", "fp")]
    hot = cut(keyed.groupBy(*bucket).count().filter(F.col("count") > LARGE).select(*bucket, F.lit(True).alias("_hot")))
    rest, whole, parts, at = F.col("rest"), sum(widths), [], 0
    for p, w in enumerate(widths):
        others = _bits(rest, 0, at) if at else F.lit(0).cast("long")
        others = others.bitwiseOR(F.shiftleft(F.shiftrightunsigned(_bits(rest, 0, whole), at + w), at))
        parts.append(F.struct((F.shiftleft(_bits(rest, at, w), 2).bitwiseOR(F.lit(p + 1))).alias("sub"), others.alias("rest")))
        at += w
    one = F.array(F.struct(F.lit(0).cast("long").alias("sub"), F.lit(0).cast("long").alias("rest")))
    keyed = keyed.join(broadcast_if_small(hot), bucket, "left")
    return keyed.select(*bucket, F.explode(F.when(F.col("_hot"), F.array(*parts)).otherwise(one)).alias("p"), "fp").select(*bucket, F.col("p.sub").alias(name), F.col("p.rest").alias("rest"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints `fp` within two bits."""
    fp = F.col("fp")
    tables = []
    for i, j in combinations(range(4), 2):
        k, m = (x for x in range(4) if x not in (i, j))
        pair = lambda a, b: F.shiftleft(_bits(fp, 16 * a, 16), 16).bitwiseOR(_bits(fp, 16 * b, 16))
        tables.append(F.struct(F.lit(16 * i + j).alias("tab"), pair(i, j).alias("key"), pair(k, m).alias("rest")))
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("t")).select("t.tab", "t.key", "t.rest", "fp")
    keyed = _dealt_again(keyed, "sub", (11, 11, 10))
    # of what is dealt again 21 or 22 bits are left; buckets that weren't have none and stay whole
    first, again = keyed.filter("sub = 0").withColumn("sub2", F.lit(0).cast("long")), _dealt_again(keyed.filter("sub > 0"), "sub2", (8, 7, 7))
    return link_buckets(first.unionByName(again).drop("rest"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Every row's id_col, fp (signed long), component_id: the least id that links lead to.

    Null and empty texts have fingerprint zero and link like others. Ids need not be
    distinct; a null id is kept and never names a component unless all its ids are null.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = component_roots(links(nodes.select("fp")))
    return _named(prints, id_col, "fp", nodes, roots)


def _named(rows: DataFrame, id_col: str, key: str, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """rows' id_col and key with component_id; nodes: key, least (id); roots: node, root."""
    of_key = nodes.join(roots.withColumnRenamed("node", key), key, "left").select(key, "least", F.coalesce("root", key).alias("root"))
    of_root = of_key.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of_key.join(of_root, "root").select(key, "component_id"), key).select(id_col, key, "component_id")


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows: (first row, end, distinct shingle hashes in order one row after the other, their number by row); null and empty texts have none."""
    for i, j, hashes, counts in text_shingles(column, shingle):
        row, h = np.repeat(np.arange(j - i), counts), hashes.view(np.int64)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        yield i, j, h[new], np.bincount(row[new], minlength=j - i)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """docs: id, row, text. id, row, key (a hash that equal sets share; 0 without words), n (shingles in the set), fp (WORDS longs), met (KEYS longs)."""
    rng = np.random.default_rng(1969)
    odd = rng.integers(0, 1 << 62, KEYS * SAMPLED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salts = rng.integers(0, 1 << 62, WORDS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            key, n = np.zeros(m, np.uint64), np.zeros(m, np.int32)
            fp, met = np.zeros((m, WORDS), np.uint64), np.zeros((m, KEYS), np.uint64)
            for i, j, h, sizes in shingle_sets(batch.column(2), shingle):
                n[i:j] = sizes
                full = i + np.flatnonzero(sizes)
                ends = np.cumsum(sizes[sizes > 0])
                first = ends - sizes[sizes > 0]
                key[full] = [xxhash.xxh64_intdigest(h[a:b].tobytes()) | 1 for a, b in zip(first.tolist(), ends.tolist())]
                h = h.view(np.uint64)
                for w, salt in enumerate(salts):
                    fp[i:j, w] = majority(tk.mix(h ^ salt), sizes)
                for k in range(KEYS):
                    sampled = np.full(len(full), np.uint64(k))
                    for o in odd[k * SAMPLED : (k + 1) * SAMPLED]:
                        v = h * o
                        v ^= v >> np.uint64(32)
                        sampled = tk.mix(sampled * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v * o, first))
                    met[full, k] = sampled
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(np.int64))) for x in (fp, met)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key.view(np.int64)), pa.array(n), *lists], ["id", "row", "key", "n", "fp", "met"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, row long, key long, n int, fp array<long>, met array<long>")


def with_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """docs: key, text. (key, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, sizes in shingle_sets(batch.column(1), shingle):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(h))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["key", "s"])

    return docs.mapInArrow(run, "key long, s array<long>")


def sets_of(keys: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(key, s) of keys; sets: key, row; docs: row, text. Only these texts are read again."""
    wanted = cut(keys.distinct().join(sets.select("key", "row"), "key"))
    return with_sets(docs.join(broadcast_if_small(wanted, 200_000), "row").dropDuplicates(["key"]).select("key", "text"), shingle)


def similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Of pairs (a, b) of keys those at J >= 4/5."""
    found = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("key")), sets, docs, shingle)
    left, right = (found.select(F.col("key").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return cut(both.filter(9 * F.size(F.array_intersect("s_a", "s_b")) >= 4 * (F.size("s_a") + F.size("s_b"))).select("a", "b"))


def _sizes_fit(m, n):
    """Sets of these sizes can have J = 4/5."""
    return 5 * F.least(m, n) >= 4 * F.greatest(m, n)


def links_in_buckets(apart: DataFrame) -> DataFrame:
    """apart: tab, met, c (members), key, n, fp, root, s. Links (a, b) at J >= 4/5 that join what has different roots; a bucket hands on no more links than members.

    A pair within the wide radius is checked on its sets, unless the bucket's links join it
    already. A large bucket's members are dealt to chunks, and each two chunks meet in a bucket
    of their own.
    """
    chunks = F.ceil(F.col("c") / LARGE).cast("int")
    apart = apart.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("key"), chunks).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    apart = apart.select("tab", "met", "key", "n", "fp", "root", "s", "chunk", other).withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}).drop("other")

    def compare(table: pa.Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        key, n, chunk = (table.column(c).to_numpy() for c in ("key", "n", "chunk"))
        n = n.astype(np.int64)
        # the parts of a bucket that are known to be linked
        label = np.unique(np.stack([bucket, table.column("root").to_numpy()]), axis=1, return_inverse=True)[1].ravel()
        mixed = table.column("low").to_numpy() != table.column("high").to_numpy()
        fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1)
        lists = table.column("s").combine_chunks()
        ends, values = np.asarray(lists.offsets), lists.values.to_numpy()
        first, a, b = np.arange(len(table)), [], []
        for lag in range(1, len(table)):
            first = first[first + lag < len(table)]
            first = first[bucket[first] == bucket[first + lag]]
            if not len(first):
                break
            for i in range(0, len(first), 1 << 15):
                u = first[i : i + (1 << 15)]
                v = u + lag
                fits = (label[u] != label[v]) & (5 * np.minimum(n[u], n[v]) >= 4 * np.maximum(n[u], n[v])) & (~mixed[u] | (chunk[u] != chunk[v]))
                u, v = u[fits], v[fits]
                hit = links_between(fp[u], fp[v], WIDE_RADIUS)
                for x, y in zip(u[hit].tolist(), v[hit].tolist()):
                    if label[x] == label[y]:
                        continue
                    both = len(np.intersect1d(values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]], assume_unique=True))
                    if 9 * both >= 4 * (n[x] + n[y]):
                        a.append(key[x])
                        b.append(key[y])
                        label[label == label[y]] = label[x]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return in_buckets(apart, ["tab", "met", "low", "high"], compare, "a long, b long")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """Every row's id_col and component_id: the least id that links at J >= 4/5 of shingle sets lead to.

    Of pairs at J = 4/5 one in a thousand may be missed, of closer ones fewer; what links is
    exact but for collisions of 64-bit hashes. Null and empty texts are copies of each other.
    Ids need not be distinct; a null id is kept and never names a component unless all its
    ids are null.
    """
    col = F.col
    named_rows = docs.select(col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), col(text_col).alias("text"))
    rows = cut(sketches(named_rows, shingle))
    sets = cut(rows.filter("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.any_value(F.struct("n", "fp", "met")).alias("s")).select("key", "row", "s.*"))
    keyed = sets.select("key", "n", "fp", F.posexplode("met").alias("tab", "met"))
    # each bucket's members meet its least one in an order that differs by table; what that links needs no more comparing
    stars = cut(keyed.groupBy("tab", "met").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("tab", "key").alias("o"), "key", "n", "fp")).alias("l")).filter("c > 1"))
    apart_bits = sum((F.bit_count(F.get("fp", F.lit(w)).bitwiseXOR(F.get("l.fp", F.lit(w)))) for w in range(WORDS)), F.lit(0))
    near = keyed.join(stars, ["tab", "met"])
    star = near.filter((col("key") != col("l.key")) & _sizes_fit(col("n"), col("l.n")) & (apart_bits <= WIDE_RADIUS))
    star = cut(star.select(F.least("key", "l.key").alias("a"), F.greatest("key", "l.key").alias("b")).distinct())
    texts = named_rows.select("row", "text")
    linked = similar(star, sets, texts, shingle)
    roots = component_roots(linked)
    apart = near.select("tab", "met", "c", "key", "n", "fp").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = cut(apart)
    mixed = apart.groupBy("tab", "met").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 < r2").select("tab", "met")
    apart = cut(apart.join(mixed, ["tab", "met"], "left_semi"))
    rest = links_in_buckets(apart.join(sets_of(apart.select("key"), sets, texts, shingle), "key"))
    roots = component_roots(linked.unionByName(cut(rest)))
    nodes = rows.groupBy("key").agg(F.min("id").alias("least"))
    return _named(rows.withColumnRenamed("id", id_col), id_col, "key", nodes, roots).drop("key")


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
