"""Windows that occur more than once in a corpus: the part that operators 4 and 5 share.

A window is `length` consecutive symbols (words or bytes) of one document. Winnowing gives
each window an anchor that depends on its content alone, so equal windows have equal
anchors. Consecutive windows with one anchor form a segment. Segments whose anchor occurs
once in the corpus can't hold a repeated window and are dropped; equal segments collapse
into one with a count. The rest is dealt to shards by anchor, so all copies of a window
are in one shard, and each shard is searched exactly by the operator's own index. What it
reports goes back to all places of each segment.

An anchor with very many different segments is not put into one shard: its segments are
cut up by where the anchor stands in their windows. Windows of one piece all hold the same
stretch around the anchor; that stretch and its place are the piece's own anchor, by which
pieces are dealt, counted and searched like segments. Should that be a hot anchor too, the
pieces are cut down to single windows, of which equal ones are one piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import textkernel as tk

#: Different segments of one anchor beyond which they are cut up.
HOT = 2000
#: Parts into which the places of an anchor in its windows are cut first; then each place is a part.
PARTS = 7


@dataclass(frozen=True)
class Kind:
    """How documents are read: as words or as bytes."""

    words: bool
    length: int  # symbols in a window
    gram: int  # symbols in an anchor
    shard: int  # symbols in a shard, about
    search: Callable  # (segments, sizes, counts) -> flags of all their windows

    def symbols(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            found = tk.Words(buf, offsets)
            return found.hashes(), found.bounds
        return tk.BYTE_SYMBOL[buf], offsets


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _key, _text. _key stands for a row; equal rows share it and are edited alike."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text).alias("_key"), text.alias("_text"))


def segments(d: DataFrame, kind: Kind) -> DataFrame:
    """anchor, body, key, lo, n of each segment, and the anchor's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            buf, offsets = tk.flat(batch.column(1))
            for i, j in tk.slices(offsets):
                symbols, bounds = kind.symbols(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = tk.anchored(symbols, bounds, kind.length, kind.gram)
                if len(found["row"]):
                    yield pa.RecordBatch.from_arrays([pa.array(found["anchor"].view(np.int64)), pa.array(found["body"].view(np.int64)), pa.array(keys[i + found["row"]]), pa.array(found["lo"].astype(np.int32)), pa.array(found["n"].astype(np.int16)), pa.array(found["spot"].astype(np.int16))], ["anchor", "body", "key", "lo", "n", "spot"])

    return d.select("_key", "_text").mapInArrow(run, "anchor long, body long, key long, lo int, n short, spot short")


def _pieces(batch: pa.RecordBatch, kind: Kind) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per row: its number, its bytes, and the byte starts and ends of its words (bytes: None)."""
    buf, offsets = tk.flat(batch.column("_text"))
    for i in range(len(offsets) - 1):
        part = buf[offsets[i] : offsets[i + 1]]
        if kind.words:
            found = tk.Words(part, np.array([0, len(part)]))
            yield i, part, found.starts, found.ends
        else:
            yield i, part, None, None


def _asked(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.StructArray]:
    """(list offsets, flat structs) of a list column without null lists."""
    lists = batch.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets)
    return offsets - offsets[0], lists.flatten()


def texts(d: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """wanted (anchor, body, bodies, count, key, lo, n, spot) without key and lo, and with the bytes of each segment."""
    same = ["anchor", "body", "bodies", "count", "n", "spot"]
    asked = wanted.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("lo", *same)).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = _asked(batch, "asked")
            lo, n = flat.field("lo").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
            out = []
            for i, part, starts, ends in _pieces(batch, kind):
                data = part.tobytes()
                for k in range(offsets[i], offsets[i + 1]):
                    a, b = lo[k], lo[k] + n[k] + kind.length - 1
                    out.append(data[starts[a] : ends[b - 1]] if kind.words else data[a:b])
            yield pa.RecordBatch.from_arrays([*map(flat.field, same), pa.array(out, pa.binary())], [*same, "segment"])

    return d.join(asked.hint("shuffle_hash"), "_key").mapInArrow(run, "anchor long, body long, bodies long, count long, n short, spot short, segment binary")


def _runs(flags: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows within rows: (row, first symbol, end symbol)."""
    inner = np.zeros(len(flags) + 1, bool)
    inner[bounds] = True
    before = np.concatenate([[False], flags[:-1]]) & ~inner[:-1]
    after = np.concatenate([flags[1:], [False]]) & ~inner[1:]
    first, last = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
    row = np.searchsorted(bounds, first, "right") - 1
    return row, first - bounds[row], last - bounds[row] + length


def searched(found: DataFrame, kind: Kind) -> DataFrame:
    """anchor, body and spans (from, until; symbols after the segment's first) of repeated windows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table.column("n").to_numpy().astype(np.int64)
        flags = kind.search(table.column("segment").combine_chunks(), n, table.column("count").to_numpy())
        bounds = np.concatenate([[0], np.cumsum(n)])
        row, a, b = _runs(flags, bounds, kind.length)
        have, first = np.unique(row, return_index=True)
        spans = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["a", "b"])
        at = pa.array(have)
        return pa.table({"anchor": table.column("anchor").take(at), "body": table.column("body").take(at), "spans": pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), spans)})

    return found.groupBy("shard").applyInArrow(run, "anchor long, body long, spans array<struct<a:int,b:int>>")


def cut_up(hot: DataFrame, kind: Kind, width: int) -> DataFrame:
    """Segments with their bytes in pieces: anchor, body, count, shift, sub, sub_body, n, spot, segment.

    A piece holds the windows in which the anchor stands at `width` neighbouring places. Its
    own anchor `sub` is the hash of what all such windows share, with that place; shift is
    its first window's place in the segment.
    """
    some = np.uint64(0xD6E8FEB86659FD93)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spot = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "spot"))
            of, shift, size, stands, sub, sub_body, out = [], [], [], [], [], [], []
            for k, data in enumerate(batch.column("segment")):
                data = data.as_py()
                text = np.frombuffer(data, np.uint8)
                bounds = np.array([0, len(text)])
                words = tk.Words(text, bounds) if kind.words else None
                rolling = tk.Rolling(kind.symbols(text, bounds)[0])
                block = (spot[k] - np.arange(n[k])) // width
                head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                tail = np.append(head[1:], n[k])
                stand = spot[k] - block[head] * width
                own = tk.mix(rolling.of(stand, stand - width + 1 + kind.length) ^ (block[head].astype(np.uint64) * some) ^ np.uint64(width))
                of.append(np.full(len(head), k))
                shift.append(head)
                size.append(tail - head)
                stands.append(spot[k] - head)
                sub.append(own)
                sub_body.append(tk.mix(rolling.of(head, tail + kind.length - 1) ^ (tail - head).astype(np.uint64) * some ^ own))
                for a, b in zip(head.tolist(), (tail + kind.length - 1).tolist()):
                    out.append(data[words.starts[a] : words.ends[b - 1]] if kind.words else data[a:b])
            if of:
                at = pa.array(np.concatenate(of))
                longs = [pa.array(np.concatenate(x).view(np.int64)) for x in (sub, sub_body)]
                shorts = [pa.array(np.concatenate(x).astype(np.int16)) for x in (size, stands)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("anchor", "body", "count")), pa.array(np.concatenate(shift).astype(np.int32)), *longs, *shorts, pa.array(out, pa.binary())], ["anchor", "body", "count", "shift", "sub", "sub_body", "n", "spot", "segment"])

    return hot.mapInArrow(run, "anchor long, body long, count long, shift int, sub long, sub_body long, n short, spot short, segment binary")


def repeated_in(once: DataFrame, kind: Kind, widths: list[int], with_texts: Callable = lambda x: x) -> DataFrame:
    """anchor, body and spans of repeated windows; once: the different segments with their counts.

    The only segment of its anchor is repeated as a whole if it occurs twice, and needs no search.
    """
    anchors = cut(once.groupBy("anchor").agg(F.count("*").alias("bodies"), F.sum("n").alias("places")))
    some = anchors.filter(F.col("bodies").between(2, HOT))
    total = some.agg(F.sum(F.col("places") + F.col("bodies") * kind.length)).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // kind.shard)))).cast("int")
    marked = once.join(anchors.select("anchor", "bodies"), "anchor")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + kind.length - 1).cast("int").alias("b")))
    spans = marked.filter("bodies = 1 and count > 1").select("anchor", "body", whole.alias("spans"))
    more = with_texts(marked.filter("bodies > 1"))
    spans = spans.unionByName(searched(more.filter(F.col("bodies") <= HOT).withColumn("shard", shard), kind))
    if anchors.filter(F.col("bodies") > HOT).isEmpty():
        return spans
    parts = cut(cut_up(more.filter(F.col("bodies") > HOT), kind, widths[0]))
    pieces = parts.groupBy(F.col("sub").alias("anchor"), F.col("sub_body").alias("body")).agg(F.sum("count").alias("count"), F.max("n").alias("n"), F.max("spot").alias("spot"), F.any_value("segment").alias("segment"))
    found = repeated_in(cut(pieces), kind, widths[1:]).withColumnsRenamed({"anchor": "sub", "body": "sub_body"})
    moved = F.transform("spans", lambda x: F.struct((x["a"] + F.col("shift")).alias("a"), (x["b"] + F.col("shift")).alias("b")))
    hit = parts.join(found, ["sub", "sub_body"]).select("anchor", "body", moved.alias("spans"))
    return spans.unionByName(hit.groupBy("anchor", "body").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def repeated(d: DataFrame, kind: Kind) -> DataFrame:
    """_key and spans (from, until; in symbols of the document; may overlap) of repeated windows."""
    found = segments(d, kind)
    shared = cut(found.groupBy("anchor").count().filter("count > 1").select("anchor"))
    near = cut(found.join(shared, "anchor"))
    once = cut(near.groupBy("anchor", "body").agg(F.count("*").alias("count"), F.min("key").alias("key"), F.min_by("lo", "key").alias("lo"), F.max("n").alias("n"), F.max("spot").alias("spot")))
    spans = repeated_in(once, kind, [-(-(kind.length - kind.gram + 1) // PARTS), 1], lambda wanted: cut(texts(d, wanted, kind)))
    placed = near.join(spans, ["anchor", "body"]).select(F.col("key").alias("_key"), "lo", "spans")
    return placed.groupBy("_key").agg(F.collect_list(F.struct("lo", "spans")).alias("_found"))


def removed(docs: DataFrame, kind: Kind, id_col: str, text_col: str) -> DataFrame:
    """id_col, size (symbols), n_removed, n_spans (maximal removed runs), kept (binary) of every row."""
    d = keyed(docs, id_col, text_col)
    found = repeated(d, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, runs, kept = [], [], [], []
            places = batch.column("_found")
            for i, part, starts, ends in _pieces(batch, kind):
                size = len(starts) if kind.words else len(part)
                mark = np.zeros(size, bool)
                if places[i].is_valid:
                    one = places[i].values
                    lo, lists = one.field("lo").to_numpy().astype(np.int64), one.field("spans")
                    flat = lists.flatten()
                    base = np.repeat(lo, np.diff(np.asarray(lists.offsets)))
                    mark = tk.covered(base + flat.field("a").to_numpy(), base + flat.field("b").to_numpy(), size)
                sizes.append(size)
                gone.append(int(mark.sum()))
                runs.append(int(mark[0]) + int((mark[1:] & ~mark[:-1]).sum()) if size else 0)
                if not kind.words:
                    kept.append(part[~mark].tobytes() if gone[-1] else part.tobytes())
                else:
                    # kept words and one space after each but the last: all bytes of a word, or the byte behind it
                    steps = np.zeros(len(part) + 2, np.int8)
                    left = ~mark
                    steps[starts[left]] += 1
                    steps[ends[left] + 1] -= 1
                    data = np.append(part, np.uint8(32))
                    data[ends] = 32
                    chosen = data[np.cumsum(steps[:-1]) > 0]
                    kept.append(chosen[:-1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(x, pa.int64()) for x in (sizes, gone, runs)], pa.array(kept, pa.binary())], [id_col, "size", "n_removed", "n_spans", "kept"])

    whole = d.join(found.hint("shuffle_hash"), "_key", "left")
    type_name = docs.schema[id_col].dataType.simpleString()
    return whole.mapInArrow(run, f"`{id_col}` {type_name}, size long, n_removed long, n_spans long, kept binary")
