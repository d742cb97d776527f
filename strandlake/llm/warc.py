"""WARC archives as seekable Zstandard bundles (operator 11).

Tasks write their rows as WARC records into bundle files. Records are gathered into
independent Zstandard frames of about a MiB; behind the last frame stands the seek table of
the seekable Zstandard format, a skippable frame with the sizes of all frames. An index
maps every record to its bundle, its frame and the place within the unpacked frame, so one
record is read by one seek and the unpacking of one frame.

Bundles have names that no other attempt of a task uses, and the index is written by
Spark's own commit: what a lost or repeated attempt left behind is named nowhere.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import checkpoint_dir, cut, stored

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 1000
#: Bytes after which a frame and (packed) a bundle is closed.
FRAME, BUNDLE = 1 << 20, 256 << 20
#: Packed bytes for a task that reads; frames of a bundle that are read together.
READ, NEAR = 32 << 20, 16
#: Rows of groups of equal payloads that go to all tasks at once.
SMALL = 100_000

#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record string, bundle string, frame long, at long, size long"
SCHEMA = pa.schema([("record", pa.string()), ("bundle", pa.string()), ("frame", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path of a URI, in any store that pyarrow knows."""
    if m := re.match(r"file:/+(.*)", uri):
        return pa.fs.LocalFileSystem(), "/" + m[1]
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def record_id(value: str | None) -> str:
    return "<urn:x-no-record:>" if value is None else f"<urn:x-record:{quote(value, safe='')}>"


def named(record: str | None) -> str | None:
    """The value that record_id() was made of."""
    m = re.fullmatch(r"<urn:x-record:(.*)>", record or "")
    return unquote(m[1]) if m else None


def record(row_id: str | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit has the response's head, which tells the payload's size, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + (payload or b"")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(row_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), b"\r\n", block, b"\r\n\r\n"])


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """(fields, payload, the payload's size by its head) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"not one WARC record: {head[:200]!r}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, payload, int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])


class Bundle:
    """A bundle that is being written: frames one after the other, then their seek table."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4()}.warc.zst"
        fs, path = opened(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)  # else the name would have it packed once more
        self.packer = zstandard.ZstdCompressor()
        self.sizes: list[tuple[int, int]] = []
        self.packed = 0

    def frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.sizes.append((len(packed), len(raw)))
        self.packed += len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Frames of a bundle by number, through the seek table at its end."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"no seek table at the end of {uri}")
        table = self.file.read_at(8 * n, end - 9 - 8 * n)
        self.sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, i: int) -> bytes:
        packed, size = self.sizes[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[i]), max_output_size=max(1, size))

    def close(self) -> None:
        self.file.close()


def with_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """pages with _bytes, _digest (SHA-1), _refers_to: of equal payloads of least bytes or more, the largest id of the others.

    Equal payloads have one SHA-256. Counts of them are summed before they meet; only those
    that occur twice are looked up.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    size, key = F.octet_length(body).cast("long"), F.sha2(body, 256)
    groups = pages.filter(size >= least).select(key.alias("_key"), F.col(id_col).alias("_id")).groupBy("_key").agg(F.max("_id").alias("_first"), F.count("*").alias("_n"))
    groups = cut(groups.filter((F.col("_n") > 1) & F.col("_first").isNotNull()).drop("_n"))
    d = pages.withColumns({"_bytes": size, "_digest": F.sha1(body), "_key": key}).join(broadcast_if_small(groups, SMALL), "_key", "left")
    other = ~F.col(id_col).eqNullSafe(F.col("_first"))
    return d.withColumn("_refers_to", F.when(other, F.col("_first"))).drop("_key", "_first")


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row into bundles in folder; the stored index: record, bundle, frame, at, size.

    Of the records with equal payloads of 1000 bytes or more, that with the largest id is a
    response and the others are revisits of it; smaller ones are all responses. Rows that
    share the largest id are all responses; where equal payloads have no id at all, so are
    they. A null payload is an empty one, a record without url has no target, control
    characters and spaces in urls are percent-encoded; a null id is read back as null. Other
    columns are not written. No rows make no bundles.
    """
    d = with_types(pages.select(id_col, url_col, payload_col), id_col, payload_col)
    text = lambda c: F.col(c).cast("string")
    rows = d.select(text(id_col), text(url_col), F.when(F.col("_refers_to").isNull(), text(payload_col)).alias("payload"), "_digest", "_bytes", text("_refers_to").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, frame, waiting = None, io.BytesIO(), []

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting:
                bundle.frame(frame.getvalue())
                records, places, sizes = zip(*waiting)
                n = len(waiting)
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.repeat(bundle.uri, n), pa.repeat(pa.scalar(len(bundle.sizes) - 1, pa.int64()), n), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], schema=SCHEMA)
                frame.seek(0)
                frame.truncate()
                waiting.clear()

        for batch in batches:
            ids, urls, digests, sizes, others = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for i, payload in enumerate(batch.column(2)):
                bundle = bundle or Bundle(folder)
                raw = payload.as_buffer()
                made = record(ids[i], urls[i], raw.to_pybytes() if raw is not None else None, digests[i], sizes[i], others[i], others[i] is not None, date)
                waiting.append((record_id(ids[i]), frame.tell(), len(made)))
                frame.write(made)
                if frame.tell() >= FRAME:
                    yield from flush()
                    if bundle.packed >= BUNDLE:
                        bundle.close()
                        bundle = None
        if bundle:
            yield from flush()
            bundle.close()

    return stored(rows.mapInArrow(run, INDEX))


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that index (or a part of it) names: id, record_type, target, payload_bytes, payload_digest, refers_to, payload.

    A frame is unpacked once for all its records that are asked for together. The digest of
    every response is taken anew from its payload and must be that of its head. payloads:
    false leaves the last column null.
    """
    n_records, n_frames = index.agg(F.count("*"), F.count_distinct("bundle", "frame")).first()  # frames are a MiB each
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, n_frames * FRAME // READ)
    near = F.floor(F.col("frame") / NEAR)
    asked = index.select("record", "bundle", "frame", "at", "size").repartition(int(min(tasks, max(1, n_records))), "bundle", near).sortWithinPartitions("bundle", "frame", "at")
    names = ["id", "record_type", "target", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name, number, unpacked = None, None, None, b""
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for batch in batches:
            for rec, bundle, frame, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != name:
                    if reader:
                        reader.close()
                    reader, name, number = Reader(bundle), bundle, None
                if frame != number:
                    if rows:
                        yield made()
                    number, unpacked = frame, reader.frame(frame)
                fields, payload, length = parsed(unpacked[at : at + size])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                if fields["WARC-Record-ID"] != rec or kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{bundle}, frame {frame}, {at}: not the record {rec} as it was written")
                rows.append((named(rec), kind, fields.get("WARC-Target-URI"), length, digest, named(fields.get("WARC-Refers-To")), payload if payloads else None))
        if rows:
            yield made()
        if reader:
            reader.close()

    return asked.mapInArrow(run, "id string, record_type string, target string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for bundles in the shared checkpoint folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4()}"


def round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes all rows as bundles and reads them back: id_col, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema[id_col].dataType.simpleString()
    index = write_bundles(pages, folder, id_col, url_col, payload_col)
    found = read_records(index, payloads=False)
    return found.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
