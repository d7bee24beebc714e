"""Seekable Zstandard bundles of WARC records.

A bundle is a file of independent Zstandard frames, each a group of records, followed by a seek table in
a skippable frame (magic number, one entry of compressed and decompressed size per frame, and a footer
with the number of frames).  Any Zstandard reader can decompress the whole file; with the seek table and
an index row (record id, bundle, frame, offset in the decompressed frame, length) a reader fetches one
record by decompressing one frame.

Records with equal payloads: the least one to write is a response, the others are revisits that name it.
Which record is the response is decided by a pre-aggregated group over (digest, size) and joined back, so
a group of copies of any size is one row of the aggregation and a split join.

Bundles are written by tasks into the shared folder under a name of their own and renamed when whole, so
a task that runs again after a lost executor leaves at most an unreferenced file; the index, a stored
table, names the files that count.

Defined results: a null payload is empty; rows with a null id are written with an empty id and returned
with a null one; rows with an equal id are written each, and of equal payloads with the same greatest id
each is a response; a null URL is written as an empty target.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, stored, text_chunks

# The skippable frame and the footer of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Decompressed bytes after which a frame ends, and frame bytes after which a bundle ends.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
#: Decompressed bytes of records that one task reads back.
TASK_BYTES = 32 << 20
MIN_REVISIT_BYTES = 1000

INDEX_SCHEMA = "bundle string, frame int, offset long, length long, record_id long"
RECORD_SCHEMA = "record_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


class BundleWriter:
    """Collects records into frames; close() appends the seek table and gives the file its name."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path = fs, path
        self.out = fs.open_output_stream(path + ".part")
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.size = self.written = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame, length) of the record."""
        if self.pending and self.size + len(record) > FRAME_BYTES:
            self._flush()
        at = len(self.frames), self.size, len(record)
        self.pending.append(record)
        self.size += len(record)
        return at

    def _flush(self) -> None:
        if self.pending:
            data = self.compressor.compress(b"".join(self.pending))
            self.out.write(data)
            self.frames.append((len(data), self.size))
            self.written += len(data)
            self.pending, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", c, d) for c, d in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


class BundleReader:
    """Reads single frames of a bundle through its seek table."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError(f"{path}: no seek table of the known kind")
        entries = struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n))
        self.frames, at = [], 0
        for compressed, plain in entries:
            self.frames.append((at, compressed, plain))
            at += compressed

    def frame(self, i: int) -> bytes:
        at, compressed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(compressed, at), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def record_bytes(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its headers carry the payload's digest and size."""
    kind = "response" if refers_to is None else "revisit"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>", f"WARC-Target-URI: {target}",
        f"WARC-Date: {datetime.fromtimestamp(0, UTC).isoformat().replace('+00:00', 'Z')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; the digest and size of a response are those of its payload as read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    if not lines[0].startswith("WARC/") or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC record")
    payload = rest[: int(field["content-length"])]

    def number(key: str) -> int | None:
        v = field.get(key, "").removeprefix("<urn:page:").removesuffix(">")
        return int(v) if v else None

    kind = field["warc-type"]
    named = field["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != named:
        raise ValueError(f"record {field['warc-record-id']}: the payload doesn't have its digest")
    return {
        "record_id": number("warc-record-id"), "record_type": kind, "url": field["warc-target-uri"], "payload_digest": named,
        "payload_bytes": len(payload) if kind == "response" else int(field["x-payload-length"]), "refers_to": number("warc-refers-to"), "payload": payload,
    }


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop path for the Python workers (file, hdfs, s3a, gs, abfs)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri}")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(record_id, url, html, digest, refers_to) of every row; refers_to is null for responses."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    # stored, so that the join back is between two plain exchanges, whose hot digests Spark splits
    groups = stored(base.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("record_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top"), "copies")
    refers = F.when(F.col("top") != F.col("record_id"), F.col("top"))
    return base.join(groups, "digest", "left").select("record_id", "url", "html", "digest", refers.alias("refers_to"))


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_revisits() as bundles into folder; the index, a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        writer = None
        rows: list[tuple] = []
        for part in text_chunks(batches, "html"):
            for i, u, h, d, r in zip(*(part.column(c).to_pylist() for c in ("record_id", "url", "html", "digest", "refers_to")), strict=True):
                if writer is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs, f"{root}/{name}")
                rows.append((name, *writer.add(record_bytes(i, u, h.encode("utf-8", "surrogatepass"), d, r)), i))
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
                    yield _index_batch(rows)
                    rows = []
        if writer is not None:
            writer.close()
            yield _index_batch(rows)

    return stored(records.mapInArrow(run, INDEX_SCHEMA), "warc-index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bundle", "frame", "offset", "length", "record_id"])


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Fetch the records of the index rows: each needed frame of a bundle is read and decompressed once."""

    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"record_id": pa.int64(), "record_type": pa.string(), "url": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.record_batch([pa.array([r[c] if payloads or c != "payload" else None for r in rows], t) for c, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        reader, at, data = None, None, b""
        for rows in batches:
            out, size = [], 0
            for name, frame, offset, length in zip(*(rows.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
                if (name, frame) != at:
                    if at is None or name != at[0]:
                        if reader:
                            reader.close()
                        reader = BundleReader(fs, f"{root}/{name}")
                    at, data = (name, frame), reader.frame(frame)
                out.append(parse_record(data[offset : offset + length]))
                size += length
                if size > 4 * FRAME_BYTES:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)
        if reader:
            reader.close()

    # frames are the unit of work, dealt by the bytes that they hold and not by the few that an index row has
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    return index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, RECORD_SCHEMA)


def lookup(index: DataFrame, folder: str, ids: Iterable[int]) -> DataFrame:
    """Random access: only the bundles and frames of the wanted records are opened."""
    return read_records(index.where(F.col("record_id").isin([int(i) for i in ids])), folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    index = write_bundles(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return read_records(index, folder, payloads=False).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
