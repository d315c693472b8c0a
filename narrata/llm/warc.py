"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC
records, and a footer: a skippable frame with the seek table (compressed and
plain size of each frame). An index table maps each record to its bundle, the
frame, and the place inside the plain frame, so one record costs one ranged
read and one frame's decompression.

Writers stream: memory holds one frame and the index rows of one bundle. A
bundle's name is unique to the task attempt, and a record exists if the index,
which Spark commits, has it; what a lost attempt leaves behind is never read.

Defined results: a null payload counts as empty; payloads that are equal and
not shorter than ``least`` are kept once, with the largest id, and the others
are revisits; rows with a null id are always responses; of repeated rows with
the largest id each is a response; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.workspace import Workspace

#: Plain bytes after which a frame is closed, and file bytes after which a bundle is.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 256 * 1024 * 1024
ROWS_OUT = 512

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = T.StructType([T.StructField("record", T.LongType()), T.StructField("bundle", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
RECORDS = T.StructType([T.StructField("record", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to", T.LongType())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(record: int | None) -> str:
    return f"<urn:record:{'' if record is None else record}>"


def _header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or, if ``refers_to`` is given, a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(record)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_header_safe(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record, with its payload (None for a revisit); a damaged one raises."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != found):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda urn: int(urn[12:-1]) if len(urn) > 13 else None
    return {"record": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "target_uri": fields.get("WARC-Target-URI"), "payload_digest": found, "payload_bytes": size, "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


class BundleWriter:
    """Frames of records and a seek table at the end, in one pass over the output."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 6):
        self._sink, self._limit, self._zstd = sink, frame_bytes, zstandard.ZstdCompressor(level=level)
        self._open, self._size, self.frames, self.written = [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame's number and the place in the plain frame."""
        if self._size and self._size + len(record) > self._limit:
            self._close_frame()
        at = (len(self.frames), self._size)
        self._open.append(record)
        self._size += len(record)
        return at

    def _close_frame(self) -> None:
        packed = self._zstd.compress(b"".join(self._open))
        self._sink.write(packed)
        self.frames.append((len(packed), self._size))
        self.written += len(packed)
        self._open, self._size = [], 0

    def finish(self) -> None:
        if self._size:
            self._close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self._sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class BundleReader:
    """Plain frames of a bundle by number, through its seek table."""

    def __init__(self, source):
        self._source, end = source, source.size()
        source.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        source.seek(end - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", source.read(8 * count)))
        self.starts = [0]
        for packed, _ in sizes:
            self.starts.append(self.starts[-1] + packed)
        self._plain = [plain for _, plain in sizes]
        self._zstd = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        self._source.seek(self.starts[number])
        return self._zstd.decompress(self._source.read(self.starts[number + 1] - self.starts[number]), max_output_size=self._plain[number])


def revisits(ws: Workspace, df: DataFrame, id: str, payload: str, least: int) -> DataFrame:
    """Add ``_refers``: the largest id with an equal payload, for rows that aren't it."""
    sha, size = F.sha1(F.col(payload)), F.length(payload)
    keyed = df.withColumn("_sha", sha).withColumn("_size", size)
    kept = df.select(F.col(id).alias("_id"), sha.alias("_sha"), size.alias("_size")).where(F.col("_size") >= least)
    first = ws.save(kept.groupBy("_sha", "_size").agg(F.max("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "first")
    met = keyed.join(first, ["_sha", "_size"], "left")
    return met.withColumn("_refers", F.when(F.col("_first") != F.col(id), F.col("_first"))).drop("_sha", "_size", "_first")


def write(df: DataFrame, id: str, uri: str, payload: Column, least: int, ws: Workspace, date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Write a record for each row; the bundles' folder and the index (record, bundle, frame, offset, length)."""
    folder = ws.folder("bundles")
    rows = df.select(F.col(id).alias("id"), F.col(uri).alias("uri"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    marked = revisits(ws, rows, "id", "payload", least).select("id", "uri", "payload", "_refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        bundle, sink, writer, index = "", None, None, []

        def close() -> pa.RecordBatch:
            writer.finish()
            sink.close()
            return pa.RecordBatch.from_pylist(index, schema=pa.schema([("record", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))

        for batch in batches:
            for record, target, body, refers in zip(*(c for c in batch.columns), strict=True):
                if writer is None:
                    bundle = f"{uuid.uuid4().hex}.warc.zst"
                    sink, index = system.open_output_stream(f"{root}/{bundle}", compression=None), []
                    writer = BundleWriter(sink)
                data = record_bytes(record.as_py(), target.as_py(), body.as_py(), refers.as_py(), date)
                frame, offset = writer.add(data)
                index.append({"record": record.as_py(), "bundle": bundle, "frame": frame, "offset": offset, "length": len(data)})
                if writer.written >= BUNDLE_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return folder, ws.save(marked.mapInArrow(run, INDEX), "index")


def read(folder: str, index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that ``index`` names, with their payloads if wanted. Records of a frame are read together."""
    fields = T.StructType([*RECORDS.fields, T.StructField("payload", T.BinaryType())]) if payload else RECORDS
    names = fields.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()][: len(names)]
        schema = pa.schema(list(zip(names, types, strict=True)))
        bundle, reader, at, plain, out = None, None, None, b"", []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != bundle:
                    bundle, at = row["bundle"], None
                    reader = BundleReader(system.open_input_file(f"{root}/{bundle}"))
                if row["frame"] != at:
                    at, plain = row["frame"], reader.frame(row["frame"])
                found = parse_record(plain[row["offset"] : row["offset"] + row["length"]])
                out.append({k: found[k] for k in names})
                if len(out) >= ROWS_OUT:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    # A frame's rows are few, so bundle and frame deal them evenly.
    frames = index.select(F.countDistinct("bundle", "frame")).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, frames // 64)
    return index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, fields)
