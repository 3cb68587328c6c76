"""Media columns: a Spark data source over directories of zip archives.

``store`` writes each payload as a lossless 8-bit grey PNG, 64 samples wide, into uncompressed zip
archives, and a manifest of the archives that committed tasks wrote (a lost or repeated task leaves
archives that no manifest names). ``ZipMediaSource`` plans byte ranges of every archive; a range's
task reads the archive's directory, takes the members whose headers lie in the range, and streams
them in Arrow batches. Each member is read by its own offset, checked against its checksum and
retried alone.

A payload is the text's UTF-8 bytes (null: none), filled up with bytes 0 to a positive multiple of
64. Null and repeated ids stay one row each; equal texts give equal values; extra columns are not
carried. An empty table makes an empty manifest and no rows.
"""

from __future__ import annotations

import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.llm.common import checkpoint_dir, slices, text_or_empty

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """payload, a multiple of 64 bytes, as rows of 64 grey samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each with filter 0 before it
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that to_png made."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, packed, width, height = len(SIGNATURE), [], 0, 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return np.ascontiguousarray(lines[:, 1:]).tobytes()


def feature(payload: bytes) -> str:
    """A mean-column hash (16 hex digits) and the shares, in 1/255, of eight ranges of sample values."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sums = rows.sum(axis=0, dtype=np.int64)
    bits = np.packbits(sums * WIDTH > sums.sum()).tobytes().hex()
    parts = np.bincount(rows.reshape(-1) >> 5, minlength=8) * 255 // rows.size
    return bits + "-" + "".join(f"{p:02x}" for p in parts)


def store(docs: DataFrame, directory: str, archive_bytes: int = 128 << 20) -> str:
    """Writes the archives of docs (doc_id, text) and their manifest under directory; returns it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(directory)
        archive = out = name = None
        made = []

        def close():
            nonlocal archive
            if archive is not None:
                archive.close()
                made.append((name, out.tell()))
                out.close()
                archive = None

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if archive is None:
                        name = f"{uuid.uuid4().hex}.zip"
                        out = fs.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                        k = 0
                    data = t.encode()
                    info = zipfile.ZipInfo(f"{k}.png")
                    info.comment = json.dumps({"doc_id": d, "n_bytes": len(data)}).encode()
                    archive.writestr(info, to_png(pad(data)))
                    k += 1
                    if out.tell() >= archive_bytes:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["name", "n_bytes"])

    fs, base = filesystem(directory)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "name string, n_bytes long")
    archives = sorted((r.name, r.n_bytes) for r in rows.collect())
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(archives).encode())
    return directory


class Range(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        self.name, self.start, self.stop = name, start, stop


class ZipMediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.directory = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 8 << 20))
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[Range]:
        fs, base = filesystem(self.directory)
        with fs.open_input_stream(f"{base}/manifest.json") as f:
            archives = json.loads(f.read())
        plan = [Range(name, a, min(a + self.range_bytes, size)) for name, size in archives for a in range(0, size, self.range_bytes)]
        return plan or [Range("", 0, 0)]

    def member(self, fs, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member's bytes by its offset; read again, from a new handle, if damaged."""
        for attempt in range(self.retries + 1):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise OSError("no member here")
                    name, extra = struct.unpack("<HH", head[26:30])
                    f.seek(info.header_offset + 30 + name + extra)
                    data = f.read(info.compress_size)
                if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                    raise OSError(f"damaged member at {info.header_offset} of {path}")
                return data
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise AssertionError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, base = filesystem(self.directory)
        path = f"{base}/{partition.name}"
        with fs.open_input_file(path) as f, zipfile.ZipFile(io.BufferedReader(f, 1 << 16)) as z:
            members = [i for i in z.infolist() if partition.start <= i.header_offset < partition.stop]
        rows, size = [], 0
        for info in members:
            note = json.loads(info.comment)
            rows.append((note["doc_id"], note["n_bytes"], partition.name, info.header_offset, self.member(fs, path, info)))
            size += info.compress_size
            if size >= self.batch_bytes:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "archive", "member_offset", "media"])


class ZipMediaSource(DataSource):
    """Options: path, rangeBytes, batchBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "zipmedia"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, archive string, member_offset long, media binary"

    def reader(self, schema) -> ZipMediaReader:
        return ZipMediaReader(self.options)


def read_media(spark: SparkSession, directory: str, **options) -> DataFrame:
    spark.dataSource.register(ZipMediaSource)
    return spark.read.format("zipmedia").options(path=directory, **options).load()


def with_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload, feature of what read_media returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 2 << 20):
                payload = [from_png(m) for m in part.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), part.column("media"), pa.array(payload, pa.binary()), pa.array([feature(p) for p in payload], pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def digest(columns: DataFrame) -> DataFrame:
    return columns.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_media(spark, sf_dir: str) -> DataFrame:
    from weftline.llm.common import table

    directory = store(table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/media-{uuid.uuid4().hex}")
    return digest(with_features(read_media(spark, directory)))
