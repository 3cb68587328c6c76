"""WARC archives made from legacy ARC archives, with repeated payloads written as revisits.

``write_arc`` stores pages as ARC archives of version 1 or 2 (header line, declared length, HTTP
response; each record a gzip member). ``convert`` turns any ARC archives (also plain ones, and with
several records a member) into WARC 1.1 archives:

1. every archive is scanned by one task, which parses the version block, each header line by the
   pattern of that version, and each block by its declared length; payload digests make an index;
2. of the index, rows with equal digests are grouped (pre-aggregated, no payload is shuffled); the
   least key of each group is the response that the others revisit;
3. every archive is scanned again beside its own list of revisits, and written as one WARC archive
   with synthesised record ids (from archive and place, so that a revisit can name its response
   without looking it up), timestamps, types and digests.

``read_warc`` scans the written archives and checks every block and payload against its digest.
An archive is the unit of work: of ``archive_bytes`` when written here, about 100 MB by custom.
Files of lost or repeated tasks are in no manifest and are never read.

Keys (``page_id``) travel as an HTTP header field. Null pages have empty payloads. Payloads under
``least_bytes`` are never revisits, nor are rows with a null key, and none refers to them. Of rows
that share the least key of their group one is the response, the others revisit that key. Null
URLs make records without a target. An empty table makes no archives and no rows. Extra columns are
not carried. A block that does not begin with ``HTTP/`` becomes a resource record, whole.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import checkpoint_dir, cut, hot_join, release, slices
from weftline.llm.media import filesystem

#: The field lists and header lines of both ARC versions.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
LINES = {
    1: re.compile(rb"(?P<url>\S.*?) (?P<ip>[0-9A-Fa-f.:]+) (?P<date>\d{8,14}) (?P<type>.*) (?P<length>\d+)"),
    2: re.compile(rb"(?P<url>\S.*?) (?P<ip>[0-9A-Fa-f.:]+) (?P<date>\d{8,14}) (?P<type>.*) (?P<code>\d+|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = b"X-Record-Key"


def gz(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _bytes(value: str | None) -> bytes:
    return re.sub(rb"[\x00-\x20]", lambda m: b"%%%02X" % m[0][0], (value or "-").encode()) or b"-"


def arc_record(version: int, name: bytes, offset: int, url: bytes, date: bytes, kind: bytes, content: bytes) -> bytes:
    extra = b"" if version == 1 else b" 200 - - %d %s" % (offset, name)
    return b"%s 0.0.0.0 %s %s%s %d\n%s\n" % (url, date, kind, extra, len(content), content)


def http_block(key: int | None, payload: bytes) -> bytes:
    named = b"" if key is None else b"%s: %d\r\n" % (KEY, key)
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (named, len(payload), payload)


def spread(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest (written), an archive a task."""
    return manifest.repartition(min(max(manifest.count(), 1), 100_000))


class _Archive:
    """An output archive that is opened with its first record and closed at a size."""

    def __init__(self, directory: str, ending: str, limit: int):
        self.fs, self.base = filesystem(directory)
        self.ending, self.limit, self.out, self.made = ending, limit, None, []

    def open(self) -> bool:
        """Whether a new archive was begun."""
        if self.out is not None:
            return False
        self.name, self.records = uuid.uuid4().hex + self.ending, 0
        self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None, buffer_size=1 << 20)
        return True

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.records += 1

    def close(self, full_only: bool = False) -> None:
        if self.out is not None and not (full_only and self.out.tell() < self.limit):
            self.made.append((self.name, self.out.tell(), self.records))
            self.out.close()
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        columns = list(zip(*self.made, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "n_bytes", "n_records"])


MANIFEST = "archive string, n_bytes long, n_records long"


def _made(directory: str) -> None:
    fs, base = filesystem(directory)
    fs.create_dir(base, recursive=True)


def write_arc(pages: DataFrame, directory: str, key: str = "page_id", url: str = "url", payload: str = "html", version: int | None = None, captured: str = "20000101000000", archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes pages as ARC archives under directory; returns their manifest, written.

    version None: tasks alternate between versions 1 and 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = version or 1 + TaskContext.get().partitionId() % 2
        to, date = _Archive(directory, ".arc.gz", archive_bytes), captured.encode()
        for batch in batches:
            for part in slices(batch, "payload", 4 << 20):
                for k, u, data in zip(part.column("key").to_pylist(), part.column("url").to_pylist(), part.column("payload").to_pylist(), strict=True):
                    if to.open():
                        name = to.name.encode()
                        to.write(gz(arc_record(v, name, 0, b"filedesc://" + name, date, b"text/plain", b"%d 0 weftline\n%s\n" % (v, FIELDS[v]))))
                    to.write(gz(arc_record(v, name, to.out.tell(), _bytes(u), date, b"text/html", http_block(k, data))))
                    to.close(full_only=True)
        to.close()
        yield to.manifest()

    _made(directory)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload), "utf-8"), F.lit(b"")).alias("payload"))
    return cut(rows.mapInArrow(run, MANIFEST))


def members(f) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the gzip members of a file, or of the records of a plain ARC file."""
    head = f.read(2)
    f.seek(0)
    if head != b"\x1f\x8b":
        yield from _plain(io.BufferedReader(f, 1 << 20))
        return
    at, data, base = 0, b"", 0  # data holds the file from base on; at is the next member's place in it
    while True:
        d, out, pos = zlib.decompressobj(31), [], at
        while not d.eof:
            if pos >= len(data):
                more = f.read(1 << 20)
                if not more:
                    if pos > at or out:
                        raise OSError(f"member at {base + at} is cut short")
                    return
                data, base, pos, at = data[at:] + more, base + at, pos - at, 0
            piece = data[pos : pos + 16384]
            out.append(d.decompress(piece))
            pos += len(piece) - len(d.unused_data)
        yield base + at, b"".join(out)
        at = pos


def _plain(f) -> Iterator[tuple[int, bytes]]:
    while True:
        at, line = f.tell(), f.readline()
        if not line:
            return
        if line.strip():
            yield at, line + f.read(int(line.rsplit(b" ", 1)[1]))


def http_split(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its empty line, and payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for end in (b"\r\n\r\n", b"\n\n"):
        at = block.find(end)
        if at >= 0:
            return block[: at + len(end)], block[at + len(end) :]
    return block, b""


class ArcRecord:
    """Header fields and content of one ARC record, with what WARC has for them."""

    __slots__ = ("offset", "inner", "version", "origin", "url", "ip", "date", "type", "content", "declared")

    def __init__(self, offset: int, inner: int, fields: dict[str, bytes], content: bytes):
        self.offset, self.inner, self.content = offset, inner, content
        self.url, self.ip, self.date, self.type = (fields[k] for k in ("url", "ip", "date", "type"))
        self.declared = int(fields["length"])

    @property
    def is_http(self) -> bool:
        return self.content.startswith(b"HTTP/")

    def split(self) -> tuple[bytes, bytes]:
        """HTTP header with its empty line, and payload; a block of another kind is all payload."""
        return http_split(self.content)

    @property
    def timestamp(self) -> str:
        d = (self.date.decode() + "00000000000000"[len(self.date) :])[:14]
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def arc_records(f) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block first."""
    version, origin = None, b""
    for offset, data in members(f):
        at = 0
        while True:
            while data[at : at + 1] in (b"\n", b"\r"):
                at += 1
            if at >= len(data):
                break
            inner, end = at, data.find(b"\n", at)
            line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
            if version is None:  # the version block names itself after its header line
                if not line.startswith(b"filedesc:"):
                    raise ValueError(f"no version block at {offset}")
                version = int(data[end + 1 :].split(b" ", 1)[0])
                if version not in LINES:
                    raise ValueError(f"ARC version {version} is not known")
                origin = data[end + 1 :].split(b"\n", 1)[0].split(b" ", 2)[-1]
            found = LINES[version].fullmatch(line)
            if not found:
                raise ValueError(f"no header line of version {version} at {offset}: {line[:200]!r}")
            at = end + 1 + int(found["length"])
            record = ArcRecord(offset, inner, found.groupdict(), data[end + 1 : at])
            record.version, record.origin = version, origin
            yield record


def header_field(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1] if found else None


def _key(head: bytes) -> int | None:
    value = header_field(head, KEY)
    return int(value) if value and re.fullmatch(rb"-?\d+", value) else None


INDEX = "archive string, at long, inner long, key long, url string, stamp string, digest string, payload_bytes long"


def index(manifest: DataFrame, directory: str) -> DataFrame:
    """archive, place, key, url, timestamp, digest and length of every HTTP record of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(directory)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with fs.open_input_file(f"{base}/{name}") as f:
                    for r in arc_records(f):
                        if r.is_http:
                            head, body = r.split()
                            rows.append((name, r.offset, r.inner, _key(head), r.url.decode(errors="replace"), r.timestamp, hashlib.sha256(body).hexdigest(), len(body)))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        release()

    return spread(manifest.select("archive")).mapInArrow(run, INDEX)


def revisits(found: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Of an index (written): place of each revisit, and place, key, url and time of its response."""
    own = found.filter((F.col("payload_bytes") >= least_bytes) & F.col("key").isNotNull())
    place = F.struct("key", "archive", "at", "inner", "url", "stamp")
    firsts = cut(own.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    joined = hot_join(own.select("archive", "at", "inner", "digest"), firsts.select("digest", "first"), ["digest"], firsts.select("digest", "n"))
    return joined.filter(~((F.col("archive") == F.col("first.archive")) & (F.col("at") == F.col("first.at")) & (F.col("inner") == F.col("first.inner")))).select("archive", "at", "inner", "first")


def record_id(archive: str, at: int, inner: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{archive}:{at}:{inner}')}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def to_warc(record: ArcRecord, archive: str, info_id: str, first: dict | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit of first (key, archive, at, inner, url, stamp) if given."""
    head, body = record.split()
    url = record.url.decode(errors="replace")
    block = head if first else record.content
    fields = [
        ("WARC-Type", "revisit" if first else "response" if record.is_http else "resource"),
        ("WARC-Record-ID", record_id(archive, record.offset, record.inner)),
        ("WARC-Warcinfo-ID", info_id),
        ("WARC-Target-URI", None if url == "-" else url),
        ("WARC-Date", record.timestamp),
        ("WARC-IP-Address", None if record.ip == b"0.0.0.0" else record.ip.decode()),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest()),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("WARC-Truncated", "unspecified" if len(record.content) < record.declared else None),
        ("Content-Type", "application/http; msgtype=response" if record.is_http else record.type.decode(errors="replace")),
    ]
    if first:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(first["archive"], first["at"], first["inner"])),
            ("WARC-Refers-To-Target-URI", None if first["url"] == "-" else first["url"]),
            ("WARC-Refers-To-Date", first["stamp"]),
            ("X-Refers-To-Key", str(first["key"])),
            ("X-Payload-Length", str(len(body))),
        ]
    return warc_record(fields, block)


def convert(manifest: DataFrame, source: str, target: str, least_bytes: int = 100) -> DataFrame:
    """Converts the ARC archives of a manifest (archive) from source into target; returns the WARC manifest, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(source)
        to = _Archive(target, ".warc.gz", 1 << 62)  # an archive each
        for batch in batches:
            for name, again in zip(batch.column("archive").to_pylist(), batch.column("again").to_pylist(), strict=True):
                firsts = {(x["at"], x["inner"]): x["first"] for x in again or ()}
                with fs.open_input_file(f"{base}/{name}") as f:
                    for r in arc_records(f):
                        if to.open():
                            info = record_id(to.name, 0, 0)
                            block = f"software: weftline\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\narc-version: {r.version}\r\narc-origin: {r.origin.decode(errors='replace')}\r\n"
                            to.write(gz(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", info), ("WARC-Date", r.timestamp), ("WARC-Filename", to.name), ("Content-Type", "application/warc-fields")], block.encode())))
                        if not r.url.startswith(b"filedesc:"):
                            to.write(gz(to_warc(r, name, info, firsts.get((r.offset, r.inner)))))
                to.close()
        yield to.manifest()
        release()

    _made(target)
    again = revisits(cut(index(manifest, source)), least_bytes).groupBy("archive").agg(F.collect_list(F.struct("at", "inner", "first")).alias("again"))  # as many as an archive has records
    plan = cut(manifest.select("archive").join(again, "archive", "left"))
    return cut(spread(plan).mapInArrow(run, MANIFEST))


RECORDS = "archive string, at long, record_type string, record_id string, target_uri string, stamp string, key long, payload_digest string, payload_bytes long, refers_to string, refers_to_key long, payload binary"


def read_warc(manifest: DataFrame, directory: str, payloads: bool = True) -> DataFrame:
    """The records of WARC archives but for warcinfo; payload is null for revisits, or if not asked for.

    Blocks and payloads are checked against their digests; a record that differs raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(directory)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, size = [], 0
                with fs.open_input_file(f"{base}/{name}") as f:
                    for at, data in members(f):
                        row = parse_warc(name, at, data)
                        if row:
                            rows.append(row if payloads else (*row[:-1], None))
                            size += len(row[-1] or b"") * payloads + 300
                        if size >= 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)
        release()

    return spread(manifest.select("archive")).mapInArrow(run, RECORDS)


def parse_warc(name: str, at: int, data: bytes) -> tuple | None:
    end = data.index(b"\r\n\r\n") + 4
    head = dict(line.split(b": ", 1) for line in data[:end].split(b"\r\n")[1:] if line)
    length = int(head[b"Content-Length"])
    block = data[end : end + length]
    kind = head[b"WARC-Type"].decode()
    if kind == "warcinfo":
        return None
    text = lambda k: head[k].decode() if k in head else None
    if len(block) != length or "sha256:" + hashlib.sha256(block).hexdigest() != text(b"WARC-Block-Digest"):
        raise OSError(f"damaged block at {at} of {name}")
    digest = text(b"WARC-Payload-Digest").split(":")[1]
    top, body = http_split(block)
    payload = None if kind == "revisit" else body
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise OSError(f"damaged payload at {at} of {name}")
    n = int(head[b"X-Payload-Length"]) if payload is None else len(payload)
    to = head.get(b"X-Refers-To-Key")
    return name, at, kind, text(b"WARC-Record-ID"), text(b"WARC-Target-URI"), text(b"WARC-Date"), _key(top), digest, n, text(b"WARC-Refers-To"), None if to is None else int(to), payload


def archive(pages: DataFrame, base: str, least_bytes: int = 100, **options) -> tuple[DataFrame, str]:
    """Pages as ARC archives under base/arc, converted into base/warc: the WARC manifest and its folder."""
    legacy = write_arc(pages, f"{base}/arc", **options)
    return convert(legacy, f"{base}/arc", f"{base}/warc", least_bytes), f"{base}/warc"


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.common import table

    manifest, directory = archive(table(spark, sf_dir, "pages"), f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}")
    rows = read_warc(manifest, directory, payloads=False)
    return rows.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS n, sha256(body) AS g FROM p),
firsts AS (SELECT *, CASE WHEN n >= 100 AND page_id IS NOT NULL THEN min(page_id) OVER (PARTITION BY g) END AS first_id, row_number() OVER (PARTITION BY g ORDER BY page_id NULLS LAST) AS place FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN first_id IS NOT NULL AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM firsts
"""
