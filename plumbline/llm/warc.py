"""WARC archives: written whole, normalised into one gzip member a record, read again by an index.

``write`` turns pages into WARC/1.1 records, each task streaming its rows into archives that
are one gzip stream from end to end, as crawlers and ``gzip`` leave them. Nothing in such a
file can be read without inflating all before it, so an archive is one task's work.

``normalise`` inflates each archive once, in pieces of ``CHUNK`` bytes, copies every record into
a gzip member of its own and writes beside the new archive a sidecar of one line a record:
offset, length, type, record id, target. The same rows come back as a DataFrame. It takes any
gzip file of WARC records, also one with several members or none; a file that breaks off or does
not hold WARC raises an error that names the archive and the place.

``read`` takes rows of the index in any number of tasks, opens each member by its offset and
returns the record, its digest taken from the bytes that are there. A revisit holds headers
only; its payload's digest and size are those its headers name.

A task writes files under names of its own, and only names that a finished task has reported
are ever read, so a task that is lost or run twice leaves files that nothing refers to. Files
are opened through Arrow's file systems (local, HDFS, S3, GCS), by the path of the shared folder.

No record is held in memory twice: payloads are copied in pieces, in ``write`` and ``read`` one
payload at a time is.

Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the smallest id is a
response and the others are revisits of it. Rows that share this id are all responses. A null
id is above all others; pages whose ids are all null are all responses. A null html is an empty
payload; a null url is left out of the record. Only the three named columns are read. An empty
table gives no archive.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import md5, sha256
from itertools import chain
from urllib.parse import quote
from uuid import UUID, uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.frames import FEW_KEYS
from ..plans.scratch import scratch_path, written
from .words import slices

REVISIT_BYTES = 100
#: Bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 512 << 20
#: Bytes inflated, copied and compressed at once.
CHUNK = 1 << 20
#: Bytes read of a compressed file at once; what follows a member's end in them is copied once a member.
READ = 64 << 10
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("archive string, offset bigint, length bigint, type string, record_id string, refers_to string, target string, "
         "page_id string, block_bytes bigint")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def record_id(page_id: str | None, digest: str) -> str:
    """The same for the same page and payload, in every run."""
    return f"<urn:uuid:{UUID(bytes=md5(f'{page_id}:{digest}'.encode()).digest())}>"


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, digest, original): the page of which the row is a revisit, or null."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # digests with copies only; a payload that is everywhere is counted before the shuffle
    several = written(rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
                      .agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("digest", "least"), "copies")
    few = several.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    revisits = F.col("id").isNull() | (F.col("least") < F.col("id"))
    return rows.join(F.broadcast(several) if few else several, "digest", "left").select(
        "id", "url", "payload", "digest", F.when(revisits, F.col("least")).alias("original"))


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, original: str | None) -> Iterator[bytes]:
    """The bytes of a record, in pieces."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = original is not None
    yield _head([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")), ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(original, digest) if revisit else None), ("WARC-Refers-To-Page-ID", original),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (0 if revisit else len(payload))))])
    yield http
    if not revisit:
        for at in range(0, len(payload), CHUNK):
            yield payload[at:at + CHUNK]
    yield b"\r\n\r\n"


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """(archive, records): the archives written, each one gzip stream of whole records."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [("archive", pa.string()), ("records", pa.int64())]
        out = press = path = None
        count = size = 0

        def closed() -> pa.RecordBatch:
            out.write(press.flush())
            out.close()
            return _batch([(path, count)], schema)

        system, root = _opened(folder)
        system.create_dir(root, recursive=True)
        for batch in slices(batches, "payload"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "original"))):
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid4().hex}.warc.gz"
                    out, press, count, size = system.open_output_stream(_opened(path)[1], compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                for piece in record(*row):
                    size += len(piece)
                    out.write(press.compress(piece))
                count += 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = decided(pages, id_col, url_col, html_col).select(F.col("id").cast("string"), "url", "payload", "digest", F.col("original").cast("string"))
    return written(rows.mapInArrow(stream, "archive string, records bigint"), "archives")


class Inflated:
    """A gzip file, of one member or many, read once from its beginning in pieces."""

    def __init__(self, source, name: str) -> None:
        self.source, self.name = source, name
        self.gz, self.new = zlib.decompressobj(31), True
        self.held, self.at, self.done = bytearray(), 0, False

    def _more(self) -> bool:
        """Inflate at most ``CHUNK`` further bytes; zeros between members and after the last one are passed over."""
        while not self.done:
            if self.gz.eof or self.new:
                raw = self.gz.unused_data.lstrip(b"\0")
                while not raw:
                    raw = self.source.read(READ)
                    if not raw:
                        self.done = True
                        return False
                    raw = raw.lstrip(b"\0")
                self.gz, self.new = zlib.decompressobj(31), False
            else:
                raw = self.gz.unconsumed_tail or self.source.read(READ)
                if not raw:
                    raise ValueError(f"{self.name}: the stream breaks off after {self.at + len(self.held)} bytes")
            try:
                got = self.gz.decompress(raw, CHUNK)
            except zlib.error as e:
                raise ValueError(f"{self.name}: no gzip after {self.at + len(self.held)} bytes: {e}") from e
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """All up to and with the mark, or None where nothing is left."""
        searched = 0
        while (found := self.held.find(mark, max(0, searched - len(mark)))) < 0:
            searched = len(self.held)
            if searched > most or not self._more():
                if not self.held:
                    return None
                raise ValueError(f"{self.name}: no record at byte {self.at}")
        return self._take(found + len(mark))

    def _take(self, size: int) -> bytes:
        out = bytes(self.held[:size])
        del self.held[:size]
        self.at += len(out)
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes."""
        while size:
            if not self.held and not self._more():
                raise ValueError(f"{self.name}: {size} bytes are missing at its end")
            piece = self._take(min(size, len(self.held)))
            size -= len(piece)
            yield piece

    def skip_newlines(self) -> None:
        while self.held or self._more():
            rest = self.held.lstrip(b"\r\n")
            self.at += len(self.held) - len(rest)
            self.held = rest
            if rest:
                return


def fields(head: bytes) -> dict[str, str]:
    """The header fields by lower-case name; a line that begins with white space continues the one before."""
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if k}


def _block_size(head: bytes, name: str, at: int) -> tuple[dict[str, str], int]:
    named = fields(head)
    size = named.get("content-length", "")
    if not head.startswith(b"WARC/") or not size.isdigit():
        raise ValueError(f"{name}: no WARC record at byte {at}")
    return named, int(size)


def members(archive: str, out: Callable[[bytes], object]) -> Iterator[tuple]:
    """Rewrite an archive's records as gzip members; (offset, length, fields, block bytes) of each."""
    system, path = _opened(archive)
    offset = 0
    with system.open_input_stream(path, compression=None) as source:
        stream = Inflated(source, archive)
        while True:
            stream.skip_newlines()
            at = stream.at
            head = stream.until(b"\r\n\r\n")
            if head is None:
                return
            named, size = _block_size(head, archive, at)
            press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            length = 0
            for piece in chain([head], stream.pieces(size), [b"\r\n\r\n"]):
                packed = press.compress(piece)
                length += len(packed)
                out(packed)
            packed = press.flush()
            out(packed)
            length += len(packed)
            yield offset, length, named, size
            offset += length


def normalise(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """The index of archives in which each record is a gzip member of its own, from a DataFrame with ``archive``."""
    spark = archives.sparkSession
    folder = folder or scratch_path(spark, "warc-members")
    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    schema = [(n, pa.int64() if n in ("offset", "length", "block_bytes") else pa.string()) for n in names]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                path = f"{folder}/{archive.rsplit('/', 1)[-1].removesuffix('.gz').removesuffix('.warc')}-{uuid4().hex[:12]}.warc.gz"
                rows = []
                with system.open_output_stream(_opened(path)[1], compression=None) as out, system.open_output_stream(_opened(path + ".idx")[1], compression=None) as sidecar:
                    for offset, length, named, size in members(archive, out.write):
                        row = (path, offset, length, named.get("warc-type"), named.get("warc-record-id"), named.get("warc-refers-to"),
                               named.get("warc-target-uri"), named.get("warc-page-id"), size)
                        sidecar.write("\t".join("-" if x is None else str(x) for x in row[1:7]).encode() + b"\n")
                        rows.append(row)
                        if len(rows) == 4096:
                            yield _batch(rows, schema)
                            rows = []
                yield _batch(rows, schema)

    # one task for each archive: a gzip stream has one beginning
    count = archives.count()
    dealt = archives.select("archive").repartitionByRange(max(1, count), "archive")
    return written(dealt.mapInArrow(rewrite, INDEX), "index")


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _shown_size(block: bytes) -> int:
    size = fields(block.partition(b"\r\n\r\n")[0]).get("content-length", "")
    return int(size) if size.isdigit() else 0


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """(record_id, page_id, url, type, refers_to, refers_to_page, payload_bytes, payload_digest[, payload]) of the records of an index.

    Digests of responses are taken from their bytes; one that differs from the record's own raises an error.
    """
    names = ["record_id", "page_id", "url", "type", "refers_to", "refers_to_page", "payload_bytes", "payload_digest", "payload"]
    schema = [(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names]
    shown = schema if payloads else schema[:-1]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if source is not None:
                        source.close()
                    system, path = _opened(archive)
                    name, source = archive, system.open_input_file(path)
                source.seek(offset)
                raw = zlib.decompress(source.read(length), 31)
                cut = raw.find(b"\r\n\r\n") + 4
                named, size = _block_size(raw[:cut], archive, offset)
                block = raw[cut:cut + size]
                digest = named.get("warc-payload-digest", "").partition(":")[2] or None
                if named.get("warc-type") == "revisit":
                    payload, count = b"", _shown_size(block)
                else:
                    payload = _payload(block)
                    count, found = len(payload), sha256(payload).hexdigest()
                    if digest not in (None, found):
                        raise ValueError(f"{archive}: the record at {offset} has another payload than its digest")
                    digest = found
                row = (named.get("warc-record-id"), named.get("warc-page-id"), named.get("warc-target-uri"), named.get("warc-type"),
                       named.get("warc-refers-to"), named.get("warc-refers-to-page-id"), count, digest, payload)
                rows.append(row if payloads else row[:-1])
                held += len(payload) if payloads else 0
                if held > 16 << 20:
                    yield _batch(rows, shown)
                    rows, held = [], 0
            yield _batch(rows, shown)
        if source is not None:
            source.close()

    # neighbours in an archive stay together, and a large archive is read by many tasks
    return index.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(
        fetch, ", ".join(f"{n} {'bigint' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in shown))
