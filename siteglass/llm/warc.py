"""Dictionary-compressed WARC archives.

Every record is a Zstandard frame of its own, compressed with a dictionary that is built from a bounded sample of the records and
stands in a skippable frame at the head of each archive. Records of equal payload are written once; the others revisit them.
Tasks write archives into a shared folder under names of their own attempt and report them; the reported list is written as
a table, and only archives on it are read, so archives of lost or repeated attempts do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import below, kept, scratch

#: Magic number of the skippable frame that holds a dictionary, and profile of revisit records.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_ROW_CHARS, ARCHIVE_BYTES, LEVEL = 64 << 10, 500, 64 << 10, 64 << 20, 6
RECORD_KINDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def bare(value: str) -> str:
    """A header value: no line ends or other control characters."""
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None, date: str) -> bytes:
    """One WARC record; ``payload`` is None for a revisit of page ``first``. ``size`` and ``digest`` are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{digest}')}"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {bare(url)}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; from too few samples the samples themselves are one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


class Archives:
    """Writes records of one task into archives of bounded size."""

    def __init__(self, folder: str, dictionary: bytes, limit: int = ARCHIVE_BYTES):
        import zstandard

        self.files, self.root = file_system(folder)
        self.files.create_dir(self.root, recursive=True)
        self.folder, self.dictionary, self.limit = folder, dictionary, limit
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        task = TaskContext.get()
        self.name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}" if task else f"part-{uuid.uuid4().hex}"
        self.done: list[tuple[str, int, int]] = []
        self.out, self.records = None, 0

    def write(self, data: bytes) -> None:
        if self.out is None:
            path = f"{self.name}-{len(self.done):04d}.warc.zst"
            self.out, self.path = self.files.open_output_stream(f"{self.root}/{path}"), path
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(self.dictionary)) + self.dictionary)
        self.out.write(self.compressor.compress(data))
        self.records += 1
        if self.out.tell() >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            size = self.out.tell()
            self.out.close()
            self.done.append((f"{self.folder}/{self.path}", self.records, size))
            self.out, self.records = None, 0


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an open archive, one record in memory at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(stream.read(size))
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True), 1 << 20)
    while first := reader.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        headers = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        length = int(headers["content-length"])
        block = reader.read(length)
        if len(block) != length or reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, block


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_verdicts(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, digest, and the first page of those with the same payload of at least ``least`` bytes.

    Digests are grouped without the pages; the join brings one row per repeated payload to the pages, and a payload of very many
    pages is split by adaptive execution.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    groups = keyed.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return keyed.join(groups, "digest", "left")


def dictionary_pages(pages: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` pages (page_id, url, html) of at most SAMPLE_ROW_CHARS characters, at most twice as many; the dictionary is built from them.

    The pages whose hash of id and url is below a threshold, which follows from their number: a partition sends on its share of the sample
    only, and the pages of one id and url count once.
    """
    mark = F.xxhash64("page_id", "url")
    short = pages.where(F.coalesce(F.length("html"), F.lit(0)) <= SAMPLE_ROW_CHARS).select("page_id", "url", "html", mark.alias("mark"))
    part = below(rows, short.count())
    return short.where(F.col("mark") <= part).groupBy("mark").agg(F.min(F.struct("page_id", "url", "html")).alias("page")).limit(2 * rows).select("page.*")


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into ``folder``; returns (path, records, bytes) of the archives.

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least ``least`` bytes that of the smallest page_id is a
    response and the others revisit it; rows that repeat the smallest page_id are responses too, and so are all rows of a payload of
    which no row has an id. A null url has no target header. No pages, no archives. Other columns are ignored.
    """
    rows = with_verdicts(pages, least)
    sample = dictionary_pages(pages).collect()
    payloads = [(r, (r.html or "").encode()) for r in sample]
    dictionary = build_dictionary([record(r.page_id, r.url, p, len(p), sha1(p), None, date) for r, p in payloads])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archives(folder, dictionary, limit)
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, html, digest, first = (batch.column(c)[at].as_py() for c in ("page_id", "url", "html", "digest", "first"))
                payload = html.encode()
                again = first is not None and page_id != first
                out.write(record(page_id, url, None if again else payload, len(payload), base64.b32encode(bytes.fromhex(digest)).decode(), first, date))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in out.done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return kept(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives listed in (path): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    The payload of a revisit is null, its size is that of the HTTP header. The digest of a response is held against its payload.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = file_system(path)
                rows, held = [], 0
                with files.open_input_stream(name) as stream:
                    for headers, block in records_of(stream):
                        rows.append(row_of(headers, block))
                        held += len(block)
                        if held > 8 << 20:
                            yield table(rows)
                            rows, held = [], 0
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in RECORD_KINDS.split(", ")])

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(n, "path").mapInArrow(run, RECORD_KINDS)


def row_of(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length:")[2].split()[0])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or sha1(payload) != digest):
        raise ValueError(f"{headers['warc-record-id']}: the payload does not have its digest")
    return page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], size, digest, page_of(headers["warc-refers-to"]) if revisit else None, None if revisit else payload


def page_of(name: str) -> int | None:
    return int(name.removeprefix("<urn:page:")[:-1]) if name.startswith("<urn:page:") else None


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    written = write_archives(pages, folder or scratch(pages.sparkSession, "warc"))
    return read_archives(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
