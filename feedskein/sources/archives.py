"""Captures in crawl archives, as a data source: spark.read.format("capture_archive").

An archive is a file of records, each a gzip member of its own: some header lines, the address
and time of the fetch among them, then the response as it came over HTTP. Since members follow
each other without an index, a file is cut at any byte: the task of a range looks for the first
member that starts in it and reads on to the last one that does. So a large file is read by
many tasks, and a broken member costs that record alone.

Filters on url (equality, a list, a prefix) are applied to the header lines, before a response
is decoded; spark.sql.python.filterPushdown.enabled lets Spark hand them over. As a stream, the
archives of a folder are taken in the order of their names, which crawlers make from the time;
the offset is the last name taken. Writing makes one archive per task, under a name that
appears when the job has succeeded.
"""

import gzip
import uuid
import zlib
from datetime import datetime, timezone
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage,
)

NAME, SUFFIX = "capture_archive", ".warc.gz"
SPLIT_BYTES = 64 << 20
READ_BYTES, PROBE_BYTES = 1 << 20, 4096
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
COLUMNS = "url string, final_url string, http_status int, error_kind string, body string, fetched_at timestamp"

# What a gzip member and a record begin with, and the names of header fields.
MEMBER, RECORD = b"\x1f\x8b\x08", b"WARC/"
KIND, ADDRESS, TIME, SIZE = "warc-type", "warc-target-uri", "warc-date", "content-length"

# Our own fields: where a client that followed redirects ended, and why a fetch failed.
ENDED_AT, FAILED = "x-final-url", "x-fetch-error"

_ARROW = pa.schema([
    ("url", pa.string()), ("final_url", pa.string()), ("http_status", pa.int32()), ("error_kind", pa.string()),
    ("body", pa.string()), ("fetched_at", pa.timestamp("us", "UTC")),
])


# --- members and records ----------------------------------------------------------------


def _begins_record(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, len(RECORD)) == RECORD
    except zlib.error:
        return False


def first_member(file, begin: int, end: int):
    """Where the first member starts that starts in [begin, end); None if none does."""
    file.seek(begin)
    at, held = begin, b""
    while at < end:
        more = file.read(READ_BYTES)
        window, place = held + more, 0
        while True:
            place = window.find(MEMBER, place)
            if place < 0:
                place = max(0, len(window) - len(MEMBER) + 1)
                break
            if at + place >= end:
                return None
            if more and len(window) - place < PROBE_BYTES:
                break  # its beginning is not all here
            if _begins_record(window[place:place + PROBE_BYTES]):
                return at + place
            place += 1
        if not more:
            return None
        at, held = at + place, window[place:]
    return None


def members(file, begin: int, end: int):
    """The contents of the members that start in [begin, end). Broken ones are passed over,
    and one that the file's end cuts off."""
    at = first_member(file, begin, end)
    while at is not None and at < end:
        file.seek(at)
        data, start = b"", at
        try:
            while at < end:
                opened, parts, used = zlib.decompressobj(31), [], 0
                while not opened.eof:
                    data = data or file.read(READ_BYTES)
                    if not data:
                        return
                    parts.append(opened.decompress(data))
                    used += len(data)
                    data = opened.unused_data
                start, at = at, at + used - len(data)
                yield b"".join(parts)
                data = data or file.read(READ_BYTES)
                if not data:
                    return
        except zlib.error:
            at = first_member(file, at + 1, end)


def _fields(lines: bytes) -> dict:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n")[1:])
    return {name.strip().decode("latin-1").lower(): value.strip().decode("utf-8", "replace") for name, _, value in pairs}


def _unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:line].split(b";")[0] or b"0", 16)
        if not size:
            break
        parts.append(body[line + 2:line + 2 + size])
        at = line + 2 + size + 2
    return b"".join(parts)


def _text(body: bytes, headers: dict):
    if "content-type" not in headers and not body:
        return None
    try:
        if headers.get("transfer-encoding", "").lower() == "chunked":
            body = _unchunked(body)
        if headers.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
    except (ValueError, OSError, EOFError, zlib.error):
        pass  # as it is
    charset = headers.get("content-type", "").lower().partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def capture(record: bytes, wanted=None):
    """The capture in a record as a row; None for other records, and those whose address is
    not wanted."""
    head, _, content = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    url = fields.get(ADDRESS, "").strip("<>")
    if not url or wanted is not None and not wanted(url):
        return None
    try:
        at = datetime.fromisoformat(fields.get(TIME, "").replace("Z", "+00:00"))
        at = at.replace(tzinfo=at.tzinfo or timezone.utc)
    except ValueError:
        at = None
    if fields.get(KIND) == "metadata" and FAILED in fields:
        return url, fields.get(ENDED_AT), None, fields[FAILED], None, at
    if fields.get(KIND) != "response":
        return None
    content = content[:int(fields[SIZE])] if fields.get(SIZE, "").isdigit() else content
    head, _, body = content.partition(b"\r\n\r\n")
    status = head.split(b"\r\n")[0].split(b" ")[1:2]
    status = int(status[0]) if status and status[0].isdigit() else None
    headers = _fields(head)
    ended = fields.get(ENDED_AT)
    if ended is None:
        ended = urljoin(url, headers["location"]) if headers.get("location") else url
    return url, ended, status, None, _text(body, headers), at


def record(row) -> bytes:
    """The member for a capture."""
    at = row.fetched_at.astimezone(timezone.utc).isoformat() if row.fetched_at else ""
    failed = row.http_status is None
    body = b""
    if not failed:
        content = row.body.encode() if row.body is not None else b""
        headers = f"HTTP/1.1 {row.http_status} -\r\n" + ("Content-Type: text/plain; charset=utf-8\r\n" if row.body is not None else "")
        body = headers.encode() + b"\r\n" + content
    lines = [f"WARC-Type: {'metadata' if failed else 'response'}", f"WARC-Target-URI: {row.url}", f"WARC-Date: {at}", f"Content-Length: {len(body)}"]
    lines += [f"X-Final-URL: {row.final_url}"] if row.final_url is not None else []
    lines += [f"X-Fetch-Error: {row.error_kind or ''}"] if failed else []
    return gzip.compress(("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n", 6, mtime=0)


# --- the data source --------------------------------------------------------------------


def _file_system(path: str):
    """(file system, path in it); a path without scheme is local or mounted."""
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


def _archives(path: str):
    """(name, size) of the archives at path, by name: a folder's, or the one."""
    system, path = _file_system(path)
    info = system.get_file_info(path)
    if info.type == files.FileType.File:
        return [(info.path, info.size)]
    if info.type == files.FileType.NotFound:
        return []
    found = system.get_file_info(files.FileSelector(path, recursive=False))
    return sorted((f.path, f.size) for f in found if f.type == files.FileType.File and f.path.endswith(SUFFIX) and f.base_name[:1] not in "._")


class Range(InputPartition):
    def __init__(self, name, begin, end):
        self.name, self.begin, self.end = name, begin, end


def _ranges(archives, split):
    return [Range(name, begin, min(begin + split, size)) for name, size in archives for begin in range(0, size, split)]


class _Wanted:
    """Whether an address passes all filters that were handed over."""

    def __init__(self):
        self.tests = []

    def take(self, f):
        if getattr(f, "attribute", None) != ("url",):
            return False
        if isinstance(f, EqualTo):
            self.tests.append(("in", {f.value}))
        elif isinstance(f, In):
            self.tests.append(("in", set(f.value)))
        elif isinstance(f, StringStartsWith):
            self.tests.append(("begins", f.value))
        else:
            return False
        return True

    def __call__(self, url):
        return all(url in value if kind == "in" else url.startswith(value) for kind, value in self.tests)


def _batches(path, part, wanted=None):
    system, _ = _file_system(path)
    rows, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW)

    with system.open_input_file(part.name) as file:
        for content in members(file, part.begin, part.end):
            row = capture(content, wanted)
            if row is None:
                continue
            rows.append(row)
            held += len(row[4] or "")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


class ArchiveReader(DataSourceReader):
    def __init__(self, path, split):
        self.path, self.split, self.wanted = path, split, _Wanted()

    def pushFilters(self, filters):
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self):
        return _ranges(_archives(self.path), self.split) or [Range(None, 0, 0)]

    def read(self, partition):
        if partition.name is not None:
            yield from _batches(self.path, partition, self.wanted)


class ArchiveStream(DataSourceStreamReader):
    def __init__(self, path, split):
        self.path, self.split = path, split

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        archives = _archives(self.path)
        return {"after": archives[-1][0] if archives else ""}

    def partitions(self, start, end):
        new = [a for a in _archives(self.path) if start["after"] < a[0] <= end["after"]]
        return _ranges(new, self.split)

    def read(self, partition):
        yield from _batches(self.path, partition)


class Written(WriterCommitMessage):
    def __init__(self, name):
        self.name = name


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path, overwrite):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        system, path = _file_system(self.path)
        system.create_dir(path, recursive=True)
        name = f"{path}/_{uuid.uuid4().hex}"
        with system.open_output_stream(name) as file:
            for row in iterator:
                file.write(record(row))
        return Written(name)

    def commit(self, messages):
        system, path = _file_system(self.path)
        old = [name for name, _ in _archives(self.path)] if self.overwrite else []
        time = datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f")
        for number, message in enumerate(m for m in messages if m):
            if system.get_file_info(message.name).size:
                system.move(message.name, f"{path}/captures-{time}-{number:05d}{SUFFIX}")
            else:
                system.delete_file(message.name)
        for name in old:
            system.delete_file(name)

    def abort(self, messages):
        system, _ = _file_system(self.path)
        for message in messages:
            if message:
                system.delete_file(message.name)


class CaptureArchive(DataSource):
    """Options: path, split_bytes."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return COLUMNS

    def _split(self):
        return int(self.options.get("split_bytes", SPLIT_BYTES))

    def reader(self, schema):
        return ArchiveReader(self.options["path"], self._split())

    def streamReader(self, schema):
        return ArchiveStream(self.options["path"], self._split())

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"], overwrite)


def register_archives(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.dataSource.register(CaptureArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
