"""WARC archives with a two-level capture index.

Tasks write archives of one gzip member per record to the shared folder. Index entries, sorted by
reversed-host URL key, go to compressed blocks; a sparse directory holds each block's first key. A
lookup searches the directory by bisection, reads one block by range, searches that, and reads the
record by range from its archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloop.llm.common import batches, open_folder, pick, shared_uri
from vecloop.session import write_and_reread

#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: Entries in a compressed index block.
BLOCK_ENTRIES = 512
#: Compressed bytes of records that one task reads back, about.
TASK_BYTES = 4 << 20
#: The date of records whose capture time is not known.
CAPTURED = "1970-01-01T00:00:00Z"

_ENTRY = [("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
ENTRY_SCHEMA = "key string, page_id bigint, file string, offset bigint, length bigint"
RECORD_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: ``org,example,www)/a?b``. No URL, or one that can't be split: the text itself."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return _line(url or "")
    if not host:
        return _line(url or "")
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return _line(f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""))


def _line(value: str) -> str:
    """No blanks or control characters, which would end a header or an entry."""
    return quote(value, safe="".join(map(chr, range(33, 127))))


def _record(ident: str, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """The bytes of a record. Pages are named in fields of our own, since a page that occurs twice has two records."""
    if refers_to is None:
        kind, body = "response", payload
    else:
        kind, body = "revisit", b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{ident}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(body)}",
    ]
    if refers_to is not None:
        lines.insert(3, f"X-Refers-To-Page-ID: {refers_to}")
        lines.insert(3, f"WARC-Refers-To-Date: {date}")
        lines.insert(3, f"WARC-Refers-To-Target-URI: {_line(refers_url or '')}")
        lines.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """Back from the bytes of one record; a response's length and digest are taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    ident = headers["X-Page-ID"]
    page_id, url = int(ident) if ident else None, headers["WARC-Target-URI"]
    if headers["WARC-Type"] == "revisit":
        target = int(headers["X-Refers-To-Page-ID"])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        return page_id, url, int(headers["X-Payload-Length"]), digest, "revisit", target, None
    return page_id, url, len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload


def _new_file(folder: str, name: str):
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    # A retried task writes another file; only the entries of the attempt that counts name theirs.
    file = f"{name}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.gz"
    return file, fs.open_output_stream(f"{root}/{file}", compression=None)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = CAPTURED
) -> DataFrame:
    """Write a record per row; returns the entries ``key, page_id, file, offset, length``, in a written table. ``date``: when the pages were captured.

    Null html is an empty payload, a null url an empty one. Of records with equal payloads of at least
    ``REVISIT_BYTES``, the largest id is the response (all rows that repeat it are), the others are
    revisits. A null id is never the largest; if all ids of a payload are null, all are responses.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = rows.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    # Sizes go with the digest, so equal payloads meet even if most pages share one.
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    kept = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.max_by("url", "page_id").alias("keeper_url"))
    other = ~F.col("keeper").eqNullSafe(F.col("page_id"))
    planned = rows.join(kept, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(other, F.col("keeper")).alias("refers_to"), F.when(other, F.col("keeper_url")).alias("refers_url")
    )

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out = _new_file(folder, "pages")

        def entries():
            offset = 0
            with out:
                for part in parts:
                    for page_id, url, *rest in zip(*[c.to_pylist() for c in part.columns]):
                        # A file's name is used once, so its name and the place in it make an identifier.
                        ident = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{file}:{offset}"))
                        member = gzip.compress(_record(ident, date, page_id, url, *rest), 6, mtime=0)
                        out.write(member)
                        yield url_key(url), page_id, file, offset, len(member)
                        offset += len(member)

        yield from batches(entries(), pa.schema(_ENTRY))

    return write_and_reread(planned.mapInArrow(write, ENTRY_SCHEMA), "captures")


@dataclass(frozen=True)
class CaptureIndex:
    """``parts``: (first entry, index file, directory file) of each sorted part, one per writing task."""

    folder: str
    parts: list[tuple[tuple, str, str]]


def _order(key: str, page_id: int | None) -> tuple:
    """Spark's order of (key, page_id): UTF-8 bytes, nulls first."""
    return key.encode(), page_id is not None, page_id or 0


def build_index(entries: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> CaptureIndex:
    """Sort the entries over the cluster; each task writes its range as blocks and their directory."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = out = None
        directory: list[str] = []
        held: list[list] = []
        offset = 0

        def flush():
            nonlocal offset
            member = gzip.compress(("\n".join(json.dumps(e) for e in held) + "\n").encode(), 6, mtime=0)
            out.write(member)
            directory.append(json.dumps([*held[0][:2], offset, len(member)]))
            offset += len(member)
            held.clear()

        for part in parts:
            for entry in zip(*[c.to_pylist() for c in part.columns]):
                if out is None:
                    file, out = _new_file(folder, "index")
                held.append(list(entry))
                if len(held) >= block_entries:
                    flush()
        if out is None:
            return
        if held:
            flush()
        out.close()
        name, sink = _new_file(folder, "directory")
        with sink:
            sink.write(gzip.compress("\n".join(directory).encode(), mtime=0))
        first = json.loads(directory[0])
        yield from batches([(first[0], first[1], file, name)], pa.schema([*_ENTRY[:2], ("file", pa.string()), ("directory", pa.string())]))

    ranged = entries.select(*[n for n, _ in _ENTRY]).repartitionByRange("key", "page_id", "file", "offset")
    ranged = ranged.sortWithinPartitions("key", "page_id", "file", "offset")
    parts = ranged.mapInArrow(write, "key string, page_id bigint, file string, directory string").collect()
    found = sorted((_order(p["key"], p["page_id"]), p["file"], p["directory"]) for p in parts)
    return CaptureIndex(folder, found)


class _Reader:
    """Range reads of gzip members, with the last files and the last block kept open."""

    def __init__(self, folder: str):
        self.fs, self.root = open_folder(folder)
        self.files: dict = {}

    def member(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.files:
            if len(self.files) >= 32:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = self.fs.open_input_file(f"{self.root}/{file}")
        return gzip.decompress(self.files[file].read_at(length, offset))

    def whole(self, file: str) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{file}") as f:
            return gzip.decompress(f.read())


def lookup(index: CaptureIndex, wanted: DataFrame, tasks: int | None = None) -> DataFrame:
    """Entries of the distinct ``(url, page_id)`` of ``wanted``; unknown ones give no row.

    ``wanted`` is sorted as the index is, so a task walks through few neighbouring blocks. ``tasks``: how many share the work, and
    the reading of the records found, whose size the small entries don't show; left to Spark if not given.
    """

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index.folder)
        firsts = [p[0] for p in index.parts]
        directories: dict[int, tuple[list, list]] = {}
        blocks: dict[tuple, tuple[list, list]] = {}

        def directory(p: int):
            if p not in directories:
                directories.clear()
                lines = [json.loads(x) for x in reader.whole(index.parts[p][2]).decode().split("\n")]
                directories[p] = [_order(x[0], x[1]) for x in lines], lines
            return directories[p]

        def block(p: int, b: int):
            if (p, b) not in blocks:
                blocks.clear()
                _, _, offset, length = directory(p)[1][b]
                lines = [json.loads(x) for x in reader.member(index.parts[p][1], offset, length).decode().splitlines()]
                blocks[p, b] = [_order(x[0], x[1]) for x in lines], lines
            return blocks[p, b]

        def entries():
            for part in parts:
                for key, page_id in zip(*[c.to_pylist() for c in part.columns]):
                    want = _order(key, page_id)
                    # Equal entries may begin in the part and block before the first that starts with them.
                    p = max(bisect.bisect_left(firsts, want) - 1, 0)
                    while p < len(firsts) and firsts[p] <= want:
                        starts = directory(p)[0]
                        b = max(bisect.bisect_left(starts, want) - 1, 0)
                        while b < len(starts) and starts[b] <= want:
                            keys, lines = block(p, b)
                            yield from lines[bisect.bisect_left(keys, want) : bisect.bisect_right(keys, want)]
                            b += 1
                        p += 1

        yield from batches(entries(), pa.schema(_ENTRY))

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names = pa.array([url_key(u) for u in part.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, part.column(1)], schema=pa.schema(_ENTRY[:2]))

    keyed = wanted.select("url", F.col("page_id").cast("long")).mapInArrow(keys, "key string, page_id bigint").distinct()
    ranged = keyed.repartitionByRange(*([tasks] if tasks else []), "key", "page_id").sortWithinPartitions("key", "page_id")
    return ranged.mapInArrow(search, ENTRY_SCHEMA)


def read_records(entries: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records at ``entries``, by range reads; ``payload=False`` leaves the bytes out (lengths and digests stay)."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)

        def records():
            for part in parts:
                for at in zip(*[c.to_pylist() for c in part.columns]):
                    record = parse_record(reader.member(*at))
                    yield record if payload else (*record[:-1], None)

        yield from batches(records(), _RECORD, 256)

    return entries.select("file", "offset", "length").mapInArrow(read, RECORD_SCHEMA)


def archive_round_trip(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """Write all pages, index them, look every page up, and read the records back. Empty tables give no rows."""
    folder = shared_uri(spark, "warc")
    entries = write_archives(pages, folder, **columns)
    index = build_index(entries, folder)
    tasks = 1 + (entries.agg(F.sum("length").alias("bytes")).head()["bytes"] or 0) // TASK_BYTES
    wanted = pick(pages, url=columns.get("url_col", "url"), page_id=columns.get("id_col", "page_id"))
    return read_records(lookup(index, wanted, tasks), folder, payload=False)
