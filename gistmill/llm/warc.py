"""WARC archives with revisit records, and a two-level capture index over them.

Archives.  Each writing task makes gzip members, one a record, in files of its own in the
shared folder, and reports a capture for each; captures are written as a table, so files of a task that was lost or
repeated are never named by it.  Payloads of at least ``revisit_from`` bytes that are equal
are stored once, by the smallest page id; the others are revisit records that name it.  Which they are is found on
digests alone; what is shuffled for it are members that are compressed already.

Index.  A capture's key is its URL with the host reversed (``com,example,www)/path?query``).
Captures are range-partitioned and sorted by key and place, written as gzip blocks of
``block_lines`` lines, and a sparse directory keeps the first and last key and the place of each
block.  A directory of more than ``top_rows`` rows is written as blocks in turn, with a directory of its own, so
the one that is sent to the executors is bounded.  Looking up a key is a binary search in that directory,
one in each decompressed block on the way, and a range read in the archive.  Each step sends keys to the tasks by block, in order, so a block is
read once, and records to the tasks by stretch of an archive, in order, so neighbours are read at once.
Keys are told apart by the place of the record too, so a
host, or a URL, with a third of all captures is spread over many blocks, which are searched in different tasks.

Files are written with pyarrow's filesystems at the URI of the shared folder.

Defined cases.  A null html is an empty payload.  A null URL has an empty key and no
WARC-Target-URI.  Repeated rows of the smallest page id are all responses.  A null page id
counts as larger than any other.  Line ends in URLs are percent-encoded.  Very long payloads are records as others, read one at a time.
Empty tables give empty results.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import delete, new_path, small_batches, stored

DATE = "2024-01-01T00:00:00Z"
STAMP = "20240101000000"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PORTS = {"http": 80, "https": 443}


def reversed_host(url: str | None) -> str:
    """The sort key of a URL: host reversed and lower-cased, without ``www``, user, default port and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return (url or "").strip()
    if not host:
        return (url or "").strip()
    if host.startswith("www."):
        host = host[4:]
    key = ",".join(reversed(host.split(".")))
    if port and port != _PORTS.get(parts.scheme):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """One uncompressed WARC/1.1 record of a payload of ``size`` bytes: a response, or, without ``payload``, a revisit of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if payload is None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record and its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    body = block.partition(b"\r\n\r\n")[2]
    number = lambda v: int(v[len("<urn:x-page:") : -1]) if v and v != "<urn:x-page:>" else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "payload": body if fields["warc-type"] == "response" else None, "refers_to": number(fields.get("warc-refers-to")),
        "digest": fields["warc-payload-digest"].removeprefix("sha256:"),
    }


def _member(raw: bytes) -> bytes:
    return gzip.compress(raw, 6, mtime=0)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 100, archive_bytes: int = 256 << 20) -> tuple[DataFrame, str]:
    """Write the rows as WARC files below ``folder``; the captures, as a stored table, and its path."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("gm_id"), F.col(f"`{url_col}`").cast("string").alias("gm_url"), html.alias("gm_html"))
    rows = rows.withColumn("gm_digest", F.sha2("gm_html", 256))
    copies = rows.filter(F.octet_length("gm_html") >= revisit_from).groupBy("gm_digest")
    copies = copies.agg(F.min("gm_id").alias("gm_first"), F.count("*").alias("gm_n")).filter("gm_n > 1").select("gm_digest", "gm_first")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(2).to_pylist()
            made = [_member(record(i, u, d, len(p), p)) for i, u, p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(map(len, payloads), pa.int64()), pa.array(made, pa.binary())], names=["gm_id", "gm_url", "gm_digest", "gm_size", "gm_member"]
            )

    packed = rows.mapInArrow(pack, "gm_id long, gm_url string, gm_digest string, gm_size long, gm_member binary")
    refers = F.when(~F.col("gm_id").eqNullSafe(F.col("gm_first")), F.col("gm_first"))
    todo = packed.join(copies, "gm_digest", "left").select("gm_id", "gm_url", "gm_digest", "gm_size", F.when(refers.isNull(), F.col("gm_member")).alias("gm_member"), refers.alias("gm_refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        for batch in batches:
            keys, files, offsets, sizes = [], [], [], []
            for page_id, url, digest, size, member, refers in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                member = member or _member(record(page_id, url, digest, size, None, refers))
                out.write(member)
                keys.append(reversed_host(url))
                files.append(name)
                offsets.append(at)
                sizes.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), batch.column(1), batch.column(2), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())],
                names=["key", "url", "digest", "file", "offset", "size"],
            )
        if out is not None:
            out.close()

    return stored(todo.mapInArrow(write, CAPTURE), "captures")


CAPTURE = "key string, url string, digest string, file string, offset long, size long"
_ENTRY = "first_key string, last_key string, file string, offset long, size long"


@dataclass(frozen=True)
class Index:
    """Levels of sorted blocks below ``folder``, level 0 of captures, and the directory of the last: (first_key, last_key, file, offset, size) a block."""

    folder: str
    levels: int
    directory: DataFrame
    path: str


def _write_level(rows: DataFrame, folder: str, block_lines: int, parts: int) -> tuple[DataFrame, str]:
    """Write ``rows``, whose first two columns are the first and the last key of each, as sorted, compressed blocks of JSON lines; their directory, stored, and its path."""
    order = [*rows.columns[:2], "file", "offset"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.cdxj.gz"
        out, at = None, 0
        lines: list[tuple[str, str, str]] = []

        def flush() -> pa.RecordBatch:
            nonlocal out, at
            if out is None:
                out = where.open_output_stream(f"{root}/{name}", compression=None)
            member = _member("\n".join(x[2] for x in lines).encode())
            out.write(member)
            row = {"first_key": lines[0][0], "last_key": max(x[1] for x in lines), "file": name, "offset": at, "size": len(member)}
            at += len(member)
            lines.clear()
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for first, last, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                lines.append((first, last, f"{json.dumps(first)} {STAMP} {json.dumps([last, *rest])}"))
                if len(lines) >= block_lines:
                    yield flush()
        if lines:
            yield flush()
        if out is not None:
            out.close()

    return stored(dealt.mapInArrow(work, _ENTRY), "directory")


def write_index(captures: DataFrame, folder: str, block_lines: int = 512, top_rows: int = 1 << 16) -> Index:
    """Write sorted, compressed blocks of captures below ``folder``, and blocks of directories as long as the last has more than ``top_rows`` rows."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    directory, path = _write_level(captures.select("key", F.col("key").alias("last"), "file", "offset", "size", "url", "digest"), f"{folder}/0", block_lines, parts)
    levels = 1
    while (rows := directory.count()) > max(top_rows, 1):
        # each task leaves a block that is not full, so there are few beside the full ones, and a level is always shorter than the one below
        upper, upper_path = _write_level(directory, f"{folder}/{levels}", max(block_lines, 2), min(parts, 1 + rows // (64 * block_lines)))
        delete(captures.sparkSession, path)
        directory, path, levels = upper, upper_path, levels + 1
    return Index(folder, levels, directory, path)


_DECODER = json.JSONDecoder()


def _key(line: str) -> str:
    return _DECODER.raw_decode(line)[0]


def entries(lines: list[str], key: str) -> Iterator[list]:
    """(last_key, file, offset, size, ...) of every line of a block whose keys take ``key`` in."""
    ends = bisect.bisect_right(lines, key, key=_key)
    for line in lines[:ends][::-1]:
        value = json.loads(line[_DECODER.raw_decode(line)[1] + len(STAMP) + 2 :])
        if value[0] < key:  # lines before it end no later: all are sorted
            return
        yield value


def _by_block(rows: DataFrame, folder: str, ddl: str, found: Callable[[str, list], tuple]) -> DataFrame:
    """(key, and what ``found(key, entry)`` makes of it) of every entry that takes in the key, in the block that a row (key, file, offset, size) names."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset", "key")
    names = [c.split()[0] for c in ddl.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder)
        held, lines = None, []
        for batch in batches:
            out: list[tuple] = []
            for key, file, offset, size in zip(*[c.to_pylist() for c in batch.columns]):
                if held != (file, offset):
                    with where.open_input_file(f"{root}/{file}") as source:
                        lines = zlib.decompress(source.read_at(size, offset), 31).decode().split("\n")
                    held = (file, offset)
                out += [found(key, e) for e in entries(lines, key)]
            yield pa.RecordBatch.from_pydict({n: [o[i] for o in out] for i, n in enumerate(names)}, schema=pa.schema([(n, pa.int64() if n in ("offset", "size") else pa.string()) for n in names]))

    return dealt.mapInArrow(work, ddl)


def search(keys: DataFrame, index: Index) -> DataFrame:
    """The captures of every key of the column ``key``: a binary search in the directory, then one in a block of each level."""
    held = keys.sparkSession.sparkContext.broadcast(sorted(tuple(r) for r in index.directory.collect()))
    place = "key string, file string, offset long, size long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        lasts = [r[1] for r in rows]
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                at = bisect.bisect_left(lasts, key)
                while at < len(rows) and rows[at][0] <= key:
                    out.append((key, *rows[at][2:]))
                    at += 1
            yield pa.RecordBatch.from_pydict({n: [o[i] for o in out] for i, n in enumerate(("key", "file", "offset", "size"))}, schema=pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]))

    found = keys.select("key").distinct().mapInArrow(work, place)
    for level in range(index.levels - 1, 0, -1):
        found = _by_block(found, f"{index.folder}/{level}", place, lambda key, e: (key, *e[1:4]))
    return _by_block(found, f"{index.folder}/0", CAPTURE, lambda key, e: (key, e[4], e[5], *e[1:4]))


#: Bytes of an archive that one task reads in one go, and what it skips rather than reading anew.
STRETCH, GAP = 8 << 20, 1 << 16


def _read(places: list[tuple[str, int, int]], archives: str) -> Iterator[dict]:
    """The records at (file, offset, size), which are in order, by range reads that take in near neighbours."""
    where, root = pafs.FileSystem.from_uri(archives)
    at = 0
    while at < len(places):
        file, start, size = places[at]
        to, end = at + 1, start + size
        while to < len(places) and places[to][0] == file and 0 <= places[to][1] - end <= GAP and places[to][1] + places[to][2] - start <= STRETCH:
            end = places[to][1] + places[to][2]
            to += 1
        with where.open_input_file(f"{root}/{file}") as source:
            held = source.read_at(end - start, start)
        for _, offset, n in places[at:to]:
            yield parse(zlib.decompress(held[offset - start : offset - start + n], 31))
        at = to


_ROW = "page_id long, url string, record_type string, refers_to long, stated_digest string, payload_bytes long, payload_digest string"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]


def fetch(captures: DataFrame, archives: str, payloads: bool = False) -> DataFrame:
    """The record of every capture: key, its fields, the bytes and digest of its payload, null for a revisit, and (``payloads``) the payload itself."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small_batches(captures.sparkSession)
    dealt = captures.select("key", "file", "offset", "size").repartition(parts, F.col("file"), F.floor(F.col("offset") / F.lit(STRETCH))).sortWithinPartitions("file", "offset")
    names = ["key", *[c.split()[0] for c in _ROW.split(", ")]] + ["payload"] * payloads

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), *_TYPES] + [pa.binary()] * payloads
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        for batch in batches:
            keys, *place = (c.to_pylist() for c in batch.columns)
            out, held = [], 0
            for key, r in zip(keys, _read(list(zip(*place)), archives)):
                body = r["payload"]
                told = (None, None) if body is None else (len(body), hashlib.sha256(body).hexdigest())
                out.append((key, r["page_id"], r["url"], r["record_type"], r["refers_to"], r["digest"], *told) + (body,) * payloads)
                held += len(body or b"") if payloads else 0
                if held > STRETCH:
                    yield pack(out)
                    out, held = [], 0
            yield pack(out)

    return dealt.mapInArrow(work, "key string, " + _ROW + ", payload binary" * payloads)


def keys_of(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct gm_asked (the URL) and key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(reversed_host, batch.column(0).to_pylist()), pa.string())], names=["gm_asked", "key"])

    return urls.select(F.col(f"`{url_col}`").cast("string").alias("gm_asked")).distinct().mapInArrow(work, "gm_asked string, key string")


def lookup(urls: DataFrame, index: Index, archives: str, url_col: str = "url", payloads: bool = True) -> DataFrame:
    """Records whose URL has the key of a distinct value of ``url_col``: asked_url and the record's columns."""
    asked = keys_of(urls, url_col)
    found = fetch(search(asked, index), archives, payloads)
    return asked.join(found, "key").select(F.col("gm_asked").alias("asked_url"), *[c for c in found.columns if c != "key"])


def resolved(found: DataFrame) -> tuple[DataFrame, str]:
    """Records read back, with the payload columns of revisits filled in from the record they refer to; and the path of the stored table that they read."""
    table, path = stored(found.select("page_id", "url", "record_type", "refers_to", "stated_digest", "payload_bytes", "payload_digest"), "records")
    needed = table.filter("record_type = 'revisit'").select(F.col("refers_to").alias("gm_need")).distinct()
    kept = table.filter("record_type = 'response'").join(needed, F.col("page_id") == F.col("gm_need"), "left_semi")
    kept = kept.groupBy(F.col("page_id").alias("gm_page")).agg(F.max(F.struct("payload_digest", "payload_bytes")).alias("gm_payload"))
    rows = table.filter("record_type = 'revisit'").join(kept, F.col("refers_to") == F.col("gm_page"), "left")
    rows = rows.select("page_id", "url", "record_type", "refers_to", "stated_digest", F.col("gm_payload.payload_bytes"), F.col("gm_payload.payload_digest"))
    return table.filter("record_type = 'response'").unionByName(rows), path


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to WARC files with revisits, and read back by its URL through the capture index."""
    pages, folder = spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc")
    captures, path = write_archives(pages, f"{folder}/archive")
    index = write_index(captures, f"{folder}/index")
    found, _ = resolved(fetch(search(keys_of(pages), index), f"{folder}/archive"))
    delete(spark, folder, path, index.path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
