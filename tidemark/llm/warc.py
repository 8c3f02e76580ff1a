"""Operator 7: WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, each a gzip member of its own. Of equal
payloads the page with the largest key is a response, others are revisits that
name it and leave the payload out. Captures are sorted by their reversed-host
URL key into blocks of lines, compressed one by one, and each file of blocks has
a sparse directory with the first key of each block. A lookup finds its file
among the first keys of the files, its block by binary search in that file's
directory, its lines by binary search in the block, and reads the record with a
range read.

Files are in the shared folder, by a file system that pyarrow opens from its
address. A task's files count only when its rows are in the table of captures
(or of index files), so a task that runs twice leaves no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines of an index block.
BLOCK_LINES = 1000
#: Captures of an index file on average.
FILE_CAPTURES = 1_000_000
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
LEVEL = 4
#: Fixed values of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def open_store(address: str):
    """A file system and the path in it."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(address)
    return store, path.rstrip("/")


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path: ``http://a.b.org:80/x?y#z`` gives ``org,b,a)/x?y``.

    White space and control characters are escaped; null and hostless addresses begin with ``)``.
    """
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else "//" + text)
        host, rest = (parts.hostname or "").rstrip("."), (parts.path or "/") + ("?" + parts.query if parts.query else "")
    except ValueError:  # a host in brackets that isn't one
        host, rest = "", text
    key = ",".join(reversed(host.split("."))) + ")" + rest
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in key)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def write_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """A record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in (url or ""))
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{json.dumps(page_id)}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{json.dumps(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + pack.flush()


def read_record(member: bytes) -> dict:
    """Type, page, digest, length of the payload and, for a response, the payload; the digest is checked."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    page = lambda v: json.loads(v[len("<urn:page:") : -1])
    out = {"record_type": fields["WARC-Type"], "page_id": page(fields["WARC-Record-ID"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(said["Content-Length"]), "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = page(fields["WARC-Refers-To"])
    else:
        out["payload"] = payload
        if len(payload) != out["payload_bytes"] or base32(hashlib.sha1(payload).digest()) != out["payload_digest"]:
            raise ValueError(f"damaged record of page {out['page_id']}")
    return out


def assign_types(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """``page_id, url, payload, sha1, refers_to``: of equal payloads of at least ``least`` bytes others refer to the largest key."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    winners = rows.where(F.octet_length("payload") >= least).groupBy(F.col("sha1").alias("of_sha1")).agg(F.max("page_id").alias("winner"))
    joined = rows.join(winners, F.col("sha1") == F.col("of_sha1"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    return joined.select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))


def write_archives(rows: DataFrame, address: str) -> DataFrame:
    """Write the records; the captures ``key, page_id, file, place, length`` say where each is."""
    schema = f"key string, page_id {rows.schema['page_id'].dataType.simpleString()}, file string, place long, length long"

    def run(batches):
        store, root = open_store(address)
        out, place, name = None, 0, ""
        for batch in batches:
            for ids, urls, digests, refers, payloads in common.small_parts(batch, 2):
                found = []
                for page_id, url, data, sha1, other in zip(ids.to_pylist(), urls.to_pylist(), payloads, digests.to_pylist(), refers.to_pylist(), strict=True):
                    if out is None or place > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, place = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = write_record(page_id, url, data, base32(sha1), other, other is not None)
                    out.write(member)
                    found.append((url_key(url), page_id, name, place, len(member)))
                    place += len(member)
                cols = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), ids.type, pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "place", "length"])
        if out is not None:
            out.close()

    return rows.mapInArrow(run, schema)


def _rank(key: str, page_id) -> tuple:
    return key.encode(), page_id is not None, page_id


def write_index(captures: DataFrame, address: str, files: int) -> list[tuple]:
    """Sort the captures into compressed blocks with sparse directories.

    Returns ``(first key, first page, file)`` of each index file in order: their
    number is the captures' over ``FILE_CAPTURES``, which is all that lookups hold.
    """
    kind = captures.schema["page_id"].dataType.simpleString()

    def run(batches):
        store, root = open_store(address)
        name, out, place, block, directory = f"index-{uuid.uuid4().hex}", None, 0, [], []

        def flush():
            nonlocal place
            data = zlib.compress("\n".join(line for _, _, line in block).encode(), LEVEL)
            out.write(data)
            directory.append((block[0][0], block[0][1], place, len(data)))
            place += len(data)
            block.clear()

        for batch in batches:
            for key, page_id, file, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}.blocks", compression=None)
                block.append((key, page_id, f"{key} {json.dumps([page_id, file, at, length])}"))
                if len(block) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        with store.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
            f.write(zlib.compress(json.dumps(directory).encode()))
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], batch.column(1).type), pa.array([name])], ["key", "page_id", "file"])

    dealt = captures.repartitionByRange(files, "key", "page_id").sortWithinPartitions("key", "page_id")
    made = common.materialize(dealt.mapInArrow(run, f"key string, page_id {kind}, file string"), "index-files")
    return sorted(((r["key"], r["page_id"], r["file"]) for r in made.collect()), key=lambda r: _rank(*r[:2]))


class Reader:
    """Lookups in an index; the last directory and block are held, and the archives stay open."""

    def __init__(self, address: str, tops: list[tuple]):
        self.store, self.root = open_store(address)
        self.tops, self.firsts = tops, [_rank(k, i) for k, i, _ in tops]
        self.held, self.open, self.directory, self.lines = {}, {}, None, None

    def _read(self, name: str, place: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) > 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.store.open_input_file(f"{self.root}/{name}")
        f = self.open[name]
        f.seek(place)
        return f.read(length)

    def _directory(self, file: str) -> list:
        if self.directory is None or self.directory[0] != file:
            with self.store.open_input_stream(f"{self.root}/{file}.directory", compression=None) as f:
                rows = json.loads(zlib.decompress(f.read()))
            self.directory = file, rows, [_rank(k, i) for k, i, _, _ in rows]
        return self.directory[1:]

    def _block(self, file: str, place: int, length: int) -> list:
        if self.lines is None or self.lines[0] != (file, place):
            lines = []
            for line in zlib.decompress(self._read(f"{file}.blocks", place, length)).decode().split("\n"):
                key, _, rest = line.partition(" ")
                page_id, *where = json.loads(rest)
                lines.append((_rank(key, page_id), where))
            self.lines = (file, place), lines, [r for r, _ in lines]
        return self.lines[1:]

    def captures(self, key: str, page_id) -> list:
        """Where the records of a URL key and page are; a run of equal ones may go on in later blocks and files."""
        want, out = _rank(key, page_id), []
        top = max(0, bisect_left(self.firsts, want) - 1)
        while top < len(self.tops) and (top == 0 or self.firsts[top] <= want):
            file = self.tops[top][2]
            rows, firsts = self._directory(file)
            at = max(0, bisect_left(firsts, want) - 1)
            while at < len(rows) and firsts[at] <= want:
                lines, ranks = self._block(file, *rows[at][2:])
                out += [where for _, where in lines[bisect_left(ranks, want) : bisect_right(ranks, want)]]
                at += 1
            top += 1
        return out

    def records(self, key: str, page_id):
        for name, place, length in self.captures(key, page_id):
            yield read_record(self._read(name, place, length))


def keyed(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, page_id`` to look up."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(1).to_pylist()], pa.string()), batch.column(0)], ["key", "page_id"])

    return rows.mapInArrow(run, f"key string, page_id {rows.schema['page_id'].dataType.simpleString()}")


def lookup(wanted: DataFrame, address: str, tops: list[tuple], files: int, payload: bool = False) -> DataFrame:
    """Read the records of ``key, page_id`` back, a row for each capture found.

    Lookups are sorted, so a task reads each directory and block once.
    """
    kind = wanted.schema["page_id"].dataType.simpleString()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    schema = f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}" + ", payload binary" * payload

    def run(batches):
        reader = Reader(address, tops)
        for batch in batches:
            own = batch.column(1).type
            kinds = (own, pa.int64(), pa.string(), pa.string(), own, pa.binary())
            found, held = [], 0
            pairs = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for n, pair in enumerate(pairs):
                for r in reader.records(*pair):
                    found.append(tuple(r[x] for x in names))
                    held += r["payload_bytes"] * payload
                if found and (held > 4 << 20 or n == len(pairs) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=False)], names)
                    found, held = [], 0

    dealt = wanted.distinct().repartitionByRange(files, "key", "page_id").sortWithinPartitions("key", "page_id")
    return dealt.mapInArrow(run, schema)


def archive(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", least: int = 0, payload: bool = False) -> DataFrame:
    """Write all pages to archives and read every record back through the index.

    Null and empty pages have an empty payload and are equal. Repeated rows of
    one page with equal payloads are alike: all responses or all revisits. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    address = common.scratch_path(spark, "warc")
    if "://" not in address:
        address = "file://" + address
    store, root = open_store(address)
    store.create_dir(root, recursive=True)
    captures = common.materialize(write_archives(assign_types(pages, key, html, url, least), address), "captures")
    n = captures.count()
    tops = write_index(captures, address, max(1, -(-n // FILE_CAPTURES)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FILE_CAPTURES))
    return lookup(keyed(pages, key, url), address, tops, tasks, payload)
