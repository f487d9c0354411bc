"""WARC archives: a writer with revisit records and a reader that splits gzip files.

The reader cuts each archive into byte ranges. A task looks for the gzip magic in its
range, takes the first place at which a whole member decodes (with its checksum) to a
WARC record and is followed by another gzip member or the end of the file, and owns the
records that start inside its range; the last may end beyond it. Archives are opened with
`pyarrow.fs`, so they can lie in any store that it knows; nothing is read in whole.

The writer gives each page a record. Pages with equal payloads (digest and length) share
one response, that of the largest page_id; the others are revisits without payload. Each
task writes files of its own and returns their names; only the returned ones are read, so
a repeated or lost task leaves no second copy in the result.

Defined results: a null html is an empty payload, a null url an empty target; rows that
repeat the largest page_id are all responses; pages with null ids are revisits of the
largest id, or all responses where no equal page has an id; extra columns are ignored; an
empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm.shared import new_folder

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8 << 20
#: Ranges are dealt to this many tasks at most; a task reads its ranges one by one.
MOST_TASKS = 100_000
FILE_BYTES = 64 << 20
CHUNK = 1 << 18
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and `original`: the page that holds the payload.

    Digests are grouped with partial sums, and the table of digests is joined back.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    df = df.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "bytes": F.octet_length("html")})
    first = df.groupBy("sha", "bytes").agg(F.max("page_id").alias("original"))
    df = df.join(first, ["sha", "bytes"])
    own = F.col("page_id") == F.col("original")
    alone = F.col("original").isNull() | F.coalesce(own, F.lit(False)) | (F.col("bytes") < least_bytes)
    return df.select("page_id", "url", "html", F.when(~alone, F.col("original")).alias("original"))


def record(page_id: int | None, url: str, payload: bytes, original: int | None) -> bytes:
    """A gzip member with the response record, or the revisit record if original is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    name = lambda x: f"<{_ID}{'' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if original is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(original)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def _write(folder: str, file_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        out, name, size, n = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, original = (b.column(k)[i].as_py() for k in range(4))
                if out is None:
                    store.create_dir(top, recursive=True)
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                member = record(page_id, url, html.encode("utf-8", "surrogatepass"), original)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> list[tuple[str, int]]:
    """Write the archives; their paths and sizes, one entry per file of up to file_bytes."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    written = with_originals(pages, least_bytes).mapInArrow(_write(folder, file_bytes), "path string, bytes long, records long")
    return [(r.path, r.bytes) for r in written.collect()]


def splits(spark: SparkSession, files: list[tuple[str, int]], split: int = SPLIT, most_tasks: int = MOST_TASKS) -> DataFrame:
    """path, start and end of every byte range, spread over tasks."""
    df = spark.createDataFrame([(p, n) for p, n in files if n], "path string, bytes long")
    ranges = df.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    n = max(1, sum(-(-b // split) for _, b in files))
    return ranges.select("path", "start", F.least("bytes", F.col("start") + split).alias("end"), "bytes").repartition(min(n, most_tasks), "path", "start")


def list_archives(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files that a glob pattern names; no content is read."""
    return [(r.path, r.length) for r in spark.read.format("binaryFile").load(pattern).select("path", "length").collect()]


class _Window:
    """A file read forward through a buffer; `need` makes bytes at a place available."""

    def __init__(self, handle, size: int, chunk: int = CHUNK):
        self.handle, self.size, self.chunk, self.base, self.data = handle, size, chunk, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if offset < self.base or offset > self.base + len(self.data):
            self.base, self.data = offset, b""
        end = min(self.size, offset + n)
        if end > self.base + len(self.data):
            self.data = self.data[offset - self.base :]
            self.base = offset
            self.handle.seek(self.base + len(self.data))
            self.data += self.handle.read(max(end - self.base - len(self.data), min(self.chunk, self.size - self.base - len(self.data))))
        return self.data[offset - self.base : end - self.base]


def _member(window: _Window, offset: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at offset, or None if there is none whole."""
    unpack, parts, at, seen = zlib.decompressobj(wbits=31), [], offset, 0
    try:
        while not unpack.eof:
            raw = window.at(at, CHUNK)
            if not raw:
                return None
            parts.append(unpack.decompress(raw))
            at += len(raw)
            seen += len(parts[-1])
            if seen >= 5 and not b"".join(parts)[:5] == b"WARC/":
                return None
            if seen >= 5:
                parts = [b"".join(parts)]
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpack.unused_data)


def _parsed(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of a record, or None if its length doesn't fit."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = headers.get("Content-Length", "")
    if not version.startswith("WARC/") or not gap or not length.isdigit() or rest[int(length) :] != b"\r\n\r\n":
        return None
    return headers, rest[: int(length)]


def records_in(window: _Window, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of the records that start in [start, end).

    Empty headers mark a place where a record should begin and none could be read; reading
    goes on at the next one. Bytes other than padding right after a record make it doubtful
    for a range that has found no record before it, which then passes it over.
    """
    at, inside = start, start == 0
    while at < end:
        if not inside:
            piece = window.at(at, CHUNK)
            found = piece.find(MAGIC)
            if found < 0:
                # The magic may begin in the last two bytes.
                if at + len(piece) >= window.size:
                    return
                at += max(1, len(piece) - 2)
                continue
            at += found
            if at >= end:
                return
        got = _member(window, at)
        record = _parsed(got[0]) if got else None
        # After a record comes the next one, the end, or padding. Where a record is known to
        # begin, nothing needs to vouch for it.
        follows = window.at(got[1], 3) if record else b""
        if record is None or not (inside or follows in (b"", MAGIC) or not follows.strip(b"\0")):
            if inside and at > 0 and window.at(at, CHUNK).strip(b"\0"):
                yield at, {}, b""
            # bytes before the first record, a torn member and padding are passed over
            inside = False
            at += 1
            continue
        inside = True
        yield at, *record
        at = got[1]


_HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}


def digest_agrees(label: str | None, payload: bytes) -> bool | None:
    """Whether a digest header is that of the payload; None without one or for an unknown kind.

    The value may be base32, with or without padding, or hexadecimal, in any case.
    """
    kind, _, value = (label or "").partition(":")
    if kind.strip().lower() not in _HASHES:
        return None
    raw, value = _HASHES[kind.strip().lower()](payload).digest(), value.strip().rstrip("=").lower()
    return value in (raw.hex(), base64.b32encode(raw).decode().rstrip("=").lower())


def _read(payloads: bool):
    kind = pa.map_(pa.string(), pa.string())
    names = ["path", "offset", "headers", "block_bytes", "payload", "payload_bytes", "payload_digest", "digest_agrees"]
    types = [pa.string(), pa.int64(), kind, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for b in batches:
            for path, start, end, size in zip(*(b.column(i).to_pylist() for i in range(4))):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as handle:
                    for offset, headers, block in records_in(_Window(handle, size), start, end):
                        payload = full = sha = agrees = None
                        if headers.get("Content-Type", "").startswith("application/http"):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
                            full = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(payload)
                        if headers.get("WARC-Type") == "revisit":
                            kind_of, _, value = headers.get("WARC-Payload-Digest", "").partition(":")
                            payload, sha = None, value.strip().upper() if kind_of.strip().lower() == "sha1" else None
                        elif payload is not None:
                            full, sha = len(payload), digest(payload)
                            agrees = digest_agrees(headers.get("WARC-Payload-Digest"), payload)
                        rows.append((path, offset, list(headers.items()), len(block), payload if payloads else None, full, sha, agrees))
                        held += len(block)
                        if len(rows) >= 2048 or held > 16 << 20:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    return run


def read(spark: SparkSession, files: list[tuple[str, int]], split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """A row per record: path, offset, headers, block_bytes, payload, payload_bytes, payload_digest, digest_agrees.

    payload_bytes and payload_digest are those of the full payload, also for revisits (null
    there if the header has no sha1). digest_agrees compares the payload with its header.
    A torn record or bytes between records end nothing: a row with empty headers marks them.
    """
    schema = "path string, offset long, headers map<string,string>, block_bytes long, payload binary, payload_bytes long, payload_digest string, digest_agrees boolean"
    return splits(spark, files, split).mapInArrow(_read(payloads), schema)


def report(pages: DataFrame) -> DataFrame:
    """Write an archive of the pages, read it back: a row per page."""
    records = read(pages.sparkSession, write(pages), payloads=False).where(F.size("headers") > 0)
    number = lambda header: F.regexp_extract(F.col("headers")[header], rf"{_ID}(-?\d+)", 1)
    page = lambda header: F.when(number(header) != "", number(header).cast("long"))
    return records.select(page("WARC-Record-ID").alias("page_id"), "payload_bytes", "payload_digest", F.col("headers")["WARC-Type"].alias("record_type"), page("WARC-Refers-To").alias("refers_to"))
