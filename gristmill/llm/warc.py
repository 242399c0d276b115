"""WARC archives: a distributed writer and a splittable reader.

Writer. Every row becomes one record in a gzip member of its own. Of records
with equal payloads of at least ``REVISIT_BYTES``, that with the largest id is
a response and the others revisit it. Which rows revisit is found on ids and
digests alone; the payloads then meet these few by id, so a payload that very
many pages share makes no partition large. Tasks write archives of about
``ARCHIVE_BYTES`` into the shared folder, each attempt under names of its own,
and return them as rows: a task that runs again adds files nobody lists.

Reader. Archives are cut into byte ranges. A task looks for the gzip magic in
its range, validates each candidate by decoding the start of the member (it
must open a WARC header), and owns the records that start inside the range; it
reads on past the end of the range to finish its last record. There are as many
tasks as ranges (``MOST_TASKS`` at most): ranges are rows of a few bytes, by
whose size adaptive execution would read all in one task.

Both use Arrow's file systems, which serve local and shared paths, HDFS, S3
and GCS by the URI of the folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import landed, pieces, shared_dir

REVISIT_BYTES, ARCHIVE_BYTES, SPLIT_BYTES, MOST_TASKS = 1000, 64 << 20, 8 << 20, 50_000
MAGIC, HEAD, STEP = b"\x1f\x8b\x08", 1 << 12, 1 << 18
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64())])
RECORD_DDL = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, archive string, offset long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with the payload, or a revisit without it if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url is not None else None),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Refers-To", record_id(refers_to, digest) if refers_to is not None else None),
        ("WARC-Profile", PROFILE if refers_to is not None else None),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to),
        ("X-Target-URI", "utf-8''" + quote(url, safe="") if url is not None else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the rows of (page_id, digest, size) that revisit another."""
    large = pages.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest")
    kept = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    return large.join(kept, "digest").where("NOT page_id <=> refers_to").distinct()


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row of ``pages`` to an archive and returns (archive, bytes, records).

    A null payload is an empty one; a row without an id keeps its record and
    never has others refer to it. Rows that repeat an id and its payload are
    each written, with the same type. Other columns are ignored; an empty table
    leaves no archive."""
    folder = (folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}").rstrip("/")
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    full = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    again = revisits(full.select("page_id", "digest", F.octet_length("payload").alias("size")))
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    typed = full.join(again, F.expr("page_id <=> _id AND digest = _digest"), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, out, name, size, n = [], None, "", 0, 0
        for b in pieces(batches):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(*row))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (f"{folder}/{name}", size, n)], None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["archive", "bytes", "records"])

    return landed(typed.mapInArrow(run, "archive string, bytes long, records long"), "archives")


class Range:
    """Reads a byte range of an archive, and past it where a record needs that."""

    def __init__(self, file, start: int, end: int, size: int) -> None:
        self.file, self.end, self.size = file, min(end, size), size
        file.seek(start)
        self.base, self.data = start, file.read(self.end - start + len(MAGIC) - 1)

    def more(self) -> bool:
        """Takes another step of the file; False at its end."""
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        self.data += self.file.read(min(STEP, self.size - at))
        return True

    def records(self) -> Iterator[tuple[int, bytes | None]]:
        """(offset, record) of every member that starts in the range and opens a
        WARC header; no record where the archive ends before the member does,
        or where the member can't be decoded."""
        at = 0
        while (at := self.data.find(MAGIC, at)) >= 0 and self.base + at < self.end:
            found = self.decode(at)
            if found is None:
                at += 1
                continue
            yield self.base + at, found[0]
            at += found[1]

    def decode(self, at: int) -> tuple[bytes | None, int] | None:
        """The record of the member at a candidate, and the member's length; None if it isn't one."""
        z, got, used = zlib.decompressobj(31), [], 0
        try:
            while not z.eof:
                piece = self.data[at + used : at + used + (HEAD if not used else STEP)]
                if not piece:
                    if not self.more():
                        return (None, used) if b"".join(got).startswith(b"WARC/1.") else None
                    continue
                got.append(z.decompress(piece))
                used += len(piece)
                if len(got) == 1 and got[0] and not b"WARC/1.".startswith(got[0][:7]):
                    return None
        except zlib.error:
            # A member that opens a WARC header and then can't be decoded; the next one may begin anywhere behind.
            return (None, 1) if b"".join(got).startswith(b"WARC/1.") else None
        whole = b"".join(got)
        return (whole, used - len(z.unused_data)) if whole.startswith(b"WARC/1.") else None


DAMAGED = "damaged"
FIELD = re.compile(rb"^([\w-]+):[ \t]*(.*?)\r?$", re.M)


def _digest(told: str | None) -> str | None:
    """The hex form of a SHA-1 in base 32 or hex; digests of other kinds as they are."""
    kind, _, value = (told or "").partition(":")
    if kind.lower() != "sha1":
        return told
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            return told
    return value.lower() if len(value) == 40 else told


def parse(raw: bytes) -> tuple | None:
    """page_id, url, type, payload size and digest, refers_to and payload of a
    response or revisit; a revisit takes size and digest from its headers. None
    for other kinds of records. A response whose payload doesn't have the SHA-1
    its header gives is ``DAMAGED``: size and digest are those found. Headers of
    other writers may lack digest, sizes and page ids, or have digests of another kind, which aren't checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    get = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in FIELD.findall(head)}
    kind = get.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    number = lambda k: int(get[k]) if get.get(k, "").strip().isdecimal() else None
    block = rest[: number("content-length")]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = _digest(get.get("warc-payload-digest"))
    if kind == "response":
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        kind, told = (DAMAGED if told and len(told) == len(found) and told != found else kind), found
    else:
        sizes = [int(v) for k, v in FIELD.findall(http) if k.lower() == b"content-length" and v.strip().isdigit()]
        size, payload = (sizes[0] if sizes else None), None
    url = unquote(get["x-target-uri"].partition("''")[2]) if "x-target-uri" in get else get.get("warc-target-uri")
    return number("x-page-id"), url, kind, size, told, number("x-refers-to-page-id"), payload


def read(archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives in (archive, bytes): page_id, url,
    record_type, payload_bytes, payload_digest, refers_to, payload (null for
    revisits), archive and offset. Nothing is dropped in silence: a record with
    a wrong digest, or one that can't be decoded or that the archive's end cuts off
    (these without page_id and payload), comes as ``DAMAGED``."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    n = archives.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / split_bytes))).first()[0] or 1
    ranges = archives.select("archive", "bytes", start.alias("start")).repartition(min(int(n), MOST_TASKS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for archive, total, start in zip(*(c.to_pylist() for c in b.columns)):
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_file(path) as file:
                    for offset, raw in Range(file, start, start + split_bytes, total).records():
                        if (row := parse(raw) if raw is not None else (None, None, DAMAGED, *[None] * 4)) is None:
                            continue
                        held.append((*row[:-1], row[-1] if with_payload else None, archive, offset))
                        size += len(raw or b"") if with_payload else 200
                        if size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), RECORD)], schema=RECORD)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), RECORD)], schema=RECORD)

    return ranges.mapInArrow(run, RECORD_DDL)
