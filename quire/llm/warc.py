"""WARC archives: written one gzip member per record, read back in byte ranges.

Writing: pages of equal payload (SHA-1 and length) are one group; the largest
page_id is the ``response`` record, the others are ``revisit`` records that refer
to it and keep the HTTP header only (its Content-Length is the full payload's).
Each task writes one file under the shared folder, through a draft that is moved
into place.

Reading is splittable: a task gets a byte range, scans it for the gzip magic and
tries each place: the member must decode (with its CRC), open with ``WARC/1.`` and
hold as many bytes as its Content-Length, and so must every member after it up to
the end of the range or file. Magic bytes inside compressed data, or a whole
archive stored inside a record, break that chain. A range owns the records that
start in it, reads on past its end to finish the last, and checks that a whole
record follows. If a record was found whose chain broke, the file is walked from its
start; if that breaks too, the archive is damaged and the read fails rather than
losing records.

Cases: null html: an empty payload. Null url: no target header. Control characters
in a url are percent-encoded. Null page_id: written as ``null``, sorts below all
ids, read back as null. Equal page_ids: a record each; a copy of the response's own
id is a response too. Empty table: no record. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.files import locate, write_whole
from quire.llm.shared import run_folder, written

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
READ_BYTES = 1 << 18
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ------------------------------------------------------------------ one record
def record(page_id, url: str | None, payload: bytes, sha: str, refers_to=None, revisit: bool = False) -> bytes:
    """A record as one gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (lower-case names) and block of a whole record, or None."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not size.isdigit() or len(data) != end + 4 + int(size) + 4 or not data.endswith(b"\r\n\r\n"):
        return None
    return fields, data[end + 4 : -4]


def member(f, at: int) -> tuple[bytes, int] | None:
    """The whole member at ``at`` and where the next begins, or None."""
    f.seek(at)
    unpack, out, used, size = zlib.decompressobj(31), [], 0, 0
    while not unpack.eof:
        raw = f.read(READ_BYTES if used else 4096)
        if not raw:
            return None
        try:
            part = unpack.decompress(raw)
        except zlib.error:
            return None
        used += len(raw) - len(unpack.unused_data)
        out.append(part)
        size += len(part)
        if size >= 7 and not b"".join(out[:8])[:7] == b"WARC/1.":
            return None
    return b"".join(out), at + used


def _holds(f, at: int, end: int, size: int) -> tuple[bool, bool]:
    """Whether a chain of records runs from ``at`` to the range's end; whether the
    first one at least is a record."""
    first = False
    while at < end and at < size:
        got = member(f, at)
        if got is None or parse(got[0]) is None:
            return False, first
        first, at = True, got[1]
    return True, True


def range_records(uri: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in ``start .. end`` of a file."""
    system, path = locate(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        end = min(end, size)
        at, doubtful, begin = start, False, 0 if start == 0 else None
        while at < end and begin is None:
            f.seek(at)
            window = f.read(min(READ_BYTES, end - at) + len(MAGIC) - 1)
            place = window.find(MAGIC)
            if place < 0:
                at += READ_BYTES
                continue
            at += place
            if at >= end:
                break
            holds, some = _holds(f, at, end, size)
            if holds:
                begin = 0 if doubtful else at
            doubtful |= some
            at += 1
        if begin is None:
            if not doubtful:
                return  # one long record covers the range
            begin = 0
        at = begin
        while at < size:
            got = member(f, at)
            parsed = got and parse(got[0])
            if not parsed:
                raise ValueError(f"damaged archive: {uri} at byte {at}")
            if at >= end:
                break  # the first record of a later range is there and whole
            if at >= start:
                yield parsed
            at = got[1]


# ------------------------------------------------------------------ jobs
def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)``; one row per file: path, records."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", body.alias("html"), F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("bytes"))
    same = rows.groupBy("sha", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("bytes") >= min_revisit_bytes))
    # large groups of copies are split by the join (AQE); the group side is one row each
    joined = rows.join(same.drop("n"), ["sha", "bytes"], "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, told = next(batches, None), 0
        if first is None:
            return

        def fill(out) -> None:
            nonlocal told
            batch = first
            while batch is not None:
                for page, url, html, to in zip(*(batch.column(i) for i in range(4))):
                    page, url, payload, to = page.as_py(), url.as_py(), html.as_py().encode(), to.as_py()
                    out.write(record(page, url, payload, digest(payload), to, revisit=to is not None and to != page))
                    told += 1
                batch = next(batches, None)

        path = write_whole(folder, f"part-{TaskContext.get().partitionId():06d}.warc.gz", fill)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [told]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return written(joined.mapInArrow(run, "path string, records long"), f"{folder}/manifest")


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of all ``*.warc.gz`` files of a folder, read in byte ranges."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.filter("length > 0").select("path", starts.alias("start"))
    number = re.compile(r"<urn:page:(-?\d+)>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

        def page(name: str | None) -> int | None:
            found = number.fullmatch(name or "")
            return int(found[1]) if found else None

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(made.names, r)) for r in rows], schema=made)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for fields, block in range_records(path, start, start + range_bytes):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    kind = fields.get("warc-type")
                    if kind == "response":
                        if digest(payload) != sha:
                            raise ValueError(f"payload does not match its digest: {fields.get('warc-record-id')}")
                        size = len(payload)
                    else:
                        said = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                        size, payload = int(said[1]) if said else 0, None
                    rows.append((page(fields.get("warc-record-id")), size, sha, kind, page(fields.get("warc-refers-to")) if kind == "revisit" else None, fields.get("warc-target-uri"), payload if payloads else None))
                    held += len(block)
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    n = max(1, ranges.count())  # ranges, not records
    return ranges.repartition(n, "path", "start").mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = run_folder(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
