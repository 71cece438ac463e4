"""WARC archives of pages, with an index of byte ranges and coalesced reads.

Writing decides first which record of equal payloads is the response (by digests alone), then every task writes
its rows as gzip members, one for each record, to archives of its own and gives an index row for each: file,
offset, length, URL and digest.  The index is a saved table, so a lost task's half-written archive is never referred to.
Reading sorts the selected index rows, joins ranges that lie close together, reads each joined range once, and
parses, checks and returns the records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, saved, settled_join, shared_folder

ARCHIVE_BYTES = 256 << 20
#: Ranges at most GAP bytes apart are read at once, up to SPAN bytes.
GAP, SPAN = 64 << 10, 8 << 20
ROWS = 1024

INDEX = "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, gzip-compressed: the page's response, or a revisit of ``refers_to`` without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def parse(data: bytes) -> dict:
    """What ``record`` wrote; raises ValueError where a response's payload and digest disagree."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(re.fullmatch(r"<urn:page:(-?\d*)>", x)[1] or 0) if x and x != "<urn:page:>" else None
    found = {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload}
    if not version.startswith("WARC/1") or found["record_type"] == "response" and (len(payload), digest(payload)) != (found["payload_bytes"], found["payload_digest"]):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    if found["record_type"] == "revisit":
        found["payload"] = None
    return found


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out, name, at, rows = None, "", 0, []

        def close():
            nonlocal out, rows
            if out:
                out.close()
            done, out, rows = rows, None, []
            columns = list(zip(*done, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_digest", "record_type", "file", "offset", "length"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    own, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    name, out = f"{folder}/{own}", store.open_output_stream(f"{base}/{own}", compression=None)
                payload = (html.as_py() or "").encode()
                data = record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), date)
                out.write(data)
                rows.append((page_id.as_py(), url.as_py(), digest(payload), "response" if refers_to.as_py() is None else "revisit", name, at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    yield close()
        if rows:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC archives under ``folder`` (a new one in the shared folder if None); gives the index.

    ``folder`` is a URI that every executor can reach by pyarrow's file systems.  Payloads are the html in UTF-8, null being empty.
    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest page_id are responses and
    the others revisits of it; smaller ones are all responses.  Rows that repeat the largest page_id are all responses; a row without page_id never
    is one that others refer to.  Other columns are ignored, payloads are written whole.  An empty table writes nothing.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    pages = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("payload_sha"))
    # Who revisits whom is decided on ids and digests; only these few words of a row meet its payload, by its own id, so that no digest is a hot key.
    told = saved(pages.select("page_id", "payload_sha", F.length(payload).alias("size")).filter(F.col("size") >= least_bytes).select("page_id", "payload_sha"))
    shared = told.groupBy("payload_sha").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
    revisits = settled_join(told, saved(shared.select("payload_sha", "first_id")), "payload_sha").filter("page_id is null or page_id != first_id").distinct()
    revisits = checked_broadcast(saved(revisits.select("page_id", "payload_sha", "first_id")), 200_000)
    same = pages.page_id.eqNullSafe(revisits.page_id) & (pages.payload_sha == revisits.payload_sha)
    rows = pages.join(revisits, same, "left").select(pages.page_id, "url", "html", F.col("first_id").alias("refers_to"))
    return saved(rows.mapInArrow(_writer(folder, date), INDEX))


def _reader(with_payload: bool):
    def ranges(batches):
        held, end = [], 0
        for batch in batches:
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (file != held[0][0] or offset > end + GAP or offset + length - held[0][1] > SPAN):
                    yield held
                    held = []
                held.append((file, offset, length))
                end = offset + length
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, rows = None, None, []

        def out():
            kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], list(kinds))

        for held in ranges(batches):
            if held[0][0] != name:
                if file:
                    file.close()
                name = held[0][0]
                store, path = _store(name)
                file = store.open_input_file(path)
            low = held[0][1]
            data = file.read_at(held[-1][1] + held[-1][2] - low, low)
            for _, offset, length in held:
                rows.append(parse(data[offset - low : offset - low + length]) | ({} if with_payload else {"payload": None}))
            if len(rows) >= ROWS:
                yield out()
                rows = []
        if rows:
            yield out()
        if file:
            file.close()

    return run


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` point to, read from the archives; an empty index gives none."""
    parts = F.floor(F.col("offset") / (4 * SPAN))
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, size // (4 * SPAN))  # by the bytes to read, which the index's own size says nothing of
    sorted_rows = index.select("file", "offset", "length").repartition(int(tasks), F.col("file"), parts).sortWithinPartitions("file", "offset")
    return sorted_rows.mapInArrow(_reader(with_payload), RECORD)
