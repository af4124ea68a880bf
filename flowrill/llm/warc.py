"""WARC archives as seekable zstd bundles, with an index from record to frame and offset.

Of pages with equal payloads of at least ``min_revisit`` bytes, the one with the largest
``page_id`` is stored as a response and the others as revisits of it, without the payload. Smaller
payloads are always responses. A null html is an empty payload; rows that repeat the largest id are
all responses; a null ``page_id`` ranks below all others, and null ids alone are all responses.
An empty table gives no bundles and an empty index. Columns other than ``page_id``, ``url`` and
``html`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowrill.llm.seekable import FrameCache, SeekableWriter, new_file

MIN_REVISIT = 1000
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, file string, frame int, offset long"
_READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, url string, payload binary"
)


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages with ``digest`` (hex SHA-1 of the payload) and ``target`` (page to revisit, or null).

    Only digests and ids are grouped, combined before the exchange. The join back is a plain
    equi-join on the digest, whose hot keys adaptive execution splits.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    originals = (
        rows.where(F.octet_length("html") >= min_revisit)
        .groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "largest")
    )
    joined = rows.join(originals, "digest", "left")
    same = F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.withColumn("target", F.when(~same, F.col("largest"))).drop("largest")


def record(page_id, url, html: str, digest: str, target, date: str) -> bytes:
    """One WARC record."""
    payload = html.encode("utf-8")
    own = f"{_ID}{'' if page_id is None else page_id}"
    address = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else own
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode("ascii") + (payload if target is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if target is None else 'revisit'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Target-URI: {address}",
        f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode("ascii"),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if target is not None:
        lines[4:4] = [f"WARC-Refers-To: <{_ID}{target}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header fields from ``at`` on, and where the body begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("ascii").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:]), end + 4


def _page(uri: str) -> int | None:
    number = uri.strip("<>")[len(_ID) :]
    return int(number) if number else None


def parse_record(data: bytes, at: int) -> dict:
    """The record that begins at ``at``; a response's digest is computed from its payload."""
    fields, start = _headers(data, at)
    block = data[start : start + int(fields["Content-Length"])]
    http, body = _headers(block, 0)
    stored = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    found = {
        "page_id": _page(fields["WARC-Record-ID"]),
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": stored,
        "record_type": fields["WARC-Type"],
        "refers_to": None,
        "url": fields["WARC-Target-URI"],
        "payload": None,
    }
    if found["record_type"] == "revisit":
        found["refers_to"] = _page(fields["WARC-Refers-To"])
        return found
    payload = block[body:]
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stored:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return found | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def write_bundles(
    records: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 30,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Lazy index of the bundles written below ``folder``; write it before use, then read it.

    Each task groups its records into frames of about ``frame_bytes`` and its frames into bundles
    of about ``bundle_bytes``. A retried task writes new bundles; only those in the index count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        writer, file, size, held = None, "", 0, 0
        ids: list[int | None] = []
        offsets: list[int] = []
        waiting: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal writer, file, size, held
            if writer is None:
                file = new_file(folder, part, ".warc.zst")
                writer = SeekableWriter(file)
            frame = writer.write_frame(b"".join(waiting))
            n = len(ids)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([file] * n, pa.string()),
                    pa.array([frame] * n, pa.int32()), pa.array(offsets, pa.int64()),
                ],
                names=["page_id", "file", "frame", "offset"],
            )
            size += held
            held = 0
            for each in (ids, offsets, waiting):
                each.clear()
            if size >= bundle_bytes:
                writer.close()
                writer, size = None, 0
            return out

        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(batch.num_columns)]):
                page_id, url, html, digest, target = (v.as_py() for v in row)
                data = record(page_id, url, html, digest, target, date)
                ids.append(page_id)
                offsets.append(held)
                waiting.append(data)
                held += len(data)
                if held >= frame_bytes:
                    yield flush()
        if ids:
            yield flush()
        if writer is not None:
            writer.close()

    return records.select("page_id", "url", "html", "digest", "target").mapInArrow(write, _INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """The records of the given index rows, read from the bundles; other frames stay packed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = FrameCache()
        for batch in batches:
            rows = [parse_record(cache.get(r["file"], r["frame"]), r["offset"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_READ)

    return (
        index.select("file", "frame", "offset")
        .repartition("file", "frame").sortWithinPartitions("file", "frame", "offset")
        .mapInArrow(read, _READ)
    )


_ARROW_READ = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
        ("payload", pa.binary()),
    ]
)


def archive(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write all pages as bundles with their index (``folder/index``); the index."""
    write_bundles(plan_records(pages), f"{folder}/bundles", **options).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(_INDEX).parquet(f"{folder}/index")
