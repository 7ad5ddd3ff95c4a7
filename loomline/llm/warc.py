"""WARC archives in seekable Zstandard bundles.

Records are gathered into independent frames of about ``frame_bytes``; a bundle
ends with a skippable frame holding the seek table (sizes of each frame) in the
public seekable format. The index maps a record to bundle, frame and the
record's offset inside the decompressed frame, so that a reader fetches the seek
table and one frame, never a whole bundle.

Bundles are named when complete and never changed; the index, a written table,
names those of the task attempts that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import files, small_batches, staged, workspace

#: Bytes of records that one task reads.
TASK_BYTES = 16 << 20
_SKIP, _SEEK = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, at long, size long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2026-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    return int(urn[10:-1]) if urn[10:-1] else None


def record(page_id, url, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_REVISIT}"]
    return "\r\n".join([*head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame of (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEK)
    return struct.pack("<II", _SKIP, len(body)) + body


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the end of a bundle."""
    end = source.size()
    source.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != _SEEK:
        raise ValueError("no seek table")
    source.seek(end - 9 - 8 * count)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", source.read(8 * count)):
        out.append((at, packed, plain))
        at += packed
    return out


class _Bundles:
    """Bundles that one task writes; ``add`` gives a record's place, rows of which are complete once flushed."""

    def __init__(self, uri: str, name: str, frame_bytes: int, bundle_bytes: int, level: int):
        import zstandard

        self.fs, self.root = files(uri)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.frame_bytes, self.bundle_bytes = name, frame_bytes, bundle_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.count, self.out, self.parts, self.held = 0, None, [], 0

    def add(self, data: bytes) -> tuple[str, int, int, int]:
        if self.out is None:
            self.bundle, self.sizes, self.at = f"{self.name}-{self.count:04d}.warc.zst", [], 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.bundle}.part")
        place = (self.bundle, len(self.sizes), self.held, len(data))
        self.parts.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self._frame()
        return place

    def _frame(self) -> None:
        if self.parts:
            packed = self.zstd.compress(b"".join(self.parts))
            self.out.write(packed)
            self.sizes.append((len(packed), self.held))
            self.at, self.parts, self.held = self.at + len(packed), [], 0
        if self.at >= self.bundle_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            out, self.out = self.out, None
            if self.parts:
                packed = self.zstd.compress(b"".join(self.parts))
                out.write(packed)
                self.sizes.append((len(packed), self.held))
                self.parts, self.held = [], 0
            out.write(seek_table(self.sizes))
            out.close()
            self.fs.move(f"{self.root}/{self.bundle}.part", f"{self.root}/{self.bundle}")
            self.count += 1


def with_roles(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (UTF-8 html) and ``first``: the smallest page of an equal payload, null where it occurs once or is under ``min_bytes``.

    Only payloads that occur more than once are joined. Their table is written
    first, so its size is known: Spark broadcasts it below its threshold and else
    joins by digest, splitting hot digests.
    """
    own = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    own = own.withColumn("_digest", F.when(F.length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    again = own.groupBy("_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n"))
    again = staged(again.filter((F.col("_n") > 1) & F.col("_digest").isNotNull()).drop("_n"), "warc-again")
    return own.join(again, "_digest", "left").drop("_digest")


def write(roles: DataFrame, uri: str, *, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Writes a record per row of ``with_roles`` into bundles below ``uri``: the index, ``INDEX``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        bundles = _Bundles(uri, f"pages-{task.partitionId():06d}-{task.taskAttemptId()}", frame_bytes, bundle_bytes, level)
        for part in parts:
            rows = []
            for page, url, payload, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "first")), strict=True):
                revisit = first is not None and page != first
                rows.append((page, *bundles.add(record(page, url, payload, first, revisit))))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])
        bundles.close()

    return roles.select("page_id", "url", "payload", "first").mapInArrow(run, INDEX)


def read(index: DataFrame, uri: str) -> DataFrame:
    """Every record of the index from its bundle: ``RECORD``. Payload digests are checked against the payloads read."""

    def run(parts):
        import pandas as pd
        import zstandard

        fs, root = files(uri)
        bundle, source, frames, number, plain = None, None, [], None, b""
        for pdf in parts:
            rows = []
            for name, frame, at, size in zip(pdf["bundle"], pdf["frame"], pdf["at"], pdf["size"], strict=True):
                if name != bundle:
                    bundle, source, number = name, fs.open_input_file(f"{root}/{name}"), None
                    frames = read_seek_table(source)
                if frame != number:
                    begin, packed, n = frames[frame]
                    source.seek(begin)
                    number, plain = frame, zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=n)
                fields, http, payload = parse(plain[at : at + size])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"{name}, frame {frame}, at {at}: payload differs from its digest")
                refers = fields.get("WARC-Refers-To")
                rows.append((_page(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, fields["WARC-Type"], _page(refers) if refers else None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    tasks = -(-(index.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES) or 1  # by the records' bytes, which the index's own do not tell
    return index.repartition(int(tasks), "bundle", "frame").sortWithinPartitions("bundle", "frame", "at").mapInPandas(run, RECORD)


def archive(pages: DataFrame, *, uri: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes a WARC record per page and reads the archives back: ``RECORD``.

    Of equal payloads of at least ``min_bytes`` the smallest page is the response;
    repeated rows of that very page are responses too. Null html is an empty
    payload, a null URL an empty one; a null page_id is never the smallest unless
    all are null. Long payloads get a frame of their own. An empty table gives no
    rows; columns beside page_id, url and html are not read.
    """
    spark = pages.sparkSession
    small_batches(spark, rows=500)
    uri = uri or workspace(spark, "warc")
    index = staged(write(with_roles(pages, min_bytes=min_bytes), uri), "warc-index")
    return read(index, uri)
