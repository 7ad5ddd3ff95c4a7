"""Media columns: content-addressed payloads in tar shards.

A payload is padded to rows of 64 samples and kept as a greyscale 8-bit PNG, a
lossless form whose first 33 bytes hold its size. Tasks append PNGs to tar
shards in the shared folder, each payload once per task, under the payload's
SHA-256; rows carry digest, shard, offset and length only. Of payloads that
several tasks have stored, the index names one place. Metadata columns come from
range reads of the header alone, features from the whole stored form.

A shard gets its name when complete and is never changed; a task that is run
again writes shards of its own, and the manifest, itself a written table, names
those of the attempt that succeeded.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import files, small_batches, staged, workspace

WIDTH = 64
#: Bytes of stored payloads that one task reads.
TASK_BYTES = 8 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
MANIFEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, shard string, at long, size long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of the width."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def encode(payload: bytes, level: int = 6) -> bytes:
    """A greyscale 8-bit PNG, WIDTH samples to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first HEADER_BYTES of a PNG."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != int.from_bytes(data[29:33], "big"):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", data[16:26])


def decode(data: bytes) -> bytes:
    """The samples of a PNG that ``encode`` has made."""
    width, height, depth, colour = header(data)
    if (depth, colour) != (8, 0):
        raise ValueError("not an 8-bit greyscale PNG")
    at, body = HEADER_BYTES, []
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if zlib.crc32(data[at + 4 : at + 8 + n]) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered PNG rows")
    return lines[:, 1:].tobytes()


def fingerprint(payload: bytes) -> str:
    """Size, mean, and which of 8 x 8 areas are brighter than the mean, as hexadecimal digits."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bands = np.minimum(np.arange(len(rows)) * 8 // len(rows), 7)
    total = np.zeros((8, 8))
    np.add.at(total, bands, rows.reshape(len(rows), 8, 8).sum(2, dtype=np.int64))
    count = np.maximum(np.bincount(bands, minlength=8), 1)[:, None] * 8
    mean = int(rows.sum(dtype=np.int64)) / rows.size
    bits = np.packbits((total / count > mean).ravel()).tobytes().hex()
    return f"{WIDTH}x{len(rows)}:{mean:.4f}:{bits}"


class _Shards:
    """Tar files that one task writes, one after another."""

    def __init__(self, uri: str, name: str, most: int):
        self.fs, self.root = files(uri)
        self.name, self.most, self.count, self.at, self.out = name, most, 0, 0, None
        self.fs.create_dir(self.root, recursive=True)

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        """(shard, offset of the data, length)."""
        if self.out is not None and self.at + len(data) > self.most:
            self.close()
        if self.out is None:
            self.shard, self.at = f"{self.name}-{self.count:04d}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.shard}.part")
            self.tar = tarfile.open(fileobj=self.out, mode="w|", format=tarfile.PAX_FORMAT)
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.tar.addfile(info, io.BytesIO(data))
        place = self.at + len(info.tobuf(tarfile.PAX_FORMAT))
        self.at = place + -(-len(data) // 512) * 512
        return self.shard, place, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.tar.close()
            self.out.close()
            self.fs.move(f"{self.root}/{self.shard}.part", f"{self.root}/{self.shard}")
            self.count, self.out = self.count + 1, None


def store(rows: DataFrame, uri: str, *, id_col: str, payload: Column, shard_bytes: int = 128 << 20, level: int = 6) -> DataFrame:
    """Writes the payloads (binary; null is empty) as PNGs into tar shards below ``uri``: the manifest, ``MANIFEST``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shards = _Shards(uri, f"media-{task.partitionId():06d}-{task.taskAttemptId()}", shard_bytes)
        known: dict[bytes, tuple[str, int, int]] = {}
        for part in parts:
            ids, sizes, lengths, digests, places = part.column(0).to_pylist(), [], [], [], []
            for raw in part.column(1).to_pylist():
                data = padded(raw or b"")
                digest = hashlib.sha256(data)
                if digest.digest() not in known:
                    known[digest.digest()] = shards.add(f"{digest.hexdigest()}.png", encode(data, level))
                sizes.append(len(raw or b""))
                lengths.append(len(data))
                digests.append(digest.hexdigest())
                places.append(known[digest.digest()])
            shard, at, size = zip(*places, strict=True) if places else ((), (), ())
            columns = [(ids, pa.int64()), (sizes, pa.int64()), (lengths, pa.int64()), (digests, pa.string()), (shard, pa.string()), (at, pa.int64()), (size, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], [c.split()[0] for c in MANIFEST.split(", ")])
        shards.close()

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), payload.alias("payload")).mapInArrow(run, MANIFEST)


def _places(manifest: DataFrame) -> DataFrame:
    """One place for each payload, dealt by shard and place in it."""
    one = manifest.groupBy("payload_sha256").agg(F.min(F.struct("shard", "at", "size")).alias("p")).select("payload_sha256", "p.*")
    # ranges of a shard go to several tasks, so that a large shard is no task of its own
    tasks = -(-(one.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES) or 1  # by the payloads' bytes, which the rows' own do not tell
    return one.repartition(int(tasks), "shard", (F.col("at") / (1 << 20)).cast("long")).sortWithinPartitions("shard", "at")


def read_headers(manifest: DataFrame, uri: str) -> DataFrame:
    """payload_sha256, width, height, bit_depth: from range reads of HEADER_BYTES only."""

    def run(parts):
        fs, root = files(uri)
        shard, source = None, None
        for pdf in parts:
            found = []
            for name, at in zip(pdf["shard"], pdf["at"], strict=True):
                if name != shard:
                    shard, source = name, fs.open_input_file(f"{root}/{name}")
                source.seek(at)
                found.append(header(source.read(HEADER_BYTES))[:3])
            yield pdf[["payload_sha256"]].assign(width=[f[0] for f in found], height=[f[1] for f in found], bit_depth=[f[2] for f in found])

    return _places(manifest).mapInPandas(run, "payload_sha256 string, width int, height int, bit_depth int")


_FEATURES = "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(manifest: DataFrame, uri: str, *, headers: bool) -> DataFrame:
    """``read_features``; with ``headers`` also the columns of ``read_headers``, from a range read before that of the whole form, and each payload's place."""
    out = _FEATURES + (", width int, height int, bit_depth int, shard string, at long, size long" if headers else "")

    def run(parts):
        import pandas as pd

        fs, root = files(uri)
        shard, source = None, None
        for pdf in parts:
            rows = []
            for sha, name, at, size in zip(pdf["payload_sha256"], pdf["shard"], pdf["at"], pdf["size"], strict=True):
                if name != shard:
                    shard, source = name, fs.open_input_file(f"{root}/{name}")
                source.seek(at)
                more = ()
                if headers:
                    more = (*header(source.read(HEADER_BYTES))[:3], name, at, size)
                    source.seek(at)
                media = source.read(size)
                payload = decode(media)
                found = hashlib.sha256(payload).hexdigest()
                if found != sha:
                    raise ValueError(f"{name} at {at}: stored payload differs")
                rows.append((found, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), fingerprint(payload), *more))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return _places(manifest).mapInPandas(run, out)


def read_features(manifest: DataFrame, uri: str) -> DataFrame:
    """A row per payload from its whole stored form: digests and feature.

    ``payload_sha256`` is that of the decoded samples; a form that decodes to another payload fails.
    """
    return _read(manifest, uri, headers=False)


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None) -> DataFrame:
    """Every whole text as a stored PNG, read back: a row per document with the columns of ``read_headers``,
    which come from range reads of the headers alone, those of ``read_features``, doc_id, n_bytes,
    payload_bytes and its place (shard, at, size).

    Null and empty texts: one row of 64 zero samples. Equal texts share a payload.
    Repeated rows each get a row; an empty table gives none; other columns are not
    read. ``uri``: folder of the shards; by default one in the shared folder.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=500)
    uri = uri or workspace(spark, "media")
    manifest = staged(store(docs, uri, id_col=id_col, payload=F.encode(F.col(text_col), "utf-8")), "media-manifest")
    rows = manifest.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")
    return rows.join(_read(manifest, uri, headers=True), "payload_sha256")
