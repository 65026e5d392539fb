"""Content-addressed media payloads in tar shards.

Every text becomes a lossless 8-bit greyscale image, 64 samples wide: its UTF-8 bytes, filled with
zero bytes to a positive multiple of 64, are the samples. Each writing task stores the distinct
images it meets, named by digest, in a tar shard of its own below the shared folder; the rows keep
only digest, shard, offset and length. Columns about the image come from range reads of its header
alone; the payload and its features come from a range read of the stored bytes.

A shard is named by its task attempt, so a lost or repeated attempt leaves an unused file and never
a torn one. Copies share one payload within a shard. Null texts count as empty. No text is moved
between tasks.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import scratch, written

WIDTH = 64
#: Bytes of a PNG up to the end of its header chunk.
HEADER = 33
INDEX = "shard string, offset long, length long, digest string, n_bytes long, doc_ids array<long>"
FEATURES = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
            "media_bytes long, media_sha256 string, feature string, width long, height long")


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes before padding, payload)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG with the payload's bytes as samples, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    """(width, height) from the first HEADER bytes."""
    if header[:8] != b"\x89PNG\r\n\x1a\n" or header[12:16] != b"IHDR":
        raise ValueError("not a stored image")
    return struct.unpack(">II", header[16:24])


def from_png(stored: bytes) -> bytes:
    """The samples of an image that to_png() made."""
    width, height = png_size(stored)
    at, packed = 8, b""
    while at < len(stored):
        (size,), kind = struct.unpack(">I", stored[at:at + 4]), stored[at + 4:at + 8]
        if kind == b"IDAT":
            packed += stored[at + 8:at + 8 + size]
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy of the samples and a 64-bit sketch of the column means."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    columns = x.reshape(-1, WIDTH).mean(axis=0)
    bits = np.packbits(columns > np.roll(columns, 1)).tobytes().hex()
    return f"{x.mean():.4f}:{x.std():.4f}:{-(p[p > 0] * np.log2(p[p > 0])).sum():.4f}:{bits}"


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads; a row for each distinct text of a shard, with the documents that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = f"{folder}/shard-{uuid.uuid4().hex}.tar"
        found: dict[tuple[str, int], list] = {}
        system, path = _opened(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{shard.rpartition('/')[2]}") as out:
            at, places, known = 0, {}, {}
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    n, payload = padded(text)
                    key = hashlib.sha256(payload).digest()
                    if key not in known:
                        image = to_png(payload)
                        known[key] = digest = hashlib.sha256(image).hexdigest()
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(image)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + image + bytes(-len(image) % tarfile.BLOCKSIZE))
                        places[digest] = (at + len(head), len(image))
                        at += len(head) + len(image) + -len(image) % tarfile.BLOCKSIZE
                    found.setdefault((known[key], n), []).append(doc)
            out.write(bytes(2 * tarfile.BLOCKSIZE))
        rows = [(shard, *places[d], d, n, ids) for (d, n), ids in found.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        for i in range(0, len(rows), 1000):
            part = list(zip(*rows[i:i + 1000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(part, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def read_back(index: DataFrame) -> DataFrame:
    """Header columns and payload features of every document, from range reads of the shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        uri, source = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["shard"] != uri:
                    uri = r["shard"]
                    system, path = _opened(uri)
                    source = system.open_input_file(path)
                source.seek(r["offset"])
                header = source.read(HEADER)
                width, height = png_size(header)
                image = header + source.read(r["length"] - HEADER)
                digest = hashlib.sha256(image).hexdigest()
                if digest != r["digest"]:
                    raise ValueError(f"{uri} at {r['offset']}: stored bytes differ from their digest")
                payload = from_png(image)
                same = (r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), digest, feature(payload), width, height)
                rows += [(doc, *same) for doc in r["doc_ids"]]
            for i in range(0, len(rows), 10_000):
                part = list(zip(*rows[i:i + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(part, kinds, strict=True)], names=names)

    return index.mapInArrow(run, FEATURES)


def headers(index: DataFrame) -> DataFrame:
    """``digest, width, height`` of the stored images, reading HEADER bytes of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                system, path = _opened(r["shard"])
                with system.open_input_file(path) as source:
                    source.seek(r["offset"])
                    out.append((r["digest"], *png_size(source.read(HEADER))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), *(pa.array([x[i] for x in out], pa.int64()) for i in (1, 2))], names=["digest", "width", "height"])

    return index.select("shard", "offset", "digest").mapInArrow(run, "digest string, width long, height long")


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of ``docs(doc_id, text)`` as media and reads its columns back."""
    index = written(store(docs, scratch(docs.sparkSession, "media")), "media-index")
    return read_back(index)


def unpacked(tar: bytes) -> dict[str, bytes]:
    """Members of a shard, for tests and other readers."""
    with tarfile.open(fileobj=io.BytesIO(tar)) as t:
        return {m.name: t.extractfile(m).read() for m in t.getmembers()}
