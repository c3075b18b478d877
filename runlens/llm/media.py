"""Media columns: content-addressed payloads in tar shards, with metadata from header-only range reads.

A text is stored as an 8-bit greyscale PNG, 192 samples wide. Each task writes the payloads it meets, each of them once,
to tar shards in the shared folder, and yields digest, shard, offset and length. Of the places of one digest the index
keeps the first; so a payload is stored at most once for each writing task, and rows point to one place. Metadata come
from the first 33 bytes of the stored form; the full read-back decodes it and proves that the payload is whole.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import documents, map_arrow, slices, texts
from runlens.session import shared_dir

WIDTH = 192
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HEADER = 33  # signature and the IHDR chunk
_BLOCK = 512  # of a tar file


def payload_of(text: bytes) -> bytes:
    """The text with bytes 32 up to a positive multiple of WIDTH."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH)


def to_png(payload: bytes) -> bytes:
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)  # each row starts with filter 0
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and colour type from the first bytes of a PNG file."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG file as to_png writes it."""
    width, rows, bits, colour = png_header(data)
    if (bits, colour) != (8, 0):
        raise ValueError("8-bit greyscale is needed")
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, width + 1)
    if raw[:, 0].any():
        raise ValueError("row filters aren't supported")
    return raw[:, 1:].tobytes()


class _Shard:
    """A tar file that is being written."""

    def __init__(self, folder: str):
        store, path = fs.FileSystem.from_uri(folder)
        self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
        self.out = store.open_output_stream(f"{path}/{self.name}")

    def add(self, digest: str, data: bytes) -> int:
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        self.out.write(data)
        self.out.write(bytes(-len(data) % _BLOCK))
        start = self.at + _BLOCK
        self.at = start + len(data) + -len(data) % _BLOCK
        return start

    def close(self) -> None:
        self.out.write(bytes(2 * _BLOCK))
        self.out.close()


def store(docs: DataFrame, folder: str) -> DataFrame:
    """digest, shard, offset, length of every payload, a row for each task that stored it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = None, set()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows = []
                for text in texts(part.column("text")):
                    payload = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest in seen:
                        continue
                    seen.add(digest)
                    shard = shard or _Shard(folder)
                    data = to_png(payload)
                    rows.append((digest, shard.name, shard.add(digest, data), len(data)))
                    if shard.at > SHARD_BYTES:
                        shard.close()
                        shard = None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    store_fs, path = fs.FileSystem.from_uri(folder)
    store_fs.create_dir(path)
    return map_arrow(docs.select("text"), run, "digest string, shard string, offset long, length long")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Of each place in the index: width, height, bits (by a range read of the header alone) and the digests of what is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, path = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard != name:
                    if file:
                        file.close()
                    name, file = shard, disk.open_input_file(f"{path}/{shard}")
                width, height, bits, colour = png_header(file.read_at(_HEADER, offset))
                data = file.read_at(length, offset)
                payload = from_png(data)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"png {width}x{height} {bits} bit grey"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        if file:
            file.close()

    ordered = index.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset")
    return map_arrow(ordered, run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and digest of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(t), hashlib.sha256(payload_of(t)).hexdigest()) for t in texts(batch.column("text"))]
            n, digest = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "digest"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, digest string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length and the metadata columns of every row of documents.

    A null or empty text is stored as one row of blanks. A very long text is one payload. Rows that repeat share a place. A null doc_id stays null. An empty
    table gives no rows. Other columns are not read. folder: where shards and index go, a URI that executors share.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    store(docs, f"{folder}/shards").write.parquet(f"{folder}/places")  # once: a second run would store all again
    first = F.min(F.struct("shard", "offset", "length"))
    index = spark.read.parquet(f"{folder}/places").groupBy("digest").agg(first.alias("p")).select("digest", "p.*")
    meta = read_back(index, f"{folder}/shards").join(index.hint("merge"), "digest")
    return digests(docs).join(meta.hint("merge"), "digest")


def op9_media(spark, sf_dir: str) -> DataFrame:
    """Stored form and metadata of every whole text of documents, as media_columns gives them; its cases hold."""
    out = media_columns(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length")
