"""Media columns: a Spark data source over directories of ZIP archives whose members are 8-bit grey PNG images.

Writing: every task writes archives of its own and tells the driver their names; the manifest that commit()
writes names the archives of successful tasks only. Reading: the manifest is planned into byte ranges, a
range serves the members that begin in it, and each member is read, checked and, on failure, retried by its
own offset.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tramline.llm._common import shared_dir, small_batches

FORMAT = "tramline_media"
WIDTH = 64
MANIFEST = "_manifest.json"
_SIGN = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """Grey 8-bit PNG, WIDTH samples a row, unfiltered; the payload's length must be a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The payload of encode_png; ValueError if the image is damaged or of another kind."""
    if media[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, data, head = 8, [], b""
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    width, height, depth, colour = struct.unpack(">IIBB", head[:10])
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("not 8-bit grey of the expected width")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and a 64-bit difference hash of the image shrunk to 8 x 9 cells."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    cells = np.add.reduceat(x, (np.arange(72) * len(x)) // 72).reshape(8, 9)
    bits = np.packbits((cells[:, 1:] > cells[:, :-1]).ravel()).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};dhash={bits}"


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    """Members are named serial_id_bytes.png; an archive is closed when it reaches `archive_bytes`."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("archive_bytes", 32 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, archive, out, name, n = [], None, None, "", 0

        def close() -> None:
            archive.close()
            files.append({"name": name, "bytes": out.tell(), "members": n})
            out.close()

        for batch in iterator:
            for doc_id, n_bytes, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive is None:
                    name, n = f"{uuid.uuid4().hex}.zip", 0
                    out = fs.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{n}_{doc_id}_{n_bytes}.png"), encode_png(payload))
                n += 1
                if out.tell() >= self.limit:
                    close()
                    archive = None
        if archive is not None:
            close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list) -> None:
        """Files of an aborted job stay unnamed, so no reader sees them."""


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("range_bytes", 8 << 20))
        self.tries = int(options.get("tries", 3))
        self.batch = int(options.get("batch_bytes", 4 << 20))

    def partitions(self) -> list[_Range]:
        fs, root = _filesystem(self.path)
        with fs.open_input_file(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        return [_Range(f["name"], at, at + self.step) for f in files for at in range(0, f["bytes"], self.step)] or [_Range("", 0, 0)]

    def _open(self, name: str):
        fs, root = _filesystem(self.path)
        return fs.open_input_file(f"{root}/{name}")

    def _member(self, source, name: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset; each try opens the archive anew. A member that fails to the end fails the task."""
        why: Exception | None = None
        for k in range(self.tries):
            f = source if not k else self._open(name)
            try:
                f.seek(info.header_offset)
                head = f.read(30)
                if len(head) < 30 or head[:4] != b"PK\x03\x04":
                    raise OSError("no member at this offset")
                f.seek(info.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                body = f.read(info.compress_size)
                if zlib.crc32(body) != info.CRC:
                    raise OSError("damaged member")
                return body
            except OSError as e:
                why = e
            finally:
                if k:
                    f.close()
        raise OSError(f"{name}: {info.filename} at {info.header_offset}: {why}")

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        ids, sizes, media, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

        if not partition.file:
            return
        with self._open(partition.file) as source:
            for info in zipfile.ZipFile(source).infolist():
                if partition.start <= info.header_offset < partition.end:
                    _, doc_id, n = info.filename.removesuffix(".png").split("_")
                    ids.append(None if doc_id == "None" else int(doc_id))
                    sizes.append(int(n))
                    media.append(self._member(source, partition.file, info))
                    held += len(media[-1])
                    if held >= self.batch:
                        yield flush()
                        ids, sizes, media, held = [], [], [], 0
            if ids:
                yield flush()


class MediaArchives(DataSource):
    """Format `tramline_media`. Options: path (a directory), archive_bytes, range_bytes, batch_bytes, tries."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def write_media(docs: DataFrame, path: str, **options: str) -> None:
    """Store each text of docs (doc_id, text) as one image: its UTF-8 bytes, then zeros up to a positive multiple of 64."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchives)
    small_batches(spark)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    full = F.greatest(F.lit(WIDTH), F.ceil(n / WIDTH) * WIDTH).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_bytes"), F.rpad(raw, full, F.unhex(F.lit("00"))).alias("payload"))
    rows.write.format(FORMAT).mode("append").options(**options).option("path", path).save()


def read_media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(doc_id, n_bytes, media) of all members below path."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format(FORMAT).options(**options).option("path", path).load()


def media_features(media: DataFrame) -> DataFrame:
    """Decode the stored images and describe their samples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for stored in batch.column(2).to_pylist():
                payload = decode_png(stored)
                for column, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_describe(docs: DataFrame, **options: str) -> DataFrame:
    """Write all texts as media into a new directory of the shared folder, read them back and describe them.

    docs: doc_id (an integer), text. One row for each row of docs; null and empty texts are 64 zero samples.
    Repeated rows are members of their own. An empty table gives an empty result."""
    path = f"{shared_dir(docs.sparkSession)}/tramline/media-{uuid.uuid4().hex}"
    write_media(docs, path, **options)
    return media_features(read_media(docs.sparkSession, path, **options))
