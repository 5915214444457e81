"""Media columns: payloads as images in archives, read back by a Spark data source.

Tasks write archives: images one after another, then a directory in blocks (of members' offsets, names,
sizes and checksums), then an index of the blocks, then a fixed-size footer. The data source lists a folder
of archives and plans byte ranges of them. A range reads the index, the blocks that overlap it, and the
members that begin in it in long stretches, a bounded number of payload bytes to an Arrow batch. If a
stretch fails, or a member's checksum differs, that member is read again by its own offset.

Files are reached through Arrow's file systems, so any store with a URI that Arrow knows will do.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.llm.shared import new_path, table

WIDTH = 192
_PNG = b"\x89PNG\r\n\x1a\n"
_MAGIC = b"TSRARCH2"
_FOOTER = "<QQ8s"
_FOOTER_BYTES = struct.calcsize(_FOOTER)
ARCHIVE_BYTES = 256 << 20
#: Bytes of a range: as many as make this number of ranges, within bounds.
RANGES, LEAST_RANGE, MOST_RANGE = 10_000, 8 << 20, ARCHIVE_BYTES
BATCH_BYTES = 4 << 20
#: Members of a block of the directory.
BLOCK_MEMBERS = 4096
ATTEMPTS = 3


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % WIDTH if data else WIDTH)


def encode_image(payload: bytes) -> bytes:
    """A grey PNG of 8 bits a sample and WIDTH samples a row, without filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.hstack((np.zeros((len(rows), 1), np.uint8), rows)).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def decode_image(image: bytes) -> bytes:
    """The samples of an image that encode_image made."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data = 8, []
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Sum, sum of squares, of absolute differences of neighbours, and a histogram of 8 levels."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    levels = np.bincount(x >> 5, minlength=8)
    return ":".join(map(str, (int(x.sum()), int((x * x).sum()), int(np.abs(np.diff(x)).sum()), *levels.tolist())))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def _packed(rows: list[tuple]) -> bytes:
    return zlib.compress(json.dumps(rows).encode(), 1)


def write_archives(docs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Store each row's text as an image in archives under ``path``. A task gives its archives names of
    its own and renames them when whole; names of archives that count come back with the job, so what a
    failed or doubled attempt leaves is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, root = _open(path)
        written, out, directory, size = [], None, [], 0

        def close() -> None:
            nonlocal out
            index, at = [], size
            for begin in range(0, len(directory), BLOCK_MEMBERS):
                members = directory[begin : begin + BLOCK_MEMBERS]
                body = _packed(members)
                out.write(body)
                index.append((members[0][0], members[-1][0], at, len(body), zlib.crc32(body)))
                at += len(body)
            body = _packed(index)
            out.write(body)
            out.write(struct.pack(_FOOTER, at, len(body), _MAGIC))
            out.close()
            out = None

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                image = encode_image(pad(data))
                if out is None:
                    name = f"{uuid.uuid4().hex}.arch"
                    written.append(name)
                    out, directory, size = store.open_output_stream(f"{root}/{name}"), [], 0
                out.write(image)
                directory.append((size, len(image), zlib.crc32(image), doc_id, len(data)))
                size += len(image)
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], ["name"])

    store, root = _open(path)
    store.create_dir(root)
    # The names of archives, one for each ARCHIVE_BYTES or task.
    kept = {r["name"] for r in docs.select("doc_id", "text").mapInArrow(run, "name string").collect()}
    for info in store.get_file_info(fs.FileSelector(root)):
        if info.base_name not in kept:
            store.delete_file(info.path)


class ByteRange(InputPartition):
    def __init__(self, uri: str, size: int, start: int, end: int):
        super().__init__(None)
        self.uri, self.size, self.start, self.end = uri, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 0))
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges from the archives' sizes alone; no archive is opened here. Ranges grow with the folder, up
        to whole archives, so that the driver plans no more than it must."""
        store, root = _open(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file:" if self.path.startswith("file:") else ""
        found = [x for x in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda x: x.path) if x.is_file and x.base_name.endswith(".arch")]
        width = self.range_bytes or min(max(sum(x.size for x in found) // RANGES, LEAST_RANGE), MOST_RANGE)
        ranges = []
        for info in found:
            uri = f"{scheme}{info.path}" if scheme in ("file://", "file:", "") else f"{self.path.rstrip('/')}/{info.base_name}"
            ranges += [ByteRange(uri, info.size, at, min(at + width, info.size)) for at in range(0, info.size, width)]
        return ranges

    def _again(self, read, what: str):
        for attempt in range(self.attempts):
            try:
                return read()
            except (OSError, ValueError, zlib.error) as e:
                if attempt + 1 == self.attempts:
                    raise OSError(f"{what}: {e}") from e
                time.sleep(0.1 * 2**attempt)

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no archives
            return
        store, file = _open(partition.uri)

        def stretch(offset: int, size: int) -> bytes:
            with store.open_input_file(file) as f:
                f.seek(offset)
                if len(data := f.read(size)) != size:
                    raise OSError("short read")
            return data

        def index() -> list:
            begin, size, magic = struct.unpack(_FOOTER, stretch(partition.size - _FOOTER_BYTES, _FOOTER_BYTES))
            if magic != _MAGIC:
                raise ValueError("not an archive")
            return json.loads(zlib.decompress(stretch(begin, size)))

        def checked(offset: int, size: int, crc: int) -> bytes:
            if zlib.crc32(data := stretch(offset, size)) != crc:
                raise ValueError("checksum differs")
            return data

        def own(image: bytes | None, offset: int, size: int, crc: int) -> bytes:
            """A member out of a stretch or, if that isn't right, read by its own offset."""
            if image is not None and len(image) == size and zlib.crc32(image) == crc:
                return image
            return self._again(lambda: checked(offset, size, crc), f"{file} at {offset}")

        def batch(members: list) -> pa.RecordBatch:
            begin = members[0][0]
            try:
                data = stretch(begin, members[-1][0] + members[-1][1] - begin)
            except OSError:
                data = None
            rows = [(doc_id, n_bytes, at, own(data and data[at - begin : at - begin + size], at, size, crc)) for at, size, crc, doc_id, n_bytes in members]
            return self._batch(partition, rows)

        members, held = [], 0
        for first, last, at, size, crc in self._again(index, f"index of {file}"):
            if last < partition.start or first >= partition.end:
                continue
            for member in json.loads(zlib.decompress(self._again(lambda a=at, s=size, c=crc: checked(a, s, c), f"directory of {file} at {at}"))):
                if partition.start <= member[0] < partition.end:
                    members.append(member)
                    held += member[1]
                    if held >= self.batch_bytes:
                        yield batch(members)
                        members, held = [], 0
        if members:
            yield batch(members)

    @staticmethod
    def _batch(partition: ByteRange, rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, offsets, images = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([partition.uri] * len(rows), pa.string()), pa.array(offsets, pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "archive", "offset", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options rangeBytes, batchBytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id bigint, n_bytes bigint, archive string, offset bigint, media binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options: int) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**{k: str(v) for k, v in options.items()}).load(path)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for media in batch.column(2).to_pylist():
            payload = decode_image(media)
            values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names)


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes,
    media_sha256 and feature of every member that the data source reads."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, schema)


def store_and_measure(docs: DataFrame) -> DataFrame:
    """Store every row's text as an image, read all images back and measure them. Null and empty texts
    are one row of spaces; repeated rows and null doc_ids are members of their own; extra columns are
    ignored; without rows there are no archives and no result."""
    spark = docs.sparkSession
    path = new_path(spark, "media")
    write_archives(docs, path)
    return media_features(read_archives(spark, path))


def op4_media(spark, sf_dir):
    return store_and_measure(table(spark, sf_dir, "documents"))
