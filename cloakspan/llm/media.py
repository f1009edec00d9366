"""Media columns: payloads kept as grey pictures in archives, read back by a data source of byte ranges.

An archive is a file of members (PNG pictures) followed by its directory: offset, size, CRC and id of each member, and
a footer. The data source reads the manifest of archives and their sizes, plans ranges of bytes, and each task reads the directory of
its archive, takes the members that begin in its range, streams them in Arrow batches of bounded size, and retries a
member by its offset when what it read doesn't have the member's CRC.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import new_folder

WIDTH = 192
MAGIC = b"ARCH0001"
#: Bytes of members that a batch holds, unless one member alone has more.
BATCH_BYTES = 8 << 20
RETRIES = 4
ENTRY = np.dtype([("offset", "<i8"), ("size", "<i8"), ("crc", "<u4"), ("no_id", "<u4"), ("doc_id", "<i8"), ("n_bytes", "<i8")])


def payload(text: str | None) -> tuple[int, bytes]:
    """The length of the text's UTF-8, and it with spaces up to a positive multiple of the width."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """The bytes as 8-bit grey samples, WIDTH a row, each row unfiltered."""
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> np.ndarray:
    """The samples of a picture of to_png's kind."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, shape = 8, [], (0, 0)
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy of the samples and an 8-by-8 difference hash, as text."""
    counts = np.bincount(samples.ravel(), minlength=256).astype(float)
    total, levels = counts.sum(), np.arange(256)
    mean = float(counts @ levels / total)
    deviation = float(np.sqrt(max(0.0, counts @ levels**2 / total - mean**2)))
    share = counts[counts > 0] / total
    rows = np.linspace(0, samples.shape[0], 9).astype(int)
    cells = np.array([samples[a : max(b, a + 1)].reshape(-1, WIDTH)[:, : WIDTH // 9 * 9].mean(axis=0).reshape(9, -1).mean(axis=1) for a, b in zip(np.minimum(rows[:-1], samples.shape[0] - 1), rows[1:], strict=True)])
    bits = np.packbits((cells[:, 1:] > cells[:, :-1]).ravel())
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.4f};dev={deviation:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};dhash={bits.tobytes().hex()}"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """One archive for each input partition under folder, a URI that all executors see, and a manifest: name, size, members of each.

    A task writes to a name of its own, and only what finished tasks return is in the manifest: a task that ran twice
    leaves an unlisted file. The manifest is a table in the folder, with a row for each task.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, entries, at = f"{uuid.uuid4().hex}.arch", [], len(MAGIC)
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(MAGIC)
            for batch in batches:
                for k in range(batch.num_rows):
                    doc_id, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    n, data = payload(text)
                    png = to_png(data)
                    out.write(png)
                    entries.append((at, len(png), zlib.crc32(png), doc_id is None, doc_id or 0, n))
                    at += len(png)
            directory = np.array(entries, ENTRY).tobytes()
            out.write(directory + struct.pack("<qq", at, len(entries)) + MAGIC)
        size = at + len(directory) + 24
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([len(entries)], pa.int64())], ["name", "size", "members"])

    own = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    own.mapInArrow(save, "name string, size long, members long").write.mode("overwrite").parquet(f"{folder}/manifest")


class _Range(InputPartition):
    def __init__(self, name: str, size: int, low: int, high: int) -> None:
        self.name, self.size, self.low, self.high = name, size, low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.range = options["path"], int(options.get("rangebytes", 16 << 20))

    def partitions(self) -> list[_Range]:
        """Planned from the manifest; a task gets its own range only."""
        store, root = _store(self.folder)
        archives = dataset(f"{root}/manifest", filesystem=store, format="parquet").to_table().to_pylist()
        found = [_Range(a["name"], a["size"], low, min(a["size"], low + self.range)) for a in archives if a["members"] for low in range(0, a["size"], self.range)]
        return found or [_Range("", 0, 0, 0)]

    @staticmethod
    def _member(file, entry: np.void, pause: float = 0.2) -> bytes:
        for k in range(RETRIES + 1):
            try:
                data = file.read_at(int(entry["size"]), int(entry["offset"]))
                if zlib.crc32(data) == entry["crc"]:
                    return data
                problem = ValueError(f"member at {entry['offset']} of {entry['size']} bytes is damaged")
            except OSError as e:
                problem = e
            time.sleep(pause * 2**k)
        raise problem

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "archive", "at", "media"]
        if not partition.name:
            return
        store, root = _store(self.folder)
        with store.open_input_file(f"{root}/{partition.name}") as file:
            start, n = struct.unpack("<qq", file.read_at(16, partition.size - 24))
            entries = np.frombuffer(file.read_at(n * ENTRY.itemsize, start), ENTRY)
            entries = entries[(entries["offset"] >= partition.low) & (entries["offset"] < partition.high)]
            held, taken, total = [], [], 0
            for k, e in enumerate(entries):
                held.append(self._member(file, e))
                taken.append(k)
                total += len(held[-1])
                if total >= BATCH_BYTES or k == len(entries) - 1:
                    own = entries[taken]
                    yield pa.RecordBatch.from_arrays([pa.array(own["doc_id"], mask=own["no_id"] > 0), pa.array(own["n_bytes"]), pa.array([partition.name] * len(own)), pa.array(own["offset"]), pa.array(held, pa.binary())], names)
                    held, taken, total = [], [], 0


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(folder), of a folder of write_archives"""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, archive string, at long, media binary"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").load(folder)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row, read back from the archives: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null text counts as empty: one row of spaces. Repeated rows and ids, null ids included: a row each. Texts of any
    length are one member each. Empty table: no rows. Other columns are ignored. Ids are integers.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "archives")
    write_archives(docs, folder, id_col, text_col)
    stored = read_archives(spark, folder)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, n, png in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                samples = from_png(png)
                data = samples.tobytes()
                rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(look, schema).withColumnRenamed("doc_id", id_col)
