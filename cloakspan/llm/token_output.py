"""Binary token output in training order.

Documents become sequences of at most `stride` ids. A keyed Feistel permutation, cycle-walking until it lands within
the number of sequences, gives every sequence its own global slot. Slots are range-partitioned into shards, and each
shard is one file of fixed-size records in slot order: record k of shard s is slot s * per_shard + k at byte
k * record. A reader resumes at any slot by one seek, and a shard that is there in full is not written again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cleaned, deleted, small_enough, written
from .tokens import encoder


#: Shards are dealt to so many tasks at most, runs of shards to each.
MAX_TASKS = 10_000


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mix: multiply and fold."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def slots(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each index in [0, n): a permutation of [0, n) that the key picks."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right, key * 31 + r & (1 << 64) - 1) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():  # the domain is below 4n, so few steps do
        out[far] = once(out[far])
    return out.astype(np.int64)


def record_type(stride: int) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<u2"), ("no_id", "u1"), ("spare", "u1"), ("ids", "<u2", (stride,))])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root, allow_not_found=True)


_HEAD = struct.Struct("<qiHBB")


def _records(doc_id: int | None, ids: np.ndarray, stride: int) -> list[bytes]:
    """The records of a document's ids, without what fills them up; their head is that of record_type."""
    data, own, none = ids.astype("<u2").tobytes(), doc_id or 0, doc_id is None
    return [_HEAD.pack(own, k, len(piece) // 2, none, 0) + piece for k, at in enumerate(range(0, len(data), 2 * stride)) for piece in (data[at : at + 2 * stride],)]


def _size(store, path: str) -> int:
    found = store.get_file_info(path)
    return found.size if found.is_file else -1


def write_shards(docs: DataFrame, tokenizer: str, folder: str, stride: int = 256, per_shard: int = 16_384, key: int = 20_240_229, end_id: int = 0, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes the shards under folder (a URI that all executors see) and returns the number of sequences.

    The sequences are kept in a table under the folder until all shards are written. A run that was broken off goes on
    when it is called again with the same folder and inputs: the table is used if it is there in full, and shards that
    are there are not written again. The shards are made in `rounds` runs, so that no more than such a part is shuffled
    at a time. Attempts that were broken off leave files whose names end in a task's number;
    they are removed in the end.

    Null or empty text: one sequence, of the end id. Repeated rows: sequences for each. Null ids are marked. Empty
    table: no file. Texts of any length. Ids of documents are integers; token ids beyond 16 bits are an error.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, nth = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end, wide = np.array([end_id], "<u4").tobytes(), max(end_id, own.tokenizer.get_vocab_size() - 1) > 0xFFFF
        for batch in batches:
            records = []
            for doc_id, found in zip(batch.column(0).to_pylist(), own.all_ids(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(found + end, "<u4")
                if wide and ids.max() > 0xFFFF:
                    raise ValueError(f"token id {ids.max()} takes more than 16 bits")
                records += _records(doc_id, ids, stride)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(np.full(len(records), part, np.int32)), pa.array(np.arange(nth, nth + len(records)))], ["record", "part", "nth"])
            nth += len(records)

    schema, table = "record binary, part int, nth long", f"{folder}/sequences"
    store, root = _open(folder)
    if _size(store, f"{root}/sequences/_SUCCESS") < 0:
        docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, schema).write.mode("overwrite").option("compression", "zstd").parquet(table)
    sequences = spark.read.schema(schema).parquet(table)
    parts = sequences.groupBy("part").agg(F.count("*").alias("n"))
    n = parts.agg(F.sum("n")).first()[0] or 0
    # Counts by partition, summed up level by level: of a million partitions no task holds more than a thousand sums.
    parts = parts.withColumn("block", F.floor(F.col("part") / 1000))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("b"))
    blocks = blocks.withColumn("base", F.sum("b").over(Window.orderBy("block")) - F.col("b")).drop("b")
    firsts = parts.withColumn("first", F.sum("n").over(Window.partitionBy("block").orderBy("part")) - F.col("n")).join(blocks, "block")
    firsts = written(firsts.select("part", (F.col("first") + F.col("base")).alias("first")), "firsts")

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(slots(index.to_numpy(), n, key))

    def full(shard: int) -> int:
        """The bytes of a shard that is there in full."""
        return min(per_shard, n - shard * per_shard) * record_type(stride).itemsize

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots come in order, so the records of a shard are appended one after the other."""
        width, (own, place) = record_type(stride).itemsize, _open(folder)
        shard, out, name = None, None, ""

        def ended() -> None:
            out.close()
            if _size(own, name) >= 0:  # not every store replaces a file that is there
                own.delete_file(name)
            own.move(f"{name}.{TaskContext.get().taskAttemptId()}", name)

        done: list[int] = []
        for batch in batches:
            slots_, records = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for s in np.unique(slots_ // per_shard).tolist():
                if s != shard:
                    if out:
                        ended()
                    shard, name = s, f"{place}/shard-{s:08d}.bin"
                    out = own.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}")
                    done.append(s)
                low, high = np.searchsorted(slots_, [s * per_shard, (s + 1) * per_shard]).tolist()
                out.write(b"".join([x.ljust(width, b"\0") for x in records[low:high].to_pylist()]))
        if out:
            ended()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["shard"])

    shards = -(-n // per_shard)
    there = {x.path.rpartition("/")[2]: x.size for x in store.get_file_info(_selector(root))} if n else {}
    wanted = [s for s in range(shards) if there.get(f"shard-{s:08d}.bin") != full(s)]
    placed = sequences.join(small_enough(firsts), "part").select(slot(F.col("first") + F.col("nth")).alias("slot"), "record")
    shard = F.floor(F.col("slot") / per_shard).cast("int")
    for r in range(rounds):
        low, high = shards * r // rounds, shards * (r + 1) // rounds
        if not (missing := [s for s in wanted if low <= s < high]):
            continue
        rows = placed.where(shard.between(low, high - 1))
        if len(missing) < high - low:
            rows = rows.join(F.broadcast(spark.createDataFrame([(s,) for s in missing], "shard int")), shard == F.col("shard"), "left_semi")
        each = -(-(high - low) // MAX_TASKS)
        with cleaned(spark):
            rows.repartitionById(-(-(high - low) // each), F.floor((shard - low) / each).cast("int")).sortWithinPartitions("slot").mapInArrow(save, "shard long").count()
    deleted(firsts)
    for x in store.get_file_info(_selector(root)) if n else []:
        if x.is_file and not x.path.endswith(".bin"):
            store.delete_file(x.path)
    if _size(store, f"{root}/sequences/_SUCCESS") >= 0:
        store.delete_dir(f"{root}/sequences")
    return n


def read_shards(spark: SparkSession, folder: str, n: int, stride: int = 256, per_shard: int = 16_384, first_slot: int = 0, with_ids: bool = True) -> DataFrame:
    """The sequences from first_slot on: slot, shard, byte, doc_id, piece, length, ids_crc32 and, if asked for, ids; a task for each shard, or run of shards."""
    kind = record_type(stride)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for shard in (x for batch in batches for x in batch.column(0).to_pylist()):
            slot, last = max(first_slot, shard * per_shard), min(n, (shard + 1) * per_shard)
            with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
                f.seek((slot - shard * per_shard) * kind.itemsize)
                while slot < last:
                    data = np.frombuffer(f.read(min(2048, last - slot) * kind.itemsize), kind)
                    wide, lengths = data["ids"].astype("<u4"), data["length"].astype(np.int64)
                    at = np.arange(slot, slot + len(data))
                    cols = [pa.array(at), pa.array(np.full(len(at), shard)), pa.array((at - shard * per_shard) * kind.itemsize), pa.array(data["doc_id"], mask=data["no_id"] > 0), pa.array(data["piece"]), pa.array(lengths)]
                    cols.append(pa.array([zlib.crc32(memoryview(x)[:m]) for x, m in zip(wide, lengths.tolist(), strict=True)], pa.int64()))
                    if with_ids:
                        inside = np.arange(stride)[None, :] < lengths[:, None]
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(wide[inside].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names)
                    slot += len(data)

    schema = "slot long, shard long, byte long, doc_id long, piece int, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    shards = range(first_slot // per_shard, -(-n // per_shard))
    wanted = spark.range(shards.start, max(shards.start, shards.stop), 1, min(MAX_TASKS, max(1, len(shards)))).withColumnRenamed("id", "shard")
    return wanted.mapInArrow(read, schema)
