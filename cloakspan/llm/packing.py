"""Best-fit packing by a configuration linear program.

Documents become token pieces of at most the capacity. Their length histogram (at most `capacity` numbers) is covered
by configurations, multisets of lengths that fit a sequence: a fractional cover is found by multiplicative weights,
each step taking the configuration that a knapsack dynamic program prices best; it is rounded down, and what is left is
packed best-fit, longest first, again on the histogram. Every piece then finds its place from its rank among the
pieces of its length, which is a running count over input partitions: no step gathers pieces in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .tokens import encoder

ROUNDS = 300


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, part, nth: the pieces of each row's token ids and end id.

    part and nth: the input partition, and the number of earlier pieces of that length in it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0), []
            take = []
            for r, found in enumerate(own.all_ids(batch.column(1).to_pylist())):
                data = found + end
                n = len(data) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - at)
                    rows.append((k, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), part, int(seen[length])))
                    seen[length] += 1
                    take.append(r)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), *arrays], ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def _priciest(worth: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths within the capacity that is worth most: unbounded knapsack by dynamic programming."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        values = worth[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(values.argmax())
        if values[k] > best[c - 1]:
            best[c], last[c] = values[k], k + 1
        else:
            best[c] = best[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if last[c]:
            out[int(last[c])] = out.get(int(last[c]), 0) + 1
            c -= last[c]
        else:
            c -= 1
    return out


def configurations(counts: dict[int, int], capacity: int = 2048, rounds: int = ROUNDS, rate: float = 0.5) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number}) that together hold each length exactly as often as counts says."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    total = left.astype(float)
    out: list[tuple[int, dict[int, int]]] = []
    if left[capacity]:
        out.append((int(left[capacity]), {capacity: 1}))
        left[capacity] = 0
    # The price of a length starts at its share of a sequence, which is the dual of the bound by total size.
    price = np.where(left > 0, np.arange(capacity + 1) / capacity, 0.0)
    cover: dict[tuple, float] = {}
    for _ in range(rounds):
        found = _priciest(price, capacity)
        if not found:
            break
        step = rate * min(total[k] / n for k, n in found.items())
        key = tuple(sorted(found.items()))
        cover[key] = cover.get(key, 0.0) + step
        for k, n in found.items():
            price[k] *= np.exp(-rate * step * n / total[k])
    for key, x in sorted(cover.items(), key=lambda e: (-e[1], e[0])):
        if (times := min([int(x), *(int(left[k]) // n for k, n in key)])) > 0:
            out.append((times, dict(key)))
            for k, n in key:
                left[k] -= times * n
    # Best fit, longest first: each filling is repeated for as long as all its lengths last, so one length at least ends.
    while (present := np.flatnonzero(left)).size:
        room, use = capacity, {}
        for k in present[::-1]:
            if (n := min(int(left[k]), room // int(k))) > 0:
                use[int(k)] = n
                room -= n * int(k)
        times = min(int(left[k]) // n for k, n in use.items())
        out.append((times, use))
        for k, n in use.items():
            left[k] -= times * n
    return out


def _layout(configs: list[tuple[int, dict[int, int]]]) -> list[np.ndarray]:
    """For each stretch of ranks of a length: key (length, first rank), first sequence, number a sequence, first offset."""
    rows, ranks, sequence = [], {}, 0
    for times, use in configs:
        offset = 0
        for length, n in use.items():
            first = ranks.get(length, 0)
            rows.append(((length << 50) + first, sequence, n, offset))
            ranks[length] = first + n * times
            offset += n * length
        sequence += times
    return [np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)] if rows else [np.zeros(0, np.int64)] * 4


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: one piece, of the end id alone. Repeated rows and ids, null ids included: pieces for each row.
    Texts of any length are cut into pieces of `capacity` ids. Empty table: no rows. Other columns are ignored.
    Sequences are filled without gaps from offset 0.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    keys, sequences, each, offsets = _layout(configurations(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(keys, (length << 50) + rank, "right") - 1
            nth = (length << 50) + rank - keys[k]
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "piece", "start", "length", "ids_crc32")]
            placed = [pa.array(sequences[k] + nth // each[k]), pa.array(offsets[k] + nth % each[k] * length)]
            yield pa.RecordBatch.from_arrays([*own, *placed], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = by_part.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
