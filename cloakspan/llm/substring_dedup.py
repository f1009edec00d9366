"""Substring dedup on difference-cover anchors.

A window of words that two texts share may begin anywhere in either. With cover positions {0, 1, 3} modulo 7, any two
begins have an offset of at most 6 at which both texts are at a cover position. So it is enough to hash the anchors,
runs of window - 6 words, at cover positions: every shared window holds an anchor that both texts hashed. Anchors seen
once are dropped; around the others the windows are extended, and a window goes where the same words begin in a text
with a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import Words, mixed, stretches, words_of
from .shared import deleted, written

PERIOD, COVER = 7, (0, 1, 3)
#: The place of a null id among the ids: after all. Rows without an id have keys from there on, by the hash of the text.
NO_ID = (1 << 63) - (1 << 40)


def _place(key: str) -> Column:
    """The key's place in the order of ids, in which all rows without an id are equal."""
    return F.least(F.col(key), F.lit(NO_ID))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover places and the hashes of the anchors there; places are counted from the begin of each text."""
    at, hashes = words.runs(width)
    cover = np.isin((at - words.first[words.text[at]]) % PERIOD, COVER)
    return at[cover], hashes[cover]


def _spread(at: np.ndarray, before: int, after: int, words: Words) -> np.ndarray:
    """Which words are at most `before` words ahead of one of `at`, or less than `after` behind, in the same text."""
    edge = np.zeros(len(words.text) + 1, np.int64)
    np.add.at(edge, np.maximum(at - before, words.first[words.text[at]]), 1)
    np.add.at(edge, np.minimum(at + after, words.first[words.text[at] + 1]), -1)
    return np.cumsum(edge[:-1]) > 0


def _listed(lists: pa.ListArray, own: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which of the hashes `own`, each of the text of that number, are in that text's list."""
    lengths = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    tag = mixed(np.arange(len(lists), dtype=np.uint64), 77)
    return np.isin(own ^ tag[text], values ^ np.repeat(tag, lengths))


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row: id, n_words, n_removed, kept_sha256 (and kept_text): words covered by earlier windows are gone.

    A word goes if a window of `window` running words that covers it also begins in a text with a smaller id. Windows
    are judged on the input. Words are runs of anything but ASCII white space, unchanged.
    Windows are told by 64-bit hashes: with 10**12 shared windows, one in 10**7 may be taken for another.
    Null or empty texts have no words. Null ids come after all others (ids are below NO_ID). Rows that share an id don't remove from each
    other. Texts under the window's length lose nothing; texts of any length count whole. Empty table: no rows. Other columns are ignored.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD}")
    width, reach = window - PERIOD + 1, PERIOD - 1
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text_col), F.lit((1 << 40) - 1))).alias("key"), F.col(text_col).alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches):
            words = words_of(_column(batch, "text"))
            at, hashes = _anchors(words, width)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), _column(batch, "key").take(pa.array(words.text[at]))], ["anchor", "key"])

    # Hashed twice, not written: a table of all anchors is as large as the texts.
    found = keyed.select("key", "text").mapInArrow(anchors, "anchor long, key long")
    # Rows, not texts, are counted: a few anchors too many cost a look and no error.
    shared = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    mine = written(found.join(shared, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "shared")
    deleted(shared)

    def near(words: Words, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and hashes of the windows around the listed anchors."""
        at, hashes = _anchors(words, width)
        open_ = _spread(at[_listed(lists, hashes, words.text[at])], reach, 1, words)
        begins, own = words.runs(window, 1)
        return begins[open_[begins]], own[open_[begins]]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches):
            words = words_of(_column(batch, "text"))
            begins, own = near(words, _column(batch, "anchors"))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), _column(batch, "key").take(pa.array(words.text[begins]))], ["w", "key"])

    found = written(keyed.select("key", "text").join(mine, "key").mapInArrow(windows, "w long, key long"), "windows")
    deleted(mine)
    firsts = written(found.groupBy("w").agg(F.min(_place("key")).alias("first"), F.max(_place("key")).alias("last")).where("first < last").drop("last"), "firsts")
    gone = written(found.join(firsts, "w").where(_place("key") > F.col("first")).groupBy("key").agg(F.collect_set("w").alias("dead")), "gone")
    deleted(found, firsts)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches):
            texts = _column(batch, "text")
            words = words_of(texts)
            begins, own = words.runs(window, 1)
            removed = _spread(begins[_listed(_column(batch, "dead"), own, words.text[begins])], 0, window, words)
            n = np.diff(words.first)
            lost = np.add.reduceat(np.append(removed, False).astype(np.int64), words.first[:-1]) * (n > 0) if len(n) else n
            digests, left = [], []
            for k, text in enumerate(texts.to_pylist()):
                own = (text or "").encode().split()  # bytes.split() parts at space and \t to \r alone
                if lost[k]:
                    own = [w for w, x in zip(own, removed[words.first[k] : words.first[k + 1]].tolist(), strict=True) if not x]
                kept = b" ".join(own)
                digests.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([_column(batch, "id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = keyed.join(gone, "key", "left").select("id", "text", "dead").mapInArrow(strip, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("id", id_col).drop(*[] if with_text else ["kept_text"])
