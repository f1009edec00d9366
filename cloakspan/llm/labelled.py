"""What the two classifiers share: their labels and the fold that is held out; and a bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learnt from: crc32 of the id as text leaves 2 when divided by 4 (a null id is in it)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def labels_of(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(_id, y) outside the held-out fold: labels other than 0 and 1 and null ids teach nothing; of several labels of an id the largest counts."""
    return labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of about per_class labelled rows of each class outside the held-out fold, and how many there are of each.

    Rows are picked by a hash of their id, at the rate that gives per_class of the class on average. Texts that occur
    more than once in the sample count once.
    """
    known = labels_of(labels, label, id_col)
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("y") == 1, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_class / max(1, counts.get(0, 0))))
    picked = known.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < rate * 1_000_000)
    # About twice per_class rows of two numbers: small enough to be broadcast by construction.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")
    return rows.dropDuplicates(["text", "y"]), counts
