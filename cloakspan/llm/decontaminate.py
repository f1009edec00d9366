"""Benchmark decontamination by spaced seeds.

A mask such as 11010011 is slid over the words of the benchmark items and of the training texts; words under a 0 do
not matter. Equal masked hashes are hits, so that a hit survives substituted words; the masks together hit every
stretch that is an overlap, wherever the words that differ are. Each hit fixes an alignment of the item to the text,
and the words around the hit are compared one by one: enough equal words in a stretch make an overlap. All steps are
DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import alnum_words, small_enough, written

#: 1: the word must be equal; 0: it may differ. Of 10 words of which any two differ, or 9 of which any one does, one mask at least is met.
MASKS = ("11111", "111011", "11010011")
#: Items of fewer words (and than the window) must be met word for word.
SHORT = 9

#: Up to so many seeds and word pairs of the benchmark go into the plan as sets that drop other places early.
SET_ROWS = 50_000
#: Words whose places are listed at once.
BLOCK = 4096
#: Characters of benchmark items that are broadcast at most; beyond it they are shuffled.
BROADCAST_CHARS = 8 << 20


def masks_for(window: int, min_equal: float) -> tuple[str, ...]:
    """Masks that hit every stretch of up to `window` words that is an overlap: MASKS if they do, else the run of words that must be left."""
    apart = {n: n - math.ceil(min_equal * n) for n in range(min(SHORT, window), window + 1)}
    if window >= SHORT and all(k <= (1 if n < 10 else 2) for n, k in apart.items()):
        return MASKS
    return ("1" * max(1, min(math.ceil((n - k) / (k + 1)) for n, k in apart.items())),)


def _seed(hashes: str, mask: str, m: int, i: Column) -> Column:
    """The hash of the words under the mask's ones at place i; null where the mask overhangs the end."""
    return F.when(i + len(mask) <= F.size(hashes), F.xxhash64(F.lit(m), *[F.get(hashes, i + j) for j, x in enumerate(mask) if x == "1"]))


def _placed(df: DataFrame, hashes: str, masks: list[tuple[int, str]], opens: list[tuple[int, int]] | None = None, known: list[int] | None = None) -> DataFrame:
    """df, but for the hashes of its words, with a row for each word place and mask: place, m, seed.

    opens: hashes of first words, and of first and second, worth a look; known: seeds worth a row. The words are taken
    in blocks that overlap by a mask's length, so that no row holds the places of a whole long text.
    """
    keep, reach = [c for c in df.columns if c != hashes], max(len(x) for _, x in masks) - 1
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.struct(at.alias("at"), F.slice(hashes, at + 1, BLOCK + reach).alias("h")))
    # explode_outer: for explode() the optimizer would add a size filter and push it, with all that it is made of, to the scan.
    df = df.withColumn("block", F.explode_outer(F.when(F.size(hashes) > 0, blocks))).select(*keep, F.col("block.at").alias("base"), F.col("block.h").alias("h"))
    seeds = lambda i: F.array(*[F.struct(i.alias("place"), F.lit(m).alias("m"), _seed("h", x, m, i).alias("seed")) for m, x in masks])
    if opens is None:
        df = df.withColumn("near", F.sequence(F.lit(0), F.least(F.size("h"), F.lit(BLOCK)) - 1))
    else:
        firsts, pairs = (",".join(map(str, sorted({x[k] for x in opens}))) for k in (0, 1))
        df = df.withColumn("near", F.expr(f"filter(transform(slice(h, 1, {BLOCK}), (x, i) -> CASE WHEN x IN ({firsts}) AND xxhash64(x, get(h, i + 1)) IN ({pairs}) THEN i END), i -> i IS NOT NULL)"))
    df = df.withColumn("seeds", F.flatten(F.transform("near", seeds)))
    if known:
        df = df.withColumn("seeds", F.expr(f"filter(seeds, s -> s.seed IN ({','.join(map(str, known))}))"))
    df = df.select(*keep, "base", F.explode_outer("seeds").alias("s")).where("s.seed is not null")
    return df.select(*keep, (F.col("base") + F.col("s.place")).alias("place"), "s.m", "s.seed")


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] | None = None, window: int = 13, min_equal: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per pair of a text and a benchmark item that share an overlap: id, text_hash, item, n_equal, n_aligned, first_word.

    An overlap is a stretch of `window` aligned words (all of a shorter item), of which `min_equal` or more are equal.
    n_equal and n_aligned count the aligned words of the best alignment; first_word is the place in the text where the
    item begins or would begin.
    Null or empty texts and items overlap with nothing. Items of fewer than SHORT words must be met word for word. Texts
    equal in id and text give one row. Items equal in id and text count once. Empty tables: no rows. Texts of any length
    count whole. Other columns are ignored. The masks of masks_for() miss no overlap; others may.
    What meets the benchmark's seeds is numbers only; words are fetched again for the alignments that were hit. Seeds
    and items are broadcast up to a checked number of rows and of characters; beyond it the same joins shuffle.
    """
    items = benchmark.select(F.col(item_col).alias("item"), alnum_words(F.col(item_text_col)).alias("item_words")).where(F.size("item_words") > 0).distinct()
    # Two texts under one id are two items: told apart by the hash of their words.
    items = written(items.withColumn("item_hash", F.xxhash64("item_words")), "items")
    chars = items.agg(F.sum(F.size("item_words") + F.char_length(F.array_join("item_words", " ")))).first()[0] or 0
    masks, least = masks or masks_for(window, min_equal), min(SHORT, window)
    # Short items are met whole, by a mask of their own length; there are a handful of such lengths.
    short = sorted(r[0] for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < least).distinct().collect())
    every = [*enumerate(masks), *((-n, "1" * n) for n in short)]
    n = F.col("n")
    hashed = items.select("item", "item_hash", F.size("item_words").alias("n"), _hashes("item_words").alias("hashes"))
    known = _placed(hashed, "hashes", every).where(((n >= least) & (F.col("m") >= 0)) | ((n < least) & (F.col("m") == -n) & (F.col("place") == 0)))
    known = written(known.select("item", "item_hash", F.col("place").alias("item_at"), "seed"), "seeds")
    # Masks that begin with two ones can't hit where the first two words open no seed of the benchmark.
    opens = hashed.select(F.explode_outer(F.transform("hashes", lambda h, i: F.struct(h.alias("first"), F.xxhash64(h, F.get("hashes", i + 1)).alias("pair")))).alias("x")).select("x.*").distinct().limit(SET_ROWS + 1).collect()
    usable = 0 < len(opens) <= SET_ROWS and all(x[:2] == "11" for _, x in every)
    opens = [(r.first, r.pair) for r in opens] if usable else None
    seeds = sorted(r[0] for r in known.select("seed").distinct().limit(SET_ROWS + 1).collect())

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), alnum_words(F.col(text_col)).alias("words"))
    placed = _placed(texts.select("id", "text_hash", _hashes("words").alias("hashes")), "hashes", every, opens, seeds if len(seeds) <= SET_ROWS else None)
    # All hits of an alignment are one: it is compared as a whole.
    hits = placed.drop("m").join(small_enough(known), "seed").select("id", "text_hash", "item", "item_hash", (F.col("place") - F.col("item_at")).alias("start"))
    hits = written(hits.distinct(), "hits")
    # Only texts that were hit are cut into words again.
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    of_text = hits.withColumnsRenamed({"id": "hit_id", "text_hash": "hit_hash"})
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = whole.join(small_enough(of_text.select("hit_id", "hit_hash").distinct()), same, "left_semi").select("id", "text_hash", alnum_words(F.col("text")).alias("words"))
    pairs = found.join(small_enough(of_text), same)
    wordy = items.withColumnsRenamed({"item": "own_item", "item_hash": "own_hash"})
    pairs = pairs.join(F.broadcast(wordy) if chars <= BROADCAST_CHARS else wordy, F.col("item").eqNullSafe(F.col("own_item")) & (F.col("item_hash") == F.col("own_hash")))
    # The stretch of both that is aligned, cut to where both have words.
    start = F.col("start")
    lead, size = F.greatest(F.lit(0), -start), F.size("item_words")
    n = F.least(size - lead, F.size("words") - F.greatest(F.lit(0), start))
    equal = F.zip_with(F.slice("words", F.greatest(F.lit(0), start) + 1, n), F.slice("item_words", lead + 1, n), lambda x, y: (x == y).cast("int"))
    pairs = pairs.select("id", "text_hash", "item", "start", F.least(F.lit(window), size).alias("width"), equal.alias("equal"))
    # Of all stretches, that with most equal words.
    stretch = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("equal") - F.col("width"))), lambda s: F.aggregate(F.slice("equal", s + 1, F.col("width")), F.lit(0), lambda acc, x: acc + x))
    pairs = pairs.withColumn("best", F.when(F.size("equal") < F.col("width"), 0).otherwise(F.array_max(stretch))).where(F.col("best") >= min_equal * F.col("width"))
    best = pairs.select("id", "text_hash", "item", F.struct(F.aggregate("equal", F.lit(0), lambda acc, x: acc + x).alias("n_equal"), F.size("equal").alias("n_aligned"), (-F.col("start")).alias("neg_start")).alias("x"))
    best = best.groupBy("id", "text_hash", "item").agg(F.max("x").alias("x"))
    return best.select(F.col("id").alias(id_col), "text_hash", F.col("item").alias(item_col), F.col("x.n_equal").cast("long").alias("n_equal"), F.col("x.n_aligned").cast("long").alias("n_aligned"), (-F.col("x.neg_start")).cast("long").alias("first_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without the rows whose text overlaps with a benchmark item (see overlaps); columns and other rows stay as they are."""
    found = overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **kw).select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_id"]) & (F.xxhash64(docs[text_col]) == found["_hash"]), "left_anti")
