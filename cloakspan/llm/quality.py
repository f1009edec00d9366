"""Quality by Bradley-Terry pairwise ranking.

Pairs of a better and a worse labelled text teach weights by the logistic loss of their feature difference, so that
the score orders texts. The threshold is a quantile of the scores, the share of worse texts among the labelled ones,
and scores are given as 0.7 there. All labelled texts outside the held-out fold are learnt from: bins, weights and
threshold come of sums over all of them, made where the rows are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labels_of
from .shared import deleted, written

#: Labelled rows of a block, in which better ones meet worse ones; a class of half as many at most is in every block.
BLOCK = 16_384
#: The worse (or better) rows that a row of the larger class of its block meets.
TURNS = 8
#: Steps of raw scores by which they are counted for the threshold.
GRID = 1 << 12
BINS = 12
_SIGN = re.compile(r"[^\w\s.,;:'’\-]")
_END = re.compile(r"[.!?]")


def _shares(text: str, words: list[str]) -> list[float]:
    """Of a stretch: shares of signs, bars, capitals, shouted words, words with a sign at the end, digits; distinct words; most frequent word; word repeated at once."""
    n, m = max(1, len(text)), max(1, len(words))
    counts = Counter(words)
    letters = sum(map(str.isalpha, text)) if len(text) < 400 else len(re.findall(r"[^\W\d_]", text))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    return [
        len(_SIGN.findall(text)) / n, text.count("|") / m, upper / max(1, letters), sum(len(w) > 1 and w.isupper() for w in words) / m, sum(not (w[-1].isalnum() or w[-1] in ".,;:") for w in words) / m,
        sum(map(str.isdigit, text)) / n if len(text) < 400 else len(re.findall(r"\d", text)) / n, len(counts) / m, (max(counts.values()) if counts else 0) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
    ]


def features(text: str | None) -> list[float]:
    """Numbers of the whole text, and the extremes over its lines."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    whole = _shares(text, words)
    each = np.array([_shares(x, w) for x in lines if len(w := x.split()) >= 5] or [[0.0] * 9])
    repeated = sum(n - 1 for n in Counter(lines).values()) / max(1, len(lines))
    trigrams = list(zip(words, words[1:], words[2:], strict=False))
    again = 1 - len(set(trigrams)) / max(1, len(trigrams))
    shape = [np.log1p(len(words)), np.log1p(len(lines)), len(text) / max(1, len(words)), len(words) / max(1, len(lines)), repeated, again, len(_END.findall(text)) / max(1, len(words)), float(not words)]
    return [*whole, *each.max(axis=0)[:6], each[:, 6].min(), *each.max(axis=0)[7:], *shape]


@dataclass
class QualityModel:
    """score = 1 / (1 + exp(-(scale * (sum of the weights of the bins that the features are in - cut) + logit of level)))"""

    edges: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float
    level: float = 0.7

    def raw(self, rows: np.ndarray) -> np.ndarray:
        bins = _binned(rows, self.edges)
        return self.weights[bins].sum(axis=1) if len(rows) else np.zeros(0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = self.scale * (self.raw(rows) - self.cut) + np.log(self.level / (1 - self.level))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _binned(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each feature, the number of its bin among all features' bins."""
    out = np.stack([np.searchsorted(e, rows[:, k], "right") for k, e in enumerate(edges)], 1) if len(rows) else np.zeros((0, len(edges)), int)
    return out + np.arange(len(edges)) * (edges.shape[1] + 1)


def _codes(rows: np.ndarray) -> np.ndarray:
    """Numbers that order the features as they are (none is negative), to nine binary digits."""
    return rows.astype(np.float32).view(np.uint32) >> 14


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _edges(rows: DataFrame) -> np.ndarray:
    """For each feature, the quantiles that part all rows in BINS bins."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _codes(_matrix(batch.column("x")))
            keys, n = np.unique(x.astype(np.int64) + (np.arange(x.shape[1]) << 32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    got = rows.select("x").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    keys, n = got["key"].to_numpy(), got["n"].to_numpy()
    out = np.zeros((len(features("")), BINS - 1))
    for k in range(len(out)):
        own = keys >> 32 == k
        if own.any():
            total = np.cumsum(n[own])
            at = np.searchsorted(total, np.linspace(0, 1, BINS + 1)[1:-1] * total[-1])
            out[k] = ((keys[own][at] & 0xFFFFFFFF).astype(np.uint32) << np.uint32(14)).view(np.float32)
    return out


def _blocks(rows: DataFrame, edges: np.ndarray, counts: dict[int, int]) -> DataFrame:
    """block, ys, bins: the bins of all rows as bytes, dealt by a hash of the text to blocks that have rows of both classes."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.searchsorted(e, v, "right") for e, v in zip(edges, _matrix(batch.column("x")).T, strict=True)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["t", "y", "bins"])

    n = max(1, sum(counts.values()) // BLOCK)
    scarce = [y for y, c in counts.items() if c <= BLOCK // 2]
    one = F.array(F.pmod(F.xxhash64("t"), F.lit(n)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    dealt = rows.mapInArrow(binned, "t string, y int, bins binary").select(F.explode(F.when(F.col("y").isin(scarce), every).otherwise(one) if scarce else one).alias("block"), "y", "bins")
    packed = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("y", "bins"))).alias("r"))
    return packed.select("block", F.col("r.y").alias("ys"), F.col("r.bins").alias("bins"))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of each block, labels and bins (among all features' bins) of its rows."""
    size = len(features(""))
    for batch in batches:
        for block, ys, bins in zip(batch.column("block").to_pylist(), batch.column("ys"), batch.column("bins"), strict=True):
            x = np.frombuffer(b"".join(bins.as_py()), np.uint8).reshape(-1, size)
            yield block, ys.values.to_numpy(zero_copy_only=False), x + np.arange(size, dtype=np.int32) * BINS


def _slope(y: np.ndarray, x: np.ndarray, w: np.ndarray, seed: int) -> tuple[int, float, np.ndarray]:
    """Pairs of a block, and the sums of their losses and of the losses' gradients. Each row is in a pair if both classes are there."""
    better, worse = (np.random.default_rng(seed).permutation(np.flatnonzero(y == k)) for k in (1, 0))
    out, m = np.zeros(len(w)), max(len(better), len(worse))
    if not len(better) or not len(worse):
        return 0, 0.0, out
    raw, pull, loss = w[x].sum(axis=1), np.zeros(len(y)), 0.0
    for turn in range(TURNS):
        a, b = better[np.arange(m) % len(better)], worse[(np.arange(m) + turn * (1 + len(worse) // TURNS)) % len(worse)]
        gap = np.clip(raw[a] - raw[b], -30, 30)
        p = 1 / (1 + np.exp(gap))  # the chance that the model gives to the wrong order
        loss += float(np.log1p(np.exp(-gap)).sum())
        pull += np.bincount(b, p, len(y)) - np.bincount(a, p, len(y))
    return m * TURNS, loss, np.bincount(x.ravel(), np.repeat(pull, x.shape[1]), len(w))


def _minimized(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps. f: value and gradient."""
    (value, grad), past = f(w), []
    for _ in range(steps):
        d, shares = -grad, []
        for s, g in reversed(past):
            shares.append(s @ d / (s @ g))
            d = d - shares[-1] * g
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, float(np.sqrt(grad @ grad))))
        for (s, g), share in zip(past, reversed(shares), strict=True):
            d = d + s * (share - g @ d / (s @ g))
        step = 1.0
        while (after := f(w + step * d))[0] > value + 1e-4 * step * (grad @ d) and step > 1e-3:
            step /= 2
        if after[0] >= value:
            break
        s, g, gain = step * d, after[1] - grad, value - after[0]
        past = [*past[1 - memory :], (s, g)] if s @ g > 1e-12 else past
        w, (value, grad) = w + s, after
        if gain < 1e-4 * value:
            break
    return w


def _cut(blocks: DataFrame, w: np.ndarray, worse_share: float) -> float:
    """Where the raw scores of all rows, weighted so that worse_share of them are worse, have that share below."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, x in _opened(batches):
            keys, n = np.unique(np.round(w[x].sum(axis=1) * GRID).astype(np.int64) * 2 + y, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    got = blocks.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    keys, n = got["key"].to_numpy(), got["n"].to_numpy()
    y = keys & 1
    total = np.cumsum(n * np.where(y == 1, (1 - worse_share) / n[y == 1].sum(), worse_share / n[y == 0].sum()))
    k = min(len(keys) - 1, int(np.searchsorted(total, worse_share)))
    return float((keys[max(0, k - 1)] >> 1) + (keys[k] >> 1)) / 2 / GRID


def _featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, t (which text it is), x (its features): a table, as they are made once and read for learning and for scores."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([features(t) for t in batch.to_pylist()], pa.list_(pa.float64()))

    return written(docs.select(F.col(id_col).alias("_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.arrow_udf(run, "array<double>")(F.col(text_col)).alias("x")), "features")


def _learnt(featured: DataFrame, labels: DataFrame, label: str, id_col: str, steps: int = 25, l2: float = 1e-3) -> QualityModel:
    """The model of all labelled rows; texts that occur more than once count once. With one class only, all texts score alike, on that class's side."""
    known = labels_of(labels, label, id_col)
    counts = {int(r.y): r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = written(featured.join(known, "_id").groupBy("t", F.col("y").cast("int").alias("y")).agg(F.first("x").alias("x")), "labelled")
    met = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    edges = _edges(rows)
    w = np.zeros(edges.shape[0] * BINS)
    if len(met) < 2:
        deleted(rows)
        return QualityModel(edges, w, -1.0 if not met.get(0) else 1.0, 3.0)
    blocks = written(_blocks(rows, edges, met), "blocks")

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, y, x in _opened(batches):
                n, own, grad = _slope(y, x, w, block)
                yield pa.RecordBatch.from_pylist([{"block": block, "n": n, "loss": own, "grad": grad.tolist()}])

        got = sorted(blocks.mapInArrow(add, "block long, n long, loss double, grad array<double>").collect())  # in an order, so that sums are equal each time
        n = sum(r.n for r in got)
        return sum(r.loss for r in got) / n + l2 / 2 * float(w @ w), np.sum([r.grad for r in got], axis=0) / n + l2 * w

    w = _minimized(loss, w, steps)
    cut = _cut(blocks, w, counts.get(0, 0) / max(1, sum(counts.values())))
    deleted(rows, blocks)
    return QualityModel(edges, w, cut, 1.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> QualityModel:
    """Learns from all labelled rows, never from the held-out fold."""
    featured = _featured(docs, id_col, text_col)
    model = _learnt(featured, labels, label, id_col)
    deleted(featured)
    return model


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row per row: id, held_out, score, predicted (1 from the threshold on).

    Null texts count as empty and score like other empty ones. Repeated rows and null ids: a row each. Empty table: no
    rows. Texts of any length count whole. Other columns are no inputs.
    """
    featured = _featured(docs, id_col, text_col)
    model = _learnt(featured, labels, label, id_col)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in columns:
            yield pa.array(model.score(_matrix(x)), pa.float64())

    scored = featured.select(F.col("_id").alias(id_col), F.arrow_udf(run, "double")(F.col("x")).alias("score"))
    return scored.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
