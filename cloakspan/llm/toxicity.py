"""Toxicity by a counterfactual-regularised classifier.

A logistic model of the words that a text has, and of their beginnings, with an L1 penalty. Labelled texts also count
with each identity term swapped for the terms of other groups, and the squared change of the logit is penalised: what
a text is called must not depend on whom it mentions. A swap changes two words of the text's set, so that the change is
the difference of their weights and the swapped copies needn't be made; the score changes by a quarter of it at most.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample
from .shared import deleted, written

_WORD = re.compile(r"[^\W\d_]+")
#: Neutral names of groups in English, German, French and Spanish, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab"),
    ("man", "woman", "boy", "girl", "transgender"),
    ("men", "women", "boys", "girls"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"),
    ("immigrant", "refugee", "native", "foreigner", "citizen"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "old", "young"),
    ("christen", "muslime", "juden", "buddhisten", "atheisten", "katholiken"),
    ("männer", "frauen", "jungen", "mädchen"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("hommes", "femmes", "garçons", "filles"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("hombres", "mujeres", "chicos", "chicas"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
TERMS = {t: k for k, group in enumerate(IDENTITY_TERMS) for t in group}
PER_CLASS = 8_000
#: The model takes so many words at most, those that speak most for toxicity, beside the identity terms.
FEATURES = 600

PREFIXES = (4, 5, 6, 7)


def words_of(text: str | None) -> set[str]:
    """The distinct words, and the beginnings ("idio*") of those that name no group: inflected forms share them."""
    words = set(_WORD.findall((text or "").lower()))
    plain = words - TERMS.keys()
    return words.union(*({w[:k] + "*" for w in plain if len(w) > k} for k in PREFIXES))


@dataclass
class ToxicityModel:
    bias: float = -4.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        x = self.bias + sum(self.weights.get(w, 0.0) for w in words_of(text) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _swaps(words: list[str]) -> list[tuple[str, str]]:
    """(term, other): the terms among the words, each with the others of its kind."""
    return [(t, o) for t in words if t in TERMS for o in IDENTITY_TERMS[TERMS[t]] if o != t]


def fit(rows: list[tuple[Collection[str], int]], fair: float = 50.0, l1: float = 2e-4, steps: int = 800, least: float = 1.5, weigh: tuple[float, float] = (1.0, 1.0)) -> ToxicityModel:
    """rows: the distinct words and the label of each text. fair: the weight of the squared score changes under swaps.

    The L1 penalty is l1, or as much as `least` texts weigh if that is more. Words that speak for toxicity are taken,
    and identity terms whatever they speak for. weigh: how many labelled texts a row of class 0 and one of class 1
    stands for, so that the odds are those of all labelled texts whatever the sample has of each class.

    With one class only, or no rows, the model says the share of the class for all.
    """
    n1 = sum(y for _, y in rows)
    if not rows or n1 in (0, len(rows)):
        return ToxicityModel(bias=4.0 if rows and n1 else -4.0)
    n0 = len(rows) - n1
    toxic, other = Counter(), Counter()
    for words, y in rows:
        (toxic if y else other).update(words)
    # Words by the evidence of their log odds; a word needs to be met a few times at least.
    l1 = max(l1, least / len(rows))
    seen = [w for w in toxic.keys() | other.keys() if toxic[w] + other[w] >= 5]
    odds = {w: (np.log((toxic[w] + 0.5) / (n1 + 1)) - np.log((other[w] + 0.5) / (n0 + 1))) / np.sqrt(1 / (toxic[w] + 0.5) + 1 / (other[w] + 0.5)) for w in seen}
    strong = sorted((w for w in seen if odds[w] > 2), key=lambda w: (-odds[w], w))[:FEATURES]
    chosen = sorted({*strong, *(t for t in TERMS if t in odds)})
    at = {w: k for k, w in enumerate(chosen)}
    y = np.array([y for _, y in rows], float)
    counted = np.where(y > 0, weigh[1], weigh[0])
    counted = counted / counted.mean()
    # The rows' words as numbers, one after the other, and the row of each: a text has few of the words.
    met, has, swaps = array("i"), np.zeros(len(rows), np.int64), Counter()
    for r, (words, _) in enumerate(rows):
        own = sorted(w for w in words if w in at)
        met.extend(at[w] for w in own)
        has[r] = len(own)
        for t, o in _swaps(own):
            swaps[at[t], at.get(o, -1)] += counted[r]
    column, row = np.frombuffer(met, np.int32) if met else np.zeros(0, np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), has)
    # The penalty is a graph of terms; its step is taken exactly. A term that isn't in the sample weighs 0.
    rate = 4.0 / (1 + float((has * counted).mean()))
    terms = sorted({a for a, _ in swaps})
    spot = {a: k for k, a in enumerate(terms)}
    pull = np.eye(len(terms))
    for (a, b), n in swaps.items():
        share = 2 * rate * fair * n / len(rows)
        pull[spot[a], spot[a]] += share
        if b in spot:
            pull[spot[b], spot[b]] += share
            pull[spot[a], spot[b]] -= share
            pull[spot[b], spot[a]] -= share
    w, v, bias, momentum = np.zeros(len(chosen)), np.zeros(len(chosen)), float(np.log(n1 * weigh[1] / (n0 * weigh[0]))), 1.0
    for _ in range(steps):  # proximal gradient with momentum
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[column], len(rows)) + bias, -30, 30)))
        moved = v - rate * np.bincount(column, (counted * (p - y))[row], len(chosen)) / len(rows)
        moved[terms] = np.linalg.solve(pull, moved[terms])
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * l1, 0)
        bias -= rate * float((counted * (p - y)).mean())
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return ToxicityModel(bias, {c: float(k) for c, k in zip(chosen, w, strict=True) if abs(k) > 1e-6})


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns from at most about per_class rows of each class, weighted by what they stand for, never from the held-out fold."""
    sample, counts = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    sample = written(sample, "sample")  # read three times below

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(words_of(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.string())), batch.column(1)], ["words", "y"])

    kind = f"words array<string>, y {sample.schema['y'].dataType.simpleString()}"
    rows = sample.mapInArrow(cut, kind)
    total = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    # The same evidence as in fit(), summed on the executors; the driver gets the strongest words and who has them.
    met = rows.select(F.explode_outer("words").alias("w"), "y").where("w is not null").groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o")).where("t + o >= 5")
    odds = (F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("o") + 0.5) / (n0 + 1))) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5))
    strong = [r.w for r in met.select("w", odds.alias("odds")).where("odds > 2").orderBy(F.desc("odds"), "w").limit(FEATURES).collect()]
    names = sorted({*strong, *TERMS})
    number = {w: k for k, w in enumerate(names)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(number[w] for w in words_of(t) & number.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1)], ["words", "y"])

    # A class that is sampled counts for all of its rows.
    weigh = tuple(max(1.0, counts.get(k, 0) / per_class) for k in (0, 1))
    # The driver gets numbers, and its rows share the names: a string for each word of each row would be most of its memory.
    got = sample.mapInArrow(keep, kind.replace("string", "int")).toArrow()
    model = fit([([names[k] for k in words.as_py()], int(y.as_py())) for words, y in zip(got["words"], got["y"], strict=True)], weigh=weigh)
    deleted(sample)
    return model


def score(model: ToxicityModel, text: Column) -> Column:
    """The model's score (0 to 1) of a text column. Null and empty texts get its base score."""
    weights, bias = model.weights, model.bias

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = ToxicityModel(bias, weights)
        for batch in texts:
            yield pa.array([own.score(t) for t in batch.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row: id, held_out, score, predicted (1 from the threshold on).

    Null texts count as empty. Repeated rows and null ids: a row each. Empty table: no rows. Texts of any length count
    whole. Other columns are no inputs. Without labels of both classes all texts score alike.
    """
    model = train(docs, labels, per_class, id_col, text_col, label)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """docs without the rows that score the threshold or more; columns and other rows stay as they are."""
    return docs.where(score(train(docs, labels, per_class, id_col, text_col, label), F.col(text_col)) < threshold)
