"""Whole jobs: redaction of a table of files, and the evaluation of the detector on synthetic texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import corpus, evaluate, redact
from ..operators.detect import detect, resolve_labels, resolve_languages
from ..sources import text as T
from ..sources.people import person_rows


@dataclass(frozen=True)
class RedactJob:
    """policy: mask or remove. languages and types may be lists or comma-separated text; no types: all."""

    policy: str = "mask"
    languages: tuple[str, ...] | str = ("ru", "en")
    types: tuple[str, ...] | str | None = None
    safe: bool = False

    def __post_init__(self) -> None:
        redact.check_policy(self.policy)

    @staticmethod
    def _listed(value: tuple[str, ...] | str | None) -> list[str]:
        return [x.strip() for x in (value.split(",") if isinstance(value, str) else value or ()) if x.strip()]

    def process(self, files: DataFrame) -> DataFrame:
        """files: name, length, text. One row a file: input_name, output_name, output_url, found, filetype, status, redacted.

        Files that are too large or of another type have a status other than 200 and no output.
        """
        found = detect(files, labels=resolve_labels(self._listed(self.types) or None), languages=resolve_languages(self._listed(self.languages)))
        fine, name = F.col("status") == 200, T.base_name(F.col("name"))
        out = found.withColumn("status", T.gate(F.col("name"), F.col("length")))
        return out.select(
            name.alias("input_name"), F.when(fine, T.output_name(name)).alias("output_name"), F.when(fine, T.public_url(T.output_name(name))).alias("output_url"), F.when(fine, F.size("spans")).otherwise(0).alias("found"),
            F.substring(T.suffix(name), 2, 10).alias("filetype"), "status", F.when(fine, redact.apply_policy(F.col("text"), F.col("spans"), self.policy, self.safe)).alias("redacted"),
        )


def evaluate_concatenated(docs: DataFrame, labels: list[str], batch_size: int = 5000, languages: list[str] | None = None) -> DataFrame:
    """Scores of the detector, by span and by character, on texts (doc_id, text, gold) put together in batches of consecutive ids."""
    joined = corpus.concatenated(docs, batch_size)
    found = detect(joined, labels=labels, languages=languages)
    gold, pred = evaluate.explode_spans(joined, "gold", "batch"), evaluate.explode_spans(found, "spans", "batch")
    return evaluate.classification(gold, pred, labels, ("batch",))


def evaluate_synthetic(spark: SparkSession, n: int = 1000, ru_share: float = 1.0, batch_size: int = 5000, languages: tuple[str, ...] = ("ru", "en")) -> DataFrame:
    """Scores of the detector on the snippets of n person rows, put together in batches, by span and by character."""
    docs = corpus.snippets(person_rows(spark, n, ru_share), corpus.SNIPPET, "doc_id")
    return evaluate_concatenated(docs, list(corpus.FIELDS.values()), batch_size, resolve_languages(list(languages)))
