"""Detection on a stream of feedback or text files, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect
from ..sources.text import FEEDBACK


def feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).json(path)


def detect_stream(texts: DataFrame, out: str, checkpoint: str, **kw) -> StreamingQuery:  # noqa: ANN003
    """Writes texts with their spans to out as Parquet; a batch that is run again replaces its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        detect(batch.drop("spans"), **kw).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
