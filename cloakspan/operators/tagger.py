"""The plug-in for models that tag texts: loaded once for each worker, fed in batches; what becomes of the tags is detect.ner_spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tag is (raw label, score, begin, end), offsets in code points.
Tag = tuple[str, float, int, int]
Model = Callable[[list[str]], list[list[Tag]]]
RESULTS = "array<struct<raw:string,score:double,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("raw", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def no_model() -> Model:
    """The stand-in where there is no model: it tags nothing."""
    return lambda texts: [[] for _ in texts]


def tag(text: Column, load: Callable[[], Model] = no_model, batch: int = 32, max_chars: int | None = None, stride: int = 128) -> Column:
    """The tags of a text column. load makes the model, on the worker.

    The model gets `batch` texts at a time. Texts over max_chars go to it in windows of so many characters that overlap
    by `stride`; of what two windows both tag, the first counts. Null and empty texts have no tags.
    """

    def windows(text: str) -> list[int]:
        if not text:
            return []
        return [0] if not max_chars or len(text) <= max_chars else list(range(0, len(text) - stride, max_chars - stride))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for column in columns:
            texts = [t or "" for t in column.to_pylist()]
            places = [(k, at) for k, t in enumerate(texts) for at in windows(t)]
            out: list[list[dict]] = [[] for _ in texts]
            for a in range(0, len(places), batch):
                own = places[a : a + batch]
                for (k, at), tags in zip(own, model([texts[k][at : at + max_chars] if max_chars else texts[k] for k, at in own]), strict=True):
                    reach = out[k][-1]["end"] if out[k] and at else 0
                    out[k] += [{"raw": raw, "score": score, "start": at + low, "end": at + high} for raw, score, low, high in tags if at + low >= reach]
            yield pa.array(out, _ARROW)

    if max_chars is not None and max_chars <= stride:
        raise ValueError("max_chars must be over stride")
    return F.arrow_udf(run, RESULTS)(text)
