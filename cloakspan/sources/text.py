"""Sources and sinks of texts, spans and records."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S

FEEDBACK = "ts string, source string, text string, spans array<struct<start:int,end:int,label:string,text:string>>"
LABELLED = "text string, entities array<array<string>>"


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback records as they were appended (one JSON a line; blank lines are skipped)."""
    return spark.read.schema(FEEDBACK).json(path)


def feedback_training(rows: DataFrame) -> DataFrame:
    """text and entities of the kept labels; records without text or entities are gone."""
    kept = F.filter(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,text:string>>")), lambda s: F.upper(s["label"]).isin(*P.FEEDBACK_LABELS))
    out = rows.select("text", F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["label"]).alias("label"))).alias("entities"))
    return out.where((F.coalesce("text", F.lit("")) != "") & (F.size("entities") > 0))


def feedback_records(docs: DataFrame, ts: Column, source: str, text_col: str = "text", spans_col: str = "spans", clear: bool = True) -> DataFrame:
    """value: the JSON of each record. clear=False keeps hashes in the place of texts."""
    shown = (lambda c: c) if clear else (lambda c: F.sha2(c, 256))
    spans = F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), shown(s["text"]).alias("text")))
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return docs.select(F.to_json(F.struct(stamp.alias("ts"), F.lit(source).alias("source"), shown(S.text_of(F.col(text_col))).alias("text"), spans.alias("spans"))).alias("value"))


def append_feedback(records: DataFrame, path: str) -> None:
    records.write.mode("append").text(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """text, entities: numbers and labels of the lists as a struct; labels aliased for training, unknown ones dropped."""
    return aliased_entities(spark.read.schema(LABELLED).json(path))


def aliased_entities(rows: DataFrame) -> DataFrame:
    """From entities of [start, end, label] lists, strings all."""
    typed = F.transform("entities", lambda e: F.struct(F.get(e, F.lit(0)).cast("int").alias("start"), F.get(e, F.lit(1)).cast("int").alias("end"), S.alias_labels(F.upper(F.trim(F.get(e, F.lit(2)))), P.TRAINING_ALIASES, False).alias("label")))
    return rows.withColumn("entities", F.filter(typed, lambda e: e["label"].isNotNull()))


def gold_spans(rows: DataFrame) -> DataFrame:
    """text, gold: aliased entities within the text, under their final labels; texts without any are gone."""
    fine = F.filter("entities", lambda e: (e["end"] > e["start"]) & (e["start"] >= 0) & (e["end"] <= F.char_length("text")))
    gold = F.transform(fine, lambda e, i: S.make_span(e["start"], e["end"], S.alias_labels(e["label"], P.FINAL_ALIASES), F.substring("text", e["start"] + 1, e["end"] - e["start"]), F.lit(0), i))
    return rows.withColumn("gold", gold).where((F.coalesce("text", F.lit("")) != "") & (F.size("gold") > 0))


def write_jsonl(rows: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON a line, letters as they are; by: a folder for each value of a column, such as the split."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


#: Readers of binary formats: suffix to a function from bytes to text. None is built in; callers register theirs.
READERS: dict[str, Callable[[bytes], str]] = {".txt": lambda data: data.decode("utf-8", "replace")}


def read_documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, length, text of files; the text is null where no reader knows the suffix."""
    known = {**READERS, **(readers or {})}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            suffix = frame.path.str.extract(r"(\.[^./]*)$")[0].str.lower()
            yield pd.DataFrame({"path": frame.path, "length": frame.length, "text": [known[s](bytes(c)) if s in known else None for s, c in zip(suffix, frame.content, strict=True)]})

    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInPandas(read, "path string, length long, text string")


#: What a writer gets beside the bytes: (label, text, what stands for it) of each span.
Replacements = list[tuple[str, str, str]]
Writer = Callable[[bytes, Replacements], bytes]


def _plain_writer(data: bytes, spans: Replacements) -> bytes:
    """Every occurrence of each span's text replaced; a space stands for any run of white space."""
    text = data.decode("utf-8", "replace")
    for _, old, new in spans:
        if old:
            text = re.sub(r"[\s\u00a0]+".join(map(re.escape, old.split(" "))), lambda m, new=new: new, text)
    return text.encode()


#: Writers of binary formats, beside READERS. Those of PDF and DOCX are the caller's; there is none here.
WRITERS: dict[str, Writer] = {".txt": _plain_writer, ".html": _plain_writer}


def rewritten(replacement: Callable[[Column, Column], Column], writers: dict[str, Writer] | None = None, name_col: str = "path", content_col: str = "content", spans_col: str = "spans") -> Column:
    """The bytes of each file with its spans replaced by the writer of its suffix; null where there is none.

    Files without spans stay byte for byte. replacement: from label and text to what stands for it.
    """
    known = {**WRITERS, **(writers or {})}
    wanted = F.transform(spans_col, lambda s: F.struct(s["label"].alias("label"), s["text"].alias("text"), replacement(s["label"], s["text"]).alias("new")))

    def write(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, contents, spans in columns:
            out = []
            for kind, content, own in zip(kinds.to_pylist(), contents.to_pylist(), spans.to_pylist(), strict=True):
                fine = kind in known and content is not None
                out.append(None if not fine else known[kind](content, [(s["label"], s["text"], s["new"]) for s in own]) if own else content)
            yield pa.array(out, pa.binary())

    return F.arrow_udf(write, "binary")(suffix(F.col(name_col)), F.col(content_col), wanted)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def gate(name: Column, length: Column, limit_mb: int = P.MAX_FILE_MB) -> Column:
    """The HTTP status that a file would get: 413 too large, 415 other than PDF and DOCX, 200 else."""
    return F.when(length > limit_mb * 1024 * 1024, 413).when(~suffix(name).isin(".pdf", ".docx"), 415).otherwise(200)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")


def output_name(name: Column, mark: str = ".redacted") -> Column:
    return F.concat(stem(name), F.lit(mark), F.regexp_extract(name, r"(?<=.)(\.[^./]+)$", 1))


def saved_name(name: Column) -> Column:
    """A name of its own for an upload."""
    return F.concat(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit("__"), base_name(name))


def public_url(name: Column) -> Column:
    return F.concat(F.lit("/api/file/"), name)


def attachment(name: Column) -> Column:
    """The header for a download: an ASCII name (NFKD, the rest dropped) and the full one in percent form."""
    def to_ascii(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for names in columns:
            yield pa.array([None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() for x in names.to_pylist()], pa.string())

    plain = F.when(name.rlike(r"^[\x20-\x7E]*$"), name).otherwise(F.arrow_udf(to_ascii, "string")(name))
    fallback = F.when(plain == "", F.concat(F.lit("download"), suffix(name))).otherwise(plain)
    return F.concat(F.lit('attachment; filename="'), fallback, F.lit("\"; filename*=UTF-8''"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))
