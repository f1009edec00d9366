import pytest
from pyspark.sql import functions as F

from cloakspan.operators.detect import detect
from cloakspan.plans.jobs import RedactJob, evaluate_synthetic
from cloakspan.sources import text as T
from cloakspan.streaming.feedback import detect_stream


def test_feedback_round_trip_and_stream(spark, tmp_path):
    docs = detect(spark.createDataFrame([("Пётр Иванов здесь",), ("nothing",), (None,)], "text string"))
    log = str(tmp_path / "log")
    T.append_feedback(T.feedback_records(docs, F.timestamp_seconds(F.lit(0)), "api"), log)
    rows = T.read_feedback(spark, log)
    assert rows.count() == 3
    assert rows.first().ts == "1970-01-01T00:00:00.000000Z"
    kept = T.feedback_training(rows).collect()
    assert [(e.start, e.end, e.label) for e in kept[0].entities] == [(0, 11, "PERSON")]
    assert len(kept) == 1
    stream = spark.readStream.schema(T.FEEDBACK).json(log)
    query = detect_stream(stream, str(tmp_path / "out"), str(tmp_path / "marks"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_labelled(spark):
    rows = spark.createDataFrame([("abc", [["0", "2", " person "], ["1", "9", "LOC"], ["0", "1", "OTHER"]]), ("", [["0", "0", "ORG"]])], "text string, entities array<array<string>>")
    gold = T.gold_spans(T.aliased_entities(rows)).collect()
    assert [(s.start, s.end, s.label, s.text) for s in gold[0].gold] == [(0, 2, "PERSON", "ab")]
    assert len(gold) == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x@y.zz")
    (tmp_path / "b.bin").write_bytes(b"\x00")
    rows = {r.path[-5:]: r.text for r in T.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "x@y.zz", "b.bin": None}
    files = spark.createDataFrame([("in/a.PDF", 10, "x@y.zz"), ("b.docx", 60 << 20, ""), ("c.txt", 1, "")], "name string, length long, text string")
    out = {r.input_name: r for r in RedactJob().process(files).collect()}
    assert (out["a.PDF"].output_name, out["a.PDF"].found, out["a.PDF"].redacted) == ("a.redacted.PDF", 1, "x@y.zz")
    assert (out["b.docx"].status, out["c.txt"].status) == (413, 415)
    with pytest.raises(ValueError, match="policy"):
        RedactJob(policy="x")


def test_names(spark):
    row = spark.createDataFrame([("отчёт é.pdf",)], "n string").select(T.attachment(F.col("n")).alias("a"), T.saved_name(F.col("n")).alias("s")).first()
    assert row.a.startswith('attachment; filename="')
    assert row.a.endswith("%20%C3%A9.pdf")
    assert row.s[32:34] == "__"


def test_synthetic(spark):
    scores = {(r.level, r.scope): r for r in evaluate_synthetic(spark, 50).where("scope = 'micro'").collect()}
    assert scores["span", "micro"].recall > 0.7
