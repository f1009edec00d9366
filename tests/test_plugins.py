import pytest
from pyspark.sql import functions as F

from cloakspan.functions import spans as S
from cloakspan.operators import corpus as C
from cloakspan.operators import detect as D
from cloakspan.operators import evaluate as E
from cloakspan.operators import redact as R
from cloakspan.operators import tagger as G
from cloakspan.sources import text as T


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_tagger(spark):
    def digits():  # local, so that the workers needn't import this file
        import re

        return lambda texts: [[("NUM", 0.9, *m.span()) for m in re.finditer(r"\d+", t)] for t in texts]

    docs = spark.createDataFrame([(1, "a 12 b 345"), (2, None), (3, ""), (4, "😀 7 " + "x" * 300 + " 99")], "k int, t string")
    out = {r.k: [(x.raw, x.start, x.end) for x in r.r] for r in docs.select("k", G.tag(F.col("t"), digits, batch=2).alias("r")).collect()}
    assert out == {1: [("NUM", 2, 4), ("NUM", 7, 10)], 2: [], 3: [], 4: [("NUM", 2, 3), ("NUM", 305, 307)]}
    cut = {r.k: [(x.start, x.end) for x in r.r] for r in docs.select("k", G.tag(F.col("t"), digits, max_chars=100, stride=20).alias("r")).collect()}
    assert cut[4] == [(2, 3), (305, 307)]
    assert {len(r.r) for r in docs.select(G.tag(F.col("t")).alias("r")).collect()} == {0}
    with pytest.raises(ValueError, match="stride"):
        G.tag(F.col("t"), digits, max_chars=10)


def test_many_matches(spark):
    text = "".join(f"{'é' * (k % 3)} {k} " for k in range(300))
    found = one(spark, text, lambda t: S.find_spans(t, r"\d+", "N", 1))
    assert [(s.text, s.ord) for s in found] == [(str(k), k) for k in range(300)]
    assert all(text[s.start : s.end] == s.text for s in found)
    assert len(one(spark, text, lambda t: S.prune_overlaps(S.find_spans(t, r"\d+", "N", 1)))) == 300
    spliced = one(spark, text, lambda t: S.splice(t, S.find_spans(t, r"\d+", "N", 1), lambda label, x: F.lit("#")))
    assert spliced == "".join(f"{'é' * (k % 3)} # " for k in range(300))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Иванов И.И.", ["Иванов И.И."]),
        ("И. ​И.­Иванов-Белый", ["И. ​И.­Иванов-Белый"]),
        ("Иванов-И.И.", []),
        ("Иванов J.K.", []),
        ("Иванов И.", []),
        (None, []),
    ],
)
def test_paragraph_names(spark, text, found):
    assert [s.text for s in one(spark, text, D.paragraph_names)] == found


def test_listed_names(spark):
    found = one(spark, "Тут Анна Смирнова и Красный Дом. Пётр Ильич", lambda t: D.paragraph_names(t, listed=True))
    assert [s.text for s in found] == ["Тут Анна Смирнова", "Пётр Ильич"]


def test_gazetteer(spark):
    docs = spark.createDataFrame([(1, "In New York, in york; санкт-петербург"), (2, None), (None, "York")], "doc_id long, text string")
    terms = spark.createDataFrame([("new york", "LOCATION"), ("York", "LOCATION"), ("Санкт-Петербург", "LOCATION"), (None, "NRP")], "term string, label string")
    out = sorted((r.doc_id or 0, r.start, r.end, r.span) for r in D.gazetteer(docs, terms).collect())
    assert out == [(0, 0, 4, "York"), (1, 3, 11, "New York"), (1, 7, 11, "York"), (1, 16, 20, "york"), (1, 22, 37, "санкт-петербург")]
    assert D.gazetteer(docs, terms.limit(0)).count() == 0


def test_leaks_by_white_space(spark):
    gold = spark.createDataFrame([(1, 0, 3, "A", "a b"), (1, 0, 3, "A", "c\td"), (1, 0, 2, "A", "")], "doc_id long, start int, end int, label string, span string")
    shown = spark.createDataFrame([(1, "a\n b, c d")], "doc_id long, redacted string")
    assert E.leakage(gold, shown).first()[:2] == (1, 2)
    row = E.redaction_metrics(gold, gold.limit(1).withColumn("start", F.lit(1)), shown).first()
    assert (row.leaked, row.tp, row.fp, row.over_redaction) == (1, 0, 1, 1.0)


def test_links(spark):
    html = '<a href="mailto:a.b@c.de"><i>x.y@z.org</i></a> q@q.qq <a href="#">no</a>'
    out = one(spark, html, R.sanitize_links)
    assert out.html == '<a href="mailto:a.*@c.de"><i>x.*@z.org</i></a> q@q.qq <a href="#">no</a>'
    assert out.n == 2
    assert one(spark, out.html, R.sanitize_links).n == 0
    assert one(spark, None, R.sanitize_links).html == ""


def test_files_are_rewritten(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"Ann\n Lee and Ann Lee")), ("b.pdf", bytearray(b"%PDF")), ("c.txt", None)], "path string, content binary")
    spans = F.array(S.make_span(F.lit(0), F.lit(7), F.lit("PERSON"), F.lit("Ann Lee"), F.lit(0), F.lit(0)))
    out = {r.path: r.x for r in files.select("path", T.rewritten(lambda label, x: F.lit("***"), spans_col=spans).alias("x")).collect()}
    assert out == {"a.txt": bytearray(b"*** and ***"), "b.pdf": None, "c.txt": None}
    own = {r.path: r.x for r in files.select("path", T.rewritten(lambda label, x: F.lit(""), {".pdf": lambda data, found: data + b"!"}, spans_col=spans).alias("x")).collect()}
    assert own["b.pdf"] == bytearray(b"%PDF!")
    plain = files.select(T.rewritten(lambda label, x: F.lit(""), spans_col=S.empty()).alias("x"))
    assert bytearray(b"Ann\n Lee and Ann Lee") in [r.x for r in plain.collect()]


def test_attachment_and_properties(spark):
    assert one(spark, "résumé.pdf", T.attachment) == "attachment; filename=\"resume.pdf\"; filename*=UTF-8''r%C3%A9sum%C3%A9.pdf"
    assert one(spark, "ﬁle.txt", T.attachment).startswith('attachment; filename="file.txt"')
    docs = spark.createDataFrame([("t", "n")], "title string, name string")
    assert R.scrub_properties(docs).first() == ("", "n")


def test_split_with_clashing_names(spark):
    rows = spark.createDataFrame([(k, "x", "y", 1) for k in range(10)], "k long, split string, h string, r int")
    out = C.split_head(rows, "k", 0.3)
    assert out.columns == ["k", "h", "r", "split"]
    assert out.where("split = 'dev'").count() == 3
    assert C.split_head(rows.limit(0), "k", 0.3).count() == 0


def test_concatenation(spark):
    gold = F.array(S.make_span(F.lit(1), F.lit(2), F.lit("A"), F.lit("b"), F.lit(0), F.lit(0)))
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "abd"), (4, "abe")], "doc_id long, text string").withColumn("gold", gold)
    out = {r.batch: (r.text, [(s.start, s.end) for s in r.gold]) for r in C.concatenated(docs, 3).collect()}
    assert out == {0: ("abcabd", [(1, 2), (4, 5), (4, 5)]), 1: ("abe", [(1, 2)])}


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("ё", "dev"), ("b", "train")], "text string, split string")
    T.write_jsonl(rows, f"{tmp_path}/out", "split")
    assert {(r.text, r.split) for r in spark.read.json(f"{tmp_path}/out").collect()} == {("ё", "dev"), ("b", "train")}
    assert "ё" in "".join(p.read_text() for p in (tmp_path / "out" / "split=dev").glob("*.json"))


def _short_and_entities(spark):
    """Documents made from a few bytes each, which the planner takes for small, and an entity in each."""
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.lit("ab cd ef").alias("text"))
    return C.tokens(docs), docs.select("doc_id", F.lit(0).alias("ent"), F.lit(3).alias("start"), F.lit(8).alias("end"), F.lit("PER").alias("label"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tags_are_not_broadcast(spark):
    tags = C.bio_tags(*_short_and_entities(spark), known=None)
    assert "Broadcast" not in _plan(tags)
    assert sorted((r.doc_id, r.tok_idx, r.tag) for r in tags.collect()) == [(i, k, t) for i in range(4) for k, t in enumerate((None, "B-PER", "I-PER"))]


def test_contract_is_not_broadcast(spark):
    found = C.contract(*_short_and_entities(spark))
    assert "Broadcast" not in _plan(found)
    assert sorted((r.doc_id, r.start, r.end) for r in found.collect()) == [(i, 3, 8) for i in range(4)]
