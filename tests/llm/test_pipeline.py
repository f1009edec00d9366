import subprocess
import sys

import corpus_pipeline as P
import pytest
from conftest import ROOT
from test_free import words
from test_native import table

from cloakspan.llm import shared as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    text = lambda k, n=60: " ".join(words(n, k))
    bench = [(0, text(500, 40))]
    docs = [(k, text(k)) for k in range(40)] + [(100 + k, text(200 + k) + " scumbag") for k in range(40)]
    near = text(3).split()
    near[5] = "changed"
    docs += [(300, " ".join(near)), (301, text(4)), (302, text(7) + "\n" + text(302)), (303, text(600) + " " + bench[0][1]), (304, None), (305, "")]
    spark.createDataFrame(docs, "doc_id long, text string").createOrReplaceTempView("d_")
    spark.sql("SELECT *, 'en' AS lang, 's' AS source, CAST(length(text) AS BIGINT) AS n_chars FROM d_").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i, _ in docs[:80]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(40)) | {304, 305}
    assert set(kept["toxicity"]) == clean | {300, 301, 302, 303}
    assert set(kept["line_dedup"]) == clean | {300, 302, 303}
    assert kept["line_dedup"][302] == " ".join(words(60, 302))
    assert set(kept["near_dedup"]) == clean | {302, 303}
    assert set(kept["decontamination"]) == clean | {302}
    packed = P.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == clean | {302}
    assert table(spark, []).count() == 0


def test_empty_table_and_repeated_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.where("doc_id in (1, 2, 304)").unionByName(docs.where("doc_id in (1, 304)"))
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        left = sorted(r.doc_id for r in stage(spark, twice, folder).select("doc_id").collect())
        # Of equal texts one stays, of rows without any text all do.
        assert left == ([1, 2, 304, 304] if name == "near_dedup" else [1, 1, 2, 304, 304]), name


def test_exchanges_share_few_threads():
    """In an application of its own, since the settings are read once."""
    code = """
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from cloakspan.llm.shared import few_threads
few_threads(spark)
for k in range(40):
    spark.range(9).groupBy((F.col("id") % 3 + k).alias("x")).count().collect()
names = [t.getName() for t in spark._jvm.java.lang.Thread.getAllStackTraces().keySet()]
print("THREADS", sum(n.startswith("shuffle-exchange") for n in names))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT)
    assert 1 <= int(said.stdout.split("THREADS")[1]) <= 16


def test_memory_that_the_driver_has_freed_is_given_back(spark, monkeypatch):
    said, real = [], S.trimmed
    monkeypatch.setattr(S, "trimmed", lambda session: said.append(real(session)))
    assert S.written(spark.range(3), "few").count() == 3
    assert said and "Trim native heap" in said[0]
