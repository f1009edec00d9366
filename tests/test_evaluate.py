from cloakspan.operators import corpus as C
from cloakspan.operators import evaluate as E

ROWS = "doc_id long, start int, end int, label string, span string"


def test_counts_and_scores(spark):
    gold = spark.createDataFrame([(1, 0, 5, "A", ""), (1, 0, 5, "A", ""), (1, 2, 4, "B", ""), (1, 1, 3, "C", "")], ROWS)
    pred = spark.createDataFrame([(1, 0, 5, "A", ""), (1, 2, 5, "B", ""), (1, 2, 5, "B", "")], ROWS)
    counts = {r.label: (r.tp, r.fp, r.fn) for r in E.match_counts(gold, pred, list("ABCD")).collect()}
    assert counts == {"A": (1, 0, 1), "B": (0, 2, 1), "C": (0, 0, 1), "D": (0, 0, 0)}
    scored = {(r.scope, r.label): r for r in E.scores(E.match_counts(gold, pred, list("ABCD"))).collect()}
    assert scored["micro", ""].tp == 1
    assert abs(scored["micro", ""].precision - 1 / 3) < 1e-12
    assert abs(scored["macro", ""].precision - 1 / 4) < 1e-12
    assert E.set_scores(gold, pred).first().n_both == 1


def test_splits_and_empty(spark):
    ids = spark.range(10).withColumnRenamed("id", "k")
    assert C.split_head(ids, "k", 0.2).where("split = 'dev'").count() == 2
    assert C.split_head(ids.limit(1), "k", 0.2).where("split = 'dev'").count() == 1
    empty = spark.createDataFrame([], ROWS)
    assert E.scores(E.match_counts(empty, empty)).where("scope = 'micro'").first().f1 == 0.0
