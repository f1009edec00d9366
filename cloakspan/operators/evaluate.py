"""Gold against predicted spans, as exploded rows with columns doc_id, start, end, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masks as M


def explode_spans(docs: DataFrame, spans: str = "spans", *keep: str) -> DataFrame:
    return docs.select(*keep, F.explode(spans).alias("s")).select(*keep, "s.start", "s.end", "s.label", F.col("s.text").alias("span"))


def characters(rows: DataFrame) -> DataFrame:
    """A row for each character of each span: start and end are its place and the next."""
    return rows.where("end > start").withColumn("start", F.explode(F.sequence("start", F.col("end") - 1))).withColumn("end", F.col("start") + 1)


def _matched(rows: DataFrame, by: list[str], on: list[str]) -> DataFrame:
    """by, tp, fp, fn of rows with t and p (whether gold or predicted): multiset match on the keys, in one aggregate."""
    both = rows.groupBy(*dict.fromkeys([*by, *on])).agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    m = F.least("t", "p")
    return both.groupBy(*by).agg(F.sum(m).alias("tp"), F.sum(F.col("p") - m).alias("fp"), F.sum(F.col("t") - m).alias("fn"))


def _sides(gold: DataFrame, pred: DataFrame, labels: list[str] | None, cols: list[str]) -> DataFrame:
    side = lambda rows, t: (rows.where(F.col("label").isin(labels)) if labels else rows).select(*cols, F.lit(t).cast("long").alias("t"), F.lit(1 - t).cast("long").alias("p"))
    return side(gold, 1).unionByName(side(pred, 0))


def _all_labels(counts: DataFrame, labels: list[str] | None, *levels: str) -> DataFrame:
    """counts with a row of zeros for each label, and level if there are some, that isn't met."""
    if not labels:
        return counts
    spark = counts.sparkSession
    known = spark.createDataFrame([(x, v) for x in labels for v in levels], "label string, level string") if levels else spark.createDataFrame([(x,) for x in labels], "label string")
    return F.broadcast(known).join(counts, known.columns, "left").fillna(0, ["tp", "fp", "fn"])


def match_counts(gold: DataFrame, pred: DataFrame, labels: list[str] | None = None, keys: tuple[str, ...] = ("doc_id", "start", "end")) -> DataFrame:
    """label, tp, fp, fn by multiset match on the keys and the label. labels: these alone, those not met with zeros."""
    return _all_labels(_matched(_sides(gold, pred, labels, [*keys, "label"]), ["label"], [*keys, "label"]), labels)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and accuracy beside tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp, tp + fp + fn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _scored(counts: DataFrame, levels: list[str]) -> DataFrame:
    """scores() of counts by level and label, in one aggregate: each row counts for its class, for micro and for macro."""
    own = with_scores(counts).withColumn("scope", F.explode(F.array(*map(F.lit, ("class", "micro", "macro")))))
    sums, shares = ("tp", "fp", "fn"), ("precision", "recall", "f1", "accuracy")
    # Where there are no labels at all, the sums are there nonetheless.
    none = counts.sparkSession.createDataFrame([(v, x) for v in levels for x in ("micro", "macro")], "level string, scope string")
    own = own.unionByName(none, allowMissingColumns=True)
    label = F.when(F.col("scope") == "class", F.col("label")).otherwise("").alias("label")
    total = own.groupBy("level", "scope", label).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in shares])
    total = with_scores(total)
    macro = F.col("scope") == "macro"
    return total.select("level", "scope", "label", *[F.when(macro, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in sums], *[F.when(macro, F.col(f"mean_{c}")).otherwise(F.col(c)).alias(c) for c in shares])


def scores(counts: DataFrame, level: str = "span") -> DataFrame:
    """level, scope (class, micro, macro), label, tp, fp, fn, precision, recall, f1, accuracy."""
    return _scored(counts.withColumn("level", F.lit(level)), [level])


def classification(gold: DataFrame, pred: DataFrame, labels: list[str] | None = None, doc: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scores by span and by character; gold and pred are read once."""
    rows = _sides(gold, pred, labels, [*doc, "start", "end", "label"])
    place = lambda level, low, high: F.struct(F.lit(level).alias("level"), low.cast("int").alias("start"), high.cast("int").alias("end"))
    each = F.when(F.col("end") > F.col("start"), F.transform(F.sequence("start", F.col("end") - 1), lambda k: place("char", k, k + 1))).otherwise(F.array().cast("array<struct<level:string,start:int,end:int>>"))
    rows = rows.select(*doc, "label", "t", "p", F.explode(F.concat(F.array(place("span", F.col("start"), F.col("end"))), each)).alias("x")).select(*doc, "label", "t", "p", "x.*")
    counts = _matched(rows, ["level", "label"], [*doc, "start", "end"])
    return _scored(_all_labels(counts, labels, "span", "char"), ["span", "char"])


def set_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: n_gold, n_pred, n_both over distinct spans, and precision, recall, f1."""
    cols = ["doc_id", "start", "end", "label"]
    g, p = gold.select(cols).distinct().withColumn("g", F.lit(1)), pred.select(cols).distinct().withColumn("p", F.lit(1))
    n = g.join(p, cols, "full").agg(F.count("g").alias("n_gold"), F.count("p").alias("n_pred"), F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("n_both"))
    n = n.withColumns({"precision": ratio(F.col("n_both"), F.col("n_pred")), "recall": ratio(F.col("n_both"), F.col("n_gold"))})
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def leakage(gold: DataFrame, redacted: DataFrame) -> DataFrame:
    """One row: leaked, total_true, pii_leakage: gold spans (doc_id, span) whose text still stands in the redacted text (doc_id, redacted).

    A space of the span's text stands for any run of white space; other characters stand for themselves.
    """
    rows = gold.where("span <> ''").join(redacted, "doc_id").select(F.regexp_like(F.col("redacted"), M.flexible_pattern(F.col("span"))).alias("leaked"))
    out = rows.agg(F.coalesce(F.sum(F.col("leaked").cast("long")), F.lit(0)).alias("leaked"), F.count("*").alias("total_true"))
    return out.withColumn("pii_leakage", ratio(F.col("leaked"), F.col("total_true")))


def redaction_metrics(gold: DataFrame, pred: DataFrame, redacted: DataFrame) -> DataFrame:
    """One row: leakage() and tp, fp, over_redaction: the share of what was predicted that no gold span matches."""
    over = match_counts(gold, pred).agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"))
    both = leakage(gold, redacted).unionByName(over, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("over_redaction", ratio(F.col("fp"), F.col("tp") + F.col("fp")))


def report(scored: DataFrame) -> DataFrame:
    """Lines of text, percentages with one decimal."""
    pct = lambda c: F.format_string("%5.1f", F.col(c) * 100)
    return scored.select("level", "scope", "label", F.concat_ws(" ", pct("precision"), pct("recall"), pct("f1"), pct("accuracy")).alias("line"))
