"""License scan by diagonal voting.

Every rolling word k-gram of every text is hashed and joined to the positions of the same gram in the licence
templates. A hit votes for the diagonal (word place in the text less place in the template). Votes are summed by
diagonal, neighbouring diagonals are merged (an inserted or lost word moves the diagonal by one), and a span counts
once enough of the template's grams, compared word for word, lie on it. All steps are DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import alnum_words

PHRASE_K, BODY_K = 2, 4


@dataclass(frozen=True)
class Template:
    """kind: "base" and "phrase" must be met in full, word after word; a "body" may have changes."""

    label: str
    kind: str
    text: str

    @property
    def grams(self) -> list[str]:
        words, k = self.text.split(), BODY_K if self.kind == "body" else PHRASE_K
        return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


#: The phrases and labels that the contract names, then short names and notices of public licences.
TEMPLATES = (
    Template("gpl", "base", "gnu general public license"),
    Template("apache", "base", "apache license"),
    Template("cc-by", "base", "cc by"),
    Template("mit", "base", "mit license"),
    Template("cc-by-nc", "phrase", "cc by nc"),
    Template("cc-by-nd", "phrase", "cc by nd"),
    Template("cc-by-sa", "phrase", "cc by sa"),
    Template("lgpl", "phrase", "gnu lesser general public license"),
    Template("agpl", "phrase", "gnu affero general public license"),
    Template("bsd", "phrase", "bsd license"),
    Template("mpl", "phrase", "mozilla public license"),
    Template("all-rights-reserved", "phrase", "all rights reserved"),
    Template("mit", "body", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "body", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("apache", "body", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "body", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("cc-by", "body", "this work is licensed under a creative commons attribution international license"),
)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, min_coverage: float = 0.6, max_shift: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (label, kind, start, end, coverage) with word places, end exclusive; score: the largest coverage
    of any span that counts, 0 without one. A body span counts from `min_coverage` of its template's grams on
    diagonals whose neighbours differ by `max_shift` at most.
    Null or empty text: a row with 0 words and no labels. Repeated rows and ids, null ids included: a row each.
    Empty table: no rows. Other columns are ignored. Texts of any length are read whole.
    The templates are a fixed argument of a few hundred grams; they alone are broadcast.
    """
    spark = docs.sparkSession
    rows = [(t, int(x.kind == "body"), p, g, len(x.grams), x.kind, x.label) for t, x in enumerate(templates) for p, g in enumerate(x.grams)]
    if len(rows) > 20_000:
        raise ValueError("more than 20,000 template grams; pass the templates in several calls")
    known = spark.createDataFrame(rows, "tpl int, body int, at int, tgram string, need int, kind string, label string")
    rolled = lambda hashes, i, k: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
    own = known.withColumn("h", F.transform(F.split("tgram", " "), lambda w: F.xxhash64(w)))
    hashed = own.select("body", F.get("h", F.lit(0)).alias("first"), F.when(F.col("body") == 1, rolled("h", F.lit(0), BODY_K)).otherwise(rolled("h", F.lit(0), PHRASE_K)).alias("whole")).collect()
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), alnum_words(F.col(text_col)).alias("words"))
    texts = texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))

    def grams(body: int, k: int) -> Column:
        """(place, gram, body) of the k-grams whose rolling hash is a template's (its first word looked at ahead); the join below takes only these on."""
        firsts, wholes = sorted({r.first for r in hashed if r.body == body}), sorted({r.whole for r in hashed if r.body == body})
        if not firsts:
            return F.array().cast("array<struct<place:int,gram:string,is_body:int>>")
        found = lambda i: F.struct(i.alias("place"), F.array_join(F.slice("words", i + 1, k), " ").alias("gram"), F.lit(body).alias("is_body"))
        near = F.transform("hashes", lambda h, i: F.when(h.isin(firsts), F.when(rolled("hashes", i, k).isin(wholes), found(i))))
        return F.array_compact(near)

    texts = texts.select("rid", "id", F.size("words").cast("long").alias("n"), F.concat(grams(0, PHRASE_K), grams(1, BODY_K)).alias("grams"))
    placed = texts.select("rid", "id", "n", F.explode_outer("grams").alias("g")).select("rid", "id", "n", "g.*")
    hits = placed.join(F.broadcast(known), (F.col("gram") == F.col("tgram")) & (F.col("is_body") == F.col("body")), "left")
    votes = hits.groupBy("rid", "id", "n", "tpl", "need", "kind", "label", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))

    by_text = Window.partitionBy("rid", "tpl").orderBy("diagonal")
    apart = F.coalesce((F.col("kind") != "body") | (F.col("diagonal") - F.lag("diagonal").over(by_text) > max_shift), F.lit(True))
    runs = votes.withColumn("run", F.sum(apart.cast("int")).over(by_text))
    spans = runs.groupBy("rid", "id", "n", "tpl", "need", "kind", "label", "run").agg(
        F.min(F.col("diagonal") + F.array_min("ats")).alias("start"), F.max(F.col("diagonal") + F.array_max("ats")).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("met")
    )
    spans = spans.withColumn("coverage", F.col("met") / F.col("need"))
    width = F.when(F.col("kind") == "body", BODY_K).otherwise(PHRASE_K)
    # The whole of a phrase, or enough of a body within a stretch not longer than half as long again.
    fine = F.when(F.col("kind") == "body", (F.col("coverage") >= min_coverage) & (F.col("last") - F.col("start") < 1.5 * F.col("need"))).otherwise(F.col("met") == F.col("need"))
    spans = spans.withColumn("fine", F.coalesce(fine, F.lit(False)))
    base = F.col("fine") & (F.col("kind") == "base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("rid", "id").agg(
        F.max("n").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"), F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("fine")).alias("labels"), F.coalesce(F.max(F.when(F.col("fine"), F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("fine"), F.struct("label", "kind", "start", (F.col("last") + width).alias("end"), "coverage")))).alias("spans"),
    )
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def oracle(templates: tuple[Template, ...] = TEMPLATES, min_coverage: float = 0.6, max_shift: int = 3) -> str:
    """DuckDB's form of op1: word places unnested, joined to the templates, summed by diagonal."""
    values = ",".join(f"({t},{BODY_K if x.kind == 'body' else PHRASE_K},{p},'{g}',{len(x.grams)},'{x.kind}','{x.label}')" for t, x in enumerate(templates) for p, g in enumerate(x.grams))
    return rf"""
WITH tp(tpl, k, tpos, gram, need, kind, label) AS (VALUES {values}),
w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS ws FROM documents),
p AS (SELECT rid, ws, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT rid, i, 2 AS k, array_to_string(ws[i + 1:i + 2], ' ') AS gram FROM p UNION ALL SELECT rid, i, 4, array_to_string(ws[i + 1:i + 4], ' ') FROM p),
v AS (SELECT rid, tpl, need, kind, label, i - tpos AS diagonal, list(DISTINCT tpos) AS ats FROM g JOIN tp USING (k, gram) GROUP BY ALL),
m AS (SELECT *, CASE WHEN kind <> 'body' OR diagonal - lag(diagonal) OVER (PARTITION BY rid, tpl ORDER BY diagonal) <= {max_shift} IS NOT TRUE THEN 1 ELSE 0 END AS apart FROM v),
r AS (SELECT *, sum(apart) OVER (PARTITION BY rid, tpl ORDER BY diagonal) AS run FROM m),
s AS (SELECT rid, tpl, need, kind, label, run, min(diagonal + list_min(ats)) AS first, max(diagonal + list_max(ats)) AS last, len(list_distinct(flatten(list(ats)))) AS met FROM r GROUP BY ALL),
f AS (SELECT *, met / need AS coverage, CASE WHEN kind = 'body' THEN met / need >= {min_coverage} AND last - first < 1.5 * need ELSE met = need END AS fine FROM s),
a AS (SELECT rid, count(*) FILTER (kind = 'base') AS n_base, min(first) FILTER (kind = 'base') AS first_word, max(first) FILTER (kind = 'base') AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM f WHERE fine GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN a USING (rid)"""


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
