"""Spans of a text column: array<struct<start, end, label, text, src, ord>>, half-open offsets in code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import PRIORITY

SPAN = "struct<start:int,end:int,label:string,text:string,src:int,ord:int>"
NONE = f"array<{SPAN}>"


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def empty() -> Column:
    return F.array().cast(NONE)


def make_span(start: Column, end: Column, label: Column, text: Column, src: Column, ord_: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"), text.alias("text"), src.cast("int").alias("src"), ord_.cast("int").alias("ord"))


#: Elements that a fold looks at before it moves on to the next block.
BLOCK = 64


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with the value made once: the planner would copy it into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(array: Column) -> Column:
    return F.sequence(F.lit(0), F.floor(F.size(array) / BLOCK).cast("int"))


def find_spans(text: Column, pattern: str, label: str, src: int, hint: str | None = None) -> Column:
    """All matches of a pattern that never matches nothing. hint: a cheaper pattern that every match contains.

    A match's offset is the sum of the lengths of the gaps up to it and of the matches before it. The sums are taken up
    to each block of matches, and within the block, so that no list grows match by match.
    """
    t = text_of(text)

    def placed(x: Column) -> Column:
        lengths = F.transform(x["m"], lambda m, i: F.char_length(m) + F.char_length(F.get(x["g"], i)))
        return let(lengths, lambda own: let(heads(own), lambda head: spans(x, own, head)))

    def total(own: Column, begin: Column, n: Column) -> Column:
        return F.aggregate(F.slice(own, begin + 1, n), F.lit(0), lambda acc, v: acc + v)

    def heads(own: Column) -> Column:
        """The length of all before each block."""
        add = lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + total(own, k * BLOCK, F.lit(BLOCK))))
        return F.aggregate(_blocks(own), F.array(F.lit(0)), add)

    def spans(x: Column, own: Column, head: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(head, block) + total(own, block * BLOCK, i % BLOCK) + F.char_length(F.get(x["g"], i))
            return let(start, lambda at: make_span(at, at + F.char_length(m), F.lit(label), m, F.lit(src), i))

        return F.transform(x["m"], one)

    both = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("g"))
    return F.when(t.rlike(hint or pattern), let(both, placed)).otherwise(empty())


def priority(label: Column) -> Column:
    return reduce(lambda c, kv: c.when(label == kv[0], kv[1]), PRIORITY.items(), F.when(F.lit(False), 0)).otherwise(0)


def _ordered(spans: Column, *keys) -> Column:  # noqa: ANN002
    """spans sorted by the keys of each, ties by recognizer and order."""
    keyed = F.transform(spans, lambda s: F.struct(*[k(s).alias(f"k{i}") for i, k in enumerate(keys)], s["src"].alias("ks"), s["ord"].alias("ko"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def _fold(spans: Column, keep) -> Column:  # noqa: ANN001
    """The spans that are kept: the first, and each for which keep(last kept, span) holds. Block by block, see find_spans."""

    def folded(own: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            new = F.struct(s.alias("last"), F.concat(acc["out"], F.array(s)).alias("out"))
            return F.when(acc["last"].isNull() | keep(acc["last"], s), new).otherwise(acc)

        def block(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(own, k * BLOCK + 1, BLOCK), F.struct(acc["last"].alias("last"), empty().alias("out")), step)
            return let(inner, lambda x: F.struct(x["last"].alias("last"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        start = F.struct(F.lit(None).cast(SPAN).alias("last"), F.array().cast(f"array<{NONE}>").alias("out"))
        return F.aggregate(_blocks(own), start, block, lambda acc: F.flatten(acc["out"]))

    return let(spans, folded)


def prune_overlaps(spans: Column, by_priority: bool = True) -> Column:
    """Left to right, of those that begin together the longest (then the most important), each that begins at or after the end of the last kept."""
    keys = [lambda s: s["start"], lambda s: s["start"] - s["end"], *([lambda s: -priority(s["label"])] if by_priority else [])]
    return _fold(_ordered(spans, *keys), lambda last, s: s["start"] >= last["end"])


def dedup_nested(spans: Column) -> Column:
    """By begin, shorter first, each that doesn't lie within the last kept."""
    return _fold(_ordered(spans, lambda s: s["start"], lambda s: s["end"]), lambda last, s: ~((s["start"] >= last["start"]) & (s["end"] <= last["end"])))


def limit_labels(spans: Column, labels: list[str]) -> Column:
    return F.filter(spans, lambda s: s["label"].isin(labels)) if labels else empty()


def alias_labels(label: Column, names: dict[str, str], keep_unknown: bool = True) -> Column:
    known = reduce(lambda c, kv: c.when(label == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    return known.otherwise(label) if keep_unknown else known


def splice(text: Column, spans: Column, replacement) -> Column:  # noqa: ANN001
    """text with each span put through replacement(label, text); spans that begin before the end of the last are skipped."""
    t = text_of(text)
    kept = _fold(_ordered(spans, lambda s: s["start"]), lambda last, s: s["start"] >= last["end"])

    def joined(own: Column) -> Column:
        after = lambda i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        pieces = F.transform(own, lambda s, i: F.concat(F.substring(t, after(i) + 1, s["start"] - after(i)), replacement(s["label"], s["text"])))
        return F.concat(F.array_join(pieces, ""), F.substring(t, after(F.size(own)) + 1, F.char_length(t)))

    return F.when(F.size(spans) > 0, let(kept, joined)).otherwise(t)


def replace_matches(text: Column, pattern: str, make) -> Column:  # noqa: ANN001
    """text with each match of the pattern put through make(match)."""
    gaps = F.split(text, pattern, -1)
    pieces = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.concat(F.get(gaps, i), make(m)))
    return F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))
