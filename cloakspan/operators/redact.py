"""Spans to redacted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import patterns as P
from ..functions import spans as S
from .detect import paragraph_names

POLICIES = ("mask", "remove")
#: The seven document properties that are blanked.
PROPERTIES = ("author", "title", "subject", "keywords", "comments", "category", "last_modified_by")


def check_policy(policy: str) -> str:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    return policy


def replacement(policy: str, safe: bool = False):  # noqa: ANN201
    """From label and text to what stands for it."""
    return (lambda label, text: M.smart_mask(label, text, safe)) if check_policy(policy) == "mask" else (lambda label, text: F.lit(""))


def apply_policy(text: Column, spans: Column, policy: str, safe: bool = False) -> Column:
    return S.splice(text, spans, replacement(policy, safe))


def replace_by_value(text: Column, spans: Column, policy: str) -> Column:
    """struct<text, n>: every occurrence of each span's text is replaced, wherever it stands, and counted."""
    make = replacement(policy)

    def step(acc: Column, s: Column) -> Column:
        rx = M.flexible_pattern(s["text"])
        n = F.regexp_count(acc["text"], rx)
        quoted = F.regexp_replace(make(s["label"], s["text"]), r"([\\$])", r"\\$1")
        return F.when(s["text"] == "", acc).otherwise(F.struct(F.regexp_replace(acc["text"], rx, quoted).alias("text"), (acc["n"] + n).alias("n")))

    return F.aggregate(spans, F.struct(S.text_of(text).alias("text"), F.lit(0).alias("n")), step)


def mask_paragraph_names(text: Column) -> Column:
    """Each paragraph with its names masked; the rest stays."""
    parts = F.transform(F.split(S.text_of(text), "\n", -1), lambda p: S.splice(p, paragraph_names(p), lambda label, t: M.mask_person(t)))
    return F.array_join(parts, "\n")


def strip_comments(html: Column) -> Column:
    """Comments and deleted parts taken out."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->|<del\b[^>]*>.*?</del>", "")


def hyperlink_emails(html: Column) -> Column:
    """The first e-mail of each link target, distinct, sorted, one a line."""
    targets = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(targets, lambda t: F.regexp_extract(t, P.EMAIL, 0)), lambda e: e != ""))), "\n")


def sanitize_mailto(html: Column, policy: str = "mask") -> Column:
    """mailto: targets masked (policy mask) or unlinked (remove)."""
    t = F.coalesce(html, F.lit(""))
    found = S.find_spans(t, r'"mailto:[^"]+"', "EMAIL_ADDRESS", 0, "mailto:")
    address = lambda x: F.substring(x, F.lit(9), F.char_length(x) - 9)
    masked = lambda label, x: F.when(~address(x).rlike(P.EMAIL), x).otherwise(F.concat(F.lit('"mailto:'), M.mask_email(address(x)), F.lit('"')) if check_policy(policy) == "mask" else F.lit('"#"'))
    return S.splice(t, found, masked)


def _masked_emails(text: Column) -> Column:
    return S.replace_matches(text, P.EMAIL, M.mask_email)


def sanitize_links(html: Column, policy: str = "mask") -> Column:
    """struct<html, n>: sanitize_mailto, and e-mails masked in what links show; n: how many targets, fields and shown texts changed.

    Targets and HYPERLINK fields hold "mailto:..." in quotes. What a link shows stands between <a ...> and </a>. An
    e-mail that is masked already stays, and isn't counted.
    """
    check_policy(policy)
    t = F.coalesce(html, F.lit(""))
    link = r"(?is)<a\b[^>]*>.*?</a>"
    shown = lambda x: F.regexp_extract(x, r"(?is)^<a\b[^>]*>(.*)</a>$", 1)
    tag = lambda x: F.regexp_extract(x, r"(?is)^(<a\b[^>]*>)", 1)
    new = lambda x: F.when(shown(x).rlike(P.EMAIL), F.concat(tag(x), _masked_emails(shown(x)), F.substring(x, -4, 4))).otherwise(x)
    links = S.replace_matches(t, link, new)
    targets = F.regexp_extract_all(t, F.lit(r'"mailto:([^"]+)"'), F.lit(1))
    changed = F.size(F.filter(targets, lambda a: a.rlike(P.EMAIL) & ((F.lit(policy) == "remove") | (M.mask_email(a) != a))))
    texts = F.size(F.filter(F.regexp_extract_all(t, F.lit(link), F.lit(0)), lambda x: shown(x).rlike(P.EMAIL) & (_masked_emails(shown(x)) != shown(x))))
    return F.struct(sanitize_mailto(links, policy).alias("html"), (changed + texts).alias("n"))


def scrub_properties(docs: DataFrame, names: tuple[str, ...] = PROPERTIES) -> DataFrame:
    return docs.withColumns({c: F.lit("") for c in names if c in docs.columns})


def by_section(sections: DataFrame, spans: DataFrame, policy: str, doc: str = "doc_id") -> DataFrame:
    """Sections (doc, section, text) with the spans (doc, spans) of their document replaced by value, and the sum of replacements of each document."""
    out = sections.join(spans, doc).withColumn("x", replace_by_value(F.col("text"), F.col("spans"), policy))
    return out.groupBy(doc).agg(F.sum("x.n").alias("found"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", F.col("x.text").alias("text")))), lambda s: s["text"]), "\n").alias("text"))
