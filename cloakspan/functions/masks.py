"""Masks of span texts, and small text helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import COMPANY_FORMS, COMPANY_NOUNS

ALNUM = r"[\p{L}\p{N}]"
WORDS = "[A-Za-zА-Яа-яЁё]+(?:-[A-Za-zА-Яа-яЁё]+)*"


def mask_digits(text: Column, keep: int = 4) -> Column:
    """All digits but the first `keep` become stars."""
    rx = rf"(?s)^((?:\P{{Nd}}*\p{{Nd}}){{0,{keep}}})(.*)$"
    return F.concat(F.regexp_extract(text, rx, 1), F.regexp_replace(F.regexp_extract(text, rx, 2), r"\p{Nd}", "*"))


def mask_person(text: Column) -> Column:
    """Cyrillic letters but the first of each part (parts end at white space and hyphens) become stars."""
    return F.regexp_replace(text, r"(?U)(?<=\p{IsCyrillic}[^\s\x{00a0}\-]{0,64})\p{IsCyrillic}", "*")


def mask_generic(text: Column) -> Column:
    return F.regexp_replace(text, ALNUM, "*")


def mask_email(text: Column) -> Column:
    """The local part keeps its first letter or digit; the domain stays."""
    at = F.instr(text, "@")
    local, domain = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.char_length(text))
    head = F.regexp_extract(local, rf"^[^\p{{L}}\p{{N}}]*{ALNUM}?", 0)
    masked = F.concat(head, mask_generic(F.substring(local, F.char_length(head) + 1, F.char_length(local))), F.lit("@"), domain)
    return F.when(at == 0, mask_generic(text)).when(at == 1, F.when(domain == "", "*").otherwise(F.concat(F.lit("*@"), domain))).otherwise(masked)


def smart_mask(label: Column, text: Column, safe: bool = False) -> Column:
    """The mask of the label; for others, of a person if the text looks like a name, else of all. safe: names in other letters too."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    named = F.size(words).between(1, 3) & F.exists(words, lambda w: w.rlike("^[A-ZА-ЯЁ]"))
    other = mask_generic(text) if safe else F.when(named, mask_person(text)).otherwise(mask_generic(text))
    return (
        F.when(label.isin("PHONE_NUMBER", "CREDIT_CARD"), mask_digits(text, 4)).when(label == "PASSPORT_ID", mask_digits(text, 2))
        .when(label == "PERSON", mask_person(text) if not safe else mask_generic(mask_person(text))).when(label == "EMAIL_ADDRESS", mask_email(text)).otherwise(other)
    )


def one_line(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\n", ", "))
    return F.trim(F.btrim(F.regexp_replace(t, " {2,}", " "), F.lit(", ")))


def first_nonempty(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def stable_company(seed: Column) -> Column:
    """A name that the SHA-256 of the seed picks."""
    digest = F.sha2(F.coalesce(F.nullif(seed, F.lit("")), F.lit("seed")), 256)
    part = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("long")
    pick = lambda names, a: F.element_at(F.array(*map(F.lit, names)), (part(a) % len(names) + 1).cast("int"))
    return F.concat(pick(COMPANY_NOUNS, 1), pick(COMPANY_FORMS, 9))


def flexible_pattern(text: Column) -> Column:
    """A pattern for the text that takes any run of white space for a space."""
    quoted = F.regexp_replace(text, r"([\\\[\](){}.*+?^$|\-&#~])", r"\\$1")
    return F.replace(quoted, F.lit(" "), F.lit(r"[\s\x{00a0}]+"))
