"""Text to spans: recognizers, address expansion and the full detector."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S


@dataclass(frozen=True)
class Recognizer:
    """find: from a text column to its spans. languages: where it is used; none: everywhere."""

    name: str
    label: str
    find: Callable[[Column], Column]
    languages: tuple[str, ...] = ()


def _regex(name: str, label: str, pattern: str, src: int, hint: str | None = None, languages: tuple[str, ...] = ()) -> Recognizer:
    return Recognizer(name, label, lambda text: S.find_spans(text, pattern, label, src, hint), languages)


def header_like(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*P.HEADINGS)


def _fio(text: Column) -> Column:
    return F.filter(S.find_spans(text, P.FIO, "PERSON", 10), lambda s: ~header_like(s["text"]))


def iban_valid(text: Column) -> Column:
    """The ISO 13616 check: letters as numbers from 10 on, the first four characters last, remainder 1 of 97."""
    turned = F.concat(F.substring(text, F.lit(5), F.char_length(text)), F.substring(text, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97)) == 1


def _iban(text: Column) -> Column:
    return F.filter(S.find_spans(text, P.IBAN, "IBAN_CODE", 2), lambda s: iban_valid(s["text"]))


#: In the order in which their spans count, for ties.
BUILT_IN = (
    _regex("ip", "IP_ADDRESS", P.IP, 1, r"\d\.\d"),
    Recognizer("iban", "IBAN_CODE", _iban),
    _regex("ssn", "US_SSN", P.SSN, 3, r"\d-\d"),
    _regex("email", "EMAIL_ADDRESS", P.EMAIL, 4, "@"),
    _regex("phone", "PHONE_NUMBER", P.PHONE, 5, r"\d\d\d"),
    _regex("card", "CREDIT_CARD", P.CARD, 6, r"\d\d\d\d"),
    _regex("passport", "PASSPORT_ID", P.PASSPORT, 7, r"\d\d\d\d\d\d"),
    _regex("surname_initials", "PERSON", P.SURNAME_INITIALS, 8, "[А-ЯЁ]", ("ru",)),
    _regex("initials_surname", "PERSON", P.INITIALS_SURNAME, 9, "[А-ЯЁ]", ("ru",)),
    Recognizer("fio", "PERSON", _fio, ("ru",)),
)
BY_NAME = {r.name: r for r in BUILT_IN}


def resolve_languages(languages: list[str] | None) -> list[str]:
    return [x for x in (y.strip() for y in languages or []) if x in ("ru", "en")] or ["ru"]


def resolve_labels(labels: list[str] | None) -> list[str]:
    """None or none given: all; else those of them that are known, which may be none."""
    return list(P.LABELS) if not labels else [x for x in P.LABELS if x in labels]


def recognize(text: Column, labels: list[str] | None = None, languages: list[str] | None = None, extra: tuple[Recognizer, ...] = ()) -> Column:
    """The spans of all recognizers whose label and language are asked for; the others never enter the plan."""
    wanted, spoken = resolve_labels(labels), resolve_languages(languages)
    used = [r for r in (*extra, *BUILT_IN) if r.label in wanted and (not r.languages or set(r.languages) & set(spoken))]
    return F.concat(*[r.find(text) for r in used]) if used else S.empty()


def expand_address(text: Column, spans: Column) -> Column:
    """ADDRESS and LOCATION spans grown to the last address word on the left and the first sentence end on the right."""
    t, soft = S.text_of(text), r"^[ ,\x{00a0}]+"

    def grown(s: Column) -> Column:
        low = F.greatest(s["start"] - P.LEFT_WINDOW, F.lit(0))
        lefts = S.find_spans(F.substring(t, low + 1, s["start"] - low), P.ADDRESS_LEFT, "", 0)
        rights = S.find_spans(F.substring(t, s["end"] + 1, F.lit(P.RIGHT_WINDOW)), P.ADDRESS_RIGHT, "", 0)
        seen = F.struct((low + F.try_element_at(lefts, F.lit(-1))["start"]).alias("left"), (s["end"] + F.get(rights, F.lit(0))["start"]).alias("right"))
        return S.let(seen, lambda v: S.let(edges(s, v), lambda e: S.let(body(e), lambda x: span(s, e, x))))

    def edges(s: Column, v: Column) -> Column:
        # From the word on the left, spaces and commas are skipped, up to the old begin.
        lead = F.regexp_replace(F.substring(t, v["left"] + 1, s["start"] - v["left"]), soft, "")
        start = F.when(v["left"].isNull(), s["start"]).otherwise(s["start"] - F.char_length(lead))
        return F.struct(start.alias("start"), F.coalesce(v["right"], F.least(F.char_length(t), s["end"] + P.RIGHT_WINDOW)).alias("end"))

    def body(e: Column) -> Column:
        return F.regexp_replace(F.substring(t, e["start"] + 1, e["end"] - e["start"]), r"[ ,\x{00a0}]+\z", "")

    def span(s: Column, e: Column, x: Column) -> Column:
        return S.make_span(e["start"], e["start"] + F.char_length(x), F.lit("ADDRESS"), x, s["src"], s["ord"])

    return F.transform(spans, lambda s: F.when(s["label"].isin("ADDRESS", "LOCATION"), grown(s)).otherwise(s))


def detect(docs: DataFrame, text_col: str = "text", labels: list[str] | None = None, languages: list[str] | None = None, extra: tuple[Recognizer, ...] = (), out: str = "spans") -> DataFrame:
    """docs with the pruned spans of the text. One projection, no shuffle."""
    found = docs.withColumn(out, recognize(F.col(text_col), labels, languages, extra))
    return found.withColumn(out, S.prune_overlaps(expand_address(F.col(text_col), F.col(out))))


def ner_spans(text: Column, results: Column, labels: list[str] | None = None, threshold: float = P.NER_THRESHOLD, compat: bool = False, src: int = 0) -> Column:
    """Spans of a tagger's results, array<struct<raw, score, start, end>>: mapped, filtered and deduplicated."""
    names = P.NER_LABELS if compat else {k: "ORGANIZATION" if v == "ORG" else v for k, v in P.NER_LABELS.items()}
    kept = F.filter(results, lambda r: (r["end"] > r["start"]) & (r["score"] >= threshold))
    spans = F.transform(kept, lambda r, i: S.make_span(r["start"], r["end"], S.alias_labels(r["raw"], names), F.substring(S.text_of(text), r["start"] + 1, r["end"] - r["start"]), F.lit(src), i))
    if labels:
        spans = S.limit_labels(spans, labels)
    return S.prune_overlaps(spans, by_priority=False)


def name_votes(chunk: Column) -> Column:
    """How many words of a chunk are a first name, a patronymic or a surname, by list and endings."""
    words = F.filter(F.split(chunk, rf"(?U){P.LOOSE}+"), lambda w: w != "")
    return F.size(F.filter(words, lambda w: F.lower(w).isin(*P.FIRST_NAMES) | w.rlike(P.PATRONYMIC) | w.rlike(P.SURNAME_END)))


def listed_names(text: Column, src: int = 11) -> Column:
    """Chunks of two or three capitalised words of which two at least pass for names; no headings."""
    return F.filter(S.find_spans(text, P.NAME_CHUNK, "PERSON", src, "[А-ЯЁ]"), lambda s: ~header_like(s["text"]) & (name_votes(s["text"]) >= 2))


#: Names by list, beside those of BUILT_IN: give it to detect() as one of `extra`.
LISTED_NAMES = Recognizer("listed_names", "PERSON", listed_names, ("ru",))


def paragraph_names(text: Column, listed: bool = False) -> Column:
    """Surnames with exactly two initials, either order, and if asked for the names by list; nested ones dropped."""
    found = [S.find_spans(text, p, "PERSON", k, "[А-ЯЁ]") for k, p in enumerate(P.PARAGRAPH_NAMES)]
    return S.dedup_nested(F.concat(*([listed_names(text, -1)] if listed else []), *found))


#: The most terms of a gazetteer that are broadcast.
BROADCAST_TERMS = 1_000_000


def gazetteer(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, src: int = 12) -> DataFrame:
    """Rows id, start, end, label, span: runs of one to `words` words that a table of terms (term, label) lists, case apart.

    Words are runs of letters and digits with single hyphens inside. Terms are broadcast up to a checked number; beyond
    it the same join shuffles. Null texts, terms and ids: no rows, no hits, rows of a null id.
    """
    pattern = r"(?U)[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
    run = lambda own, i, n: F.struct(F.get(own, i)["start"].alias("start"), F.get(own, i + n - 1)["end"].alias("end"), F.lower(F.array_join(F.transform(F.slice(own, i + 1, n), lambda w: w["text"]), " ")).alias("term"))
    runs = lambda own: F.flatten(F.transform(own, lambda _, i: F.array(*[run(own, i, n) for n in range(1, words + 1)])))
    found = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), F.explode(S.let(S.find_spans(F.col(text_col), pattern, "", src), runs)).alias("r")).where("r.end is not null")
    own = terms.where("term is not null").select(F.lower(F.trim("term")).alias("term_"), "label").distinct()
    own = F.broadcast(own) if own.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else own
    met = found.join(own, F.col("r.term") == F.col("term_"))
    return met.select(F.col("id_").alias(id_col), "r.start", "r.end", "label", F.substring("text_", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("span"))
