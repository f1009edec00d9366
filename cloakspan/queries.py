"""The queries of the library's own operators and their SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions import masks as M
from .functions import patterns as P
from .functions import spans as S
from .operators import corpus as C
from .operators import detect as D
from .operators import evaluate as E
from .operators import redact as R
from .operators import tagger as G
from .plans.jobs import RedactJob, evaluate_concatenated
from .sources import text as T
from .sources.people import CITIES, pick, select_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder of its own under spark.checkpoint.dir, which all executors see; a temporary one where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='cloakspan-')).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def russian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic Russian texts, one for each customer: much work for few bytes, so the keys alone are dealt to all cores."""
    customers = table(spark, sf_dir, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(select_sql("{customers}", "c_custkey"), customers=customers)


def flat(docs: DataFrame, spans: Column, *keep: str) -> DataFrame:
    keep = keep or ("doc_id",)
    return docs.select(*keep, F.explode_outer(spans).alias("s")).where("s is not null").select(*keep, "s.start", "s.end", "s.label", F.col("s.text").alias("span"))


SHOWN = 'SELECT doc_id, start, "end", label, span FROM ({})'
RU = f"({O.RU})"

# Recognizers, one by one.
for _name, _source, _docs in (("email", "documents", None), ("card", "documents", None), ("ip", "documents", None), ("ssn", RU, russian), ("iban", RU, russian), ("phone", RU, russian), ("passport", RU, russian), ("surname_initials", RU, russian), ("initials_surname", RU, russian), ("fio", RU, russian)):

    @query(f"spans_{_name}", SHOWN.format(O.recognized(_source, _name)))
    def _spans(spark: SparkSession, sf_dir: str, name: str = _name, docs: Query | None = _docs) -> DataFrame:
        rows = docs(spark, sf_dir) if docs else table(spark, sf_dir, "documents")
        return flat(rows, D.BY_NAME[name].find(F.col("text")))


@query("header_like", f"SELECT doc_id, lower(trim(w)) IN ({', '.join(map(repr, P.HEADINGS))}) AS header FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS w FROM {RU})")
def header_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return russian(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("w")).select("doc_id", D.header_like(F.col("w")).alias("header"))


# Span transforms.
@query("label_limit", SHOWN.format(O.recognized(RU)) + " WHERE label IN ('EMAIL_ADDRESS', 'PASSPORT_ID')")
def label_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(russian(spark, sf_dir), D.recognize(F.col("text"), ["EMAIL_ADDRESS", "PASSPORT_ID", "NO_SUCH"]))


_CITY = "|".join(CITIES)
_LOW = "greatest(start - 32, 0)"
_KEY = O.SPACE[:-1] + ",]"
_EXPANDED = rf"""WITH loc AS ({O.matches(RU, _CITY, "LOCATION", 0, keep="doc_id, text")}),
w AS (SELECT *, substr(text, {_LOW} + 1, start - {_LOW}) AS lw, substr(text, "end" + 1, 256) AS rw FROM loc),
h AS (SELECT *, regexp_extract_all(lw, '(?i)(?:^|{_KEY})(?:{P.ADDRESS_KEYS})\.?(?:{O.SPACE}|$)') AS lm, string_split_regex(lw, '(?i)(?:^|{_KEY})(?:{P.ADDRESS_KEYS})\.?(?:{O.SPACE}|$)') AS lg, regexp_extract_all(rw, '[.;!?](?:{O.SPACE}+[A-ZА-ЯЁpLu{{}}]|$)|\n') AS rm, string_split_regex(rw, '[.;!?](?:{O.SPACE}+[A-ZА-ЯЁpLu{{}}]|$)|\n') AS rg FROM w),
b AS (SELECT *, CASE WHEN len(lm) = 0 THEN start ELSE {_LOW} + length(lw) - length(lg[-1]) - length(lm[-1]) END AS s0, CASE WHEN len(rm) = 0 THEN least(length(text), "end" + 256) ELSE "end" + length(rg[1]) END AS e0 FROM h),
c AS (SELECT *, s0 + length(regexp_extract(substr(text, s0 + 1, start - s0), '^[ ,\x{{00a0}}]+')) AS s1 FROM b),
d AS (SELECT *, regexp_replace(substr(text, s1 + 1, e0 - s1), '[ ,\x{{00a0}}]+\z', '') AS body FROM c)
SELECT doc_id, s1::INTEGER AS start, (s1 + length(body))::INTEGER AS "end", 'ADDRESS' AS label, body AS span FROM d"""


@query("expand_address", _EXPANDED)
def expand_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = russian(spark, sf_dir)
    return flat(docs, D.expand_address(F.col("text"), S.find_spans(F.col("text"), _CITY, "LOCATION", 0)))


@query("prune_overlaps", SHOWN.format(O.pruned(O.recognized(RU))))
def prune_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(russian(spark, sf_dir), S.prune_overlaps(D.recognize(F.col("text"))))


# Written from the rule: two Cyrillic initials with points, white space or characters without width between, beside a surname.
_GAP = r"[\s\x{00a0}\x{200b}\x{200c}\x{200d}\x{feff}\x{00ad}]"
_TWO = rf"[А-ЯЁ]\.{_GAP}*[А-ЯЁ]\."
_PAIR = (rf"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?{_GAP}*{_TWO}", rf"{_TWO}{_GAP}*[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?")
_PAIRS = " UNION ALL ".join(f"({O.matches(RU, p, 'PERSON', k)})" for k, p in enumerate(_PAIR))


@query("dedup_nested", SHOWN.format(O.nested(_PAIRS)))
def dedup_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(russian(spark, sf_dir), D.paragraph_names(F.col("text")))


_RAW = pick(("B-PER", "LOC", "I-ORG", "MISC", "PER"), "event_id")
_NER = f"""SELECT user_id AS doc_id, event_id AS ord, {_RAW} AS raw, (event_id % 10) / 10.0 AS score, CAST(event_id * 7 % 60 AS INTEGER) AS start, CAST(event_id * 7 % 60 + event_id % 9 AS INTEGER) AS "end" FROM events"""
_MAPPED = f"""SELECT doc_id, start, "end", CASE raw WHEN 'B-PER' THEN 'PERSON' WHEN 'PER' THEN 'PERSON' WHEN 'LOC' THEN 'ADDRESS' WHEN 'I-ORG' THEN 'ORGANIZATION' ELSE raw END AS label, '' AS span, 0 AS src, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS ord FROM ({_NER}) WHERE "end" > start AND score >= 0.7"""


@query("ner_postprocess", 'SELECT doc_id, start, "end", label FROM (' + O.folded(_MAPPED, 'start, start - "end", src, ord', "v.start >= a.e") + ")")
def ner_postprocess(spark: SparkSession, sf_dir: str, labels: list[str] | None = None) -> DataFrame:
    """A tagger's results made from events, by user."""
    rows = spark.sql(_NER.replace('"end"', "`end`").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    docs = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "raw", "score", "start", "end"))), lambda r: F.struct(r["raw"].alias("raw"), r["score"].alias("score"), r["start"].alias("start"), r["end"].alias("end"))).alias("results"))
    return flat(docs, D.ner_spans(F.lit(""), F.col("results"), labels)).drop("span")


@query("ner_limit", 'SELECT doc_id, start, "end", label FROM (' + O.folded(f"SELECT * FROM ({_MAPPED}) WHERE label IN ('PERSON', 'ADDRESS')", 'start, start - "end", src, ord', "v.start >= a.e") + ")")
def ner_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner_postprocess(spark, sf_dir, ["PERSON", "ADDRESS"])


def _capitals() -> G.Model:
    """A model for the test of the plug-in: each capitalised Cyrillic word is a person, surer the longer it is."""
    word = re.compile("[А-ЯЁ][а-яё]+")
    return lambda texts: [[("B-PER", len(m[0]) % 8 / 8 + 0.1, *m.span()) for m in word.finditer(t)] for t in texts]


_TAGGED = f"SELECT * REPLACE (0 AS src) FROM ({O.matches(RU, '[А-ЯЁ][а-яё]+', 'PERSON')}) WHERE length(span) % 8 / 8 + 0.1 >= 0.7"


@query("ner_plugin", SHOWN.format(O.folded(_TAGGED, 'start, start - "end", src, ord', "v.start >= a.e")))
def ner_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = russian(spark, sf_dir).withColumn("results", G.tag(F.col("text"), _capitals))
    return flat(docs, D.ner_spans(F.col("text"), F.col("results")))


_TERMS = [*((x, "LOCATION") for x in CITIES), ("Ленина", "LOCATION"), ("Список Литературы", "ORGANIZATION"), ("ул", "NRP"), ("Меня зовут", "NRP")]
_WORDS = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
_LISTED = " UNION ALL ".join(f"SELECT {x.lower()!r} AS term, {label!r} AS label" for x, label in _TERMS)


@query("gazetteer", f"""WITH w AS ({O.matches(RU, _WORDS)}), n AS (SELECT doc_id, start, "end", lower(span) AS term FROM w UNION ALL SELECT a.doc_id, a.start, b."end", lower(a.span) || ' ' || lower(b.span) FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1)
SELECT n.doc_id, start, "end", label, substr(text, start + 1, "end" - start) AS span FROM n JOIN ({_LISTED}) t USING (term) JOIN {RU} d USING (doc_id)""")
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.gazetteer(russian(spark, sf_dir), spark.createDataFrame(_TERMS, "term string, label string"))


_CHUNK = rf"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?(?:[ \x{{00a0}}]+[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?){{1,2}}"
_VOTE = f"lower(w) IN ({', '.join(map(repr, P.FIRST_NAMES))}) OR regexp_matches(lower(w), '(?:ович|евич|ич|овна|евна|ична|ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|енко)$')"


@query("listed_names", SHOWN.format(O.matches(RU, _CHUNK, "PERSON")) + rf" WHERE lower(trim(span)) NOT IN ({', '.join(map(repr, P.HEADINGS))}) AND len(list_filter(string_split_regex(span, '[\s\x{{00a0}}]+'), lambda w: {_VOTE})) >= 2")
def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(russian(spark, sf_dir), D.listed_names(F.col("text")))


# The full detector and redaction.
_ALL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM {RU})"


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = russian(spark, sf_dir).select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(own)


@query("detect_all", SHOWN.format(O.pruned(O.recognized(_ALL))))
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(D.detect(everything(spark, sf_dir)), F.col("spans"))


def _redacted(docs: DataFrame, policy: str) -> DataFrame:
    found = D.detect(docs)
    return found.select("doc_id", F.size("spans").alias("n_spans"), R.apply_policy(F.col("text"), F.col("spans"), policy).alias("redacted"))


for _where, _source in (("documents", "documents"), ("russian", RU)):
    for _policy in R.POLICIES:

        @query(f"redact_{_policy}_{_where}", O.spliced(_source, O.pruned(O.recognized(_source)), O.smart_mask("label", "span") if _policy == "mask" else "''"))
        def _redact(spark: SparkSession, sf_dir: str, policy: str = _policy, own: bool = _where == "documents") -> DataFrame:
            return _redacted(table(spark, sf_dir, "documents") if own else russian(spark, sf_dir), policy)


_MASKS = {
    "phone": ("phone", lambda t: M.mask_digits(t, 4), O.mask_digits("phone", 4)), "card": ("bank", lambda t: M.mask_digits(t, 4), O.mask_digits("bank", 4)), "passport": ("passport_id", lambda t: M.mask_digits(t, 2), O.mask_digits("passport_id", 2)),
    "person": ("full_name", M.mask_person, O.mask_person("full_name")), "email": ("email", M.mask_email, O.mask_email("email")), "generic": ("address", M.mask_generic, O.mask_generic("address")),
}
for _name, (_field, _mask, _sql) in _MASKS.items():

    @query(f"mask_{_name}", f"SELECT doc_id, {_sql} AS masked FROM {RU}")
    def _masked(spark: SparkSession, sf_dir: str, field: str = _field, mask: Callable = _mask) -> DataFrame:
        return russian(spark, sf_dir).select("doc_id", mask(F.col(field)).alias("masked"))


_KINDS = {"PHONE_NUMBER": "phone", "CREDIT_CARD": "bank", "PASSPORT_ID": "passport_id", "PERSON": "full_name", "EMAIL_ADDRESS": "email", "IP_ADDRESS": "ip", "ADDRESS": "address", "ORGANIZATION": "surname"}
_EACH = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, {c} AS t FROM ru" for k, c in _KINDS.items())


@query("mask_smart", f"WITH ru AS {RU} SELECT doc_id, label, {O.smart_mask('label', 't')} AS masked FROM ({_EACH})")
def mask_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).alias("t")) for k, c in _KINDS.items()]))
    return russian(spark, sf_dir).select("doc_id", pairs.alias("p")).select("doc_id", "p.label", M.smart_mask(F.col("p.label"), F.col("p.t")).alias("masked"))


@query("replace_by_value", f"SELECT doc_id, ((length(text) - length(replace(text, full_name, ''))) // length(full_name))::INTEGER AS n, replace(text, full_name, {O.mask_person('full_name')}) AS redacted FROM {RU}")
def replace_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = russian(spark, sf_dir)
    name = F.array(S.make_span(F.lit(0), F.char_length("full_name"), F.lit("PERSON"), F.col("full_name"), F.lit(0), F.lit(0)))
    return docs.select("doc_id", R.replace_by_value(F.col("text"), name, "mask").alias("x")).select("doc_id", "x.n", F.col("x.text").alias("redacted"))


_PARAGRAPHS = f"(SELECT row_number() OVER (ORDER BY doc_id, nth) AS doc_id, doc_id AS own, nth, text FROM (SELECT doc_id, unnest(range(len(p))) AS nth, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {RU})))"
_NAMED = O.nested(" UNION ALL ".join(f"({O.matches('par', p, 'PERSON', k)})" for k, p in enumerate(_PAIR)))


@query("mask_paragraph_person", f"WITH par AS {_PARAGRAPHS}, m AS ({O.spliced('par', _NAMED, O.mask_person('span'))}) SELECT own AS doc_id, string_agg(redacted, chr(10) ORDER BY nth) AS redacted FROM m JOIN par USING (doc_id) GROUP BY own")
def mask_paragraph_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return russian(spark, sf_dir).select("doc_id", R.mask_paragraph_names(F.col("text")).alias("redacted"))


_LINKS = "'<p><a href=\"mailto:' || email || '\">' || full_name || '</a> <a href=\"https://x.ru/?to=' || email || '\">y</a> <a href=\"mailto:none\">z</a><a href=\"mailto:a' || email || '\">w</a>'"


@query("hyperlink_emails", f"SELECT doc_id, array_to_string(list_sort(list_distinct(['a' || email, email])), chr(10)) AS emails FROM {RU}")
def hyperlink_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return russian(spark, sf_dir).select("doc_id", R.hyperlink_emails(F.expr(_LINKS)).alias("emails"))


@query("sanitize_mailto", f"""SELECT doc_id, replace(replace({_LINKS}, '"mailto:' || email || '"', '"mailto:' || {O.mask_email('email')} || '"'), '"mailto:a' || email || '"', '"mailto:' || {O.mask_email("('a' || email)")} || '"') AS html FROM {RU}""")
def sanitize_mailto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return russian(spark, sf_dir).select("doc_id", R.sanitize_mailto(F.expr(_LINKS)).alias("html"))


_SHOWN = "'<p>' || email || ' <A class=\"x\" href=\"https://x.ru\">' || full_name || ' <b>' || email || '</b>, ' || email || '</A> <a href=\"mailto:' || email || '\">write</a> {HYPERLINK \"mailto:' || email || '\"}'"
_MASKED = O.mask_email("email")


@query("sanitize_links", f"""SELECT doc_id, '<p>' || email || ' <A class="x" href="https://x.ru">' || full_name || ' <b>' || m || '</b>, ' || m || '</A> <a href="mailto:' || m || '">write</a> {{HYPERLINK "mailto:' || m || '"}}' AS html, 3::INTEGER AS n FROM (SELECT *, {_MASKED} AS m FROM {RU})""")
def sanitize_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return russian(spark, sf_dir).select("doc_id", R.sanitize_links(F.expr(_SHOWN)).alias("x")).select("doc_id", "x.html", "x.n")


@query("scrub_properties", "SELECT c_custkey, '' AS title, c_name AS name, '' AS author FROM customer")
def scrub_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scrub_properties(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("title"), F.col("c_name").alias("name"), F.col("c_name").alias("author")))


@query("strip_comments", "SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<del\\b[^>]*>.*?</del>', '', 'g') AS html FROM pages")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", R.strip_comments(F.col("html")).alias("html"))


@query("sections_redacted", f"SELECT doc_id, sum((length(p) - length(replace(p, full_name, ''))) // length(full_name))::BIGINT AS found, string_agg(replace(p, full_name, ''), chr(10) ORDER BY i) AS text FROM (SELECT doc_id, full_name, unnest(range(len(q))) AS i, unnest(q) AS p FROM (SELECT doc_id, full_name, string_split(text, chr(10)) AS q FROM {RU})) GROUP BY doc_id")
def sections_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = russian(spark, sf_dir)
    spans = docs.select("doc_id", F.array(S.make_span(F.lit(0), F.lit(1), F.lit("PERSON"), F.col("full_name"), F.lit(0), F.lit(0))).alias("spans"))
    return R.by_section(docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("section", "text")), spans, "remove")


# Corpora.
def _from_parts(parts: list[tuple[str, str]], source: str) -> str:
    """SQL for texts of parts (SQL, label) and a row for each marked part."""
    selects, before = [], "0"
    text = " || ".join(p for p, _ in parts)
    for p, label in parts:
        if label:
            selects.append(f"""SELECT doc_id, text, ({before})::INTEGER AS start, ({before} + length({p}))::INTEGER AS "end", '{label}' AS label, {p} AS span FROM c WHERE {p} <> ''""")
        before += f" + length({p})"
    return f"WITH c AS (SELECT *, {text} AS text FROM (SELECT * EXCLUDE (text) FROM {source})) " + " UNION ALL ".join(selects)


def _snippet_sql(template: tuple) -> str:
    return _from_parts([("'" + x.replace("\n", "") + "'" + (" || chr(10)" if "\n" in x else ""), "") if label is None else (x, label) for x, label in template], RU)


def _gold(docs: DataFrame) -> DataFrame:
    return flat(docs, F.col("gold"), "doc_id", "text").select("doc_id", "text", "start", "end", "label", "span")


@query("build_snippets", _snippet_sql(C.SNIPPET))
def build_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(C.snippets(russian(spark, sf_dir), C.SNIPPET, "doc_id"))


@query("build_english", _snippet_sql(C.ENGLISH))
def build_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(C.snippets(russian(spark, sf_dir), C.ENGLISH, "doc_id"))


def _line(c: str) -> str:
    return f"trim(trim(regexp_replace(trim(replace(replace({c}, chr(13) || chr(10), ', '), chr(10), ', ')), ' {{2,}}', ' ', 'g'), ', '))"


def _company(seed: str) -> str:
    h = lambda a: f"('0x' || substr(sha256({seed}), {a}, 8))::BIGINT"
    one = lambda names, a: f"[{', '.join(map(repr, names))}][{h(a)} % {len(names)} + 1]"
    return f"({one(P.COMPANY_NOUNS, 1)} || {one(P.COMPANY_FORMS, 9)})"


_CARD_SOURCE = f"(SELECT * REPLACE ({_line('full_name')} AS full_name, {_line('address')} AS address), {_company('email')} AS company FROM {RU})"


@query("build_cards", _from_parts([x for prefix, c, label in C.CARD for x in ((f"'{prefix}'", ""), (c, label), ("chr(10)", ""))], _CARD_SOURCE))
def build_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(C.cards(russian(spark, sf_dir), "doc_id"))


_HEAD = lambda a: f"[{', '.join(map(repr, P.HEADING_WORDS))}][('0x' || substr(md5(c_custkey::VARCHAR), {a}, 4))::BIGINT % {len(P.HEADING_WORDS)} + 1]"


_WORD = lambda a: _HEAD(a).replace("c_custkey", "k")


@query("build_negatives", f"SELECT c_custkey, CASE WHEN ('0x' || substr(md5(c_custkey::VARCHAR), 13, 4))::BIGINT % 10 < 6 THEN {_HEAD(1)} || ' ' || {_HEAD(5)} ELSE {_HEAD(1)} || ' ' || {_HEAD(5)} || ' ' || {_HEAD(9)} END AS text FROM customer")
def build_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.headings(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("ru_records", f"""SELECT doc_id, text, start, "end", span FROM ({_snippet_sql(C.SNIPPET)}) WHERE label = 'PERSON' UNION ALL SELECT -1 - k, CASE WHEN ('0x' || substr(md5(k::VARCHAR), 13, 4))::BIGINT % 10 < 6 THEN {_WORD(1)} || ' ' || {_WORD(5)} ELSE {_WORD(1)} || ' ' || {_WORD(5)} || ' ' || {_WORD(9)} END, -1, -1, '' FROM (SELECT unnest(range(greatest(100, (SELECT count(*) FROM customer) // 10))) AS k)""")
def ru_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = russian(spark, sf_dir)
    n = people.count()
    out = C.ru_records(people, spark.range(max(100, n // 10)), n)
    return out.select("doc_id", "text", F.explode_outer("gold").alias("s")).select("doc_id", "text", *[F.coalesce(f"s.{c}", F.lit(-1)).alias(c) for c in ("start", "end")], F.coalesce("s.text", F.lit("")).alias("span"))


@query("first_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_rows(table(spark, sf_dir, "customer"), 20, F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_name")


@query("one_line", f"SELECT doc_id, {_line('address')} AS line FROM {RU}")
def one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return russian(spark, sf_dir).select("doc_id", M.one_line(F.col("address")).alias("line"))


@query("first_nonempty", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' END, ''), nullif(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END, ''), '') AS v FROM customer")
def first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, M.first_nonempty(F.when(k % 2 == 0, ""), F.when(k % 3 == 0, F.col("c_name")).otherwise("")).alias("v"))


@query("stable_company", f"SELECT s_suppkey, {_company('s_name')} AS company FROM supplier")
def stable_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", M.stable_company(F.col("s_name")).alias("company"))


for _name, _share, _names in (("split_dev_head", 2 / 6, ("dev", "train")), ("split_80_20", 0.2, ("dev", "train")), ("split_90_10", 0.9, ("train", "dev"))):

    @query(_name, f"SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey) <= greatest(1, floor((SELECT count(*) FROM customer) * {_share} + 1e-9)) THEN '{_names[0]}' ELSE '{_names[1]}' END AS split FROM customer")
    def _split(spark: SparkSession, sf_dir: str, share: float = _share, names: tuple[str, str] = _names) -> DataFrame:
        return C.split_head(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", share, names)


_TOKENS = f'SELECT doc_id, ord AS tok_idx, start AS cs, "end" AS ce, span AS token FROM ({O.matches(RU, chr(92) + "S+")})'
_ENTITIES = f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, src) AS ent FROM ({O.recognized(RU, 'fio', 'surname_initials', 'phone')})"""


def _entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = russian(spark, sf_dir)
    found = F.concat(*[D.BY_NAME[n].find(F.col("text")) for n in ("phone", "surname_initials", "fio")])
    ents = docs.select("doc_id", F.posexplode(S._ordered(found, lambda s: s["start"], lambda s: -s["end"])).alias("ent", "s"))  # noqa: SLF001
    plain = r"[^\s]+"  # ASCII white space, as DuckDB's \S
    return C.tokens(docs, plain), ents.select("doc_id", "ent", "s.start", "s.end", "s.label")


@query("bio_tags", f"""WITH t AS ({_TOKENS}), e AS ({_ENTITIES}), h AS (SELECT t.doc_id, tok_idx, ent, label, row_number() OVER (PARTITION BY t.doc_id, ent ORDER BY tok_idx) AS nth FROM t JOIN e ON t.doc_id = e.doc_id AND cs < e."end" AND ce > e.start),
g AS (SELECT doc_id, tok_idx, arg_max(CASE WHEN nth = 1 THEN 'B-' ELSE 'I-' END || CASE label WHEN 'PERSON' THEN 'PER' ELSE label END, ent) AS tag FROM h GROUP BY ALL) SELECT t.*, CASE WHEN tag IN ('B-PER', 'I-PER') THEN tag END AS tag FROM t LEFT JOIN g USING (doc_id, tok_idx) WHERE tok_idx < 12""")
def bio_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of twelve tokens a text; a telephone number's tag isn't known."""
    toks, entities = _entities(spark, sf_dir)
    return C.bio_tags(toks, entities.withColumn("label", S.alias_labels(F.col("label"), P.TRAINING_ALIASES)), max_length=12)


@query("token_contract", f"""SELECT t.doc_id, label, min(cs) AS start, max(ce) AS "end" FROM ({_TOKENS}) t JOIN ({_ENTITIES}) e ON t.doc_id = e.doc_id AND cs >= e.start AND ce <= e."end" GROUP BY t.doc_id, ent, label""")
def token_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.contract(*_entities(spark, sf_dir)).drop("ent")


# Evaluation: the snippets' gold against what is found in them.
_LABELS = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD")
_GOLD = f'SELECT doc_id, start, "end", label, span FROM ({_snippet_sql(C.SNIPPET)})'
_SNIPPETS = f"(SELECT DISTINCT doc_id, text FROM ({_snippet_sql(C.SNIPPET)}))"
_PRED = f'SELECT doc_id, start, "end", label, span FROM ({O.pruned(O.recognized(_SNIPPETS))})'


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = D.detect(C.snippets(russian(spark, sf_dir), C.SNIPPET, "doc_id"))
    return flat(docs, F.col("gold")), flat(docs, F.col("spans"))


@query("metrics_span", O.counts(_GOLD, _PRED, labels=(*_LABELS, "ADDRESS")))
def metrics_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.match_counts(*_both(spark, sf_dir), [*_LABELS, "ADDRESS"])


@query("metrics_char", O.counts(O.characters(_GOLD), O.characters(_PRED), "doc_id, start", _LABELS))
def metrics_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = _both(spark, sf_dir)
    return E.match_counts(E.characters(gold), E.characters(pred), list(_LABELS), ("doc_id", "start"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "accuracy")})


@query("metrics_scores", O.scores(O.counts(_GOLD, _PRED, labels=_LABELS)) + " UNION ALL " + O.scores(O.counts(O.characters(_GOLD), O.characters(_PRED), "doc_id, start", _LABELS), "char"))
def metrics_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.classification(*_both(spark, sf_dir), list(_LABELS)))


_KEYS = 'doc_id, start, "end", label'


@query("metrics_set", f"SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (SELECT *, CASE WHEN n_pred > 0 THEN n_both / n_pred ELSE 0 END AS precision, CASE WHEN n_gold > 0 THEN n_both / n_gold ELSE 0 END AS recall FROM (SELECT count(g) AS n_gold, count(p) AS n_pred, count(g + p) AS n_both FROM (SELECT DISTINCT {_KEYS}, 1 AS g FROM ({_GOLD})) FULL JOIN (SELECT DISTINCT {_KEYS}, 1 AS p FROM ({_PRED})) USING ({_KEYS})))")
def metrics_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.set_scores(*_both(spark, sf_dir))


@query("metrics_pooled", O.counts(_GOLD, _PRED, 'start, "end"', _LABELS))
def metrics_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in one pool: spans of different texts may match."""
    return E.match_counts(*_both(spark, sf_dir), list(_LABELS), ("start", "end"))


_PERCENT = " || ' ' || ".join(f"printf('%5.1f', {c} * 100)" for c in ("precision", "recall", "f1", "accuracy"))


@query("metrics_report", f"SELECT level, scope, label, {_PERCENT} AS line FROM (" + O.scores(O.counts(_GOLD, _PRED, labels=_LABELS)) + " UNION ALL " + O.scores(O.counts(O.characters(_GOLD), O.characters(_PRED), "doc_id, start", _LABELS), "char") + ")")
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.report(_rounded(E.classification(*_both(spark, sf_dir), list(_LABELS))))


# Written from the rule: the span's text, a space of it standing for any white space, is looked for in the redacted text.
_LEFT_OVER = rf"regexp_matches(redacted, replace(regexp_escape(span), '\ ', '[\s\x{{00a0}}]+'))"
_LEAKED = lambda texts: f"SELECT leaked, total_true, CASE WHEN total_true > 0 THEN leaked / total_true ELSE 0 END AS pii_leakage FROM (SELECT coalesce(sum({_LEFT_OVER}::INTEGER), 0)::BIGINT AS leaked, count(*) AS total_true FROM ({_GOLD}) JOIN ({texts}) USING (doc_id) WHERE span <> '')"
#: Redacted texts in which every fifth keeps its name, with other white space.
_LEAKY = lambda texts: f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN redacted || replace(full_name, ' ', '  ') WHEN doc_id % 5 = 1 THEN redacted || replace(full_name, ' ', '') ELSE redacted END AS redacted FROM ({texts}) JOIN {RU} USING (doc_id)"


@query("leakage", _LEAKED(O.spliced(_SNIPPETS, _PRED, O.smart_mask("label", "span"))))
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.detect(C.snippets(russian(spark, sf_dir), C.SNIPPET, "doc_id"))
    return E.leakage(flat(docs, F.col("gold")), docs.select("doc_id", R.apply_policy(F.col("text"), F.col("spans"), "mask").alias("redacted")))


@query("redaction_metrics", f"""SELECT l.*, tp, fp, CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 0 END AS over_redaction FROM ({_LEAKED(_LEAKY(O.spliced(_SNIPPETS, _PRED, O.smart_mask("label", "span"))))}) l, (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp FROM ({O.counts(_GOLD, _PRED)}))""")
def redaction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = russian(spark, sf_dir)
    docs = D.detect(C.snippets(people, C.SNIPPET, "doc_id", "full_name"))
    redacted, name = R.apply_policy(F.col("text"), F.col("spans"), "mask"), lambda gap: F.replace(F.col("full_name"), F.lit(" "), F.lit(gap))
    leaky = F.when(F.col("doc_id") % 5 == 0, F.concat(redacted, name("  "))).when(F.col("doc_id") % 5 == 1, F.concat(redacted, name(""))).otherwise(redacted)
    return E.redaction_metrics(flat(docs, F.col("gold")), flat(docs, F.col("spans")), docs.select("doc_id", leaky.alias("redacted")))


_BATCHED = f"SELECT doc_id, floor((doc_id - 1) / 64.0)::BIGINT AS batch, text FROM {_SNIPPETS}"
_JOINED = f"(SELECT batch AS doc_id, string_agg(text, '' ORDER BY doc_id) AS text FROM ({_BATCHED}) GROUP BY batch)"
_MOVED = f"""SELECT batch AS doc_id, (start + before)::INTEGER AS start, ("end" + before)::INTEGER AS "end", label, span FROM ({_GOLD}) JOIN (SELECT doc_id, batch, sum(length(text)) OVER (PARTITION BY batch ORDER BY doc_id) - length(text) AS before FROM ({_BATCHED})) USING (doc_id)"""
_ON_JOINED = f'SELECT doc_id, start, "end", label, span FROM ({O.pruned(O.recognized(_JOINED, *(x.name for x in D.BUILT_IN if x.label in _LABELS)))})'


@query("metrics_concatenated", O.scores(O.counts(_MOVED, _ON_JOINED, labels=_LABELS)) + " UNION ALL " + O.scores(O.counts(O.characters(_MOVED), O.characters(_ON_JOINED), "doc_id, start", _LABELS), "char"))
def metrics_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector on texts put together, 64 at a time."""
    docs = C.snippets(russian(spark, sf_dir), C.SNIPPET, "doc_id")
    return _rounded(evaluate_concatenated(docs, list(_LABELS), 64))


@query("batch_offsets", f'SELECT doc_id, floor((doc_id - 1) / 256.0)::BIGINT AS batch, (sum(length(text)) OVER (PARTITION BY floor((doc_id - 1) / 256.0) ORDER BY doc_id) - length(text))::BIGINT AS "offset" FROM {RU}')
def batch_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.batch_offsets(russian(spark, sf_dir), 256)


# Feedback, files and names.
@query("feedback_json", f"""SELECT '{{"ts":"' || strftime(to_timestamp(doc_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') || '","source":"api","text":' || to_json(text)::VARCHAR || ',"spans":' || coalesce(s, '[]') || '}}' AS value FROM {RU} LEFT JOIN (SELECT doc_id, to_json(list({{'start': start, 'end': "end", 'label': label, 'text': span}} ORDER BY start))::VARCHAR AS s FROM ({O.pruned(O.recognized(RU))}) GROUP BY doc_id) USING (doc_id)""")
def feedback_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.detect(russian(spark, sf_dir))
    return T.feedback_records(docs, F.timestamp_seconds(F.col("doc_id")), "api")


@query("feedback_filter", f"""SELECT text, start, "end", label FROM (SELECT t.text, s.start, s."end", s.label FROM ({O.pruned(O.recognized(RU))}) s JOIN {RU} t USING (doc_id)) WHERE label = 'PERSON' AND text <> ''""")
def feedback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the log and back."""
    path = scratch(spark)
    T.append_feedback(T.feedback_records(D.detect(russian(spark, sf_dir)), F.timestamp_seconds(F.col("doc_id")), "api"), path)
    kept = T.feedback_training(T.read_feedback(spark, path))
    return kept.select("text", F.explode("entities").alias("e")).select("text", "e.start", "e.end", "e.label")


@query("label_records", f"""SELECT text, start, "end", CASE label WHEN 'ORG' THEN 'ORG' ELSE label END AS label FROM (SELECT text, start, "end", label FROM ({_from_parts([x for prefix, c, label in C.CARD for x in ((f"'{prefix}'", ""), (c, label), ("chr(10)", ""))], _CARD_SOURCE)}))""")
def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as label lists of strings, aliased for training and then to the final labels."""
    rows = C.cards(russian(spark, sf_dir), "doc_id").select("text", F.transform("gold", lambda s: F.array(s["start"].cast("string"), s["end"].cast("string"), F.lower(s["label"]))).alias("entities"))
    return T.gold_spans(T.aliased_entities(rows)).select("text", F.explode("gold").alias("g")).select("text", "g.start", "g.end", "g.label")


_FILES = f"SELECT page_id, url || {pick(('.pdf', '.DOCX', '.html', ''), 'page_id')} AS name, page_id * 1000003 % 80000000 AS size FROM pages"


@query("file_gate", f"SELECT page_id, CASE WHEN size > 52428800 THEN 413 WHEN lower(regexp_extract(name, '(\\.[^./]+)$', 1)) NOT IN ('.pdf', '.docx') THEN 415 ELSE 200 END AS status FROM ({_FILES})")
def file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_FILES.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    return rows.select("page_id", T.gate(F.col("name"), F.col("size")).alias("status"))


@query("output_names", f"""SELECT page_id, regexp_replace(b, '(.)\\.[^./]+$', '\\1') || '.redacted' || e AS output_name, '/api/file/' || b AS url, regexp_replace(b, '(.)\\.[^./]+$', '\\1') || '_redacted' || e AS download_name FROM (SELECT *, regexp_extract(b, '.(\\.[^./]+)$', 1) AS e FROM (SELECT page_id, regexp_extract(name, '([^/]*)$', 1) AS b FROM ({_FILES})))""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_FILES.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    b = T.base_name(F.col("name"))
    return rows.select("page_id", T.output_name(b).alias("output_name"), T.public_url(b).alias("url"), T.output_name(b, "_redacted").alias("download_name"))


_ASKED = O.pruned(O.recognized(RU, *(x.name for x in D.BUILT_IN if x.label in ("PERSON", "EMAIL_ADDRESS"))))


@query("process_files", f"""SELECT name || '.docx' AS input_name, name || '.redacted.docx' AS output_name, '/api/file/' || name || '.redacted.docx' AS output_url, n_spans AS found, 'docx' AS filetype, 200 AS status, redacted FROM (SELECT *, 'doc' || doc_id AS name FROM ({O.spliced(RU, _ASKED, O.smart_mask('label', 'span'))}))""")
def process_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = russian(spark, sf_dir)
    files = docs.select(F.concat(F.lit("in/doc"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("name"), F.octet_length("text").cast("long").alias("length"), "text")
    return RedactJob(languages="ru, en", types="PERSON,EMAIL_ADDRESS").process(files)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
