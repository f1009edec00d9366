"""DuckDB's forms of the operators: its regular expressions have no lookaround and ASCII classes, so patterns differ."""

from __future__ import annotations

from .functions import patterns as P
from .sources.people import select_sql

SOFT, SPACE = r"[\s\x{00a0}\-]", r"[\s\x{00a0}]"
OCTET = P.OCTET
SUR, INI = P.SURNAME, P.INITIALS
#: label -> (recognizer number, pattern on the masked text, mask: letters put out of the way so that \b and \B see digits only)
DIGITS = r"regexp_replace(text, '[A-Za-z_]', '#', 'g')"
PATTERNS = {
    "ip": ("IP_ADDRESS", 1, r"[A-Za-z0-9_.]+", "text", rf"regexp_full_match(m1, '{OCTET}(?:\.{OCTET}){{3}}')"),
    "iban": ("IBAN_CODE", 2, r"[A-Za-z0-9]+", "text", r"regexp_full_match(m1, '[A-Z]{2}\d{2}[A-Z0-9]{11,30}') AND list_reduce(list_transform(string_split(substr(m1, 5) || substr(m1, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"),
    "ssn": ("US_SSN", 3, r"[A-Za-z0-9_\-]+", "text", r"regexp_full_match(m1, '\d{3}-\d{2}-\d{4}')"),
    "email": ("EMAIL_ADDRESS", 4, r"(?:\b[A-Za-z0-9_]|\B[.%+\-])[A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "text", ""),
    "phone": ("PHONE_NUMBER", 5, rf"(?:\B\+7|\b7|\b8){SOFT}?(?:\(\d{{3}}\)|\d{{3}}){SOFT}?\d{{3}}{SOFT}?\d{{2}}{SOFT}?\d{{2}}\b", DIGITS, ""),
    "card": ("CREDIT_CARD", 6, rf"\b(?:\d{{4}}(?:{SOFT})?){{3}}\d{{4}}\b", DIGITS, ""),
    "passport": ("PASSPORT_ID", 7, rf"(?i)(?:(?:сери[яи]|№|номер){SOFT}*|\b)(?:\d{{2}}{SOFT}?\d{{2}}){SOFT}?(?:\d{{6}})\b", DIGITS, ""),
    "surname_initials": ("PERSON", 8, rf"{SUR}{SPACE}*{INI}", "text", ""),
    "initials_surname": ("PERSON", 9, rf"{INI}{SPACE}*{SUR}", "text", ""),
    "fio": ("PERSON", 10, rf"(?:{SUR}{SPACE}+[А-ЯЁ][а-яё]+(?:{SPACE}+[А-ЯЁ][а-яё]+|{SPACE}+{INI})?|{INI}{SPACE}+{SUR})", "text", f"lower(trim(m1)) NOT IN ({', '.join(repr(x) for x in P.HEADINGS)})"),
}
RU = select_sql("customer", "c_custkey")


def matches(table: str, pattern: str, label: str = "", src: int = 0, masked: str = "text", where: str = "", keep: str = "doc_id") -> str:
    """keep, start, end, label, span, src, ord of all matches in the table's text."""
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    return f"""SELECT {keep}, CAST(s AS INTEGER) AS start, CAST(s + length(m1) AS INTEGER) AS "end", '{label}' AS label, substr(text, CAST(s AS INTEGER) + 1, length(m1)) AS span, {src} AS src, CAST(i - 1 AS INTEGER) AS ord FROM (
SELECT *, m[i] AS m1, {size("g[1:i]")} + {size("m[1:i - 1]")} AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
SELECT *, regexp_extract_all(n, '{pattern}') AS m, string_split_regex(n, '{pattern}') AS g FROM (SELECT *, {masked} AS n FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM {table})))))""" + (f" WHERE {where}" if where else "")  # fmt: skip


def recognized(table: str, *names: str, keep: str = "doc_id") -> str:
    return " UNION ALL ".join(f"({matches(table, p, label, src, masked, where, keep)})" for label, src, p, masked, where in (PATTERNS[n] for n in names or PATTERNS))


PRIORITY = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.PRIORITY.items()) + " ELSE 0 END"


def folded(rows: str, order: str, keep: str, doc: str = "doc_id") -> str:
    """Of rows with start, end, label, span: those that a left-to-right fold keeps. keep: a condition on a (last kept) and v."""
    return f"""SELECT {doc}, unnest(k.k, recursive := true) FROM (SELECT {doc}, list_reduce(x, lambda a, v: CASE WHEN {keep} THEN {{'b': v.start, 'e': v."end", 'k': list_append(a.k, v)}} ELSE a END, {{'b': -1, 'e': -1, 'k': x[1:0]}}) AS k FROM (
SELECT {doc}, list({{'start': start, 'end': "end", 'label': label, 'span': span}} ORDER BY {order}) AS x FROM ({rows}) r GROUP BY {doc}))"""


def pruned(rows: str, doc: str = "doc_id") -> str:
    return folded(rows, f'start, start - "end", -({PRIORITY}), src, ord', "v.start >= a.e", doc)


def nested(rows: str) -> str:
    return folded(rows, 'start, "end", src, ord', 'len(a.k) = 0 OR NOT (v.start >= a.b AND v."end" <= a.e)')


ALNUM = r"[\p{L}\p{N}]"


def mask_digits(t: str, keep: int) -> str:
    rx = rf"(?s)^((?:\P{{Nd}}*\p{{Nd}}){{0,{keep}}})(.*)$"
    return rf"(regexp_extract({t}, '{rx}', 1) || regexp_replace(regexp_extract({t}, '{rx}', 2), '\p{{Nd}}', '*', 'g'))"


def mask_person(t: str) -> str:
    part = r"regexp_extract(w, '^[^\p{Cyrillic}]*\p{Cyrillic}?')"
    parts = rf"list_transform(regexp_extract_all({t}, '[^\s\x{{00a0}}\-]+|[\s\x{{00a0}}\-]+'), lambda w: {part} || regexp_replace(substr(w, length({part}) + 1), '\p{{Cyrillic}}', '*', 'g'))"
    return f"array_to_string({parts}, '')"


def mask_generic(t: str) -> str:
    return f"regexp_replace({t}, '{ALNUM}', '*', 'g')"


def mask_email(t: str) -> str:
    local, domain = f"substr({t}, 1, strpos({t}, '@') - 1)", f"substr({t}, strpos({t}, '@') + 1)"
    head = rf"regexp_extract({local}, '^[^\p{{L}}\p{{N}}]*{ALNUM}?')"
    return f"(CASE WHEN strpos({t}, '@') = 0 THEN {mask_generic(t)} WHEN strpos({t}, '@') = 1 THEN CASE WHEN {domain} = '' THEN '*' ELSE '*@' || {domain} END ELSE {head} || {mask_generic(f'substr({local}, length({head}) + 1)')} || '@' || {domain} END)"


def smart_mask(label: str, t: str) -> str:
    words = f"regexp_extract_all({t}, '[A-Za-zА-Яа-яЁё]+(?:-[A-Za-zА-Яа-яЁё]+)*')"
    named = f"len({words}) BETWEEN 1 AND 3 AND len(list_filter({words}, lambda z: regexp_matches(z, '^[A-ZА-ЯЁ]'))) > 0"
    return f"(CASE WHEN {label} IN ('PHONE_NUMBER', 'CREDIT_CARD') THEN {mask_digits(t, 4)} WHEN {label} = 'PASSPORT_ID' THEN {mask_digits(t, 2)} WHEN {label} = 'PERSON' THEN {mask_person(t)} WHEN {label} = 'EMAIL_ADDRESS' THEN {mask_email(t)} WHEN {named} THEN {mask_person(t)} ELSE {mask_generic(t)} END)"


def spliced(table: str, spans: str, replacement: str, doc: str = "doc_id", text: str = "text") -> str:
    """doc, n_spans, redacted: the text with each span (none overlapping) replaced."""
    gap = f'substr(t.{text}, coalesce(lag("end") OVER (PARTITION BY {doc} ORDER BY start), 0) + 1, start - coalesce(lag("end") OVER (PARTITION BY {doc} ORDER BY start), 0))'
    return f"""SELECT {doc}, coalesce(n, 0)::INTEGER AS n_spans, coalesce(body, '') || substr(coalesce(t.{text}, ''), coalesce(last, 0) + 1) AS redacted FROM {table} t LEFT JOIN (
SELECT {doc}, count(*) AS n, max("end") AS last, string_agg(piece, '' ORDER BY start) AS body FROM (SELECT {doc}, start, "end", {gap} || {replacement} AS piece FROM ({spans}) s JOIN {table} t USING ({doc})) GROUP BY {doc}) b USING ({doc})"""


def counts(gold: str, pred: str, keys: str = 'doc_id, start, "end"', labels: tuple[str, ...] = ()) -> str:
    known = f"(VALUES {', '.join(f'({x!r})' for x in labels)}) k(label) LEFT JOIN" if labels else ""
    where = f"WHERE label IN ({', '.join(map(repr, labels))})" if labels else ""
    inner = f"""(SELECT label, sum(least(t, p)) AS tp, sum(p - least(t, p)) AS fp, sum(t - least(t, p)) AS fn FROM (SELECT label, coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM
(SELECT {keys}, label, count(*) AS t FROM ({gold}) {where} GROUP BY ALL) g FULL JOIN (SELECT {keys}, label, count(*) AS p FROM ({pred}) {where} GROUP BY ALL) q USING ({keys}, label)) GROUP BY label) c"""
    return f"SELECT label, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, coalesce(fn, 0)::BIGINT AS fn FROM {known} {inner} {'USING (label)' if labels else ''}"


def characters(rows: str) -> str:
    return f'SELECT doc_id, label, CAST(unnest(range(start, "end")) AS INTEGER) AS start, 0 AS "end" FROM ({rows})'


def with_scores(rows: str) -> str:
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0::DOUBLE END"
    return f"""SELECT label, tp, fp, fn, pr AS precision, re AS recall, {ratio('2 * pr * re', 'pr + re')} AS f1, ac AS accuracy FROM (SELECT *, {ratio('tp::DOUBLE', 'tp + fp')} AS pr, {ratio('tp::DOUBLE', 'tp + fn')} AS re, {ratio('tp::DOUBLE', 'tp + fp + fn')} AS ac FROM ({rows}))"""


def scores(rows: str, level: str = "span") -> str:
    r = lambda c: f"round({c}, 9) AS {c}"
    total = f"SELECT '' AS label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({rows})"
    shown = ", ".join(map(r, ("precision", "recall", "f1", "accuracy")))
    mean = f"SELECT '' AS label, 0::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(accuracy) AS accuracy FROM ({with_scores(rows)})"
    return " UNION ALL ".join(f"SELECT '{level}' AS level, '{scope}' AS scope, label, tp, fp, fn, {shown} FROM ({x})" for scope, x in (("class", with_scores(rows)), ("micro", with_scores(total)), ("macro", mean)))
