import pytest
from pyspark.sql import functions as F

from cloakspan.functions import masks as M
from cloakspan.functions import spans as S
from cloakspan.operators import detect as D
from cloakspan.operators import redact as R


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("mask", "text", "expected"),
    [
        (lambda t: M.mask_digits(t, 4), "+7 (999) 123-45-67", "+7 (999) ***-**-**"),
        (lambda t: M.mask_digits(t, 4), "4111 1111 1111 1111", "4111 **** **** ****"),
        (lambda t: M.mask_digits(t, 2), "12 34 567890", "12 ** ******"),
        (M.mask_person, "Иванов Иван-Пётр", "И***** И***-П***"),
        (M.mask_person, "И.И. Сидорова", "И.*. С*******"),
        (M.mask_person, "John Smith", "John Smith"),
        (M.mask_email, "ivan.p@mail.ru", "i***.*@mail.ru"),
        (M.mask_email, ".x_y+z9@q.org", ".x_*+**@q.org"),
        (M.mask_email, "nomail", "******"),
        (M.mask_email, "@d.ru", "*@d.ru"),
        (M.mask_email, "@", "*"),
        (M.one_line, " a\r\nb\n c,  ", "a, b, c"),
    ],
)
def test_masks(spark, mask, text, expected):
    assert one(spark, text, mask) == expected


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [
        ("phone", "8\xa0999\xa0123\xa045\xa067", [(0, 15)]),
        ("passport", "серия 12 34 567890", [(0, 18)]),
        ("passport", "12345678901", []),
        ("fio", "Содержание Введение\nДоговор", [(0, 27)]),
        ("fio", "Список Литературы", []),
        ("email", "я a.b@c.de, x@y", [(2, 10)]),
        ("email", "😀 a@b.cc", [(2, 8)]),
        ("ip", "1.2.3.4 256.1.1.1 1.2.3.4.5", [(0, 7)]),
        ("iban", "DE89370400440532013000 DE89370400440532013001", [(0, 22)]),
        ("email", None, []),
        ("email", "", []),
    ],
)
def test_recognizers(spark, name, text, expected):
    found = one(spark, text, D.BY_NAME[name].find)
    assert [(s.start, s.end) for s in found] == expected
    assert all(text[s.start : s.end] == s.text for s in found)


def spans(*pairs):
    return F.array(*[S.make_span(F.lit(a), F.lit(b), F.lit(label), F.lit(""), F.lit(0), F.lit(k)) for k, (a, b, label) in enumerate(pairs)])


def test_prune(spark):
    kept = one(spark, "", lambda _: S.prune_overlaps(spans((5, 9, "NRP"), (3, 6, "NRP"), (0, 4, "NRP"), (9, 10, "NRP"))))
    assert [(s.start, s.end) for s in kept] == [(0, 4), (5, 9), (9, 10)]
    kept = one(spark, "", lambda _: S.prune_overlaps(spans((0, 4, "NRP"), (0, 4, "PERSON"), (0, 3, "PERSON"))))
    assert [(s.end, s.label) for s in kept] == [(4, "PERSON")]


def test_nested_keeps_the_longer_with_the_same_begin(spark):
    kept = one(spark, "", lambda _: S.dedup_nested(spans((0, 9, "A"), (0, 4, "A"), (5, 8, "A"))))
    assert [(s.start, s.end) for s in kept] == [(0, 4), (0, 9)]


def test_labels():
    assert D.resolve_labels(["NO_SUCH"]) == []
    assert len(D.resolve_labels(None)) == 12
    assert D.resolve_languages([" en", "xx"]) == ["en"]
    assert D.resolve_languages([]) == ["ru"]
    with pytest.raises(ValueError, match="policy"):
        R.check_policy("hide")


def test_compat_and_safe_masks_differ(spark):
    assert one(spark, "DE89", lambda t: M.smart_mask(F.lit("IBAN_CODE"), t)) == "DE89"
    assert one(spark, "DE89", lambda t: M.smart_mask(F.lit("IBAN_CODE"), t, safe=True)) == "****"


def test_detect_properties(spark):
    text = "Пишите: И.О. Петров, a@b.cc; тел. +7 (999) 123-45-67, карта 4111 1111 1111 1111. Паспорт 12 34 567890"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in D.detect(docs).select("doc_id", "spans", R.apply_policy(F.col("text"), F.col("spans"), "mask").alias("m")).collect()}
    found = out[1].spans
    assert [s.label for s in found] == ["PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "PASSPORT_ID"]
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))
    assert len(out[1].m) == len(text)
    assert out[2].spans == out[3].spans == []
    assert out[2].m == out[3].m == ""


def test_values_with_special_characters(spark):
    text = "a.b a  b a.b \\$1"
    span = F.array(S.make_span(F.lit(0), F.lit(3), F.lit("NRP"), F.lit("a.b"), F.lit(0), F.lit(0)), S.make_span(F.lit(0), F.lit(3), F.lit("NRP"), F.lit("a b"), F.lit(0), F.lit(1)))
    out = one(spark, text, lambda t: R.replace_by_value(t, span, "remove"))
    assert (out.text, out.n) == ("   \\$1", 3)
