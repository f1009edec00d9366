import math
import random
import re
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from cloakspan.llm import decontaminate as D
from cloakspan.llm import license_scan as L
from cloakspan.llm import line_dedup as LD

SCHEMA = "doc_id long, text string, key string, c int, id int, n int, _key int, _gone string, score double, words string"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, "g", 0.5, "w") for i, t in rows], SCHEMA)


NASTY = [(None, None), (None, "mit license"), (1, ""), (2, "   \n\n "), (3, "MIT License, mit license"), (3, "MIT License, mit license"), (4, "x" * 100_000 + " gnu general public license")]


def test_license_cases(spark):
    out = L.license_scan(table(spark, NASTY)).collect()
    assert len(out) == len(NASTY)
    by = {(r.doc_id, r.n_words): r for r in out}
    assert (by[3, 4].n_base, by[3, 4].first_word, by[3, 4].last_word, by[3, 4].base_labels) == (2, 0, 2, "mit")
    assert by[4, 5].base_labels == by[4, 5].labels == "gpl"
    assert (by[None, 0].labels, by[None, 0].score, by[None, 0].first_word) == ("", 0.0, None)
    assert L.license_scan(table(spark, NASTY).limit(0)).count() == 0


def test_license_body_with_changes(spark):
    text = "permission is hereby granted free of charge to any lucky person obtaining a copy of this software and associated files"
    row = L.license_scan(table(spark, [(1, text), (2, "permission is hereby granted to go")])).orderBy("doc_id").collect()
    assert (row[0].labels, row[0].base_labels) == ("mit", "")
    assert 0.6 <= row[0].score < 1
    assert row[1].labels == ""


def test_license_sql(spark):
    rows = [*NASTY[2:], (7, "Apache-License; CC BY-NC, all rights reserved"), (8, "redistribution and use in source and binary forms with or without modification are permitted")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    expected = con.sql(L.oracle()).fetchall()
    found = [tuple(r) for r in L.license_scan(table(spark, rows)).drop("spans").collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_overlaps_with_substitutions(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(6)]
    docs, expected = [(900, None), (901, ""), (902, " ".join(word() for _ in range(300)))], set()
    for k, text in items:
        own = text.split()
        for j, changed in enumerate((0, 3, 6)):  # up to six of forty words differ, never two running
            new = [word() if changed and i % (40 // changed) == 3 else w for i, w in enumerate(own)]
            docs.append((10 * k + j, " ".join([*(word() for _ in range(30)), *new, *(word() for _ in range(30))])))
            expected.add((10 * k + j, k))
        docs.append((10 * k + 9, " ".join(own[:8])))  # too short a stretch
    bench = spark.createDataFrame([*items, (50, None), (51, "tiny item"), (52, "")], "item_id long, text string")
    docs.append((990, "a TINY, item here"))
    expected.add((990, 51))
    found = D.overlaps(table(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert {r.first_word for r in found if r.doc_id % 10 < 3 and r.doc_id < 900} == {30}
    kept = D.decontaminate(table(spark, docs), bench)
    assert kept.columns == table(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in expected}
    assert D.overlaps(table(spark, docs), bench.limit(0)).count() == 0
    assert D.overlaps(table(spark, []), bench).count() == 0


def test_every_pattern_of_substitutions_is_met(spark):
    docs, items, expected = [], [], set()
    for n in (9, 10, 11, 12, 13):
        own = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(own)))
        for k in range(4):
            for differ in combinations(range(n), k):
                docs.append((len(docs), " ".join("new" if i in differ else w for i, w in enumerate(own))))
                if n - k >= 0.8 * n:
                    expected.add((docs[-1][0], n))
    for n in (20, 30, 50, 100):
        own = [f"v{n}x{i}" for i in range(n)]
        items.append((n, " ".join(own)))
        for phase in range(5):
            docs.append((len(docs), "before " + " ".join("new" if i % 5 == phase else w for i, w in enumerate(own))))
            expected.add((docs[-1][0], n))
    found = D.overlaps(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected


def best_overlaps(docs, items, window=13, least=0.8):
    """(doc_id, item_id): n_equal, n_aligned, first_word, by comparing each text with each item at each alignment."""
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    out = {}
    for i, text in docs:
        own = cut(text)
        for k, item in items:
            other = cut(item)
            if not own or not other:
                continue
            width = min(window, len(other))
            for start in range(1 - len(other), len(own)):
                equal = [own[start + j] == w for j, w in enumerate(other) if 0 <= start + j < len(own)]
                need = least * width if len(other) >= D.SHORT else width
                if len(equal) >= width and max(sum(equal[a : a + width]) for a in range(len(equal) - width + 1)) >= need:
                    out[i, k] = max(out.get((i, k), (0, 0, 0)), (sum(equal), len(equal), -start))
    return {key: (a, b, -c) for key, (a, b, c) in out.items()}


@pytest.mark.parametrize("block", [4096, 16])
@pytest.mark.parametrize("set_rows", [50_000, 10])
def test_overlaps_against_brute_force(spark, monkeypatch, block, set_rows):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "SET_ROWS", set_rows)
    monkeypatch.setattr(D, "BROADCAST_CHARS", 100 if set_rows == 10 else 8 << 20)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("uvwxyz")
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 8, 9, 11, 13, 25, 60])))) for k in range(16)]
    items += [(3, "second text of one id with nine words in it"), (30, None), (31, " - ")]
    docs = [(0, None), (1, ""), (2, "!?")]
    for i in range(40):
        own = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            part = (rng.choice(items)[1] or "").split()
            own += [word() if rng.random() < rng.choice([0, 0.1, 0.25]) else w for w in part[rng.randint(0, len(part) // 2) :]]
            own += [word() for _ in range(rng.randint(0, 10))]
        docs.append((10 + i, ", ".join(own)))
    docs += [docs[5], docs[6], (200, " ".join(word() for _ in range(3000)) + " " + items[-3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_equal, r.n_aligned, r.first_word) for r in D.overlaps(table(spark, docs), bench).collect()}
    assert found == best_overlaps(docs, items)


@pytest.mark.parametrize(("window", "min_equal"), [(13, 0.8), (9, 0.8), (14, 0.8), (20, 0.8), (6, 0.7), (15, 0.9)])
def test_masks_hit_every_overlap(window, min_equal):
    masks = D.masks_for(window, min_equal)
    for n in range(min(D.SHORT, window), window + 1):
        for differ in combinations(range(n), n - math.ceil(min_equal * n)):
            assert any(all(x == "0" or at + j not in differ for j, x in enumerate(m)) for m in masks for at in range(n - len(m) + 1)), (n, differ)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(200):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            if rng.random() < 0.5:
                b.insert(k, rng.choice("abé"))
            elif k < len(b):
                b[k : k + 1] = rng.choice([[], ["a"]])
        pairs.append(("".join(a), "".join(b)))
    out = LD.with_edit_distance(spark.createDataFrame(pairs, "a string, b string"), "a", "b", edits, "d").collect()
    for r in out:
        d = distance(r.a, r.b)
        assert r.d == d if d <= edits else r.d > edits


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_against_brute_force(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(18, 40))) for _ in range(40)]

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], ["a"], ["b", s[k]]])
        return "".join(s)

    docs = [(i, "\n".join([changed(rng.choice(base)) for _ in range(rng.randint(0, 5))] + ["short"] * rng.randint(0, 2) + [""] * rng.randint(0, 1))) for i in range(60)]
    docs += [(200, ""), (201, base[0]), (202, "y" * 20_000), (203, "y" * 20_001)]
    out = {r.doc_id: r.text for r in LD.line_dedup(table(spark, [*docs, (None, None)]), edits).collect()}
    before = []
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            near = lambda p: len(line) >= 20 and len(p) >= 20 and abs(len(line) - len(p)) <= edits and (distance(line, p) if len(line) < 100 else abs(len(line) - len(p))) <= edits  # noqa: E731, B023
            if not line.strip() or not any(line == p or near(p) for p in before):
                kept.append(line)
            if line.strip():
                before.append(line)
        assert out[i] == "\n".join(kept)
    assert out[None] is None


def test_near_copies_of_lines_go_by_default(spark):
    line = "in the year 1987 the company moved its head office to the north of the city, where it had 45 workers"
    near = [line.replace("87", "92"), line.replace(" to ", " at "), line.replace("1987", "1972").replace("45", "44"), line.replace("year ", "years ").replace("city", "cits")]
    far = line.replace("1987", "2012").replace("45", "36")
    out = LD.line_dedup(table(spark, [(1, line), *((2 + k, x) for k, x in enumerate([*near, far]))]))
    assert {r.doc_id for r in out.collect() if r.text} == {1, 6}


@pytest.mark.parametrize("edits", [1, 2, 3])
@pytest.mark.parametrize("length", [20, 21, 22, 29, 36, 60])
def test_lines_within_the_edits_share_keys(spark, edits, length):
    rng, pairs = random.Random(length), []
    for _ in range(300):
        a = [rng.choice("abcdefghijklmnop") for _ in range(length)]
        b = list(a)
        for _ in range(edits):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], ["x"], ["y", b[k]]])
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"la": F.char_length("a"), "lb": F.char_length("b")})
    assert df.where(F.size(F.array_intersect(LD._one_segment_keys("a", "la", edits), LD._one_segment_keys("b", "lb", edits))) == 0).count() == 0


def test_line_cases(spark):
    rows = [(5, "one line\nother line"), (6, "one line"), (7, "one line\n\nmine"), (8, ""), (None, "one line\nlast"), (None, None)]
    out = LD.line_dedup(table(spark, rows), counts=True)
    assert out.columns == [*table(spark, []).columns, "n_lines", "n_removed"] if "n_lines" not in table(spark, []).columns else True
    assert {(r.doc_id, r.text): r.n_removed for r in out.collect()} == {(5, "one line\nother line"): 0, (6, ""): 1, (7, "\nmine"): 1, (8, ""): 0, (None, "last"): 1, (None, None): 0}
    left = LD.line_dedup(table(spark, rows), drop_emptied=True)
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, -1, 5, 7, 8]
    assert LD.line_dedup(table(spark, [])).count() == 0
    assert out.select(F.sum("n_lines")).first()[0] == 9


def test_a_long_text_and_many_items(spark, monkeypatch):
    """A text of 20,000 words and more items than the plan's sets take; the overlap crosses a block's end."""
    monkeypatch.setattr(D, "SET_ROWS", 100)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(50))) for k in range(200)]
    own = [word() for _ in range(20_000)]
    own[D.BLOCK - 20 : D.BLOCK + 30] = items[7][1].split()
    found = D.overlaps(table(spark, [(1, " ".join(own)), (1, " ".join(own)), (2, "")]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_equal, r.first_word) for r in found] == [(1, 7, 50, D.BLOCK - 20)]


def test_a_crowd_of_lines_is_linked_without_all_pairs(spark, monkeypatch):
    """5,000 lines that differ in one place, and 600 that differ by a long word: no table has the square of them."""
    rng, sizes = random.Random(6), []
    base = "the quick report of the northern office was sent to all of its members on a cold morning in the spring"
    docs = [(k, base[:50] + chr(0x4E00 + k) + base[51:]) for k in range(5000)]
    docs += [(10_000 + k, base.upper()[:40] + "".join(rng.choice("abcdefghijklmnop") for _ in range(14)) + base.upper()[40:]) for k in range(600)]
    write = LD.written
    monkeypatch.setattr(LD, "written", lambda df, name: (out := write(df, name), sizes.append((name, out.count())))[0])
    left = LD.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.where("text <> ''").collect()) == [0, *(i for i, _ in docs[5000:])]
    assert max(n for name, n in sizes if name in ("line-pairs", "measured")) < 15_000, sizes


@pytest.mark.parametrize("crowd", [0, 3])
def test_crowded_lines_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(LD, "CROWD", crowd)
    rng = random.Random(crowd)
    lines = []
    for _ in range(6):
        base = [rng.choice("abcdefgh ") for _ in range(rng.randint(22, 45))]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 7)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], ["x"], ["y", own[k]], ["z"]])
            lines.append("".join(own))
    lines += ["a" * 30, "a" * 32, "a" * 35, "a" * 29 + "b", "ab" * 15, "ab" * 16]
    rng.shuffle(lines)
    out = {r.doc_id: r.text for r in LD.line_dedup(table(spark, list(enumerate(lines)))).collect()}
    for i, line in enumerate(lines):
        near = any(line == p or (min(len(line), len(p)) >= 20 and abs(len(line) - len(p)) <= 3 and distance(line, p) <= 3) for p in lines[:i])
        assert out[i] == ("" if near else line), line


def test_lines_with_other_letters_make_no_pairs(spark, monkeypatch):
    """Lines with four letters put in, each elsewhere: eight edits apart, though few of their runs of two differ."""
    rng = random.Random(5)
    base = " ".join("".join(rng.choice("etaoins") for _ in range(5)) for _ in range(40))
    lines = [base]
    for k in range(60):
        at = 3 + 3 * k
        lines.append(base[:at] + ("bcdf", "gjkp", "qvwx")[k % 3] + base[at:])
    near = [lines[9][:100] + "u" + lines[9][101:], lines[20][:-3] + "muh"]
    pairs, real = [], LD.written

    def counted(df, name):
        out = real(df, name)
        if name == "line-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(LD, "written", counted)
    out = LD.line_dedup(table(spark, list(enumerate([*lines, *near]))))
    assert sorted(r.doc_id for r in out.collect() if not r.text) == [61, 62]
    assert pairs[0] < 60 * 59 // 2 // 2


def test_signature_never_denies_edits(spark):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        a = "".join(rng.choice("abcdeÄß 12Z") for _ in range(rng.randint(20, 60)))
        b = list(a)
        for _ in range(3):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "q", "€"])
        rows.append((k, a, "".join(b)))
    signed = spark.createDataFrame(rows, "k long, x string, y string").select(
        *[F.struct(F.struct(F.lit(n).alias("key")).alias("first"), F.char_length(c).alias("length"), LD._signature(c).alias("s")).alias(c) for n, c in enumerate("xy")]
    )
    flat = signed.select(*[F.struct(f"{c}.first", f"{c}.length", f"{c}.s.*").alias(c) for c in "xy"])
    assert flat.where(~LD._may_be_near("x", "y", 3)).count() == 0


def test_lines_that_share_a_segment_but_not_their_length_are_not_read_again(spark, monkeypatch):
    """Only those of a key whose lengths differ by the edits at most may be near."""
    rng, begin, counts, real = random.Random(5), "a passage that all lines begin with, ", {}, LD.written
    tail = lambda n: "".join(rng.choice("abcdefgh ä😀") for _ in range(n))
    lines = [begin + tail(n - len(begin)) for n in (98, 106, 113)]
    docs = [(k, x) for k, x in enumerate(lines)] + [(10, lines[0][:70] + "#" + lines[0][72:])]

    def counted(df, name):
        out = real(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(LD, "written", counted)
    gone = {r.key: r.gone for r in LD.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert gone == {10: [0]}
    assert counts["suspects"] == 2


@pytest.mark.parametrize("text", ["plain letters, as many as it takes", "ä and 😀 among the letters of it, too"])
def test_keys_are_the_same_segments_in_utf_32(spark, text):
    df = spark.createDataFrame([(text,)], "a string").selectExpr("a", "char_length(a) AS n", "encode(a, 'UTF-32') AS w")
    narrow, wide = df.select(LD._one_segment_keys("a", "n", 3), LD._one_segment_keys("w", "n", 3, unit=4)).first()
    assert len(narrow) == len(wide) > 3
