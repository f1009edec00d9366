import hashlib
import random
import sys
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from test_native import NASTY, table

from cloakspan.llm import media as M
from cloakspan.llm import near_dedup as N
from cloakspan.llm import packing as P
from cloakspan.llm import quality as Q
from cloakspan.llm import substring_dedup as S
from cloakspan.llm import token_output as T
from cloakspan.llm import tokens as K
from cloakspan.llm import toxicity as X
from cloakspan.llm.components import components
from cloakspan.llm.shared import new_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(n, seed, alphabet="abcdefghij"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n)]


def test_token_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    own, whole = K.encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = ["<|endoftext|> a", "ÀÉ ß İstanbul éx don't we'll 12³ ½ a\xa0b \x1cx\x1f y\x85z", "ΑΣ ΣΑΣ. 日本語!!", "\xadsoft 'S $$%% _x__", "", "  ", "A" * 500]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    rows = [*NASTY, *((100 + k, " ".join(words(40 * k, k))) for k in range(40))]
    out = P.pack(table(spark, rows), TOKENIZER, capacity=512).toPandas()
    own = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(map(repr, own)) == sorted(repr((i, k, at, len(ids), crc(ids))) for i, k, at, ids in expected_pieces(rows, 512))
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() <= 512
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 512) + 2
    assert P.pack(table(spark, []), TOKENIZER).count() == 0


def test_the_linear_program_runs_on_few_pieces(monkeypatch):
    priced = []
    monkeypatch.setattr(P, "_priciest", lambda *a, f=P._priciest: priced.append(1) or f(*a))
    rng = random.Random(3)
    counts = {rng.randint(1, 2048): 1 for _ in range(50)}
    made = P.configurations(counts)
    assert len(priced) >= 100
    assert sum(times for times, _ in made) <= -(-sum(k * n for k, n in counts.items()) // 2048) + 2


def test_configurations_cover_exactly():
    rng = random.Random(1)
    for counts in ({}, {5: 3}, {2048: 7, 1: 1}, {rng.randint(1, 2048): rng.randint(1, 5000) for _ in range(300)}):
        made: dict[int, int] = {}
        for times, use in P.configurations(counts):
            assert sum(k * n for k, n in use.items()) <= 2048
            for k, n in use.items():
                made[k] = made.get(k, 0) + times * n
        assert made == counts


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1025])
def test_slots_are_a_permutation(n):
    assert sorted(T.slots(np.arange(n), n, 7)) == list(range(n))


def expected_pieces(rows, size):
    """(doc_id, piece, ids) of each row, by the tokenizer itself."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        yield from ((i, k, at, ids[at : at + size]) for k, at in enumerate(range(0, len(ids), size)))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_round_trip_and_resume(spark, monkeypatch):
    rows = [*NASTY, (9, " ".join(words(900, 1)))]
    docs, folder = table(spark, rows), new_folder(spark, "shards")
    n = T.write_shards(docs, TOKENIZER, folder, stride=64, per_shard=8)
    found = T.read_shards(spark, folder, n, 64, 8).toPandas()
    assert sorted(found.slot) == list(range(n))
    assert (found.shard == found.slot // 8).all()
    assert (found.byte == found.slot % 8 * T.record_type(64).itemsize).all()
    expected = [(i, k, len(ids), crc(ids), tuple(ids)) for i, k, _, ids in expected_pieces(rows, 64)]
    own = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.length, r.ids_crc32, tuple(r.ids)) for r in found.itertuples()]
    assert sorted(map(repr, own)) == sorted(map(repr, expected))
    # The slots are those of the permutation: of a table that is one partition, in order.
    ordered = T.slots(np.arange(n), n, 20_240_229)
    single = new_folder(spark, "shards")
    T.write_shards(table(spark, rows).coalesce(1), TOKENIZER, single, stride=64, per_shard=8)
    placed = {r.slot: r.ids_crc32 for r in T.read_shards(spark, single, n, 64, 8, with_ids=False).collect()}
    assert [placed[s] for s in ordered.tolist()] == [crc(ids) for *_, ids in expected_pieces(rows, 64)]
    assert sorted(r.slot for r in T.read_shards(spark, folder, n, 64, 8, first_slot=13).collect()) == list(range(13, n))
    # A run that was broken off: one shard is missing, one is cut short, and an attempt is left.
    import os

    path = folder.removeprefix("file://")
    assert not [x for x in os.listdir(path) if not x.endswith(".bin") and not x.startswith(".")]
    os.remove(f"{path}/shard-00000001.bin")
    os.truncate(f"{path}/shard-00000002.bin", 10)
    open(f"{path}/shard-00000001.bin.77", "w").close()
    before = {x: os.stat(f"{path}/{x}").st_mtime_ns for x in os.listdir(path)}
    assert T.write_shards(docs, TOKENIZER, folder, stride=64, per_shard=8) == n
    after = {x: os.stat(f"{path}/{x}").st_mtime_ns for x in os.listdir(path)}
    assert {x for x in after if after[x] != before.get(x)} == {"shard-00000001.bin", "shard-00000002.bin"}
    assert "shard-00000001.bin.77" not in after
    again = T.read_shards(spark, folder, n, 64, 8).toPandas()
    assert sorted(map(repr, zip(again.slot, again.ids_crc32, strict=True))) == sorted(map(repr, zip(found.slot, found.ids_crc32, strict=True)))
    monkeypatch.setattr(T, "MAX_TASKS", 3)  # runs of shards
    T.write_shards(docs, TOKENIZER, single := new_folder(spark, "shards"), stride=64, per_shard=8)
    assert T.read_shards(spark, single, n, 64, 8).count() == n
    assert T.write_shards(table(spark, []), TOKENIZER, new_folder(spark, "shards")) == 0
    assert T.read_shards(spark, folder, 0).count() == 0


def test_media(spark):
    rows = [*NASTY, (50, "é" * 95 + "a"), (51, "x" * 192), (52, "x" * 193), (52, "x" * 193)]
    expected = []
    for i, t in rows:
        own = (t or "").encode()
        own_padded = own + b" " * (max(192, -(-len(own) // 192) * 192) - len(own))
        png = M.to_png(own_padded)
        expected.append((i, len(own), len(own_padded), hashlib.sha256(own_padded).hexdigest(), zlib.crc32(own_padded[-16:]), len(png), hashlib.sha256(png).hexdigest(), M.feature(np.frombuffer(own_padded, np.uint8).reshape(-1, 192))))
    assert sorted(map(repr, map(tuple, M.media_columns(table(spark, rows)).collect()))) == sorted(map(repr, expected))
    assert M.media_columns(table(spark, [])).count() == 0


def test_ranges_of_bytes_meet_each_member_once(spark):
    folder = new_folder(spark, "archives")
    M.write_archives(table(spark, [(i, "word " * i) for i in range(100)]), folder)
    spark.dataSource.register(M.ArchiveSource)
    found = spark.read.format("archive").option("rangebytes", 500).load(folder)
    assert found.rdd.getNumPartitions() > 10
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == list(range(100))


def test_damaged_member_is_read_again():
    png = M.to_png(M.payload("x")[1])
    entry = np.array([(0, len(png), zlib.crc32(png), 0, 0, 1)], M.ENTRY)[0]

    class File:
        reads = 0

        def read_at(self, n, at):
            self.reads += 1
            return b"?" * n if self.reads < 3 else png

    file = File()
    assert M._Reader._member(file, entry, pause=0) == png
    assert file.reads == 3


def shingles(text, k):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else {tuple(own)} if own else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rng, docs = random.Random(k), []
    for g in range(12):
        base = words(rng.randint(3, 120), g)
        for c in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                own[rng.randrange(len(own))] = "zz" + str(rng.randint(0, 99))
            docs.append((100 * g + c, " ".join(own).upper() if c == 1 else " ".join(own)))
    big = words(300, 77)  # one large group of near copies
    for c in range(150):
        own = list(big)
        own[rng.randrange(300)] = f"n{c}"
        docs.append((5000 + c, " ".join(own)))
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one")]
    out = {r.doc_id: r for r in N.near_duplicates(table(spark, docs), k=k).collect()}
    sets, parent = {i: shingles(t, k) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    for i in ids:
        assert (out[i].n_shingles, out[i].component_id, out[i].kept) == (len(sets[i]), find(i), find(i) == i), i


def test_classes_are_told_apart(spark):
    rows = [(1, 10, 5, 100), (2, 20, 5, 100), (3, 30, 5, 200), (4, 40, 6, 300), (5, 50, None, None)]
    signed = spark.createDataFrame(rows, "id long, text_hash long, c long, c2 long").selectExpr("*", "1L n", "array(1) mh", "1L s1", "1L s2")
    own, classes = N.told_apart(N.written(signed, "signatures"))
    of = {r.id: r.c for r in own.collect()}
    assert of[1] == of[2] != of[3]
    assert (of[4], of[5]) == (6, None)
    assert {r.c: r.least for r in classes.collect()} == {of[1]: 1, of[3]: 3, 6: 4}


def test_single_links_in_a_large_group_are_found(spark):
    """800 near copies of a text, and texts that are linked to one or two of them only."""
    rng, base, docs = random.Random(5), words(200, 5), []
    for i in range(800):
        own = list(base)
        for k in rng.sample(range(200), 4):
            own[k] = f"n{rng.randrange(10**6)}"
        docs.append((100 + i, own))
    for i in range(30):
        own = list(docs[rng.randrange(800)][1])
        for k in rng.sample(range(200), 10):
            own[k] = f"m{rng.randrange(10**6)}"
        docs.append((10_000 + i, own))
    sets = {i: {tuple(t[k : k + 2]) for k in range(199)} for i, t in docs}
    linked = lambda a, b: 100 * (both := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - both)
    hard = [i for i in sets if i >= 10_000 and 1 <= sum(linked(i, j) for j in sets if j != i) <= 3]
    assert hard
    out = {r.doc_id: r for r in N.near_duplicates(table(spark, [(i, " ".join(t)) for i, t in docs]), k=2).collect()}
    found = [out[i].component_id == 100 for i in hard if any(out[j].component_id == 100 and linked(i, j) for j in sets if j != i)]
    assert found
    assert np.mean(found) >= 0.9, (len(found), sum(found))


def test_one_of_each(spark):
    text = " ".join(words(50, 1))
    docs = table(spark, [(1, text), (1, text), (2, text), (None, text), (3, None), (3, None), (4, ""), (5, "other words stand here today")])
    out = N.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(1, text), (5, "other words stand here today")]
    assert sum(not r.text for r in out.collect()) == 3
    assert N.one_of_each(table(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (7, 7)]
    out = {(r.u, r.v) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {(i, 1) for i in range(2, 41)} | {(200, 100), (300, 100)}


def test_substrings_against_brute_force(spark):
    rng, docs = random.Random(4), []
    passages = [words(rng.randint(10, 60), 50 + k) for k in range(6)]
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 3)):
            own += words(rng.randint(0, 20), 1000 + i + len(own)) + rng.choice(passages)
        docs.append((i, (" " if i % 2 else "\n\t").join(own)))
    docs += [(70, None), (71, ""), (72, docs[5][1]), (73, "a " * 40), (74, "a " * 40)]
    first: dict = {}
    cut = {i: (t or "").encode().split() for i, t in docs}
    for i, own in cut.items():
        for k in range(len(own) - 12):
            first.setdefault(tuple(own[k : k + 13]), i)
    out = {r.doc_id: r for r in S.substring_dedup(table(spark, docs), with_text=True).collect()}
    for i, own in cut.items():
        keep = [True] * len(own)
        for k in range(len(own) - 12):
            if first[tuple(own[k : k + 13])] < i:
                keep[k : k + 13] = [False] * 13
        left = b" ".join(w for w, x in zip(own, keep, strict=True) if x)
        assert (out[i].n_words, out[i].n_removed, out[i].kept_sha256) == (len(own), keep.count(False), hashlib.sha256(left).hexdigest())
        assert out[i].kept_text == left.decode()
    assert S.substring_dedup(table(spark, [])).count() == 0
    twice = S.substring_dedup(table(spark, [(None, docs[5][1]), (5, docs[5][1]), (5, docs[5][1])])).collect()
    assert sorted((r.doc_id or 99, r.n_removed > 0) for r in twice) == [(5, False), (5, False), (99, len(cut[5]) >= 13)]


def test_toxicity(spark):
    rng, docs, labels = random.Random(2), [], []
    for i in range(600):
        own, bad = words(30, i), i % 4 == 0
        own[rng.randrange(30)] = "muslim" if bad and i % 3 else "christian"
        if bad:
            own[rng.randrange(30)] = rng.choice(["scumx", "idiotish"])
        docs.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (9999, 1), (0, None)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in X.toxicity(table(spark, [*docs, (7000, "muslim " + " ".join(words(20, 7))), (7001, None), (7002, "")]), marks).collect()}
    assert all(out[i].predicted == y for i, y in labels[:600] if out[i].held_out)
    assert out[7000].predicted == 0
    assert out[7001].score == out[7002].score
    model = X.fit([(set(t.split()), y) for (_, t), (_, y) in zip(docs, labels, strict=False)])
    plain = X.fit([(set(t.split()), y) for (_, t), (_, y) in zip(docs, labels, strict=False)], fair=0.0)
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))
    assert gap(model) < 0.2 * gap(plain)
    assert X.toxicity(table(spark, []), marks.limit(0)).count() == 0
    assert {r.predicted for r in X.toxicity(table(spark, docs[:5]), marks.limit(0)).collect()} == {0}


def test_scores_are_the_models(spark):
    rows = [*NASTY, *((20 + k, " ".join(words(30, k)) + (" scumx!!" if k % 2 else "")) for k in range(60)), (99, " ".join(words(150_000, 1))), (99, " ".join(words(150_000, 1)))]
    docs = table(spark, rows)
    marks = spark.createDataFrame([(20 + k, k % 2, 1 - k % 2) for k in range(60)], "doc_id long, toxic int, quality int")
    model = X.train(docs, marks)
    assert sorted(repr((r.doc_id, r.score)) for r in X.toxicity(docs, marks).collect()) == sorted(repr((i, model.score(t))) for i, t in rows)
    ranked = Q.train(docs, marks)
    expected = ranked.score(np.array([Q.features(t) for _, t in rows]))
    assert sorted(repr((r.doc_id, r.score)) for r in Q.quality(docs, marks).collect()) == sorted(repr((i, float(x))) for (i, _), x in zip(rows, expected, strict=True))


def test_long_texts_and_repeated_rows(spark):
    long = " ".join(words(60_000, 3))
    rows = [(1, long), (1, long), (2, long + " one more"), (None, long), (3, None), (3, None)]
    out = N.near_duplicates(table(spark, rows), k=2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]
    left = S.substring_dedup(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_words - r.n_removed) for r in left) == [(0, 0), (1, 60_000), (1, 60_000), (2, 2), (3, 0), (3, 0)]


def test_rows_without_an_id_keep_what_they_share(spark):
    a, b = " ".join(words(40, 1)), " ".join(words(40, 2))
    out = S.substring_dedup(table(spark, [(None, a), (None, a + " x"), (None, b), (7, b)])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out) == [(0, 40, 0), (0, 40, 40), (0, 41, 0), (7, 40, 0)]


def test_toxicity_of_a_capped_sample(spark):
    rng, docs, labels = random.Random(9), [], []
    for i in range(3000):
        own, bad = words(12, i), i % 10 == 0
        own += ["scumx"] * (rng.random() < (0.6 if bad else 0.3)) + ["idiotish"] * (bad and rng.random() < 0.5)
        docs.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    docs, marks = table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, capped = X.train(docs, marks), X.train(docs, marks, per_class=150)
    for text in ("", "scumx", "idiotish", "scumx idiotish"):
        assert (capped.score(text) >= 0.3) == (whole.score(text) >= 0.3), text
    assert abs(capped.score("scumx") - whole.score("scumx")) < 0.1


def test_quality(spark):
    docs = [(i, " ".join(w.upper() + "!!" for w in words(40, i)) if i % 5 == 0 else " ".join(words(40, i)).capitalize() + ".") for i in range(400)]
    marks = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)], "doc_id long, quality int")
    out = {r.doc_id: r for r in Q.quality(table(spark, [*docs, (900, None), (901, "")]), marks).collect()}
    held = [i for i in range(400) if out[i].held_out]
    assert held
    assert np.mean([out[i].predicted == int(i % 5 > 0) for i in held]) > 0.95
    assert out[900].score == out[901].score
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    assert Q.quality(table(spark, []), marks.limit(0)).count() == 0


def test_toxicity_is_fitted_in_little_memory():
    """Texts have few of the model's words, and a table of all texts by all words would hold mostly zeros."""
    rng = random.Random(6)
    rows = [(set(rng.sample(range(400), 10)), i % 4 == 0) for i in range(8_000)]
    rows = [({f"{'t' if y and k % 2 else 'w'}{k}" for k in own}, int(y)) for own, y in rows]
    tracemalloc.start()
    model = X.fit(rows, steps=50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights
    assert peak < 8_000 * 200 * 4, peak


@pytest.mark.parametrize("better", [12_000, 37_000])
def test_quality_learns_from_all_rows(spark, better):
    """40,000 labelled texts, of which a sample of 8,000 a class would leave most out: each is in a block, and in a pair there."""
    size = len(Q.features(""))
    rows = spark.range(40_000).selectExpr("md5(string(id)) AS t", f"int(id < {better}) AS y", f"transform(sequence(1, {size}), k -> double(id * k % 1000)) AS x")
    edges = Q._edges(rows)
    exact = np.quantile(np.arange(40_000) % 1000, np.linspace(0, 1, Q.BINS + 1)[1:-1])
    assert np.allclose(edges[0], exact, rtol=0.01, atol=2)
    blocks = list(Q._opened(Q._blocks(rows, edges, {1: better, 0: 40_000 - better}).toArrow().to_batches()))
    n = [(int((y == 1).sum()), int((y == 0).sum())) for _, y, _ in blocks]
    scarce = 40_000 - better <= Q.BLOCK // 2
    assert len(n) == 2
    assert sum(a for a, _ in n) == better
    assert sum(b for _, b in n) == (40_000 - better) * (2 if scarce else 1)
    for block, y, x in blocks:
        pairs, _, grad = Q._slope(y, x, np.zeros(size * Q.BINS), block)
        assert pairs == Q.TURNS * max(sum(y == 0), sum(y == 1))
        assert grad.any()


def test_crowd_of_copies_makes_few_pairs(spark, monkeypatch):
    """Copies of a text that are similar enough to it or just not, and mostly not to each other."""
    rng, base = random.Random(8), words(60, 77)
    docs = [(0, " ".join(base))]
    for k in range(1, 320):
        own = list(base)
        for at in rng.sample(range(60), rng.choice((2, 3, 4, 4, 5))):
            own[at] = f"x{k}y{at}"
        docs.append((k, " ".join(own)))
    # Two that are tied to each other only, and one that is tied by a copy that itself is tied to the text.
    far = docs[300][1].split()
    far[10:14] = ["p", "q", "r", "s"]
    docs += [(400, " ".join(far)), (401, " ".join(far[:59]))]
    counts, real = {}, N.written

    def counted(df, name):
        out = real(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(N, "written", counted)
    found = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=2).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in docs}
    root = {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets.items(), 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            root[max(top(i), top(j))] = min(top(i), top(j))
    assert found == {i: top(i) for i in root}
    assert counts["pairs"] < 20 * len(docs)


def test_classes_of_a_crowd_that_share_what_tells_them_apart_are_not_all_paired(spark):
    """Copies that lack long, overlapping passages of a text and have a few shingles of their own."""
    rng, sets = random.Random(9), {0: set(range(120))}
    for c in range(1, 200):
        at = rng.randrange(100)
        sets[c] = set(range(120)) - set(range(at, at + 20)) | {1000 * c + k for k in range(10)}
    rows = [(0, c, len(x), 0, 0, c, sorted(x)) for c, x in sets.items()]
    members = spark.createDataFrame(rows, "g long, c long, n long, s1 long, s2 long, root long, shingles array<long>")
    found = [(r.u, r.v) for r in N.in_crowds(N.set_apart(members), 80).collect()]
    linked = {(i, j) for (j, a), (i, b) in combinations(sorted(sets.items()), 2) if 100 * len(a & b) >= 80 * len(a | b)}
    assert linked and linked <= set(found)
    assert len(set(found)) < 2 * len(linked) < len(sets) ** 2 / 4


def test_remembered_words_are_looked_up_without_a_step_each():
    memory, steps = K._Memory(), []
    memory.late, memory.before = {f"l{k}": b"" for k in range(500)}, {f"b{k}": b"x" for k in range(500)}

    def traced(frame, event, arg):
        steps.append(event)
        return traced

    sys.settrace(traced)
    try:
        found = memory.unknown({"new", *memory.late, *memory.before})
    finally:
        sys.settrace(None)
    assert set(found) == {"new"} and memory.late["b7"] == b"x" and len(memory.late) == 1000
    assert len(steps) < 50
