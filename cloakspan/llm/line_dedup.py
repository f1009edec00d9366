"""Line dedup by a segment-partition edit join.

Two lines within `edits` edits that are cut into edits + 1 segments share one segment unchanged, at a place that the
number of edits bounds. So each distinct line is indexed by its segments under (size, segment number) and probes the
index with its substrings at those places. Lines that meet there are first compared with the earliest of them; those
that aren't near to it make pairs with others whose signatures, of which an edit changes few bits, are near. Pairs are
verified by the banded bit-parallel edit distance, the likeliest of a line first. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, clash_free, deleted, small_enough, written


#: Near copies of a line: a word or number of a few letters changed, also in two or three places.
EDITS = 3
#: Keys of more lines are crowded: their lines are compared only if they also share a run of GRAM characters that is rare there.
CROWD, GRAM = 2048, 3


def _sizes(length: str, edits: int, parts: int) -> list[str]:
    """SQL of the segment sizes of the line's own class of length (first), and of the classes of lines within `edits` of its length.

    A class goes up to 1.2 times its shortest line, whose size of segments all have, so that nearly equal lengths are cut alike.
    """
    return [f"CAST(floor(pow(1.2D, floor(ln(greatest(1, {length} + {d})) / ln(1.2D))) / {parts}) AS int)" for d in (0, -edits, edits)]


def _moves(edits: int) -> list[tuple[int, int]]:
    """For edits + 1 segments: (number, shift) of one that may be without an edit, with each shift it may have.

    Segments of the first half are counted from the line's begin and the others from its end, and what is between
    belongs to the last of the first half. A shift comes of edits further out in the same half, an edit for each place;
    some segment i has no edit while exactly i edits are left of it.
    """
    half = (edits + 2) // 2
    return [(i, d) for i in range(edits + 1) for d in range(-edits, edits + 1) if abs(d) <= (i if i < half else edits - i)]


def _begin(i: str, size: str, length: str, parts: int) -> str:
    return f"IF({i} < {(parts + 1) // 2}, {size} * {i}, {length} - {size} * ({parts} - {i}))"


def _one_segment_keys(line: str, length: str, edits: int, sizes: list[str] | None = None, unit: int = 1) -> Column:
    """Keys of single segments, of which two lines within `edits` edits share one that is the own one of either.

    sizes: columns of _sizes(), if there are some. unit: 4 if line is in UTF-32, of four bytes a code point, where a
    segment is found without counting all that is before it.
    """
    parts, keys = edits + 1, []
    sizes = sizes or _sizes(length, edits, parts)
    for n, size in enumerate(sizes):
        for i, d in _moves(edits):
            begin = f"({_begin(str(i), size, length, parts)} + {d})"
            other = f"{size} <> {sizes[0]} AND " if n else ""
            keys.append(f"IF({other}{begin} >= 0 AND {begin} + {size} <= {length}, xxhash64({size}, {i}, substring({line}, {begin} * {unit} + 1, {size} * {unit})), NULL)")
    return F.array_distinct(F.array_compact(F.array(*map(F.expr, keys))))


def with_edit_distance(pairs: DataFrame, a: str, b: str, edits: int, out: str = "distance") -> DataFrame:
    """pairs with the edit distance of columns a and b, code points counted, where it is `edits` at most; edits + 1 where it is more.

    Bit-parallel on a band of 2 * edits + 1 diagonals: bit k of the state is row j - edits + k of column j. The steps
    are columns of their own, since the planner would copy what is used more than once into each use.
    """
    if not 1 <= edits <= 20:
        raise ValueError("edits must be 1 to 20")
    width = 2 * edits + 1
    full = (1 << width) - 1
    ahead = F.char_length(a) >= F.char_length(b)
    p, t, m, n = clash_free(pairs.columns, "_p", "_t", "_m", "_n")
    rows = pairs.withColumns({p: F.split(F.when(ahead, F.col(a)).otherwise(F.col(b)), ""), t: F.split(F.when(ahead, F.col(b)).otherwise(F.col(a)), "")})
    rows = rows.withColumns({m: F.greatest(F.char_length(a), F.char_length(b)), n: F.least(F.char_length(a), F.char_length(b))})
    step = " + ".join(f"IF(j + {k - edits} >= 0 AND get({p}, j + {k - edits}) <=> get({t}, j), {1 << k}L, 0L)" for k in range(width))
    # Each lambda names what the next one uses: the matches x, then d0, then the two horizontal differences.
    d0 = f"((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {full}L"
    hp = f"s.vn | ((d0 | s.vp) ^ {full}L)"
    down = f"IF((d0 & {1 << (width - 1)}L) = 0, 1, 0)"
    along = f"CASE WHEN (hp & shiftleft(1L, greatest(0, {m} - 1 - j + {edits}))) <> 0 THEN 1 WHEN (d0 & s.vp & shiftleft(1L, greatest(0, {m} - 1 - j + {edits}))) <> 0 THEN -1 ELSE 0 END"
    new = f"named_struct('vp', (d0 & s.vp) | ((shiftrightunsigned(d0, 1) | hp) ^ {full}L), 'vn', shiftrightunsigned(d0, 1) & hp, 'd', s.d + IF(j + {edits} < {m}, {down}, {along}))"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    body = let("x", step, let("d0", d0, let("hp", hp, new)))
    start = f"named_struct('vp', {((1 << (edits + 1)) - 1) << edits}L, 'vn', 0L, 'd', {edits})"
    fold = F.expr(f"aggregate(IF({n} > 0, sequence(0, {n} - 1), CAST(array() AS array<int>)), {start}, (s, j) -> {body}, s -> s.d)")
    # Lines no longer than the band have no band: they are compared outright.
    distance = F.when(F.col(m) - F.col(n) > edits, edits + 1).when(F.col(m) <= edits, F.levenshtein(a, b)).otherwise(fold)
    return rows.withColumn(out, F.least(distance, F.lit(edits + 1))).drop(p, t, m, n)


def _chars(line: str, body: str) -> Column:
    """body with the line's characters as c."""
    return F.expr(f"element_at(transform(array(split({line}, '')), c -> {body}), 1)")


def _signature(line: str) -> Column:
    """s1, s2: for each of 128 classes of two running characters, whether their number is odd; s3: for each of 32 classes of characters, their number.

    An edit changes four of the first at most. Numbers of s3 are taken modulo 4 and written in Gray code, so that one more
    or one less changes one bit: an edit changes two bits at most.
    """
    bits = "transform(sequence(0, greatest(0, size(c) - 2)), i -> CAST(pmod(xxhash64(get(c, i), get(c, i + 1)), 128) AS int))"
    odd = lambda low: f"aggregate(b, 0L, (acc, x) -> acc ^ IF(x BETWEEN {low} AND {low + 63}, shiftleft(1L, x - {low}), 0L))"
    # Two bits a class, counted up without a carry into the next class.
    bit = "shiftleft(1L, 2 * CAST(ascii(x) & 31 AS int))"
    counted = f"aggregate(c, 0L, (acc, x) -> acc ^ {bit} ^ shiftleft(acc & {bit}, 1), acc -> acc ^ (shiftrightunsigned(acc, 1) & {0x5555555555555555}L))"
    return _chars(line, f"element_at(transform(array({bits}), b -> named_struct('s1', {odd(0)}, 's2', {odd(64)}, 's3', {counted})), 1)")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))


def _may_be_near(a: str, b: str, edits: int) -> Column:
    """Whether line a comes before b and may be within the edits; what it denies is not."""
    letters = F.bit_count(F.col(f"{a}.s3").bitwiseXOR(F.col(f"{b}.s3")))
    return (F.col(f"{a}.first") < F.col(f"{b}.first")) & (F.abs(F.col(f"{a}.length") - F.col(f"{b}.length")) <= edits) & (letters <= 2 * edits) & (_apart(a, b) <= 4 * edits)


def _near_pair() -> list[Column]:
    return [F.col("a.h1").alias("early"), F.col("b.h1").alias("late"), _apart("a", "b").alias("apart")]


def _grams(line: str) -> Column:
    """The distinct runs of GRAM characters, hashed."""
    return _chars(line, f"array_distinct(transform(sequence(0, greatest(0, size(c) - {GRAM})), i -> xxhash64({', '.join(f'get(c, i + {j})' for j in range(GRAM))})))")


def _rare(grams: str, leader: str, edits: int) -> Column:
    """The first runs of a line, those ahead that its crowd's leader doesn't have.

    An edit changes GRAM runs at most. So of two lines within the edits, if the runs of both are put in one order, the
    first GRAM * edits + 1 have one in common. Lines with few runs, which may all be changed, also share one key.
    """
    touched = GRAM * edits
    ordered = F.concat(F.array_sort(F.array_except(grams, leader)), F.array_sort(F.array_intersect(grams, leader)))
    few = F.when(F.size(grams) <= 2 * touched, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.array_union(F.slice(ordered, 1, touched + 1), few)


def of_like_length(found: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """The bands of lengths in which keys have more lines than one, and the rows of found (k, length and others) that have such a band, as tables.

    A line is in the band of its length and in the next one: lines of a key whose lengths differ by `edits` at most share
    a band, so no line that may be near to another one of the key goes.
    """
    banded = found.withColumn("band", F.explode(F.expr(f"array(length div {edits + 1}, length div {edits + 1} + 1)")))
    bands = written(banded.groupBy("k", "band").agg(F.count("*").alias("m")).where("m > 1").drop("m"), "bands")
    return bands, written(banded.join(small_enough(bands), ["k", "band"], "left_semi").drop("band", "length").distinct(), "segments")


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, text_hash, gone: for each row (by id and text) that has some, the numbers (from 0) of its repeated lines.

    A line is repeated if an equal line, or one of min_chars or more within `edits` edits (this line having min_chars
    or more too), comes earlier: in a row with a smaller id (nulls last; of equal ids, the smaller hash of the text),
    or further up in the row. Lines are judged on the input, not on what is left. Blank lines are never repeated.
    Lines and texts of any length count whole.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("key"), F.xxhash64(text_col).alias("text_hash"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))
    placed = texts.select("key", "text_hash", F.posexplode_outer("lines").alias("at", "line")).where(F.trim("line") != "")
    hashed = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")]
    first = F.min(F.struct("key", "text_hash", "at")).alias("first")
    long = F.char_length("line") >= min_chars
    # The segments of all lines come first, few keys a line; only lines that share a segment with another line are read again.
    keys = F.when(F.col("length") >= min_chars, _one_segment_keys("wide", "length", edits, ["z0", "z1", "z2"], unit=4)).alias("keys")
    # The sizes are columns of their own, since each key uses them several times.
    wide = placed.withColumn("wide", F.encode("line", "UTF-32")).withColumn("length", F.expr("octet_length(wide) div 4").cast("int"))
    sized = wide.withColumns({f"z{n}": F.expr(x) for n, x in enumerate(_sizes("length", edits, edits + 1))})
    each = sized.select("key", "text_hash", "at", "length", *hashed, keys)
    distinct = written(each.groupBy("h1", "h2").agg(first, F.first("length").alias("length"), F.first("keys").alias("keys")), "lines")
    segments = distinct.select("h1", "h2", "length", F.explode("keys").alias("k"))
    shared = written(segments.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "segments")
    found = written(segments.join(small_enough(shared), "k"), "segments")
    bands, kept = of_like_length(found, edits)
    suspects = small_enough(written(kept.select("h1", "h2").distinct(), "suspects"), BROADCAST_ROWS // 4)
    wanted = placed.where(long).select("key", "text_hash", "at", "line", *hashed).join(suspects, ["h1", "h2"])
    wanted = wanted.groupBy("h1", "h2").agg(F.first("line").alias("line"), first).withColumn("length", F.char_length("line"))
    wanted = written(wanted.withColumn("s", _signature("line")).select("*", "s.*").drop("s"), "wanted")
    marks = ["h1", "length", "first", "s1", "s2", "s3"]
    # ks: those of the line's keys that aren't crowded.
    of_line = kept.groupBy("h1", "h2").agg(F.collect_list(F.when(F.col("n") <= CROWD, F.col("k"))).alias("ks"))
    keyed = written(kept.join(wanted.select("h2", *marks), ["h1", "h2"]).join(of_line, ["h1", "h2"]).select("k", "n", F.struct(*marks).alias("b"), "ks"), "keyed")
    deleted(shared, found, bands, kept)

    def measured(pairs: DataFrame) -> DataFrame:
        """late: of each late line the likeliest pair is measured first, and the others where that is too far."""
        of = lambda side: wanted.select(F.col("h1").alias(side), F.col("line").alias(f"{side}_line"))
        near = with_edit_distance(pairs.select("early", "late").join(of("early"), "early").join(of("late"), "late"), "early_line", "late_line", edits)
        # Written before it is filtered: a filter would be pushed down with a copy of all steps.
        return written(near.drop("early_line", "late_line"), "measured").where(F.col("distance") <= edits).select("late").distinct()

    nearest = lambda pairs: pairs.groupBy("late").agg(F.min_by("early", F.struct("apart", "early")).alias("early"))
    # What is near to the first line of one of its keys needs no other; so a crowd of near copies takes a pair for each line.
    leaders = keyed.groupBy("k").agg(F.min_by("b", "b.first").alias("a"))
    tied = measured(nearest(keyed.join(leaders, "k").where(_may_be_near("a", "b", edits)).select(*_near_pair())))
    done = small_enough(tied)
    few = keyed.where(F.col("n") <= CROWD)
    early = few.select(F.col("k").alias("k_"), F.col("b").alias("a"), F.col("ks").alias("ks_"))
    # Near copies share most of their keys; the pair is made on the least of them only.
    once = F.array_min(F.array_intersect("ks", "ks_")) == F.col("k")
    pairs = early.join(few.join(done, F.col("b.h1") == F.col("late"), "left_anti"), (F.col("k") == F.col("k_")) & _may_be_near("a", "b", edits) & once).select(*_near_pair())

    # Lines of crowded keys meet on what their leader doesn't have.
    many = keyed.where(F.col("n") > CROWD).drop("n", "ks")
    in_crowds = written(many.select(F.col("b.h1").alias("h1")).distinct(), "crowd")
    grams = written(wanted.join(small_enough(in_crowds), "h1", "left_semi").select("h1", _grams("line").alias("gs")), "grams")
    heads = leaders.join(small_enough(many.select("k").distinct()), "k", "left_semi").join(grams, F.col("a.h1") == F.col("h1")).select("k", F.col("gs").alias("leader"))
    rare = many.join(grams, F.col("b.h1") == F.col("h1")).join(heads, "k").select("k", "b", F.explode(_rare("gs", "leader", edits)).alias("g"))
    rare = written(rare, "rare")
    early = rare.select(F.col("k").alias("k_"), F.col("g").alias("g_"), F.col("b").alias("a"))
    late = rare.join(done, F.col("b.h1") == F.col("late"), "left_anti")
    crowded = early.join(late, (F.col("k") == F.col("k_")) & (F.col("g") == F.col("g_")) & _may_be_near("a", "b", edits)).select(*_near_pair())

    pairs = written(pairs.unionByName(crowded).distinct(), "line-pairs")
    soon = measured(nearest(pairs))
    found = tied.unionByName(soon).unionByName(measured(pairs.join(soon, "late", "left_anti")))
    linked = written(found.select(F.col("late").alias("h1")).distinct().join(wanted.select("h1", "h2"), "h1").withColumn("linked", F.lit(True)), "linked")
    deleted(keyed, in_crowds, grams, rare, pairs, wanted)

    verdict = distinct.drop("keys", "length").join(linked, ["h1", "h2"], "left")
    here = F.struct("key", "text_hash", "at")
    gone = placed.select("key", "text_hash", "at", *hashed).join(verdict, ["h1", "h2"]).where(F.col("linked") | (here != F.col("first")))
    return written(gone.groupBy("key", "text_hash").agg(F.collect_set("at").alias("gone")), "gone")


def line_dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """docs with their repeated lines (see repeated_lines) taken out of the text; columns and rows stay, texts shrink.

    counts adds n_lines and n_removed. drop_emptied leaves out rows of which nothing but blank lines is left (rows that
    had no other lines stay). Null and empty texts stay as they are. Of rows equal in id and text each keeps its first
    lines, since they aren't told apart. Empty table: no rows. Ids are integers. Columns n_lines and n_removed of docs
    give way if counts is set.
    """
    key, digest, numbers, lines, left = clash_free(docs.columns, "_key", "_hash", "_gone", "_lines", "_left")
    gone = repeated_lines(docs, edits, min_chars, id_col, text_col).select(F.col("key").alias(key), F.col("text_hash").alias(digest), F.col("gone").alias(numbers))
    same = (F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1)) == gone[key]) & (F.xxhash64(docs[text_col]) == gone[digest])
    out = docs.join(gone, same, "left").drop(key, digest).withColumn(lines, F.split(F.col(text_col), "\n"))
    some = F.col(numbers).isNotNull()
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers))
    out = out.withColumn(left, F.when(some, F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")).otherwise(F.col(text_col)))
    if counts:
        out = out.withColumn("n_lines", F.coalesce(F.size(lines).cast("long"), F.lit(0))).withColumn("n_removed", F.when(some, F.size(numbers)).otherwise(0).cast("long"))
        out = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines")))
    if drop_emptied:
        out = out.where(~some | (F.trim(F.translate(left, "\n\r\t", "   ")) != ""))
    return out.withColumn(text_col, F.col(left)).drop(lines, left, numbers)
