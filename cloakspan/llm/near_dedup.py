"""Near-duplicate documents by a chosen-path set similarity join.

Each text is a set of word shingles, and texts with equal sets are one class. In each of a number of independent trees
the classes are branched by the least value that a chosen minwise hash gives their shingles: a class goes down the path
of the tokens chosen at each node. Nodes that are still large choose again (one coordinate, sometimes two, so that a
similar pair is expected to stay together along one path a level); the pairs of small nodes are compared exhaustively,
on a 2-bit minwise sketch, and those that may be similar enough are confirmed on the full sets. Nodes that stay large
to the last level hold near copies of a text. A class that isn't tied to most others there meets those with which it
shares enough of what tells it from a class amid them, found by what the others have beyond that class.

Before that, each class is compared with a pivot or two of its nodes, that which is nearest to a sample of the node among
them, and the nearest is confirmed: copies of a text are tied by as many pairs as there are copies, though they may not
be similar enough to each other. Links are merged to components; pairs
that confirmed links already tie are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mixed, rolled, stretches, words_of
from .shared import deleted, small_enough, written

COORDINATES = 64
#: Of 64 two-bit coordinates, as many may differ: at similarity 0.8, 9.6 do on average (0.2 of which a quarter agree by chance), deviation 2.9.
SKETCH_APART = 25


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, the distinct hashes of k running words, A to Z lower-cased; of the whole if there are fewer; none without words."""
    words = words_of(texts, fold=True)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        own = words.hashes[a:b]
        yield np.unique(rolled(own, k)) if len(own) >= k else rolled(own, len(own), 100 + len(own)) if len(own) else own


_FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64), 7) | np.uint64(1)


def _minima(found: np.ndarray) -> np.ndarray:
    """For each coordinate, the least 32-bit hash of the set's shingles."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(found), 4096):
            x = found[a : a + 4096, None] * _FACTORS[None, :]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
            out = np.minimum(out, x.min(axis=0))
    return out


def _print_of(found: np.ndarray, seed: int) -> int:
    """A 64-bit hash of the set."""
    with np.errstate(over="ignore"):
        total = found.sum() + mixed(found, seed).sum() * np.uint64(3) + np.uint64(len(found))
    return int(mixed(np.array([total]), seed)[0].view(np.int64))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches):
            n, c, c2, mh, s1, s2 = [], [], [], [], [], []
            for found in shingle_sets(batch.column(2), k):
                n.append(len(found))
                if not len(found):
                    c.append(None), c2.append(None), mh.append(None), s1.append(None), s2.append(None)
                    continue
                c.append(_print_of(found, 3))
                c2.append(_print_of(found, 9))
                least = _minima(found)
                two = (mixed(least, 11) & np.uint64(3)) << (np.arange(COORDINATES, dtype=np.uint64) % np.uint64(32) * np.uint64(2))
                mh.append(least.astype(np.uint32).view(np.int32))
                s1.append(int(np.bitwise_or.reduce(two[:32]).view(np.int64)))
                s2.append(int(np.bitwise_or.reduce(two[32:]).view(np.int64)))
            own = [pa.array(x, t) for x, t in ((n, pa.int64()), (c, pa.int64()), (c2, pa.int64()), (mh, pa.list_(pa.int32())), (s1, pa.int64()), (s2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], ["id", "text_hash", "n", "c", "c2", "mh", "s1", "s2"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches):
            own = [x.view(np.int64) for x in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["c", "shingles"])

    return run


def _differ(a: Column, b: Column) -> Column:
    """In how many of 32 coordinates the halves of two sketches differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _apart() -> Column:
    """In how many coordinates the sketches of a and b differ."""
    return _differ(F.col("a.s1"), F.col("b.s1")) + _differ(F.col("a.s2"), F.col("b.s2"))


def _may_link(least: float) -> Column:
    return (F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n")) & (_apart() <= SKETCH_APART)


def _pair() -> list[Column]:
    return [F.greatest("a.c", "b.c").alias("u"), F.least("a.c", "b.c").alias("v"), _apart().alias("apart")]


#: So many classes of a large node show how near to the others a class is.
SHOWN = 16
#: So many sets are broadcast at most; beyond it the same join shuffles.
FEW_SETS = 256
#: Longs of the parities that tell classes of a crowd apart.
PARITIES = [f"q{k}" for k in range(8)]


def told_apart(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """signed and its classes, as tables: rows of equal sets have the same c, all others another one.

    A set has two hashes, c and c2. Where sets that differ in c2 agree in c, c is made anew of both; then a class is
    told from others by all 128 bits.
    """
    while True:
        own = [F.min(x).alias(x) for x in ("n", "s1", "s2", "mh", "c2")]
        classes = signed.where("c is not null").groupBy("c").agg(F.min("id").alias("least"), F.min(F.struct("id", "text_hash")).alias("rep"), F.max("c2").alias("top"), *own)
        classes = written(classes, "classes")
        clash = classes.where("c2 <> top").select(F.col("c").alias("clash"))
        if clash.isEmpty():
            return signed, classes
        new = F.when(F.col("clash").isNull(), F.col("c")).otherwise(F.xxhash64("c", "c2"))
        before, signed = signed, written(signed.join(small_enough(clash), F.col("c") == F.col("clash"), "left").withColumn("c", new).drop("clash"), "signatures")
        deleted(before, classes)


def branched(classes: DataFrame, trees: int, leaf: int, levels: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The small nodes of all trees, and the large ones that are left at the last level: c, n, s1, s2, tree, node, size; and the tables they are in."""
    slim = [F.col(x) for x in ("c", "n", "s1", "s2")]
    start = classes.select(*slim, F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.get("mh", F.lit(t * 37 % COORDINATES))).alias("node")) for t in range(trees)])).alias("x"))
    now, small, tables = start.select(*slim, "x.tree", "x.node"), None, []
    for level in range(1, levels + 1):
        now = written(now, "nodes")
        sizes = now.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        sized = written(now.join(sizes, "node"), "sized")
        deleted(now)
        tables.append(sized)
        few = sized.where(F.col("size") <= leaf)
        small = few if small is None else small.unionByName(few)
        large = sized.where(F.col("size") > leaf)
        if level == levels or large.isEmpty():
            return small, large, tables
        # The node chooses its next coordinate, and one in four nodes a second one.
        choose = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDINATES)).cast("int")  # noqa: E731, B023
        down = lambda k: F.struct(F.xxhash64("node", F.lit(k), F.get("mh", choose(k))).alias("node"))  # noqa: E731, B023
        both = F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(4)) == 0
        deep = large.drop("size").join(classes.select("c", "mh"), "c").withColumn("x", F.explode(F.when(both, F.array(down(0), down(1))).otherwise(F.array(down(0)))))
        now = deep.select("c", "n", "s1", "s2", "tree", "x.node")


def with_centres(large: DataFrame) -> DataFrame:
    """large with far: the distance of each class to SHOWN classes of its node. Copies of a text lie around it: it is the least far."""
    own = F.struct("s1", "s2")
    at = F.pmod(F.xxhash64("c", "node"), F.lit(SHOWN)).cast("int")
    shown = large.groupBy("node", at.alias("at")).agg(F.min(F.struct(F.xxhash64("c", F.lit(1)).alias("h"), own.alias("x"))).alias("m")).groupBy("node").agg(F.collect_list("m.x").alias("shown"))
    return large.join(shown, "node").withColumn("far", F.aggregate("shown", F.lit(0), lambda acc, x: acc + _differ(F.col("s1"), x["s1"]) + _differ(F.col("s2"), x["s2"]))).drop("shown")


def to_pivots(nodes: DataFrame, pivots: int, least: float) -> DataFrame:
    """u, v: for each class its nearest pivot, of those of its nodes, if there is one that may be similar enough.

    Pivots are the class that is least far, if nodes have that column, and others by a hash.
    """
    own = [F.col(x) for x in ("c", "n", "s1", "s2")]
    first = F.col("far").cast("long") if "far" in nodes.columns else F.xxhash64("c", "node", F.lit(0))
    picked = nodes.groupBy("node").agg(F.array(*[F.min(F.struct((first if p == 0 else F.xxhash64("c", "node", F.lit(p))).alias("h"), *own)) for p in range(pivots)]).alias("p"))
    picked = picked.select(F.col("node").alias("pivot_node"), F.explode("p").alias("b")).select("pivot_node", "b.*")
    met = nodes.alias("a").join(picked.alias("b"), (F.col("a.node") == F.col("b.pivot_node")) & (F.col("a.c") != F.col("b.c")) & _may_link(least))
    return met.select(F.col("a.c").alias("u"), F.struct(_apart().alias("apart"), F.col("b.c").alias("v")).alias("x")).groupBy("u").agg(F.min("x").alias("x")).select("u", "x.v")


def in_small_nodes(small: DataFrame, least: float) -> DataFrame:
    """u > v, apart: the pairs of classes that share a small node, aren't tied (have another root) and whose sketches are near."""
    apart = (F.col("a.root") != F.col("b.root")) & _may_link(least)
    return small.alias("a").join(small.alias("b"), (F.col("a.node") == F.col("b.node")) & (F.col("a.c") < F.col("b.c")) & apart).select(*_pair())


def crowds(large: DataFrame) -> DataFrame:
    """g, c, n, s1, s2, root: the classes of large nodes by g, the root that most of a node have."""
    most = large.groupBy("node", "root").agg(F.count("*").alias("m")).groupBy("node").agg(F.max_by("root", F.struct("m", "root")).alias("g"))
    return large.join(most, "node").groupBy("g", "c").agg(*[F.min(x).alias(x) for x in ("n", "s1", "s2", "root")])


def set_apart(members: DataFrame) -> DataFrame:
    """members (of crowds(), with their shingles) with p, n_p and differs: the shingles that a class has and p hasn't, or p has and it hasn't.

    p is a class of root g: that which is nearest to what most of SHOWN classes of the crowd have, if copies of a text
    their original. What few others differ in comes first.
    """
    at = F.pmod(F.xxhash64("c"), F.lit(SHOWN)).alias("at")
    shown = members.groupBy("g", at).agg(F.min_by("shingles", F.xxhash64("c", F.lit(1))).alias("shingles"))
    half = shown.groupBy("g").agg((F.count("*") / 2).alias("half"))
    usual = shown.select("g", F.explode("shingles").alias("e")).groupBy("g", "e").agg(F.count("*").alias("k")).join(half, "g").where("k >= half").groupBy("g").agg(F.collect_list("e").alias("usual"))
    usual = small_enough(written(usual, "usual"), FEW_SETS)
    far = F.size(F.array_except("shingles", "usual")) + F.size(F.array_except("usual", "shingles"))
    none = F.array().cast("array<long>")
    centred = members.where("root = g").join(usual, "g", "left").withColumn("usual", F.coalesce("usual", none))
    amid = centred.select("g", "c", far.alias("far")).groupBy("g").agg(F.min(F.struct("far", "c")).alias("x")).select("g", F.col("x.c").alias("c"))
    amid = centred.join(small_enough(written(amid, "amid"), FEW_SETS), ["g", "c"], "left_semi").select("g", F.col("c").alias("p"), F.col("shingles").alias("of_p"), "usual")
    both = members.join(small_enough(written(amid, "amid-sets"), FEW_SETS), "g").withColumn("extra", F.array_except("shingles", "of_p"))
    differs = F.concat(F.array_except("extra", "usual"), F.array_except("of_p", "shingles"), F.array_intersect("extra", "usual"))
    told = both.select("g", "p", "c", "n", "s1", "s2", "root", F.size("of_p").cast("long").alias("n_p"), differs.alias("differs"))
    return told.select("*", _parities().alias("parities")).select("*", "parities.*").drop("parities")


def _parities() -> Column:
    """For each of 512 classes of shingles, whether the number of those in differs is odd, a bit each in columns PARITIES.

    A shingle that one of two classes has and the other hasn't changes one bit, so the bits that differ are no more than those.
    """
    at = f"transform(differs, e -> CAST(pmod(xxhash64(e, 1), {64 * len(PARITIES)}) AS int))"
    start = ", ".join(f"'{q}', 0L" for q in PARITIES)
    flip = ", ".join(f"'{q}', acc.{q} ^ IF(x div 64 = {k}, shiftleft(1L, x % 64), 0L)" for k, q in enumerate(PARITIES))
    return F.expr(f"aggregate({at}, named_struct({start}), (acc, x) -> named_struct({flip}))")


def _may_link_in_crowd(percent: int) -> Column:
    """Whether what a and b differ in, of which their parities show a part at least, is little enough; no linked pair is denied."""
    shown = sum((F.bit_count(F.col(f"a.{q}").bitwiseXOR(F.col(f"b.{q}"))) for q in PARITIES), F.lit(0))
    return shown * (100 + percent) <= (100 - percent) * (F.col("a.n") + F.col("b.n"))


def in_crowds(apart: DataFrame, percent: int) -> DataFrame:
    """u > v, apart: pairs of classes of a crowd that aren't tied, among them all that are linked and have near sketches. apart: of set_apart().

    Say D is what a class differs in from p, and r is (100 - percent) / (100 + percent): classes i and j are linked if
    |D_i| + |D_j| - 2 |D_i and D_j| <= r (n_i + n_j). A class i that isn't linked to p has |D_i| > r (n_i + n_p), so it
    shares more than s = (|D_j| + r (n_p - n_j)) / 2 with each j that it is linked to: D_i meets any |D_j| - floor(s) of
    D_j. Of two classes that aren't tied one at least isn't tied to p; it is linked to p, which ties it, or is such an i.
    Those that meet are many, as classes that aren't linked share some of D too; the parities of D deny most of them.
    """
    sized = apart.withColumn("d", F.size("differs").cast("long"))
    own = ["g", "c", "n", "s1", "s2", "root", *PARITIES]
    loose, to_p = F.col("root") != F.col("g"), F.col("d") * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("n_p"))
    free = sized.where(loose & ~to_p).select(*own, F.explode("differs").alias("e"))
    floor = F.expr(f"(d * {100 + percent} + {100 - percent} * (n_p - n)) div {2 * (100 + percent)}")
    met = sized.select(*own, F.explode(F.slice("differs", F.lit(1), (F.col("d") - floor).cast("int"))).alias("e"))
    near = (F.col("a.g") == F.col("b.g")) & (F.col("a.e") == F.col("b.e")) & (F.col("a.root") != F.col("b.root")) & _may_link(percent / 100) & _may_link_in_crowd(percent)
    pairs = free.alias("a").join(met.alias("b"), near).select(*_pair())
    tied = sized.where(loose & to_p).select(F.greatest("c", "p").alias("u"), F.least("c", "p").alias("v"), F.lit(0).cast("int").alias("apart"))
    return pairs.unionByName(tied)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = pairs.join(sets.select(F.col("c").alias("u"), F.col("shingles").alias("a")), "u")
    two = one.join(sets.select(F.col("c").alias("v"), F.col("shingles").alias("b")), "v")
    same = two.select("u", "v", F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("sum"))
    return same.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("sum") - F.col("both"))).select("u", "v")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 14, leaf: int = 12, levels: int = 6, pivots: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, text_hash, n_shingles, component_id, kept, copies.

    Two texts are linked if 100 * shared shingles >= percent * all their shingles; component_id is the smallest id
    that links lead to, its own included, and kept whether the id is that one. copies: rows equal in id and text.
    Null or empty texts, and those without words, have no shingles and are linked with nothing. A null id is in its
    component but never its smallest unless all are null; it is kept then (a null component_id). Repeated rows: a row
    each. Empty table: no rows. Other columns are ignored. Texts of any length count whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = texts.mapInArrow(_signatures(k), f"id {kind}, text_hash long, n long, c long, c2 long, mh array<int>, s1 long, s2 long")
    signed, classes = told_apart(written(signed, "signatures"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets of the classes c, each by one of its texts."""
        needed = small_enough(written(wanted.distinct().join(classes.select("c", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")), "c"), "needed"))
        own = texts.join(needed, texts["id"].eqNullSafe(needed["rep_id"]) & (texts["text_hash"] == needed["rep_hash"])).select("c", "text")
        return written(own.mapInArrow(_sets(k), "c long, shingles array<long>").dropDuplicates(["c"]), "sets")

    both = lambda pairs: pairs.select(F.explode(F.array("u", "v")).alias("c"))
    small, large, nodes = branched(classes, trees, leaf, levels)
    # In each node, a class and its nearest pivot.
    centred = written(with_centres(large), "centred")
    early = to_pivots(small, 1, percent / 100).unionByName(to_pivots(centred, pivots, percent / 100))
    early = written(early.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "early")
    known = sets_of(both(early))
    tied = components(_confirmed(early, known, percent))
    roots = small_enough(tied.select(F.col("u").alias("c"), F.col("v").alias("root")))
    rooted = lambda nodes: nodes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    missing = lambda found, sets: sets_of(found.join(sets.select("c"), "c", "left_anti"))
    members = written(crowds(rooted(centred)), "members")
    more_sets = missing(members.select("c"), known)
    sets = known.unionByName(more_sets)
    full = written(members.join(sets, "c"), "member-sets")
    apart = written(set_apart(full), "apart")
    pairs = written(in_small_nodes(rooted(small), percent / 100).unionByName(in_crowds(apart, percent)).distinct(), "pairs")
    last_sets = missing(both(pairs), sets)
    sets = sets.unionByName(last_sets)
    # First, for each class, its nearest pair upwards: most of the other pairs are then within a component and need no look.
    nearest = pairs.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("x")).select("u", "x.v")
    joined = components(_confirmed(nearest, sets, percent).unionByName(tied))
    rest = pairs.join(joined.select("u", F.col("v").alias("u_root")), "u", "left").withColumn("u_root", F.coalesce("u_root", "u"))
    rest = rest.join(joined.select(F.col("u").alias("v"), F.col("v").alias("v_root")), "v", "left").withColumn("v_root", F.coalesce("v_root", "v"))
    rest = written(rest.where("u_root <> v_root").select("u", "v", "u_root", "v_root"), "rest")
    # What links of the others tie together are components, so their graph is small.
    more = components(_confirmed(rest, sets, percent).join(rest, ["u", "v"]).select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).distinct())
    tops = joined.join(more.select(F.col("u").alias("v"), F.col("v").alias("top")), "v", "left").select("u", F.coalesce("top", "v").alias("v"))
    roots = tops.unionByName(more).dropDuplicates(["u"])

    rooted_classes = classes.select("c", "least").join(roots.select(F.col("u").alias("c"), F.col("v").alias("root")), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = rooted_classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = written(rooted_classes.join(least, "root").select("c", "component_id"), "components")
    deleted(classes, *nodes, centred, early, known, tied, members, more_sets, full, apart, pairs, last_sets, joined, rest, more)
    copies = signed.groupBy("id", "text_hash").agg(F.count("*").alias("copies")).where("copies > 1")
    out = signed.select("id", "text_hash", F.col("n").alias("n_shingles"), "c").join(of_class, "c", "left")
    out = out.withColumn("component_id", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")))
    out = out.join(copies.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "copies"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select(F.col("id").alias(id_col), "text_hash", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("copies", F.lit(1)).alias("copies"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with one row of each component (the one with the smallest id; of rows equal in id and text, one); columns stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **kw)
    stay = written(found.where("kept").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), "copies", "n_shingles").distinct(), "stay")
    same = docs[id_col].eqNullSafe(stay["_id"]) & (F.xxhash64(docs[text_col]) == stay["_hash"])
    single = docs.join(stay.where("copies = 1 or n_shingles = 0"), same, "left_semi")
    several = docs.join(stay.where("copies > 1 and n_shingles > 0"), same, "left_semi")
    if several.isEmpty():
        return single
    return single.unionByName(several.dropDuplicates([id_col, text_col]))
