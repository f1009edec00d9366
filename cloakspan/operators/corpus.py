"""Synthetic labelled texts, splits and token tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import spans as S
from ..functions.patterns import BIO_TAGS, HEADING_WORDS

#: The templates' texts.
FIELDS = {"full_name": "PERSON", "email": "EMAIL_ADDRESS", "phone": "PHONE_NUMBER", "bank": "CREDIT_CARD"}
SNIPPET = (("Меня зовут ", None), ("full_name", "PERSON"), (". Моя почта ", None), ("email", "EMAIL_ADDRESS"), (". Мой телефон ", None), ("phone", "PHONE_NUMBER"), (". Номер карты ", None), ("bank", "CREDIT_CARD"), (".\n", None))
ENGLISH = (("My name is ", None), ("full_name", "PERSON"), (". Email ", None), ("email", ""), (". Phone ", None), ("phone", ""), (". Card number ", None), ("bank", ""), (".\n", None))
CARD = (("ФИО: ", "full_name", "PERSON"), ("E-mail: ", "email", ""), ("Телефон: ", "phone", ""), ("Дата рождения: ", "birth_date", ""), ("Адрес: ", "address", "ADDRESS"), ("Организация: ", "company", "ORG"), ("Паспорт: ", "passport_id", ""), ("Карта: ", "bank", ""))


def from_parts(parts: list[tuple[Column, str]]) -> tuple[Column, Column]:
    """The text that the parts make, and a span for each part with a label that isn't empty."""
    text, offset, found = F.concat(*[c for c, _ in parts]), F.lit(0), []
    for k, (part, label) in enumerate(parts):
        if label:
            found.append(F.when(part != "", S.make_span(offset, offset + F.char_length(part), F.lit(label), part, F.lit(0), F.lit(k))))
        offset = offset + F.char_length(part)
    return text, F.array_compact(F.array(*found)) if found else S.empty()


def snippets(people: DataFrame, template: tuple = SNIPPET, *keep: str) -> DataFrame:
    """text and gold of the template; a field with an empty label is not marked."""
    parts = [(F.lit(x) if label is None else F.coalesce(F.col(x).cast("string"), F.lit("")), label or "") for x, label in template]
    text, gold = from_parts(parts)
    return people.select(*keep, text.alias("text"), gold.alias("gold"))


def cards(people: DataFrame, *keep: str) -> DataFrame:
    """Eight lines of prefix and value; a company made from the e-mail or the name where there is none."""
    own = people.withColumns({c: M.one_line(F.col(c).cast("string")) for c in ("full_name", "address", "birth_date")})
    company = M.first_nonempty(M.one_line(F.col("company")) if "company" in people.columns else F.lit(""), M.stable_company(M.first_nonempty(F.col("email"), F.col("full_name"))))
    own = own.withColumn("company", company)
    parts = []
    for prefix, c, label in CARD:
        parts += [(F.lit(prefix), ""), (F.coalesce(F.col(c), F.lit("")), label), (F.lit("\n"), "")]
    text, gold = from_parts(parts)
    return own.select(*keep, text.alias("text"), gold.alias("gold"))


def headings(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Heading-like texts without spans: two words for six ids of ten, else three, picked by the MD5 of the id."""
    digest = F.md5(F.col(id_col).cast("string"))
    part = lambda a: F.conv(F.substring(digest, a, 4), 16, 10).cast("long")
    word = lambda a: F.element_at(F.array(*map(F.lit, HEADING_WORDS)), (part(a) % len(HEADING_WORDS) + 1).cast("int"))
    return ids.select(id_col, F.when(part(13) % 10 < 6, F.concat_ws(" ", word(1), word(5))).otherwise(F.concat_ws(" ", word(1), word(5), word(9))).alias("text"))


def ru_records(people: DataFrame, ids: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """id, text, gold: the snippets of n people with their PERSON spans alone, and headings without spans, one for ten people, a hundred at least.

    ids: a table of one column, id, that has as many rows as there are headings to make; theirs are the ids -1 - id.
    """
    own = snippets(people, SNIPPET, id_col).withColumn("gold", F.filter("gold", lambda s: s["label"] == "PERSON"))
    wanted = ids.where(F.col("id") < max(100, n // 10))
    negative = headings(wanted).select((-1 - F.col("id")).alias(id_col), "text", S.empty().alias("gold"))
    return own.unionByName(negative)


def first_rows(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first `limit` rows in order."""
    return rows.orderBy(*order).limit(limit)


def split_head(rows: DataFrame, id_col: str, share: float, names: tuple[str, str] = ("dev", "train"), at_least: int = 1) -> DataFrame:
    """rows with split: the first share of them (one at least), by the MD5 of the id, is the first name, the rest the second.

    The limit is found from counts by the first bytes of the MD5, so that no task orders all rows. A column split of
    rows gives way.
    """
    plain = [c for c in rows.columns if c.lower() != "split"]
    own = rows.select(F.struct(*plain).alias("row"), F.md5(F.col(id_col).cast("string")).alias("h"), F.col(id_col).alias("id")).withColumn("b", F.substring("h", 1, 3))
    counts = own.groupBy("b").agg(F.count("*").alias("n"))
    before = counts.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("all"))
    placed = own.join(F.broadcast(before), "b").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", "id")))
    limit = F.greatest(F.lit(at_least), F.floor(F.col("all") * share + 1e-9))
    return placed.select("row.*", F.when(F.col("r") <= limit, names[0]).otherwise(names[1]).alias("split"))


def tokens(docs: DataFrame, pattern: str = r"(?U)\S+", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tok_idx, cs, ce, token"""
    found = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(S.find_spans(F.col(text_col), pattern, "", 0)).alias("tok_idx", "s"))
    return found.select("doc_id", "tok_idx", F.col("s.start").alias("cs"), F.col("s.end").alias("ce"), F.col("s.text").alias("token"))


def bio_tags(toks: DataFrame, entities: DataFrame, max_length: int = 512, known: tuple[str, ...] | None = BIO_TAGS) -> DataFrame:
    """doc_id, tok_idx, cs, ce, token, tag: overlap join of tokens and entities (doc_id, ent, start, end, label); a later entity wins; null: none.

    Tokens from max_length on are cut off. Tags that aren't known ones (None: all are) count as none. The joins shuffle:
    tokens are made from a few bytes each, so the planner would take them for small and send them all to the driver.
    """
    toks = toks.where(F.col("tok_idx") < max_length)
    hit = toks.alias("t").join(entities.alias("e").hint("merge"), (F.col("t.doc_id") == F.col("e.doc_id")) & (F.col("t.cs") < F.col("e.end")) & (F.col("t.ce") > F.col("e.start")))
    hit = hit.select("t.doc_id", "t.tok_idx", "e.ent", "e.label", F.row_number().over(Window.partitionBy("t.doc_id", "e.ent").orderBy("t.tok_idx")).alias("nth"))
    tagged = hit.groupBy("doc_id", "tok_idx").agg(F.max_by(F.concat(F.when(F.col("nth") == 1, "B-").otherwise("I-"), F.col("label")), "ent").alias("tag"))
    if known:
        tagged = tagged.withColumn("tag", F.when(F.col("tag").isin(*known), F.col("tag")))
    return toks.join(tagged.hint("merge"), ["doc_id", "tok_idx"], "left")


def contract(toks: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, ent, label, start, end: the tokens that lie within each entity; entities without any are gone. The join shuffles, as in bio_tags."""
    inside = toks.alias("t").join(entities.alias("e").hint("merge"), (F.col("t.doc_id") == F.col("e.doc_id")) & (F.col("t.cs") >= F.col("e.start")) & (F.col("t.ce") <= F.col("e.end")))
    return inside.groupBy("e.doc_id", "e.ent", "e.label").agg(F.min("t.cs").alias("start"), F.max("t.ce").alias("end"))


def batch_offsets(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, batch, offset: where each text begins in the concatenation of its batch of `size` consecutive ids (from 1; smaller ids are in batches before 0)."""
    batch = F.floor((F.col(id_col) - 1) / size)
    n = F.char_length(S.text_of(F.col(text_col))).cast("long")
    w = Window.partitionBy("batch").orderBy(id_col)
    return docs.select(F.col(id_col), batch.alias("batch"), n.alias("n")).select(id_col, "batch", (F.sum("n").over(w) - F.col("n")).alias("offset"))


def concatenated(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", gold_col: str = "gold") -> DataFrame:
    """batch, text, gold: the texts of each batch of batch_offsets, one after the other by id, and their spans, moved along.

    A batch is `size` texts at most, so no task gathers more than that.
    """
    own = docs.select(F.floor((F.col(id_col) - 1) / size).alias("batch"), F.struct(F.col(id_col).alias("id"), S.text_of(F.col(text_col)).alias("text"), F.col(gold_col).alias("gold")).alias("x"))
    rows = own.groupBy("batch").agg(F.array_sort(F.collect_list("x")).alias("x"))
    # Where each text begins: the sum of the lengths before it.
    starts = F.aggregate("x", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(x["text"]))))
    rows = rows.withColumn("at", starts)
    moved = lambda x, i: F.transform(x["gold"], lambda s: S.make_span(s["start"] + F.get("at", i), s["end"] + F.get("at", i), s["label"], s["text"], s["src"], s["ord"]))
    return rows.select("batch", F.array_join(F.transform("x", lambda x: x["text"]), "").alias("text"), F.flatten(F.transform("x", moved)).alias("gold"))
