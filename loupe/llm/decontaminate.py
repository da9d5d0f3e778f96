"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Words are lower-cased (A-Z) runs of ASCII letters, digits and all non-ASCII
characters. A window is ``SIZE`` consecutive words of a test item; an item of fewer
words is one window. Per window the occurrences of its test terms in all documents
are counted and its two rarest places taken; windows with a term that no document
has are done. The index stores a posting (row, term, position) for each occurrence
of those terms, and with the rarest ones also the words around it.

Lists are intersected after taking off the place of the term in its item: a posting
of the rarest term stays where the second rarest stands at the same distance as in
the item. What stays is an exact phrase match if the words around it agree with the
item over a whole window; every matched window lies in such a stretch around its own
rarest place, so the stretches together are all words hit. ``proximity`` asks the
same index for items whose terms all lie within some words of their rarest term.

Postings are linear in the text and never grouped by term; lists of frequent terms
are only read where such a term is rarest, and are split by adaptive execution. The
test terms are broadcast while their counted bytes are under ``MAX_BYTES``, else
joined by shuffle. Texts are exploded in pieces of ``PIECE`` words with the words
around them, so a long text is not copied for each of its words.

Null and empty texts have no words and are hit by nothing; null and empty items have
no window. Rows may repeat ids (each row gives one row; rows are told apart by id and
a hash of the text). Items with equal ids are one item, a null item id is ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm import common as C

SIZE, PIECE = 10, 512
MAX_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"


def _runs(of: str) -> str:
    """Runs of characters that are not ASCII or in ``of``. Each other ASCII character is listed: Java looks those up in one table, but tries ranges one by one."""
    return "[^" + "".join(f"\\x{i:02X}" for i in range(128) if chr(i) not in of) + "]+"


WORD = _runs(_DIGITS + _LOWER)
ANY_WORD = _runs(_DIGITS + _LOWER + _UPPER)  # before lower-casing


def words(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _bounded(terms: DataFrame, *cols: str) -> DataFrame:
    """``terms``, to be broadcast if their counted bytes are few."""
    size = terms.agg(F.sum(sum((F.octet_length(c) for c in cols), F.lit(40)))).first()[0] or 0
    return F.broadcast(terms) if size <= MAX_BYTES else terms.hint("merge")


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(k, item_id, words, n)`` of the different items that have words; ``k`` tells texts of one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(text).alias("words")).distinct()
    return C.keep(rows.where(F.size("words") > 0).select(F.xxhash64("item_id", "words").alias("k"), "item_id", "words", F.size("words").alias("n")))


def counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, c)``: occurrences in all documents of those terms that occur."""
    said = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return C.keep(said.join(_bounded(terms, "term"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("c")))


def _around(array: str, at: Column, before: bool, size: int = SIZE) -> Column:
    """The ``size - 1`` words before (nearest first) or after place ``at`` of an array."""
    if before:
        start = F.greatest(at - (size - 1), F.lit(0))
        return F.reverse(F.slice(array, start + 1, at - start))
    return F.slice(array, at + 2, F.lit(size - 1))


def postings(docs: DataFrame, terms: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc_id, h, term, pos, before, after)`` for each occurrence of ``terms`` (term, near); the words around it only where ``near``."""
    split = docs.select("doc_id", "h", words(F.col("text")).alias("words"))
    split = split.where(F.size("words") > 0).withColumn("base", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(PIECE))))
    lead = F.least(F.col("base"), F.lit(size - 1))
    pieces = split.select("doc_id", "h", "base", lead.alias("lead"), F.slice("words", F.col("base") - lead + 1, lead + PIECE + size - 1).alias("piece"))
    said = pieces.select("*", F.posexplode("piece").alias("at", "term")).where((F.col("at") >= F.col("lead")) & (F.col("at") < F.col("lead") + PIECE))
    found = said.join(_bounded(terms, "term"), "term")
    side = lambda before: F.when(F.col("near"), _around("piece", F.col("at"), before, size))
    return found.select("doc_id", "h", "term", (F.col("base") + F.col("at") - F.col("lead")).alias("pos"),
                        side(True).alias("before"), side(False).alias("after"))


def _agree(a: str, b: str) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def rarest_places(items: DataFrame, found: DataFrame, size: int = SIZE) -> DataFrame:
    """``(k, a1, t1, a2, t2)``: place and term of the rarest and second rarest word of each window that may occur; no second in windows of one word."""
    width = F.least(F.col("n"), F.lit(size))
    spans = items.select("k", "words", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("s"))
    each = spans.select("k", "s", F.posexplode(F.slice("words", F.col("s") + 1, F.col("width"))).alias("j", "term"))
    each = each.join(found, "term", "left").select("k", "s", F.struct(F.coalesce("c", F.lit(0)).alias("c"), (F.col("s") + F.col("j")).alias("a"), "term").alias("w"))
    order = each.groupBy("k", "s").agg(F.sort_array(F.collect_list("w")).alias("w")).where(F.col("w")[0]["c"] > 0)  # size words at most
    second = F.when(F.size("w") > 1, F.col("w")[1])
    return order.select("k", F.col("w")[0]["a"].alias("a1"), F.col("w")[0]["term"].alias("t1"),
                        second["a"].alias("a2"), second["term"].alias("t2")).distinct()


_ROW = ("doc_id", "h")


def _same(a: DataFrame, b: DataFrame, *cols: str) -> Column:
    on = a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])
    for c in cols:
        on = on & (a[c] == b[c])
    return on


def phrases(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc_id, h, item_id, start, end)``: stretches of document words that repeat a window or more of an item, word for word."""
    found = counts(docs, items.select(F.explode("words").alias("term")).distinct())
    places = C.keep(rarest_places(items, found, size))
    firsts = places.select(F.col("t1").alias("term"), F.lit(True).alias("near"))
    terms = firsts.union(places.where("t2 IS NOT NULL").select("t2", F.lit(False))).groupBy("term").agg(F.max("near").alias("near"))
    index = C.keep(postings(docs, C.keep(terms), size))

    ends = places.groupBy("k", "a1", "t1").agg(F.max(F.col("a2").isNull()).alias("alone")).join(items, "k").select(
        "k", "item_id", "n", "a1", "alone", F.col("t1").alias("term"),
        _around("words", F.col("a1"), True, size).alias("i_before"), _around("words", F.col("a1"), False, size).alias("i_after"))
    one = index.where("before IS NOT NULL").join(_bounded(C.keep(ends), "term", "item_id"), "term").withColumn("diagonal", F.col("pos") - F.col("a1"))
    seconds = places.where("a2 IS NOT NULL").select("k", "a1", "a2", F.col("t2").alias("term"))
    two = index.select("doc_id", "h", "term", "pos").join(_bounded(C.keep(seconds), "term"), "term").select(
        "doc_id", "h", "k", "a1", (F.col("pos") - F.col("a2")).alias("diagonal"))
    both = one.join(two.hint("merge"), _same(one, two, "k", "a1", "diagonal"), "left_semi").unionByName(one.where("alone"))
    left, right = _agree("before", "i_before"), _agree("after", "i_after")
    exact = both.withColumn("l", left).withColumn("r", right).where(F.col("l") + F.col("r") + 1 >= F.least(F.col("n"), F.lit(size)))
    return exact.select(*_ROW, "item_id", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r") + 1).alias("end"))


def proximity(docs: DataFrame, items: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text",
              item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, places, first)`` of documents that hold all terms of an item, in any order, within ``within`` words of its rarest term.

    ``places`` counts the occurrences of the rarest term with all others that near, ``first`` is the first one's position.
    """
    C.prepare(docs.sparkSession)
    rows, its = _rows(docs, id_col, text_col), _items(items, item_id, item_text)
    need = C.keep(its.select("k", "item_id", F.explode(F.array_distinct("words")).alias("term")))
    found = counts(rows, need.select("term").distinct())
    known = need.join(found, "term", "left").groupBy("k", "item_id").agg(
        F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "term")).alias("rare"), F.count(F.lit(1)).alias("terms")).where(F.col("rare.c") > 0)
    known = C.keep(known.select("k", "item_id", F.col("rare.term").alias("rare"), "terms"))
    asked = C.keep(need.join(known.select("k", "rare"), "k").select("k", "term", (F.col("term") == F.col("rare")).alias("is_rare")))
    index = C.keep(postings(rows, asked.select("term", F.lit(False).alias("near")).distinct()).select(*_ROW, "term", "pos"))
    held = C.keep(index.join(_bounded(asked, "term"), "term").distinct())
    span = max(1, within)
    cell = F.floor(F.col("pos") / span)
    rare = held.where("is_rare").select(*_ROW, "k", F.col("pos").alias("p"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    rest = held.where("NOT is_rare").select(*_ROW, "k", "term", "pos", cell.alias("cell"))
    met = rare.join(rest.hint("merge"), _same(rare, rest, "k", "cell")).where(F.abs(F.col("p") - F.col("pos")) <= within)
    met = met.select(rare["doc_id"], rare["h"], rare["k"], "p", "term").distinct().groupBy(*_ROW, "k", "p").agg(F.count(F.lit(1)).alias("others"))
    alone = held.where("is_rare").select(*_ROW, "k", F.col("pos").alias("p"), F.lit(0).cast("long").alias("others"))
    full = met.unionByName(alone).join(known, "k").where(F.col("others") == F.col("terms") - 1)
    return full.groupBy(*_ROW, "item_id").agg(F.countDistinct("p").alias("places"), F.min("p").cast("long").alias("first")).drop("h")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, spans)`` per row of ``docs``: items sorted as strings, spans (start, end) of words hit, ends excluded."""
    C.prepare(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    hits = phrases(rows, _items(items, item_id, item_text), size)
    # what one document holds of the items: never more than its own words allow
    per = C.keep(hits.groupBy(*_ROW).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("parts")))
    joined = F.aggregate("parts", F.expr("CAST(array() AS array<struct<start:int,end:int>>)"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["end"] >= x["start"]),
        F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["start"].alias("start"),
            F.greatest(F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["end"], x["end"]).alias("end"))))
    ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    per = per.select(*_ROW, "items", joined.alias("spans"))
    sized = rows.select("doc_id", "h", F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"))
    out = sized.join(per.hint("merge"), _same(sized, per), "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select(sized["doc_id"], "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
                      F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:int,end:int>>)")).alias("spans"))


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    """Windows of all ``benchmark`` items in all whole texts of ``documents``."""
    found = contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _sql_words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{C.WORD_SQL}')"


SQL = {"op13_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_sql_words("text")} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_sql_words("text")} AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), {SIZE}) AS size, array_to_string(w[s + 1:s + least(len(w), {SIZE})], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(0, len(w) - least(len(w), {SIZE}) + 1)) AS s FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d),
m AS (SELECT DISTINCT p.r, p.i, v.size, v.item FROM p, (SELECT DISTINCT size FROM v) z, v
  WHERE p.i + z.size <= len(p.w) AND v.size = z.size AND v.phrase = array_to_string(p.w[p.i + 1:p.i + z.size], ' ')),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS x FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""}
