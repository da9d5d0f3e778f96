"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of ``block`` bytes. The distinct blocks are dealt by hash,
sorted within each part and numbered: a block's name is its part and its place there,
so nothing is sampled to the driver. Then the names of adjacent
blocks are paired, the distinct pairs sorted and numbered again, until one name
per document is left. Equal name and equal length mean equal text; nothing is
compared by a fingerprint, so there are no collisions.

The first round names the leading block alone, together with the text's length:
a document whose (length, leading block) no other has is identified by that, and
only the others go on to further blocks. Distinct blocks and pairs are
aggregated before they are shuffled, so a text in a third of all rows costs a
row per task; the joins that hand names back are sort-merge joins of written
tables at every size (no side has a bound to broadcast by), which adaptive
execution splits where a name is frequent.

Null texts count as empty; empty texts are equal. Of equal texts the row with
the largest ``doc_id`` stays (null is smallest). Rows that repeat id and text
alike count in ``group_size``; one of them is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm import common as C

BLOCK, LEAD = 2048, 64


def _names(df: DataFrame, *cols: str) -> DataFrame:
    """The distinct values of ``cols``, sorted within the parts that they are dealt to, with part and place as ``name``."""
    return C.keep(df.select(*cols).distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id()))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw")).select(
        "doc_id", "raw", F.xxhash64("raw").alias("h"), F.octet_length("raw").cast("long").alias("n"),
        F.substring("raw", 1, LEAD).alias("lead"))


def identities(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, h, n, name)``: the identity (n, name) of each text that may have an equal.

    ``(doc_id, h)`` only tells rows apart; it plays no part in an identity.
    """
    ties = C.keep(rows.groupBy("n", "lead").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    tied = rows.join(ties.hint("merge"), ["n", "lead"], "left_semi")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / block) - 1, F.lit(0)).cast("int")),
                      lambda i: F.struct(i.alias("i"), F.substring("raw", i * block + 1, F.lit(block)).alias("c")))
    blocks = C.keep(tied.select("doc_id", "h", "n", F.explode(cut).alias("b")).select("doc_id", "h", "n", "b.i", "b.c"))
    level = C.keep(blocks.join(_names(blocks, "c").hint("merge"), "c").select("doc_id", "h", "n", "i", "name"))
    longest = blocks.agg(F.max("n")).first()[0] or 0
    width, done = block, []
    while True:
        done.append(level.where(F.col("n") <= width))
        if longest <= width:
            break
        pairs = C.keep(level.where(F.col("n") > width).groupBy("doc_id", "h", "n", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")))
        level = C.keep(pairs.join(_names(pairs, "a", "b").hint("merge"), ["a", "b"]).select("doc_id", "h", "n", "i", "name"))
        width *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return C.keep(out.select("doc_id", "h", "n", "name").distinct())


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, h)`` per row of ``docs``."""
    rows = _rows(docs, id_col, text_col)
    ids = identities(rows, block)
    all_rows = rows.select("doc_id", "h", F.sha2("raw", 256).alias("text_sha256"))
    named = all_rows.join(ids.hint("merge"), _same_row(all_rows, ids), "left").select(all_rows["*"], ids["n"], ids["name"])
    first = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("text_sha256"))
    named = C.keep(named.withColumn("first", first == 1))
    groups = C.keep(named.where(F.col("name").isNotNull()).groupBy("n", "name").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    out = named.join(groups.hint("merge"), ["n", "name"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      (F.col("doc_id").eqNullSafe(keep_id) & F.col("first")).alias("kept"), "text_sha256", "h")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stay."""
    h = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    stay = C.keep(find_copies(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")))
    rows = docs.withColumn("__rh", h)
    cols = docs.columns
    found = rows.join(stay.hint("merge"), rows["doc_id"].eqNullSafe(stay["__id"]) & (rows["__rh"] == stay["__h"]), "left_semi")
    return found.dropDuplicates(["doc_id", "__rh"]).select(*cols)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Copies among all whole texts of ``documents``."""
    return find_copies(C.table(spark, sf_dir, "documents")).drop("h")


SQL = {"op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""}
