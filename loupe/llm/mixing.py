"""Mixing sources to target weights, by hierarchical budgets.

A token budget is handed down a tree (domain, language, source). Below each node
its children share its budget by their weights; a child that cannot use its
share (all its tokens times ``max_epochs`` are fewer) takes what it has, and its
siblings share the rest by their weights. As no node is given more than its
descendants can use, a shortage is made up among siblings, and reaches the next
ancestor's siblings only if a whole subtree is short.

A leaf repeats its rows in full epochs; of the last one it takes the token
prefix, in the order of a seeded hash of id, text and epoch. Rows are only ranked where the
prefix ends: sums per leaf and hash prefix find the slice, and the running sum is
taken within that slice alone (1/4096 of a leaf).

Tokens are runs of characters other than blank, tab and line ends; a null or
empty text has none and is taken with the full epochs and, in a part epoch, as
the prefix reaches it. Null path values are a child of their own; weights that
are not given are 1, as are null ones. A child of weight 0 is left out with all below
it: it gives no rows, and its tokens count nowhere as usable. Budgets are rounded
down to tokens. Rows that repeat id and text alike are taken one by one: where the
prefix ends among them, as many as still fit, those of the first scan parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm import common as C
from loupe.llm.merkle import number

SLICE = 3  # hex digits of the order that tell slices apart
# fixed parameters of the registered query: weights by level, share of the budget, epochs, seed
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "language": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
SHARE, MAX_EPOCHS, SEED = 0.75, 3, 17


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _weight(column: str, given: dict) -> Column:
    out = F.lit(1).cast("long")
    for value, w in given.items():
        out = F.when(F.col(column) == f"={value}", F.lit(int(w)).cast("long")).otherwise(out)
    return out


def _left_out(weights: dict, levels: tuple[str, ...], path: list[str]) -> Column:
    """Whether a node on the path has weight 0."""
    return F.array_contains(F.array(*(_weight(c, weights.get(level) or {}) for c, level in zip(path, levels))), F.lit(0).cast("long"))


def budgets(leaves: DataFrame, weights: dict, budget: int, max_epochs: int, levels: tuple[str, ...], path: list[str]) -> DataFrame:
    """``(path..., budget)``: the tokens each of the leaves (path..., tokens) is to give.

    ``path`` names the columns, ``levels`` the entries of ``weights``, root to leaf.
    """
    big = "decimal(38,0)"
    above = None
    leaves = leaves.withColumn("tokens", F.when(_left_out(weights, levels, path), 0).otherwise(F.col("tokens")))
    for i, (column, level) in enumerate(zip(path, levels)):
        nodes = leaves.groupBy(*path[:i + 1]).agg((F.sum("tokens") * max_epochs).alias("cap"))
        nodes = nodes.withColumn("w", _weight(column, weights.get(level) or {}))
        if above is None:
            nodes = nodes.withColumn("given", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(above.withColumnRenamed("budget", "given"), path[:i])
        by = Window.partitionBy(*path[:i]) if i else Window.partitionBy(F.lit(0))
        per_weight = F.when(F.col("w") > 0, F.col("cap") / F.greatest("w", F.lit(1))).otherwise(0)
        before = by.orderBy(per_weight, column).rowsBetween(Window.unboundedPreceding, -1)
        nodes = (nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
                 .withColumn("w_left", F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0)))
                 .withColumn("full", F.col("cap").cast(big) * F.col("w_left") <= F.col("w").cast(big) * (F.col("given") - F.col("cap_before")))
                 .withColumn("used", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by))
                 .withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(by)))
        share = F.expr("CAST((CAST(w AS DECIMAL(19,0)) * CAST(given - used AS DECIMAL(19,0))) DIV CAST(greatest(w_open, 1) AS DECIMAL(19,0)) AS BIGINT)")
        above = nodes.select(*path[:i + 1], F.when(F.col("full"), F.col("cap")).otherwise(share).alias("budget"))
    return above


def select(docs: DataFrame, path: dict[str, Column], weights: dict, share: float, max_epochs: int, seed: int,
           id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``(doc_id, path..., tokens, copies)`` per row: copies is how often the mix holds it.

    ``path`` names the levels, root to leaf, by columns of ``docs``. With
    ``carry`` the whole input row comes along as the struct ``row``.
    """
    C.prepare(docs.sparkSession)
    levels, names = tuple(path), [f"p{i}" for i in range(len(path))]
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias(n) for n, c in zip(names, path.values())],
                       tokens(text_col).alias("tokens"),
                       F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"),
                       *([F.struct(*docs.columns).alias("row")] if carry else []))
    slim = C.keep(rows.select("doc_id", *names, "tokens", "th"))
    leaves = C.keep(slim.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    left_out = _left_out(weights, levels, names)
    total, usable = (int(x or 0) for x in leaves.agg(F.sum("tokens"), F.sum(F.when(~left_out, F.col("tokens")))).first())
    plan = budgets(leaves, weights, min(int(total * share), usable * max_epochs), max_epochs, levels, names)
    plan = plan.join(leaves, names).withColumn(
        "epochs", F.when(F.col("tokens") > 0, F.expr("budget DIV greatest(tokens, 1)")).otherwise(0).cast("int"))
    plan = C.keep(plan.select(*names, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest")))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))

    def ordered(df: DataFrame) -> DataFrame:
        return (df.join(plan, names).withColumn("order", order)
                .withColumn("slice", F.substring("order", 1, SLICE)))

    marked = ordered(slim)
    sums = marked.groupBy(*names, "slice", "rest").agg(F.sum("tokens").alias("s"))
    upto = Window.partitionBy(*names).orderBy("slice")
    ends = C.keep(sums.withColumn("upto", F.sum("s").over(upto)).where(F.col("upto") > F.col("rest"))
                  .groupBy(*names).agg(F.min(F.struct("slice", (F.col("upto") - F.col("s")).alias("b"))).alias("e"))
                  .select(*names, F.col("e.slice").alias("end"), F.col("e.b").alias("before")))
    last = marked.join(ends, names).where(F.col("slice") == F.col("end"))
    # equal rows are one row of the running sum: all those before the place where it passes the budget, and of those there as many as fit
    alike = last.groupBy(*names, "order", "th", "rest", "before").agg(F.count(F.lit(1)).alias("rows"), F.max("tokens").alias("tokens"))
    running = Window.partitionBy(*names).orderBy("order", "th").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("at", F.coalesce(F.sum(F.col("rows") * F.col("tokens")).over(running), F.lit(0)) + F.col("before"))
    fits = F.when(F.col("tokens") > 0, F.expr("greatest(rest - at, 0L) DIV greatest(tokens, 1L)")).otherwise(F.col("rows"))
    place = F.struct("order", "th")
    stops = (alike.withColumn("fit", F.least("rows", fits)).where((F.col("at") <= F.col("rest")) & (F.col("fit") > 0)).groupBy(*names)
             .agg(F.max(place).alias("stop"), F.max_by("fit", place).alias("fit"), F.max_by("rows", place).alias("rows")))
    cuts = C.keep(ends.join(stops, names, "left").select(*names, "end", "stop", "fit", "rows"))  # a row per leaf at most
    final = ordered(rows).join(cuts, names, "left")
    if not cuts.where("fit < rows").isEmpty():  # equal rows of which some are taken: number them
        split = F.coalesce((place == F.col("stop")) & (F.col("fit") < F.col("rows")), F.lit(False))
        some = number(final.where(split).withColumn("leaf", F.array_join(F.array(*names), "\x00")), "leaf", "order")
        final = final.where(~split).withColumn("pos", F.lit(0).cast("long")).unionByName(some.drop("leaf", "gid", "n"))
    else:
        final = final.withColumn("pos", F.lit(0).cast("long"))
    here = F.coalesce((place < F.col("stop")) | ((place == F.col("stop")) & (F.col("pos") < F.col("fit"))), F.lit(False))
    more = F.when(F.col("epochs") >= max_epochs, 0).when(
        F.col("end").isNull() | (F.col("slice") < F.col("end")) | ((F.col("slice") == F.col("end")) & here), 1).otherwise(0)
    copies = F.when(left_out, 0).otherwise(F.col("epochs") + more).cast("int")
    return final.select("doc_id", *[F.when(F.col(n) != "", F.substr(n, F.lit(2))).alias(level) for n, level in zip(names, levels)], "tokens",
                        copies.alias("copies"), *(["row"] if carry else []))


def tree() -> dict[str, Column]:
    """domain (one of three, by the last character of the source), language and source of ``documents``."""
    last = F.ascii(F.right(F.coalesce("source", F.lit("0")), F.lit(1)))
    return {"domain": F.concat(F.lit("d"), F.pmod(last, F.lit(3)).cast("string")), "language": F.col("lang"), "source": F.col("source")}


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (documents), each as often as the mix holds it."""
    out = select(docs, tree(), WEIGHTS, SHARE, MAX_EPOCHS, SEED, carry=True)
    return out.where("copies > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """How often the mix holds each document."""
    return select(C.table(spark, sf_dir, "documents"), tree(), WEIGHTS, SHARE, MAX_EPOCHS, SEED)


def _level(i: int) -> str:
    """DuckDB SQL of one level of the tree, as budgets() shares it out."""
    names = ["domain", "language", "source"]
    path, up = ", ".join(names[:i + 1]), names[:i]
    given = f"JOIN b{i - 1} u ON " + " AND ".join(f"n.{c} IS NOT DISTINCT FROM u.{c}" for c in up) if i else f"CROSS JOIN (SELECT least(CAST(floor(sum(tokens) * {SHARE}) AS BIGINT), sum(tokens) * {MAX_EPOCHS}) AS budget FROM leaves) u"
    by = "PARTITION BY " + ", ".join(up) if up else ""
    weight = "CASE " + names[i] + "".join(f" WHEN '{k}' THEN {w}" for k, w in WEIGHTS[names[i]].items()) + " ELSE 1 END"
    before = f"OVER ({by} ORDER BY cap::DOUBLE / w, {names[i]} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
n{i} AS (SELECT {path}, (sum(tokens) * {MAX_EPOCHS})::HUGEINT AS cap, ({weight})::HUGEINT AS w FROM leaves GROUP BY ALL),
g{i} AS (SELECT n.*, u.budget::HUGEINT AS given FROM n{i} n {given}),
f{i} AS (SELECT *, cap * (sum(w) OVER ({by}) - coalesce(sum(w) {before}, 0)) <= w * (given - coalesce(sum(cap) {before}, 0)) AS whole FROM g{i}),
b{i} AS (SELECT {path}, CASE WHEN whole THEN cap ELSE (w * (given - sum(CASE WHEN whole THEN cap ELSE 0 END) OVER ({by}))::HUGEINT)
  // greatest(1, sum(CASE WHEN whole THEN 0 ELSE w END) OVER ({by}))::HUGEINT END::BIGINT AS budget FROM f{i})"""


SQL = {"op3_mixing": f"""
WITH d AS (SELECT doc_id, 'd' || (ascii(right(coalesce(source, '0'), 1)) % 3) AS domain, lang AS language, source,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, language, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),{",".join(map(_level, range(3)))},
plan AS (SELECT l.domain, l.language, l.source, CASE WHEN l.tokens > 0 THEN b.budget // l.tokens ELSE 0 END AS epochs,
  b.budget - CASE WHEN l.tokens > 0 THEN b.budget // l.tokens ELSE 0 END * l.tokens AS rest
  FROM leaves l JOIN b2 b ON l.domain IS NOT DISTINCT FROM b.domain AND l.language IS NOT DISTINCT FROM b.language AND l.source IS NOT DISTINCT FROM b.source),
o AS (SELECT d.*, epochs, rest, sum(tokens) OVER (PARTITION BY d.domain, d.language, d.source
  ORDER BY md5('{SEED}|' || epochs || '|' || coalesce(doc_id::VARCHAR, '')) ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.language IS NOT DISTINCT FROM p.language AND d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, language, source, tokens, (epochs + CASE WHEN epochs < {MAX_EPOCHS} AND upto <= rest THEN 1 ELSE 0 END)::INT AS copies FROM o"""}
