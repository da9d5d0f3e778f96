"""Tables behind the topic reports: P3-P7 and the text layout of S5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.guards import bounded_broadcast
from loupe.session import checkpoint_dir


def label_crosstab_topk(df: DataFrame, k: int = 15, label_col: str = "label",
                        true_col: str = "true_label", specific_label=None) -> DataFrame:
    """The k most frequent true labels within each label (or one label)."""
    if specific_label is not None:
        df = df.where(F.col(label_col) == F.lit(specific_label))
    counts = df.groupBy(F.col(label_col).alias("label"), F.col(true_col).alias("true_label")).agg(
        F.count(F.lit(1)).alias("frequency"))
    w = Window.partitionBy("label").orderBy(F.desc("frequency"), F.asc("true_label"))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def cluster_summary(df: DataFrame, label_col: str = "label", sentiment_col: str | None = "sentiment") -> DataFrame:
    """Label, size and mean sentiment rounded to 2 places (null when absent)."""
    sent = (F.round(F.avg(F.col(sentiment_col)), 2) if sentiment_col and sentiment_col in df.columns
            else F.lit(None).cast("double"))
    return df.groupBy(F.col(label_col).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), sent.alias("sentiment"))


def stacked_bar(df: DataFrame, series_col: str, category_col: str, value_col: str,
                reverse: bool = False) -> DataFrame:
    """P5: bar base (sum of earlier series in the same category) and height.

    With ``reverse`` the category order is flipped and reported as
    ``position``; series stacking order is unchanged.
    """
    out = df.select(F.col(series_col).alias("series"), F.col(category_col).alias("category"),
                    F.col(value_col).cast("double").alias("height"))
    out = out.withColumn("base", F.coalesce(F.sum("height").over(
        Window.partitionBy("category").orderBy("series").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0.0)))
    cats = out.select("category").distinct()
    order = F.desc("category") if reverse else F.asc("category")
    # categories are the small label set; the ranking runs on that table only
    pos = cats.withColumn("position", (F.row_number().over(Window.orderBy(order)) - 1).cast("bigint"))
    return out.join(pos, "category")


def ordered_positions(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Add ``_pos``: each row's 0-based position in the global order.

    A range-partitioned sort spreads the rows (a hot leading key is split over
    many tasks; Spark sizes the ranges by their bytes); each row is numbered in
    its range, and per-range counts (one small table) give the offsets. The
    ranges are checkpointed to the shared folder so both uses see the same ones.
    """
    checkpoint_dir(df.sparkSession)
    ranges = df.repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    counts = ranges.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_pid", (F.sum("_c").over(Window.orderBy("_pid")) - F.col("_c")).alias("_off"))
    within = Window.partitionBy("_pid").orderBy(*order_cols)
    # one row per range
    return (ranges.withColumn("_local", F.row_number().over(within) - 1).join(F.broadcast(offsets), "_pid")
            .withColumn("_pos", F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off"))


def value_counts(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """``(_g, _v, _c, _before, _n)``: each group's distinct values, how often they occur, how many rows are smaller, and the group's size.

    Equal values are merged before any shuffle, so a value that half of a group's
    rows share is one row; ranges of (group, value) are numbered as in
    ``ordered_positions``, so no group is gathered into one task. Null values do
    not count.
    """
    checkpoint_dir(df.sparkSession)
    rows = df.where(F.col(value_col).isNotNull()).select(F.col(group_col).alias("_g"), F.col(value_col).alias("_v"))
    counts = rows.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranges = counts.repartitionByRange("_g", "_v").withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    # one row per group in each range that holds some of it
    pieces = ranges.groupBy("_g", "_pid").agg(F.sum("_c").alias("_s"))
    in_group = Window.partitionBy("_g")
    pieces = pieces.select(F.col("_g").alias("_pg"), F.col("_pid").alias("_pp"), F.sum("_s").over(in_group).alias("_n"),
                           (F.sum("_s").over(in_group.orderBy("_pid")) - F.col("_s")).alias("_off"))
    local = F.sum("_c").over(Window.partitionBy("_g", "_pid").orderBy("_v")) - F.col("_c")
    same = F.col("_g").eqNullSafe(F.col("_pg")) & (F.col("_pid") == F.col("_pp"))
    return ranges.withColumn("_local", local).join(pieces, same).select("_g", "_v", "_c", (F.col("_off") + F.col("_local")).alias("_before"), "_n")


def silhouette_bands(sil: DataFrame, label_col: str = "label", value_col: str = "silhouette",
                     gap: int = 10) -> DataFrame:
    """Y-positions of a silhouette plot.

    Within each label values ascend; labels are stacked in label order with
    ``gap`` empty units before each band, so a row's position is its rank
    in the global (label, value, id) order plus ``gap`` times its label's
    ordinal. No window spans a whole label (``ordered_positions``).
    """
    base = sil.select("review_id", F.col(label_col).alias("label"), F.col(value_col).alias("silhouette"))
    pos = ordered_positions(base, ["label", "silhouette", "review_id"])
    ordinals = base.select("label").distinct().select(
        "label", F.row_number().over(Window.orderBy("label")).alias("_ord"))
    # one row per label, size checked
    return (pos.join(bounded_broadcast(ordinals), "label")
            .select("review_id", "label", "silhouette",
                    (F.col("_pos") + F.lit(gap) * F.col("_ord")).cast("bigint").alias("y")))


def _order_statistic(position) -> "F.Column":
    """The value at a 0-based position of a group's ascending rows, as an aggregate of ``value_counts``."""
    return F.max(F.when((F.col("_before") <= position) & (position < F.col("_before") + F.col("_c")), F.col("_v")))


def exact_quantiles(df: DataFrame, group_col: str, value_col: str, probs) -> DataFrame:
    """Exact linear-interpolation quantiles per group, ``(group, p, value)``.

    The value at fraction p of a group of n is v[lo] + (h - lo)(v[hi] - v[lo])
    with h = (n - 1)p, lo = floor(h), hi = ceil(h) (as numpy / DuckDB
    ``quantile_cont``). The order statistics are partial aggregates over the
    counted distinct values. Null values do not count.
    """
    return _quantiles(value_counts(df, group_col, value_col), probs).withColumnRenamed("_g", group_col)


def _quantiles(counts: DataFrame, probs) -> DataFrame:
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        picks += [_order_statistic(F.floor(h)).alias(f"lo{i}"), _order_statistic(F.ceil(h)).alias(f"hi{i}"), F.max(h - F.floor(h)).alias(f"part{i}")]
    found = counts.groupBy("_g").agg(*picks)
    values = [F.struct(F.lit(float(p)).alias("p"), (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias("value")) for i, p in enumerate(probs)]
    return found.select("_g", F.inline(F.array(*values)))


def boxplot_stats(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """Quartiles, whisker ends inside 1.5 IQR, and outlier count per group.

    Quartiles are exact; the whiskers are a partial aggregation of the counted
    values against the per-group quartile table.
    """
    counts = value_counts(df, group_col, value_col)
    quartile = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    q = _quantiles(counts, [0.25, 0.5, 0.75]).groupBy(F.col("_g").alias("_qg")).agg(
        quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"))
    # one row per group, size checked
    j = counts.join(bounded_broadcast(q), F.col("_g").eqNullSafe(F.col("_qg")))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
    return j.groupBy("_g", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).cast("bigint").alias("outliers"),
    ).withColumnRenamed("_g", group_col)


def format_distance(col) -> "F.Column":
    """Distance text as written in central-review files: rounded to 2 places."""
    return F.round(col, 2).cast("string")
