"""A5: shadow-mode statistics over scored mail.

Scores are decided on their text, read as an exact decimal, so histogram bins
and threshold grids of any fineness are exact, and the sweep is one grouped
count plus a running sum over at most ``steps + 1`` rows — no join of every
message with every threshold. The texts counted are those that the verdict
accepts (``parse_score``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.scoring import parse_score


def score_decimal(text_col: str = "score_text") -> Column:
    """Score text → exact decimal in [0, 1] (null when the verdict refuses it). The text is evaluated once."""
    def exact(text):
        plain = F.trim(F.translate(text, "\n\r\t\x0b\f", "     "))
        return let(parse_score(text), lambda s: F.when((s >= 0) & (s <= 1), plain.try_cast("decimal(38,18)")))

    return let(F.col(text_col), exact)


def _bin(text_col: str, bins: int) -> Column:
    """``floor(score * bins)``, exactly."""
    if not 1 <= bins <= 10000:
        raise ValueError(f"between 1 and 10000 bins or steps, not {bins}")
    return F.floor(score_decimal(text_col) * F.lit(bins)).cast("int")


def status_counts(df: DataFrame) -> DataFrame:
    """Counts by status (Yes/No/Error) and folder."""
    return df.groupBy("status", "folder").agg(F.count(F.lit(1)).alias("n"))


def score_histogram(df: DataFrame, text_col: str = "score_text", bins: int = 20) -> DataFrame:
    """Counts per bin ``floor(score * bins)`` (a score of exactly 1 joins the last bin)."""
    # least() skips nulls, so invalid texts must stay null explicitly
    b = let(_bin(text_col, bins), lambda u: F.when(u.isNotNull(), F.least(u, F.lit(bins - 1))).cast("int"))
    # the bin leaves a generator, so that the filter isn't pushed below it with a copy of the expression
    return (df.select(F.explode(F.array(b)).alias("bin")).filter(F.col("bin").isNotNull())
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("lo", F.round(F.col("bin") / F.lit(bins), 4))
            .withColumn("hi", F.round((F.col("bin") + 1) / F.lit(bins), 4)))


def bin_counts(df: DataFrame, truth: Column, text_col: str = "score_text", steps: int = 20) -> DataFrame:
    """Scored mail → messages per (``bin`` = floor(score * steps), ``pos``): at most ``2 * (steps + 1)`` rows of ``n``, also as a
    stream's running aggregate. Texts that the verdict refuses and null truths don't count."""
    one = F.struct(_bin(text_col, steps).alias("bin"), truth.cast("boolean").alias("pos"))
    scored = df.select(F.inline(F.array(one))).filter(F.col("bin").isNotNull() & F.col("pos").isNotNull())
    return scored.groupBy("bin", "pos").agg(F.count(F.lit(1)).alias("n"))


def sweep_counts(spark: SparkSession, counts: DataFrame, steps: int = 20) -> DataFrame:
    """``bin_counts`` → confusion counts, precision and recall at thresholds k/steps, k = 0..steps."""
    n = F.col("n")
    per_bin = counts.groupBy("bin").agg(F.sum(F.when(F.col("pos"), n).otherwise(0)).alias("p"),
                                        F.sum(F.when(F.col("pos"), 0).otherwise(n)).alias("q"))
    grid = spark.range(0, steps + 1).select(F.col("id").cast("int").alias("k"))
    # grid (steps+1 rows) left-joined with at most steps+1 bins; the running sum
    # spans those few rows only.
    g = grid.join(per_bin, grid["k"] == per_bin["bin"], "left").select(
        "k", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    g = g.select("k", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"),
                 F.sum("p").over(everything).alias("P"), F.sum("q").over(everything).alias("N"))
    return g.select(
        F.round(F.col("k") / F.lit(steps), 4).alias("threshold"),
        F.col("tp").cast("long").alias("tp"),
        F.col("fp").cast("long").alias("fp"),
        (F.col("P") - F.col("tp")).cast("long").alias("fn"),
        (F.col("N") - F.col("fp")).cast("long").alias("tn"),
        F.when(F.col("tp") + F.col("fp") > 0, F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6)).alias("precision"),
        F.when(F.col("P") > 0, F.round(F.col("tp") / F.col("P"), 6)).alias("recall"),
    )


def threshold_sweep(spark: SparkSession, df: DataFrame, truth: Column, text_col: str = "score_text",
                    steps: int = 20) -> DataFrame:
    """Confusion counts, precision and recall at thresholds k/steps, k = 0..steps.

    A message is called spam at threshold k/steps iff its score ``s >= k/steps``,
    i.e. iff ``floor(s * steps) >= k``. One grouped count per (bin, truth), then a
    running sum from the top bin.
    """
    return sweep_counts(spark, bin_counts(df, truth, text_col, steps), steps)
