"""Corpus bookkeeping: flatten/keep-last (S4/W1), manifest (K6/O1), inputs (K7),
manifest diff (J3), top domains (A6/O2) and domain marking (X16).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_urls, url_domains
from ..sources.mail import split_paths

MAX_VOCAB = 200


def keep_last(df: DataFrame, keys=("class", "basename"), ord_col: str = "ord", subdir: str = "subdir",
              path: str = "path") -> DataFrame:
    """One message per (class, basename): the latest folder in list order
    wins; ties go to the smaller subdir, then the smaller path.

    Written as a ``min`` over a struct whose first field is ``-ord`` instead of a
    ``row_number`` window: the aggregate combines map-side, so a basename shared
    by a third of the corpus is reduced inside every task and never gathered
    into one window partition.
    """
    others = [c for c in df.columns if c not in keys]
    win = F.min(F.struct(F.negative(F.col(ord_col)).alias("__k"), F.col(subdir).alias("__s"),
                         F.col(path).alias("__p"), *[F.col(c) for c in others])).alias("__w")
    return df.groupBy(*keys).agg(win).select(*keys, *[F.col("__w")[c].alias(c) for c in others])


def manifest(df: DataFrame, class_col: str = "class", name_col: str = "basename", length: str = "length",
             mtime: str = "modificationTime") -> DataFrame:
    """K6/O1: class, name, size and whole-second mtime, ordered by class (good, bad) then name.

    ``mtime`` may be a timestamp (``binaryFile``'s modificationTime) or epoch
    seconds; seconds are rounded half-to-even like ``%.0f``. With ``binaryFile``
    input the content column is never selected, so files are not opened.
    """
    m = F.col(mtime)
    if isinstance(df.schema[mtime].dataType, T.TimestampType):
        secs = F.bround(F.unix_micros(m) / 1e6)
    else:
        secs = F.bround(m.cast("double"))
    out = df.select(F.col(class_col).alias("class"), F.col(name_col).alias("basename"),
                    F.col(length).cast("long").alias("length"), secs.cast("long").alias("mtime"))
    # good first, then bad (the order the classes are listed in), names sorted within a class
    rank = F.when(F.col("class") == "good", 0).when(F.col("class") == "bad", 1).otherwise(2)
    return out.orderBy(rank, "class", "basename")


def manifest_lines(man: DataFrame) -> DataFrame:
    """The text form ``class/name size mtime``."""
    return man.select(F.format_string("%s/%s %d %d", "class", "basename", "length", "mtime").alias("value"))


def listed_inputs(spark: SparkSession, good, bad) -> DataFrame:
    """K7 from the lists themselves: ``class, folders`` as given, also folders without any mail."""
    return spark.createDataFrame([(c, ",".join(split_paths(paths))) for c, paths in (("good", good), ("bad", bad))],
                                 "class string, folders string")


def inputs(df: DataFrame, class_col: str = "class", folder: str = "folder", ord_col: str = "ord") -> DataFrame:
    """K7: which folders fed each class, in list order (one short list per class)."""
    f = df.select(class_col, ord_col, folder).distinct()
    return f.groupBy(class_col).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(ord_col, folder))), lambda s: s[folder]),
                     ",").alias("folders"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added / removed / changed / unchanged per (class, basename)."""
    o = old.select("class", "basename", F.col("length").alias("old_length"), F.col("mtime").alias("old_mtime"))
    n = new.select("class", "basename", F.col("length").alias("new_length"), F.col("mtime").alias("new_mtime"))
    j = o.join(n, ["class", "basename"], "full_outer")
    status = (F.when(F.col("old_length").isNull(), F.lit("added"))
              .when(F.col("new_length").isNull(), F.lit("removed"))
              .when((F.col("old_length") != F.col("new_length")) | (F.col("old_mtime") != F.col("new_mtime")),
                    F.lit("changed"))
              .otherwise(F.lit("unchanged")))
    return j.withColumn("status", status)


def new_only(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Ingest only messages not in the previous manifest (anti join).

    The previous keys are de-duplicated first (combined map-side), so a name
    repeated across a third of the old corpus is one key on the build side."""
    keys = seen.select("class", "basename").distinct()
    return candidates.join(keys, ["class", "basename"], "left_anti")


def domain_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Domain frequencies over all URLs of all texts (partial counts map-side)."""
    d = df.select(F.explode(url_domains(text_col)).alias("domain"))
    return d.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def top_domains(df: DataFrame, text_col: str, k: int = MAX_VOCAB) -> DataFrame:
    """The ``k`` most frequent domains (ties by name) — a top-k report."""
    return domain_counts(df, text_col).orderBy(F.desc("n"), F.asc("domain")).limit(k)


def domain_vocab(df: DataFrame, text_col: str, k: int = MAX_VOCAB) -> list[str]:
    """The vocabulary as a driver list; its size is bounded by ``k``."""
    return [r["domain"] for r in top_domains(df, text_col, k).collect()]


def mark_domains(df: DataFrame, text_col: str, vocab: list[str], out: str = "marked") -> DataFrame:
    """URL → ``[DOM_<domain>]`` for vocabulary domains, → domain otherwise."""
    v = F.lit(list(vocab)) if vocab else F.array().cast("array<string>")
    return df.withColumn(out, strip_urls(text_col, v))
