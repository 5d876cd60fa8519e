"""Mail files into DataFrames.

``binaryFile`` lists and reads the files; two per-read Hadoop options make
Maildir names with colons (``1717.M1P2.host:2,S``) readable on local file
systems, where the checksum file system would otherwise build an invalid
``.name:2,S.crc`` path. Hidden names (``.x``, and ``_x`` — a Spark listing
rule) are skipped below the given roots; a root itself may be hidden, and the
any-depth Maildir discovery also reads ``cur``/``new`` of hidden sub-folders.
"""

from __future__ import annotations

import logging
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import list_files, scan_files, with_content

log = logging.getLogger(__name__)

BINARY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("modificationTime", T.TimestampType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("content", T.BinaryType(), True),
    ]
)

FS_OPTIONS = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}

MAILDIR_SUBDIRS = ("cur", "new")


def split_paths(paths) -> list[str]:
    """Comma lists are split and trimmed, empty items dropped; repeats are kept."""
    if isinstance(paths, str):
        paths = [paths]
    out = []
    for p in paths:
        out.extend(x.strip() for x in str(p).split(","))
    return [p for p in out if p]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def escape_glob(path: str) -> str:
    """A path for a reader that takes patterns: ``[Gmail]`` then means itself."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def one_pattern(paths: list[str]) -> str:
    """A pattern for the given directories: their common parent and a brace list of the rest.

    Inside the list a pattern's own signs can't be escaped and stand as ``?``, which may match more:
    ``under_any`` then keeps what was asked for.
    """
    split = [p.rstrip("/").split("/") for p in dict.fromkeys(paths)]
    if len(split) == 1:
        return escape_glob("/".join(split[0]))
    n = 0
    while all(len(s) > n + 1 for s in split) and len({s[n] for s in split}) == 1:
        n += 1
    rest = ",".join(re.sub(r"[\[\]{}*?\\,]", "?", "/".join(s[n:])) for s in split)
    return escape_glob("/".join(split[0][:n])) + "/{" + rest + "}"


def under_any(paths: list[str], path_col: str = "path") -> Column:
    """Whether a file lies in one of the given directories, at any depth."""
    return reduce(lambda a, b: a | b, (F.col(path_col).contains(p.rstrip("/") + "/") for p in dict.fromkeys(paths)))


def _read(spark: SparkSession, path: list[str]) -> DataFrame:
    """One ``binaryFile`` scan over several directories (a single scan node)."""
    path = [escape_glob(p) for p in path]
    return (spark.read.format("binaryFile").schema(BINARY_SCHEMA).options(**FS_OPTIONS)
            .option("recursiveFileLookup", "true").load(path))


def maildir_dirs(spark: SparkSession, root: str, subdirs: tuple[str, ...] = MAILDIR_SUBDIRS) -> list[str]:
    """The ``cur``/``new`` directories at any depth below ``root`` (hidden folders
    included, ``tmp`` never), found by walking directories only: the walk never
    lists the inside of a ``cur``/``new``/``tmp`` directory, so no message file
    is listed or opened here. The result — one or two directories per Maildir
    folder — is a short list; Spark then reads just those directories.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, pending = [], [top]
    while pending:
        for status in fs.listStatus(pending.pop()):
            if not status.isDirectory():
                continue
            name = status.getPath().getName()
            if name in subdirs:
                found.append(status.getPath().toString())
            elif name != "tmp":
                pending.append(status.getPath())
    return sorted(found)


def scan_mail(spark: SparkSession, paths, subdirs: tuple[str, ...] | None = None,
              any_depth: bool = False) -> DataFrame:
    """One row per message file: ``path, modificationTime, length, content, root, subdir, basename``.

    ``subdirs=("cur", "new")`` reads only those Maildir sub-directories (S2),
    directly below each root or, with ``any_depth``, wherever they occur below
    it; folders are then found and files listed and read by tasks (``files.scan_files``), for all roots at once.
    A missing root is a warning and contributes no rows; a root listed
    twice is read twice (``unionByName`` keeps duplicates).
    """
    if subdirs and any_depth:
        return scan_files(spark, split_paths(paths), subdirs, any_depth=True)
    frames = []
    for root in split_paths(paths):
        targets = [f"{root.rstrip('/')}/{s}" for s in subdirs] if subdirs else [root]
        present = []
        for t in targets:
            if _exists(spark, t):
                present.append(t)
            else:
                log.warning("Path not found: %s", t)
        if present:
            # the directories of one root do not overlap: one scan reads them all
            frames.append(_read(spark, present).withColumn("root", F.lit(root)))
    if not frames:
        empty = T.StructType(BINARY_SCHEMA.fields + [T.StructField("root", T.StringType())])
        return (spark.createDataFrame([], empty).withColumn("basename", F.lit(None).cast("string"))
                .withColumn("subdir", F.lit(None).cast("string")))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    parts = F.split(F.col("path"), "/")
    return (df.withColumn("basename", F.element_at(parts, -1))
            .withColumn("subdir", F.element_at(parts, -2)))


def load_corpus(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Good → label 0, bad → 1; a message in both lists yields two rows."""
    return good.withColumn("label", F.lit(0)).unionByName(bad.withColumn("label", F.lit(1)), allowMissingColumns=True)


def list_corpus(spark: SparkSession, good_paths, bad_paths, subdirs=None, any_depth: bool = False) -> DataFrame:
    """S1/S2 + S3 without the bytes, for two path lists at once: ``class, folder, ord, subdir, basename, path, length,
    modificationTime``."""
    good, bad = split_paths(good_paths), split_paths(bad_paths)
    files = list_files(spark, [*good, *bad], subdirs, any_depth)
    is_bad = F.col("ord") >= len(good)
    return files.select(F.when(is_bad, "bad").otherwise("good").alias("class"), F.col("root").alias("folder"),
                        F.when(is_bad, F.col("ord") - len(good)).otherwise(F.col("ord")).alias("ord"),
                        "subdir", "basename", "path", "length", "modificationTime")


def scan_corpus(spark: SparkSession, good_paths, bad_paths, subdirs=None, any_depth: bool = False) -> DataFrame:
    """S1 + S3 for two path lists, with ``class`` = good/bad and the folder order ``ord``."""
    if subdirs and any_depth:
        return with_content(list_corpus(spark, good_paths, bad_paths, subdirs, any_depth)).withColumn(
            "label", (F.col("class") == "bad").cast("int")).withColumn("root", F.col("folder"))

    def side(paths, cls):
        frames = []
        for i, p in enumerate(split_paths(paths)):
            frames.append(scan_mail(spark, p, subdirs, any_depth).withColumn("folder", F.lit(p))
                          .withColumn("ord", F.lit(i)))
        if not frames:  # an empty list is a class without mail
            frames = [scan_mail(spark, []).withColumn("folder", F.lit(None).cast("string"))
                      .withColumn("ord", F.lit(None).cast("int"))]
        return reduce(DataFrame.unionByName, frames).withColumn("class", F.lit(cls))

    return load_corpus(side(good_paths, "good"), side(bad_paths, "bad"))


def compact_mail(corpus: DataFrame, path: str, max_records_per_file: int = 200_000) -> None:
    """Copy scanned mail (many small files) into Parquet once, partitioned by
    ``class`` when present, so later jobs read a few large columnar files
    instead of listing and opening every message again. ``content`` is written
    as BINARY next to its file metadata; ``maxRecordsPerFile`` bounds file size."""
    w = corpus.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
    if "class" in corpus.columns:
        w = w.partitionBy("class")
    w.parquet(path)


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """The compacted corpus; a filter on ``class`` prunes partitions."""
    return spark.read.parquet(path)
