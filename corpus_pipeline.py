"""From raw documents to packed training sequences.

Quality rules, language identification, near-duplicate removal, secret masking, packing. Every stage takes
(spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame with the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import jaccard_join, language_id, packing, quality_rules, secret_scan
from mailsift.llm.common import unused
from mailsift.session import scratch_path, table

#: A document whose language is less certain than this goes.
LEAST_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a language reference; references are learned from ``docs``.

    Null and empty texts have no words and go. Repeated rows are judged alike. Extra columns pass through, whatever their
    names. An empty table stays empty.
    """
    refs = quality_rules.learn_references(docs)
    verdict = quality_rules.quality(refs, "text", repeatable=False)
    name = unused("verdict", docs)
    return docs.withColumn(name, verdict).where(F.col(name)["kept"]).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; ``und``, uncertain ones and those that don't fit go.

    Null texts and texts without a letter are ``und``; where no row has a language, all are. Extra columns pass through,
    whatever their names.
    """
    model = language_id.train(docs)
    fits = language_id.learn_fits(spark, model, docs)
    found = language_id.judge(spark, model, fits, "text", repeatable=False)
    name = unused("found", docs)
    at = F.col(name)
    return docs.withColumn(name, found).where(
        (at["lang_pred"] != language_id.UNKNOWN) & (at["score"] >= LEAST_LANGUAGE_SCORE) & (at["margin"] >= 0)
    ).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each near-duplicate class, once however often its row is repeated.

    A null text counts as an empty one; empty ones are copies of each other. Extra columns pass through, whatever their names.
    """
    return jaccard_join.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts, and ``n_chars`` counted anew where there is such a column.

    Null and empty texts stay as they are. Extra columns pass through, whatever their names.
    """
    name = unused("masked", docs)
    text = F.col(name)["text"]
    masked = docs.withColumn(name, secret_scan.mask(spark))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return masked.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences. A null or empty text is one piece, the end id."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("language identification", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Learned references and a learned model decide what stays, which SQL can't express; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
