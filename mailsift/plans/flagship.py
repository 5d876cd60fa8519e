"""The flagship plan: "which messages are spam?" end to end.

synthetic mail (from ``documents``) → parse (P1-P5) → features (X6, E1, X7, X9)
→ balanced logistic regression (A1, A2, E2) → score (E3, E5) → verdict (X11,
X12) → counts by verdict, folder and label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _parsed_corpus
from .score import score_parsed
from .train import build_model


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _parsed_corpus(spark, sf)
    trained, _ = build_model(parsed, "label")
    scored = score_parsed(parsed, trained)
    return scored.groupBy("status", "folder", "label").agg(F.count(F.lit(1)).alias("n"))
