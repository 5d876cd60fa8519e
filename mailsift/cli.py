"""Command line for the three workflows, each one a Spark job.

    python -m mailsift ingest  --good DIRS --bad DIRS --output OUT [--maildir]
    python -m mailsift train   --data OUT --model-dir MODEL
    python -m mailsift filter  --model-dir MODEL --input DIRS --output DEST [--mode tag|deliver] [--stream]
    python -m mailsift classify --model-dir MODEL --input TABLE --output DEST

Run with ``spark-submit`` on a cluster (the session comes from the
submitter); ``--master`` is only for local use.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import DEFAULT_EMBEDDING_DIM, DEFAULT_THRESHOLD
from .functions.scoring import check_threshold
from .functions.vectors import parse_metadata, resolve_dims
from .operators.model import KINDS, classify, load_model, save_model, score
from .operators.parse import parse_mail
from .operators.route import tag_headers, write_maildir_files
from .plans.score import filter_mail
from .plans.train import Trained, encoder_of, features
from .sources.mail import scan_corpus, scan_mail, split_paths
from .sources.training import read_training, write_training

log = logging.getLogger("mailsift")


def _session(master: str | None) -> SparkSession:
    b = SparkSession.builder.appName("mailsift")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    return b.getOrCreate()


def ingest(spark: SparkSession, good, bad, output: str, maildir: bool = False, compact_to: str | None = None) -> dict:
    """S1-S3 → P1-P6 → K1: parse the two folder lists and write JSON lines.

    The per-class totals (P6) are observed while the write runs, so the mail
    is scanned and parsed once and nothing is cached. With ``compact_to`` the
    raw messages are first copied into Parquet (partitioned by class) and
    parsed from there, so later runs need not list the small files again."""
    from pyspark.sql import Observation

    from .sources.mail import compact_mail, read_compacted

    corpus = scan_corpus(spark, good, bad, subdirs=("cur", "new") if maildir else None, any_depth=maildir)
    if compact_to:
        compact_mail(corpus.select("path", "length", "modificationTime", "class", "label", "content"), compact_to)
        corpus = read_compacted(spark, compact_to)
    parsed = parse_mail(corpus.select("path", "class", "label", "content"))
    ok, cls = F.col("parse_error").isNull(), F.col("class")
    obs = Observation("ingest")
    observed = parsed.observe(
        obs,
        *[F.count_if(cls == c).alias(f"{c}_files") for c in ("good", "bad")],
        *[F.count_if((cls == c) & ok).alias(f"{c}_processed") for c in ("good", "bad")],
        *[F.count_if((cls == c) & ~ok).alias(f"{c}_errors") for c in ("good", "bad")])
    write_training(observed.filter(ok), output)
    m = obs.get
    return {c: (m[f"{c}_files"], m[f"{c}_processed"], m[f"{c}_errors"]) for c in ("good", "bad")}


def train_from_jsonl(spark: SparkSession, data: str, model_dir: str,
                     embedding_dim: int = DEFAULT_EMBEDDING_DIM, kind: str = "logistic") -> dict:
    """S5 → A1/A2 → E1 → E2 (``kind`` logistic, gbt, or svm with calibrated margins: E6) → A4 → K8."""
    from .operators.model import accuracy
    from .plans.train import build_model

    rows, rejects = read_training(spark, data)
    n_bad = rejects.count()
    if n_bad:
        log.warning("%d training lines rejected", n_bad)
    trained, feats = build_model(rows.withColumn("parse_error", F.lit(None).cast("string")), "label",
                                 embedding_dim=embedding_dim, kind=kind)
    found = accuracy(score(feats, trained.model), "score", "label").first()["accuracy"]
    save_model(spark, trained.model, model_dir, trained.contract)
    return {"samples": trained.samples, "rejected": n_bad, "accuracy": found, **trained.contract}


def _trained(spark: SparkSession, model_dir: str) -> Trained:
    model, c = load_model(spark, model_dir)
    emb, meta = resolve_dims(model.numFeatures, c)  # X10
    return Trained(model, meta, emb, c or {}, encoder_of(c) or "hashing")


def run_filter(spark: SparkSession, model_dir: str, inputs, output: str, mode: str = "deliver",
               threshold: float = DEFAULT_THRESHOLD, stream: bool = False) -> None:
    """E-B: score mail files, then tag (K2/K3, Parquet of tagged bytes) or deliver (K4/K5, Maildir)."""
    trained = _trained(spark, model_dir)
    check_threshold(threshold)
    if stream:
        from .plans.score import filter_files_stream

        filter_files_stream(spark, trained, split_paths(inputs), output, threshold,
                            available_now=False, mode=mode).awaitTermination()
        return
    decided = filter_mail(scan_mail(spark, inputs).select("path", "content"), trained, threshold, tag=False)
    if mode == "tag":
        tag_headers(decided, "content", threshold).select("path", "status", "score_text", "error", "tagged") \
            .write.mode("overwrite").parquet(output)
    else:
        write_maildir_files(decided.filter(F.col("error").isNull()), output, "folder", "path", "content")


def classify_table(spark: SparkSession, model_dir: str, table: str, output: str) -> DataFrame:
    """E-C in batch: a table with ``subject, body`` and optional ``metadata`` (JSON
    text) → SPAM/HAM with both probabilities (E4)."""
    trained = _trained(spark, model_dir)
    df = spark.read.parquet(table) if not table.endswith(".json") else spark.read.json(table)
    meta = parse_metadata(F.col("metadata"), trained.metadata_dim) if "metadata" in df.columns else \
        F.array_repeat(F.lit(0.0), trained.metadata_dim)
    feats = features(df.withColumn("metadata_features", meta), trained.metadata_dim, trained.embedding_dim)
    out = classify(score(feats, trained.model)).drop("text", "embedding", "metadata", "features")
    out.write.mode("overwrite").parquet(output)
    return out


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="mailsift")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("-g", "--good", nargs="+", required=True)
    a.add_argument("-b", "--bad", nargs="+", required=True)
    a.add_argument("-o", "--output", required=True)
    a.add_argument("--maildir", action="store_true", help="read only cur/ and new/ directories, at any depth")
    a.add_argument("--compact-to", default=None, help="also keep the raw messages as Parquet here")
    t = sub.add_parser("train")
    t.add_argument("--data", required=True)
    t.add_argument("--model-dir", required=True)
    t.add_argument("--embedding-dim", type=int, default=DEFAULT_EMBEDDING_DIM)
    t.add_argument("--kind", choices=tuple(KINDS), default="logistic", help="svm: its margins are calibrated")
    f = sub.add_parser("filter")
    f.add_argument("--model-dir", required=True)
    f.add_argument("--input", nargs="+", required=True)
    f.add_argument("--output", required=True)
    f.add_argument("--mode", choices=("tag", "deliver"), default="deliver")
    f.add_argument("--threshold", type=float, default=DEFAULT_THRESHOLD)
    f.add_argument("--stream", action="store_true")
    c = sub.add_parser("classify")
    c.add_argument("--model-dir", required=True)
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    args = p.parse_args(argv)
    spark = _session(args.master)
    if args.cmd == "ingest":
        print(json.dumps(ingest(spark, args.good, args.bad, args.output, args.maildir, args.compact_to)))
    elif args.cmd == "train":
        print(json.dumps(train_from_jsonl(spark, args.data, args.model_dir, args.embedding_dim, args.kind)))
    elif args.cmd == "filter":
        run_filter(spark, args.model_dir, args.input, args.output, args.mode, args.threshold, args.stream)
    else:
        classify_table(spark, args.model_dir, args.input, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
