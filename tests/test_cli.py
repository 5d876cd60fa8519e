"""The three workflows on real files: ingest → train → filter (deliver and tag) → classify."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF001


def test_ingest_train_filter_classify(spark, tmp_path):
    from mailsift.cli import classify_table, ingest, run_filter, train_from_jsonl
    from mailsift.operators.route import write_maildir_files
    from mailsift.session import table
    from mailsift.sources.synthetic import synthetic_mail

    mail = synthetic_mail(table(spark, SF001, "documents"), table(spark, SF001, "pages"),
                          table(spark, SF001, "labels")).filter(F.col("label").isNotNull())
    mail = mail.withColumn("box", F.when(F.col("label") == 1, F.lit("Junk")).otherwise(F.lit("Inbox")))
    base = str(tmp_path / "Maildir")
    write_maildir_files(mail.withColumn("path", F.col("doc_id").cast("string")), base, "box", "path", "content",
                        subdir="cur", info="2,S")

    counts = ingest(spark, [f"{base}/Inbox"], [f"{base}/Junk"], str(tmp_path / "train.jsonl"), maildir=True,
                    compact_to=str(tmp_path / "raw"))
    n_good, n_bad = mail.filter("label = 0").count(), mail.filter("label = 1").count()
    assert counts == {"good": (n_good, n_good, 0), "bad": (n_bad, n_bad, 0)}
    assert spark.read.parquet(str(tmp_path / "raw")).count() == n_good + n_bad

    info = train_from_jsonl(spark, str(tmp_path / "train.jsonl"), str(tmp_path / "model"), embedding_dim=64)
    assert info["samples"] == n_good + n_bad and info["metadata_dim"] == 1 and info["total_features"] == 65
    assert 0.5 <= info["accuracy"] <= 1.0

    run_filter(spark, str(tmp_path / "model"), [f"{base}/Inbox/cur"], str(tmp_path / "out"), mode="deliver")
    delivered = sum(len(os.listdir(tmp_path / "out" / f / "new")) for f in ("spam", "ham")
                    if (tmp_path / "out" / f).exists())
    assert delivered == n_good

    run_filter(spark, str(tmp_path / "model"), [f"{base}/Junk/cur"], str(tmp_path / "tagged"), mode="tag")
    tagged = spark.read.parquet(str(tmp_path / "tagged")).collect()
    assert len(tagged) == n_bad and all(r.tagged.startswith(b"X-Spam-Status: ") for r in tagged)

    q = spark.createDataFrame([("cheap pills", "buy now", "[1]"), ("minutes", "see attached", "[0]")],
                              "subject string, body string, metadata string")
    q.write.parquet(str(tmp_path / "q"))
    out = classify_table(spark, str(tmp_path / "model"), str(tmp_path / "q"), str(tmp_path / "c")).collect()
    assert {r.prediction for r in out} <= {"SPAM", "HAM"} and all(r.spam_probability.endswith("%") for r in out)
    json.dumps(info)  # the CLI prints it as JSON
