"""Sources and sinks: Maildir scan with colon names and hidden entries (S1, S2),
corpus labelling (S3), JSON lines (K1, S5), domain lists (S6), manifest (K6)."""

import os
import tempfile

from pyspark.sql import functions as F


def _maildir():
    root = tempfile.mkdtemp(prefix="mailsift-test-")
    spam = os.path.join(root, ".Spam")
    names = ["1717.M1P2.host:2,S", "1718.M2P3.host:2,", "plain", "_under", ".dot"]
    for sd in ("cur", "new", "tmp", ".hid"):
        os.makedirs(os.path.join(spam, sd))
        for n in names:
            with open(os.path.join(spam, sd, n), "wb") as f:
                f.write(f"Subject: {sd}/{n}\n\nbody".encode())
    return root, spam


def test_scan_all_and_maildir_only(spark):
    from mailsift.sources.mail import scan_mail

    _, spam = _maildir()
    every = scan_mail(spark, spam)
    assert every.count() == 9  # 3 visible names x cur/new/tmp; hidden dir, .dot and _under skipped
    cn = scan_mail(spark, spam, subdirs=("cur", "new"))
    assert cn.count() == 6
    assert cn.filter(F.col("basename") == "1717.M1P2.host:2,S").select("content").first()[0][:8] == b"Subject:"


def test_scan_missing_and_repeated(spark):
    from mailsift.sources.mail import scan_mail

    _, spam = _maildir()
    assert scan_mail(spark, "/nonexistent/path").count() == 0
    assert scan_mail(spark, f"{spam}/cur, ,{spam}/cur").count() == 6


def test_corpus_labels_and_manifest(spark):
    from mailsift.operators.corpus import manifest
    from mailsift.sources.mail import scan_corpus

    _, spam = _maildir()
    c = scan_corpus(spark, f"{spam}/cur", f"{spam}/cur,{spam}/new")
    assert sorted((r.label, r.n) for r in c.groupBy("label").agg(F.count("*").alias("n")).collect()) == [(0, 3), (1, 6)]
    m = manifest(c.select("class", "basename", "length", "modificationTime")).collect()
    assert [r["class"] for r in m] == sorted((r["class"] for r in m), key=lambda c: c != "good")
    assert all(isinstance(r.mtime, int) and r.length > 0 for r in m)


def test_training_roundtrip_and_rejects(spark):
    from mailsift.sources.training import parse_training_lines, read_training, write_training

    df = spark.createDataFrame([("Sübject", "bödy", [1.0], 1)],
                               "subject string, body string, metadata_features array<double>, label int")
    path = tempfile.mkdtemp(prefix="mailsift-jsonl-") + "/t"
    write_training(df, path)
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path) if f.endswith(".json"))
    assert "Sübject" in text
    good, bad = read_training(spark, path)
    assert good.collect()[0].asDict() == {"subject": "Sübject", "body": "bödy", "label": 1, "metadata_features": [1.0]}
    lines = ['{"label":1}', "", "{bad", '{"label":"1"}', '{"label":0.0}', '{"label":null}', '{"subject":"x"}',
             '{"label":1,"metadata_features":null}', '{"label":1,"metadata_features":[null,2]}',
             '{"label":1,"metadata_features":["3.5"]}', '{"label":1,"metadata_features":["q"]}',
             '{"label":1,"subject":null}']
    g, b = parse_training_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert g.count() == 6 and b.count() == 5
    metas = sorted(tuple(r.metadata_features) for r in g.collect())
    assert (2.0,) in metas and (3.5,) in metas
    assert g.filter(F.col("subject") == "None").count() == 1


def test_domain_list(spark):
    from mailsift.functions.headers import flag_domains
    from mailsift.sources.domains import domain_list

    lines = spark.createDataFrame([("# comment",), ("freemail_domains Gmail.com  web.de",), ("",), ("web.de",)],
                                  "value string")
    d = domain_list(lines)
    assert sorted(r.domain for r in d.collect()) == ["gmail.com", "web.de"]
    mail = spark.createDataFrame([("web.de",), ("x.org",)], "reply_domain string")
    flags = {r.reply_domain: r.free for r in flag_domains(mail, "reply_domain", d, "free").collect()}
    assert flags == {"web.de": True, "x.org": False}


def test_domain_list_directives(spark):
    from mailsift.sources.domains import domain_list

    lines = spark.createDataFrame([("freemail_domains a.example b.example",), ("freemail_whitelist B.example c.example",),
                                   ("util_rb_tld com",), ("d.example e.example # x",)], "value string")
    assert sorted(r.domain for r in domain_list(lines).collect()) == ["a.example", "d.example", "e.example"]


def test_pattern_signs_in_folder_names(spark, tmp_path):
    from mailsift.sources.mail import one_pattern, scan_corpus, scan_mail, under_any
    from mailsift.streaming.score import run_to_table, stream_mail

    for name in ("[Gmail]", "a{b,c}", "q?*", "[Spam] x"):
        (tmp_path / name / "new").mkdir(parents=True)
        (tmp_path / name / "new" / "m1").write_bytes(b"Subject: x\n\nbody")
    roots = [str(tmp_path / n) for n in ("[Gmail]", "q?*")]
    assert scan_mail(spark, roots, subdirs=("cur", "new")).count() == 2
    assert scan_mail(spark, [str(tmp_path / "[Gmail]")], subdirs=("new",), any_depth=True).count() == 1
    assert scan_corpus(spark, "", roots[0]).groupBy("class").count().collect() == [("bad", 1)]
    boxes = [str(tmp_path / n / "new") for n in ("[Gmail]", "[Spam] x")]
    (tmp_path / "xSpamx x" / "new").mkdir(parents=True)
    (tmp_path / "xSpamx x" / "new" / "m2").write_bytes(b"not asked for")
    src = stream_mail(spark, one_pattern(boxes)).where(under_any(boxes)).select("path")
    run_to_table(src, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_old_files_are_streamed(spark, tmp_path):
    import os
    import time

    from mailsift.streaming.score import run_to_table, stream_mail

    box = tmp_path / "new"
    box.mkdir()
    (box / "m1").write_bytes(b"x")
    run = lambda: run_to_table(stream_mail(spark, str(box)).select("path"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    run()
    (box / "m2").write_bytes(b"y")
    old = time.time() - 90 * 86400
    os.utime(box / "m2", (old, old))
    run()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_maildir_dirs_at_any_depth(spark):
    from mailsift.sources.mail import maildir_dirs, scan_mail

    root, spam = _maildir()
    nested = os.path.join(spam, "archive", "2024")
    for sd in ("cur", "new", "tmp"):
        os.makedirs(os.path.join(nested, sd))
        with open(os.path.join(nested, sd, "m1"), "wb") as f:
            f.write(b"Subject: x\n\ny")
    hidden = os.path.join(spam, ".Sub", "cur")  # a hidden sub-folder is part of the tree as well
    os.makedirs(hidden)
    with open(os.path.join(hidden, "m2:2,S"), "wb") as f:
        f.write(b"Subject: y\n\nz")
    dirs = maildir_dirs(spark, spam)
    assert sorted(d.rsplit("/", 1)[-1] for d in dirs) == ["cur", "cur", "cur", "new", "new"]
    assert not any(d.endswith("/tmp") for d in dirs)
    df = scan_mail(spark, spam, subdirs=("cur", "new"), any_depth=True)
    assert df.count() == 6 + 2 + 1  # 3 visible names in cur and new, the nested cur/new, the hidden folder


def test_compacted_corpus_round_trip(spark, tmp_path):
    from mailsift.sources.mail import compact_mail, read_compacted, scan_corpus

    _, spam = _maildir()
    corpus = scan_corpus(spark, f"{spam}/cur", f"{spam}/new")
    compact_mail(corpus, str(tmp_path / "mail"))
    back = read_compacted(spark, str(tmp_path / "mail"))
    assert {"class=bad", "class=good", "_SUCCESS"} <= set(os.listdir(tmp_path / "mail"))
    assert back.count() == corpus.count() == 6
    only_bad = back.filter(F.col("class") == "bad")
    assert only_bad.count() == 3
    assert "PartitionFilters" in only_bad._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.content for r in back.collect()) == sorted(r.content for r in corpus.collect())


def test_any_depth_scan_over_many_folders(spark, tmp_path):
    """More than 32 Maildir directories: one scan lists them (Spark's parallel listing path)."""
    from mailsift.sources.mail import maildir_dirs, scan_mail

    root = tmp_path / "mail"
    for i in range(40):
        for sd in ("cur", "new", "tmp"):
            d = root / f"box{i:02d}" / sd
            d.mkdir(parents=True)
            (d / f"m{i}.x:2,S").write_bytes(b"Subject: s\n\nb")
    assert len(maildir_dirs(spark, str(root))) == 80
    assert scan_mail(spark, str(root), subdirs=("cur", "new"), any_depth=True).count() == 80
