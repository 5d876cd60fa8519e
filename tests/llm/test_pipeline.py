"""The corpus pipeline by stages, against what each stage must keep, and the guard of the entry module."""

import re
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_tables import empty, odd  # noqa: F401

import corpus_pipeline
from mailsift.llm import jaccard_join, quality_rules, secret_scan

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's result, written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF001}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out[name] = (docs, stage)
        stage(spark, docs, SF001).write.parquet(str(at / str(i)))
        docs = spark.read.parquet(str(at / str(i)))
        out[name] = (out[name][0], docs)
    return out


def test_stage_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_quality_stage(stages):
    before, after = stages["quality rules"]
    refs = quality_rules.learn_references(before)
    work = quality_rules.judge(refs)
    rows = before.collect()
    kept = {r.doc_id for r, k in zip(rows, work([r.text for r in rows])[6], strict=True) if k}
    assert {r.doc_id for r in after.collect()} == kept and kept


def test_language_stage(stages):
    before, after = stages["language identification"]
    gone = set(before.collect()) - set(after.collect())
    assert len(gone) < 0.02 * before.count()


def test_near_duplicate_stage(stages):
    from test_table_operators import brute_classes

    before, after = stages["near duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {c for c, _, _ in brute_classes(rows).values()}


def test_secret_stage(stages):
    before, after = stages["secrets"]
    texts = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        spans = secret_scan.base_spans(r.text)
        new = texts[r.doc_id]
        assert new.n_chars == len(new.text) and not re.search("AKIA[A-Z0-9]{16}", new.text)
        assert bool(spans) == (new.text != r.text)
    assert len(texts) == before.count()


def test_secrets_go_and_the_rest_stays(spark):
    docs = spark.createDataFrame([(1, "a password=32bb02aa3b580bf8ab z", "en", "s", 31), (2, "clean text", "en", "s", 10), (3, None, None, None, None)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = {r.doc_id: r for r in corpus_pipeline.secret_stage(spark, docs, SF001).collect()}
    assert rows[1].text == "a [SECRET] z" and rows[1].n_chars == 12
    assert rows[2] == docs.where("doc_id = 2").first() and rows[3].text is None


def test_packing_stage(stages):
    before, after = stages["packing"]
    gpt = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(gpt.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
    assert after.agg(F.sum("length")).first()[0] == want


def test_awkward_documents_through_all_stages(spark, odd):
    docs = odd.drop("id", "size")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF001)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.collect()
    corpus_pipeline.STAGES[-1][1](spark, docs, SF001).collect()


def test_extra_columns_pass_through_all_stages(spark, odd):
    """Columns named like the stages' own temporary ones come back as they went in, also without n_chars."""
    names = ["verdict", "found", "masked", "own_key", "first_id", "first_key", "__verdict", "__found", "__masked", "__own"]
    docs = odd.drop("n_chars")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF001)
        assert after.columns == columns
        for r in after.collect():
            assert [r[n] for n in names] == [n + str(r.doc_id or 0) for n in names]


def test_empty_documents_through_all_stages(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
        assert docs.collect() == []


def test_entry_without_the_operators(tmp_path):
    repo = Path(corpus_pipeline.__file__).parent
    for p in repo.glob("*.py"):
        if p.name != "corpus_pipeline.py":
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "mailsift").mkdir()
    for p in (repo / "mailsift").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "mailsift" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'parse_mail' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    (tmp_path / "run.py").write_text(code)
    entry = (tmp_path / "__spark_entry__.py")
    text = entry.read_text()
    entry.unlink()
    entry.write_text(text)
    done = subprocess.run([sys.executable, "-B", "run.py"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_copies_are_classes_of_their_own_text(spark):
    df = spark.createDataFrame([(3, "x y"), (1, "x y"), (2, "z")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.class_id) for r in jaccard_join.jaccard_join(df).collect()) == [(1, 1), (2, 2), (3, 1)]
