"""Rules that must hold for any input: nothing dropped, nothing that ends a job."""

import pytest
from pyspark.sql import functions as F

from mailsift.functions.headers import email_domain
from mailsift.operators.corpus import mark_domains
from mailsift.operators.embed import embed_hashing
from mailsift.operators.html import html_to_text_py
from mailsift.operators.measure import score_histogram, threshold_sweep
from mailsift.operators.parse import parse_mail
from mailsift.operators.route import route_tagged
from conftest import one_col


def test_hashing_counts_every_token_of_any_script(spark):
    long = " ".join(f"w{i}" for i in range(600))
    df = spark.createDataFrame([(0, "привет мир"), (1, long), (2, long + " end tail")], "i int, text string")
    v = {r.i: r.embedding for r in embed_hashing(df).collect()}
    assert any(v[0])
    assert v[1] != v[2]


@pytest.mark.parametrize("steps", [1, 3, 20, 300, 9999])
def test_sweep_counts_every_message(spark, steps):
    df = spark.createDataFrame([("1.0000", 1), ("0.9990", 1), ("0.1000", 0), (".5", 1), ("1e-1", 0), ("2", 1), (None, 1)],
                               "score_text string, y int")
    rows = threshold_sweep(spark, df, F.col("y") == 1, steps=steps).orderBy("threshold").collect()
    assert len(rows) == steps + 1
    assert (rows[0].tp, rows[0].fp) == (3, 2)
    assert rows[-1].tp == 1
    assert score_histogram(df, bins=30).agg(F.sum("n")).first()[0] == 5


def test_sweep_refuses_odd_steps(spark):
    df = spark.createDataFrame([("1.0000", 1)], "score_text string, y int")
    with pytest.raises(ValueError):
        threshold_sweep(spark, df, F.col("y") == 1, steps=10001)


def test_marking_with_a_large_vocabulary(spark):
    vocab = [f"d{i}.example" for i in range(2500)]
    df = spark.createDataFrame([("see http://d2400.example/x and http://other.example",)], "t string")
    assert mark_domains(df, "t", vocab).first().marked == "see [DOM_d2400.example] and other.example"


def test_halves_of_surrogate_pairs():
    assert html_to_text_py("a &#55357;&#56832; &#x110000; b") == "a \ufffd\ufffd \ufffd b"


def test_damaged_mail_is_parsed(spark):
    mail = [(0, b"Content-Type: text/plain; charset=utf-7\n\n+2D0- x"), (1, None), (2, b"Subject: \xff\xfe\n\n\xff"),
            (3, b"Content-Type: text/html\n\n<p>&#55357;</p>"), (4, b"")]
    rows = {r.i: r for r in parse_mail(spark.createDataFrame(mail, "i int, content binary")).collect()}
    assert rows[0].body == "\ufffd x" and rows[3].body == "\ufffd"
    assert rows[1].parse_error and not rows[4].parse_error


def test_tags_of_mail_in_any_bytes(spark):
    mail = spark.createDataFrame([(b"X-Spam-Status: Yes\nSubject: \xe9\n\n\xff",), (b"Subject: \xe9\n\nX-Spam-Status: Yes",)], "content binary")
    assert [r.tagged_spam for r in route_tagged(mail).collect()] == [True, False]


def test_first_address_of_a_header(spark):
    cases = {"a@b.com, c@d.com": "b.com", "a@b.com (Ann)": "b.com", '"x, y@z" <a@B.com>': "b.com", "Ann <a@b.com>, <c@d.e>": "b.com", "none": ""}
    assert one_col(spark, list(cases), email_domain) == list(cases.values())


def test_encoder_must_be_that_of_the_contract(spark):
    from mailsift.plans.train import Trained

    with pytest.raises(ValueError):
        Trained(None, 0, 4, {"embedding_model": "onnx"}).check_encoder()
    with pytest.raises(ValueError):
        Trained(None, 0, 4, {"embedding_model": "precomputed"}, "precomputed").check_encoder()
    Trained(None, 0, 4, {"embedding_model": "hashing-4"}).check_encoder()


def test_mail_without_an_embedding_gets_the_fallback(spark):
    from mailsift.plans.score import score_parsed
    from mailsift.plans.train import build_model

    mail = spark.createDataFrame(
        [(i, i % 2, f"Subject: s{i}\n\nbody {i}".encode()) for i in range(12)], "doc_id int, label int, content binary")
    emb = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(10)], "doc_id int, embedding array<double>")
    parsed = parse_mail(mail)
    trained, _ = build_model(parsed, encoder="precomputed", embedding_dim=2, embeddings=emb)
    rows = {r.doc_id: r for r in score_parsed(parsed, trained).collect()}
    assert len(rows) == 12
    assert rows[10].score_text == rows[11].score_text == "0.5000" and rows[10].scored_by_fallback
    assert not rows[1].scored_by_fallback and rows[1].status == "Yes"


@pytest.mark.parametrize("kind", ["logistic", "svm", "gbt"])
def test_models_of_every_kind_reload(spark, tmp_path, kind):
    from mailsift.operators.model import contract, load_model, predicted_class, save_model, train

    df = spark.createDataFrame([([float(i % 2), i / 20], i % 2) for i in range(20)], "features array<double>, label int")
    model = train(df, kind=kind, max_iter=20)
    save_model(spark, model, str(tmp_path), contract(model, 0, 2))
    loaded, _ = load_model(spark, str(tmp_path))
    want = [r.predicted for r in predicted_class(df, model).collect()]
    assert [r.predicted for r in predicted_class(df, loaded).collect()] == want


def test_delivery_of_a_stream_to_maildir(spark, tmp_path):
    from mailsift.plans.score import filter_files_stream
    from mailsift.plans.train import build_model

    mail = spark.createDataFrame(
        [(i, i % 2, f"Subject: {'buy now' if i % 2 else 'minutes'}\n\nbody {i}".encode()) for i in range(12)],
        "doc_id int, label int, content binary")
    trained, _ = build_model(parse_mail(mail), embedding_dim=16)
    box = tmp_path / "in"
    box.mkdir()
    for i in range(4):
        (box / f"m{i}").write_bytes(f"Subject: {'buy now' if i % 2 else 'minutes'}\n\nnew {i}".encode())
    filter_files_stream(spark, trained, [str(box)], str(tmp_path / "out"), mode="deliver").awaitTermination()
    found = [p for p in (tmp_path / "out").glob("*/new/*") if not p.name.endswith(".crc")]
    assert len(found) == 4 and {p.parent.parent.name for p in found} == {"spam", "ham"}


def test_inputs_as_listed(spark):
    from mailsift.operators.corpus import listed_inputs

    rows = {r["class"]: r.folders for r in listed_inputs(spark, " a, b ,,", ["c"]).collect()}
    assert rows == {"good": "a,b", "bad": "c"}


def test_delivery_base_is_qualified(spark, tmp_path):
    from mailsift.operators.route import qualified

    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}"


def test_hashed_words_are_those_of_mllib(spark):
    """The batched encoder gives the numbers of RegexTokenizer, HashingTF and Normalizer to the last bit."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from mailsift.operators.embed import hash_words, tokenizer

    texts = ["", " ", "\n", "a", "The the THE tHe", "x_1 2nd ²½ Ⅷ ٣ a‿b", "ÉTÉ été été", "İstanbul ΟΔΟΣ ΣΑΣ.Σ ß ẞ",
             "Привет, мир! 你好世界 😀😀 नमस्ते", "a\x00b c d​e", "z" * 1000 + " " + "я" * 1001,
             *("ü" + "abcdefghij"[:n] * 2 + " " + "é" * n for n in range(10))]
    df = spark.createDataFrame(list(enumerate([*texts, " ".join(texts)])), "i int, text string")
    for dim in (7, 384):
        tf = HashingTF(inputCol="tok", outputCol="tf", numFeatures=dim).transform(tokenizer("text", "tok").transform(df))
        want = Normalizer(inputCol="tf", outputCol="nv", p=2.0).transform(tf).select("i", vector_to_array("nv").alias("v"))
        want = {r.i: r.v for r in want.collect()}
        got = {r.i: r.embedding for r in embed_hashing(df, dim=dim).collect()}
        assert got == want and hash_words([*texts, " ".join(texts)], dim).tolist() == [want[i] for i in sorted(want)]
    nulls = spark.createDataFrame([(1, None), (2, "a")], "i int, text string")
    assert [r.embedding is None for r in embed_hashing(nulls, dim=3).orderBy("i").collect()] == [True, False]


def test_whitespace_runs_are_those_of_the_class(spark):
    from mailsift.constants import WS_CLASS
    from mailsift.functions.text import WS_RUN

    points = spark.createDataFrame([(chr(c),) for c in range(0x11000) if not 0xD800 <= c <= 0xDFFF], "c string")
    one = points.where(F.col("c").rlike("[" + WS_CLASS + "]") != F.col("c").rlike(WS_RUN))
    assert one.count() == 0 and points.where(F.col("c").rlike(WS_RUN)).count() == 29
