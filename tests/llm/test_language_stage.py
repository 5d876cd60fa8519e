"""The language stage drops what no labelled document teaches and keeps the rest."""

import random
import string

import pytest
from pyspark.sql import functions as F

import llm_tables  # noqa: F401

import corpus_pipeline
from mailsift.llm import language_id

SF01 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("untaught", ["de", "es"])
def test_unlearned_languages_and_gibberish_go(spark, untaught):
    draw = random.Random(7)
    noise = ["Это предложение написано на языке, которого никто здесь не знает.", "asdf jkl; qwer uiop zxcv bnm, lkjhgf qwerty",
             "".join(draw.choices(string.ascii_lowercase + " ", k=600)), "日本語だけで書かれた文章です。誰も教えていません。"]
    junk = spark.createDataFrame([(-1 - i, t, None, "noise", len(t)) for i, t in enumerate(noise)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    real = spark.read.parquet(f"{SF01}/documents.parquet")
    docs = real.select("doc_id", "text", F.when(F.col("lang") != untaught, F.col("lang")).alias("lang"), "source",
                       "n_chars").unionByName(junk.select(*[F.col(c).cast(real.schema[c].dataType) for c in junk.columns]))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SF01).collect()}
    of = {r.doc_id: r.lang for r in real.collect()}
    foreign, clean = ({i for i, x in of.items() if (x == untaught) == want} for want in (True, False))
    assert not any(i < 0 for i in kept)
    assert len(kept & foreign) <= 0.02 * len(foreign) and len(foreign) > 50
    assert len(kept & clean) >= 0.98 * len(clean)


def test_margin_matches_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = language_id.train(docs)
    fits = language_id.learn_fits(spark, model, docs)
    text = "Der Hund, 12 und die Katze"
    langs, scores, margins = language_id.scorer(model, fits)(["", text, "12", None])
    k = model.langs.index(langs[1])
    own = [sum(int(model.weights[row[i], k]) for row in language_id.grams([text])[0])
           for i, c in enumerate(text) if c.isalpha()]
    mean = sum(own) / len(own) / 3 / language_id.SCALE
    bound = fits[k][0] - fits[k][1] * (language_id.SPREAD + language_id.SHORT_SPREAD / len(own) ** 0.5)
    assert margins[1] == pytest.approx(mean - bound)
    assert [margins[i] for i in (0, 2, 3)] == [float("-inf")] * 3
    assert (langs, list(scores)) == tuple(map(list, language_id.scorer(model)(["", text, "12", None])))
