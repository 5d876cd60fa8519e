"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1-, 2- and 3-grams of lower-cased letters per language map-side and sums them in Spark;
the driver turns languages x buckets counts into one log-probability matrix, which is broadcast. Scoring gathers
the rows of that matrix for the n-grams of a whole batch of texts at once and adds them up per text. The matrix
holds whole numbers (log-probabilities times ``SCALE``), so a sum does not depend on the order of its parts.

The posterior only compares the learned languages: it is near 1 for any longer text. Whether a text is in one of them
at all is told by its fit, the mean log-probability of the n-grams that begin with its letters, against what the
labelled documents of the language have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import held, slices, text_udf

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
SMOOTHING = 0.5
SCALE = 1 << 12
UNKNOWN = "und"
#: Bytes of text whose n-grams are held at a time: each takes some 50 bytes and 4 more for a language.
GRAM_BYTES = 1 << 20
RESULT = "lang_pred string, score double"
#: A text fits a language if its mean lies above the median of the labelled documents less so many standard deviations
#: of a letter, and so many more over the root of its letters, as the mean of a short text varies.
SPREAD, SHORT_SPREAD = 1.5, 3.0
#: The least standard deviation, and steps to a unit in which means and deviations are counted.
LEAST_DEVIATION, STEPS = 0.5, 64
JUDGED = RESULT + ", margin double"


@dataclass(frozen=True)
class LanguageModel:
    """``weights``: buckets x languages, int32; ``prior``: per language, same scale."""

    langs: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray


def _letters() -> np.ndarray:
    """Code points with letters kept and all else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x40000):
        if chr(c).isalpha():
            table[c] = c
    return table


def _codes(texts: list[str], orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts set end to end, all but letters as spaces, and each text's start."""
    pad = " " * max(orders)
    table = held(("letters",), _letters)
    lowered = [t.lower() + pad for t in texts]
    starts = np.cumsum([0, *map(len, lowered)])
    return table[np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)], starts


def grams(texts: list[str], orders=ORDERS, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams (one row per order) of the texts set end to end, and each text's start.

    Runs of other characters than letters count as single spaces would, character by character; pads keep an
    n-gram from reaching into the next text.
    """
    code, starts = _codes(texts, orders)
    out, key = [], np.zeros(len(code), np.uint32)
    for n in range(1, max(orders) + 1):
        key = key * np.uint32(0x01000193) + (np.roll(code, 1 - n) + np.uint32(0x9E37 * n))
        if n in orders:
            h = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits))
    return np.stack(out), starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's documents; bucket -1 counts documents."""
    size = 1 << BUCKET_BITS
    counts: dict[str, np.ndarray] = {}

    def rows():
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at - 1), pa.array(c[at])],
                                             ["lang", "bucket", "n"])
        counts.clear()

    for batch in batches:
        for lo, hi in slices(batch.column("text"), GRAM_BYTES):
            langs = np.array(batch.column("lang").slice(lo, hi - lo).to_pylist(), object)
            texts = batch.column("text").slice(lo, hi - lo).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                held_counts = counts.setdefault(lang, np.zeros(size + 1, np.int64))
                for row in grams(own)[0]:
                    held_counts[1:] += np.bincount(row, minlength=size)
                held_counts[0] += len(own)
            if len(counts) > 64:
                yield from rows()
    yield from rows()


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """Learns from every row with a text and a language. The driver gets languages x buckets counts."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_pylist()
    langs = tuple(sorted(set(names)))
    at = {x: i for i, x in enumerate(langs)}
    table = np.zeros((len(langs), (1 << BUCKET_BITS) + 1))
    table[[at[x] for x in names], counts.column("bucket").to_numpy() + 1] = counts.column("n").to_numpy()
    gram = table[:, 1:] + SMOOTHING
    weights = np.rint(np.log(gram / gram.sum(axis=1, keepdims=True)) * SCALE).astype(np.int32)
    prior = np.rint(np.log(table[:, 0] / max(1, table[:, 0].sum())) * SCALE).astype(np.int64)
    return LanguageModel(langs, np.ascontiguousarray(weights.T), prior)


def fit(model: LanguageModel, texts: list[str], langs: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Letters of each text, and the mean and standard deviation of their n-grams' log-probability in its language."""
    code, starts = _codes(texts)
    letters = code != 32
    own = np.repeat(langs, np.diff(starts))
    x = np.zeros(len(code), np.int64)
    for row in buckets:
        x += model.weights[row, own]
    x[~letters] = 0
    n, total, squares = (np.add.reduceat(v, starts[:-1], dtype=np.int64) for v in (letters, x, x * x))
    some, unit = np.maximum(n, 1), len(buckets) * SCALE
    mean = total / some
    return n, mean / unit, np.sqrt(np.maximum(squares / some - mean * mean, 0)) / unit


def _fits(model: LanguageModel):
    """A function from labelled batches to (lang, mean, deviation, n): documents by fit, in steps."""
    at = {x: i for i, x in enumerate(model.langs)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            for lo, hi in slices(batch.column("text"), GRAM_BYTES):
                langs = batch.column("lang").slice(lo, hi - lo).to_pylist()
                texts = batch.column("text").slice(lo, hi - lo).to_pylist()
                n, mean, deviation = fit(model, texts, np.array([at[x] for x in langs]), grams(texts)[0])
                steps = np.rint(np.stack([mean, deviation]) * STEPS).astype(np.int64)
                for i in np.flatnonzero(n):
                    key = (langs[i], *steps[:, i].tolist())
                    counts[key] = counts.get(key, 0) + 1
            columns = list(zip(*counts)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in [*columns[1:], counts.values()])],
                ["lang", "mean", "deviation", "n"])

    return work


def _median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    return values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)] / STEPS


def learn_fits(spark: SparkSession, model: LanguageModel, docs: DataFrame, lang: str = "lang",
               text: str = "text") -> np.ndarray:
    """Per language of ``model``: median mean and median deviation of its labelled documents' fits, over all rows that
    taught the model. The driver gets counts by step, some thousands a language at most. No letters: nothing fits."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(model)
    counts = rows.mapInArrow(lambda batches: _fits(shared.value)(batches),
                             "lang string, mean bigint, deviation bigint, n bigint").groupBy(
        "lang", "mean", "deviation").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(counts.column("lang").to_pylist(), object)
    mean, deviation, n = (counts.column(c).to_numpy() for c in ("mean", "deviation", "n"))
    out = np.full((len(model.langs), 2), [np.inf, LEAST_DEVIATION])
    for i, x in enumerate(model.langs):
        own = langs == x
        if own.any():
            out[i] = _median(mean[own], n[own]), max(LEAST_DEVIATION, _median(deviation[own], n[own]))
    return out


def scorer(model: LanguageModel, fits: np.ndarray | None = None):
    """A function from texts to (languages, scores); with ``fits`` also how far each text's mean lies above the bound of
    its language (below: negative; no letters: minus infinity)."""

    def work(texts):
        langs, scores, margins = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        columns = [langs, scores] if fits is None else [langs, scores, margins]
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not known or not model.langs:
            return columns
        buckets, starts = grams([texts[i] for i in known])
        total = np.tile(model.prior, (len(known), 1))
        for row in buckets:
            total += np.add.reduceat(model.weights[row], starts[:-1], axis=0, dtype=np.int64)
        best = total.argmax(axis=1)
        gap = (total - total[np.arange(len(known)), best][:, None]) / SCALE
        sure = 1 / np.exp(gap).sum(axis=1)
        for i, b, s in zip(known, best, sure, strict=True):
            langs[i], scores[i] = model.langs[b], s
        if fits is not None:
            n, mean, _ = fit(model, [texts[i] for i in known], best, buckets)
            middle, deviation = fits[best].T
            margins[known] = mean - middle + deviation * (SPREAD + SHORT_SPREAD / np.sqrt(np.maximum(n, 1)))
        return columns

    return work


def predict(spark: SparkSession, model: LanguageModel, text: Column | str = "text", repeatable: bool = True) -> Column:
    """The struct ``RESULT``: the likeliest learned language and its posterior probability.

    ``und`` with score 0 where a text is null, empty or has no letter, or nothing was learned. Ties go to the
    language that sorts first. The broadcast matrix has 4 bytes x 65,536 buckets for each language.
    """
    shared = spark.sparkContext.broadcast(model)
    return text_udf(lambda: scorer(shared.value), RESULT, text, repeatable, GRAM_BYTES)


def judge(spark: SparkSession, model: LanguageModel, fits: np.ndarray, text: Column | str = "text",
          repeatable: bool = True) -> Column:
    """The struct ``JUDGED``: as ``predict``, and the margin by which a text fits its language (negative: it doesn't)."""
    shared = spark.sparkContext.broadcast((model, fits))
    return text_udf(lambda: scorer(*shared.value), JUDGED, text, repeatable, GRAM_BYTES)
