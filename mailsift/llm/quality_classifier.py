"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text that resembles the good sample compresses smaller with the good dictionary. It is cut into blocks, each
compressed with either dictionary; the difference of the summed sizes, divided by the size without a dictionary,
is the main feature. Text that repeats itself shrinks to so little that this difference says nothing, so the
plain ratio (up to ``PLAIN_RATIO``, where ordinary prose begins) is the second. A logistic curve fitted on
labelled rows turns both into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import text_udf
from mailsift.session import scratch_path

#: Blocks in which a text is compressed, in bytes; the dictionary then helps all along a long text.
BLOCK_BYTES = 4096
#: The dictionaries are trained on at most so many blocks a label, those with the smallest hash of (id, block).
SAMPLE_BLOCKS = 4000
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
#: The curve is fitted on a histogram of the features, with so many bins over -1..1 and over 0..PLAIN_RATIO: all
#: labelled rows count.
BINS, RATIO_BINS = 1024, 35
PLAIN_RATIO = 0.35
#: Share of labelled rows, by hash of the id, whose blocks train dictionaries; the rest fit the curve.
DICTIONARY_SHARE = 35
CUT = 0.3
RESULT = "score double, predicted int, difference double, ratio double"


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    #: Of the difference, of the ratio, and the constant.
    curve: tuple[float, float, float]


def blocks(raw: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    for i in range(0, len(raw), size):
        yield raw[i:i + size]


def differences(good: bytes, bad: bytes):
    """A function from texts to their features: the difference, positive where the good dictionary helps more, and
    the plain ratio."""
    def packer(raw):
        if not raw:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        data = zstandard.ZstdCompressionDict(raw)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False,
                                        write_checksum=False, write_dict_id=False)

    plain, with_good, with_bad = packer(b""), packer(good), packer(bad)

    def work(texts):
        out, ratio = np.zeros(len(texts)), np.full(len(texts), PLAIN_RATIO)
        for i, text in enumerate(texts):
            p = g = b = 0
            raw = (text or "").encode("utf-8", "replace")
            for part in blocks(raw):
                p += len(plain.compress(part))
                g += len(with_good.compress(part))
                b += len(with_bad.compress(part))
            if p:
                out[i] = max(-1.0, min(1.0, (b - g) / p))
                ratio[i] = min(PLAIN_RATIO, p / len(raw))
        return [out, ratio]

    return work


def sample_blocks(rows: DataFrame, most: int = SAMPLE_BLOCKS) -> list[bytes]:
    """The ``most`` blocks of the texts of ``rows`` (id, text) with the smallest hash of (id, block number).

    First only hashes are compared, then just the chosen blocks are cut out of their texts.
    """
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("text") / BLOCK_BYTES).cast("int") - 1, F.lit(0)))
    hashed = F.transform(numbers, lambda n: F.struct(F.xxhash64("id", n).alias("h"), n.alias("n")))
    least = rows.select(F.explode(hashed).alias("b")).select("b.h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if least is None:
        return []
    chosen = rows.select("id", "text", F.explode(F.filter(hashed, lambda b: b["h"] <= least)).alias("b"))
    block = F.substring(F.encode("text", "UTF-8"), F.col("b.n") * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES))
    return [bytes(r.block) for r in chosen.select("b.h", "id", "b.n", block.alias("block")).orderBy("h", "id", "n").limit(most).collect()]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where there are too few to train on."""
    samples = [s for s in samples if s]
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 4))
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little or too uniform text
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def fit_curve(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, ...]:
    """Coefficients and constant of the logistic curve through counts of good and bad rows at feature values ``x``.

    Newton steps on the weighted log-loss with a small ridge; each label counts with one row more, spread evenly,
    so that a label that never occurs leaves a finite curve.
    """
    good, bad = good + 1 / len(x), bad + 1 / len(x)
    x, w = np.column_stack([x, np.ones(len(x))]), good + bad
    beta = np.zeros(x.shape[1])
    beta[-1] = math.log(good.sum() / bad.sum())
    ridge = np.diag([1e-3] * (len(beta) - 1) + [1e-9])

    def loss(b):
        return np.logaddexp(0, -(x @ b)) @ good + np.logaddexp(0, x @ b) @ bad + b @ ridge @ b / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (good - w * p) - ridge @ beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return tuple(map(float, beta))


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", quality: str = "quality") -> CompressionModel:
    """Learns from rows (id, text, quality 0 or 1); rows with a null in text or quality are not used.

    Half of the rows, by hash of the id, offer blocks for the dictionaries (``SAMPLE_BLOCKS`` a label at most);
    the other half, all of it, fits the curve.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(quality).isin(0, 1)).select(
        F.col(id_col).cast("string").alias("id"), F.col(quality).cast("int").alias("quality"), F.col(text).alias("text"))
    half = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("half")), F.lit(100)) < DICTIONARY_SHARE
    at = scratch_path(labelled.sparkSession, "labelled")
    rows.write.parquet(at)  # the labelled texts are gathered once and read four times
    rows = labelled.sparkSession.read.parquet(at)
    made = [_dictionary(sample_blocks(rows.where(half & (F.col("quality") == q)))) for q in (1, 0)]
    feature = text_udf(lambda: differences(*made), "x double, ratio double", "text")
    bins = F.floor((F.col("f.x") + 1) * (BINS / 2)) * (RATIO_BINS + 1) + F.floor(F.col("f.ratio") / PLAIN_RATIO * RATIO_BINS)
    counts = rows.where(~half).select("quality", feature.alias("f")).groupBy(
        "quality", bins.alias("bin")).count().collect()
    held = np.zeros((2, (BINS + 1) * (RATIO_BINS + 1)))
    for r in counts:
        held[r.quality, r.bin] += r["count"]
    i, j = np.divmod(np.arange(held.shape[1]), RATIO_BINS + 1)
    at = np.column_stack([(i + 0.5) / (BINS / 2) - 1, j / RATIO_BINS * PLAIN_RATIO])
    return CompressionModel(*made, fit_curve(at, held[1], held[0]))


def score(spark: SparkSession, model: CompressionModel, text: Column | str = "text") -> Column:
    """The struct ``RESULT``. Null and empty texts have difference 0 and the ratio of prose, and so the score
    of the curve there.

    The two dictionaries, of ``DICTIONARY_BYTES`` at most, are broadcast.
    """
    shared = spark.sparkContext.broadcast(model)

    def make():
        m = shared.value
        work = differences(m.good, m.bad)

        def scored(texts):
            x, ratio = work(texts)
            p = 1 / (1 + np.exp(-np.clip(m.curve[0] * x + m.curve[1] * ratio + m.curve[2], -700, 700)))
            return [p, (p >= CUT).astype(np.int32), x, ratio]

        return scored

    return text_udf(make, RESULT, text)
