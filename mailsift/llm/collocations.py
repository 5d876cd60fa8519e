"""Phrase collocations by top-order marginalisation.

Every word begins one window: itself and the words that follow it in its piece, padded to the longest phrase. Only
these windows are counted; the count of a shorter phrase is the sum over the windows that begin with it, which a
ROLLUP over the window's columns gives for all lengths at once.

Windows of four words are mostly unique, so before they are counted each is cut where no frequent phrase can go on:
a phrase is at most as frequent as any two neighbours in it. Neighbours are counted by 64-bit hash in a first
pass, and the hashes that reach the least count are marked in a bit table whose size follows their number up to
``MOST_BITS``. Marks of other neighbours (and a full table) only leave windows longer than need be: no count that
reaches the least count changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import Memo, slices
from mailsift.session import scratch_path

LONGEST, LEAST, COVERED, TOP = 4, 30, 80, 2000
#: Bits of the table of frequent neighbours: so many a pair, at least and at most (32 MB).
BITS_A_PAIR, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28
#: Text of a batch: windows are counted this many bytes at a time before they leave a task.
BATCH_BYTES = 3 << 20
#: Parts that each language's candidates are ranked in first.
PARTS = 64
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]

_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: list[str | None]) -> list[bytes]:
    """The words of all texts in order; ``\\n`` stands wherever a piece ends."""
    raw = "\n".join(t or "" for t in texts).encode("utf-8", "replace").translate(_TABLE)
    return raw.replace(b"\n", b" \n ").split(b" ")


def _coded(words: list[bytes], code: Memo) -> np.ndarray:
    """Hash of each word; 0 for a piece's end. Empty strings between spaces are left out."""
    h = np.fromiter(map(code.__getitem__, words), np.uint64, len(words))
    return h[h != 1]


def _memo() -> Memo:
    """Word hashes from 2 on: 0 is the end of a piece and 1 no word."""
    code = Memo(lambda w: max(xxhash.xxh3_64_intdigest(w), 2), most=100_000)
    code[b"\n"], code[b""] = 0, 1
    code.old = {b"\n": 0, b"": 1}
    return code


def pair_hashes(h: np.ndarray, lang: str) -> np.ndarray:
    """A hash of each word with the next one, in a language; 0 where a piece ends between or at them."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    pairs = (h[:-1] * _ODD ^ (h[1:] >> np.uint64(7)) ^ h[1:]) * _ODD + seed
    pairs = np.maximum(pairs ^ (pairs >> np.uint64(29)), np.uint64(1))
    pairs[(h[:-1] == 0) | (h[1:] == 0)] = 0
    return pairs


def _by_language(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[tuple[str, list[str]]]:
    texts = batch.column("text")
    for lo, hi in slices(texts, limit):
        by: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        yield from by.items()
        pa.default_memory_pool().release_unused()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): counts of neighbours by hash."""
    code = _memo()
    for batch in batches:
        for lang, texts in _by_language(batch):
            found, n = np.unique(pair_hashes(_coded(words_of(texts), code), lang), return_counts=True)
            keep = found != 0
            yield pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(n[keep])], ["pair", "n"])


def _windows(bits):
    """(lang, w1 .. w4, n): counts of padded windows, cut where the bit table has no mark for the next two words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table = _memo(), np.frombuffer(bits.value, np.uint8)
        mask = np.uint64(len(table) * 8 - 1)
        for batch in batches:
            for lang, texts in _by_language(batch):
                words = [w for w in words_of(texts) if w]
                h = _coded(words, code)
                pairs = pair_hashes(h, lang)
                at = pairs & mask
                goes_on = (pairs != 0) & (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                # places of the words in the batch's own sorted vocabulary, from 1 on; 0 pads
                names, place = np.unique(h, return_inverse=True)
                first = np.zeros(len(names), np.int64)
                first[place[::-1]] = np.arange(len(h))[::-1]
                if len({words[i] for i in first}) != len(set(words)):  # two words of the batch share a hash
                    order = {w: i for i, w in enumerate(sorted(set(words)))}
                    place = np.fromiter(map(order.__getitem__, words), np.int64, len(words))
                    first = np.zeros(len(order), np.int64)
                    first[place[::-1]] = np.arange(len(words))[::-1]
                place += 1
                columns, alive = [np.where(h != 0, place, 0)], h != 0
                for k in range(1, LONGEST):
                    alive = alive & np.append(goes_on[k - 1:], np.zeros(min(k, len(h)), bool))[:len(h)]
                    shifted = np.append(place[k:], np.zeros(min(k, len(h)), np.int64))
                    columns.append(np.where(alive, shifted, 0))
                starts = h != 0
                key = columns[0][starts]
                kept = []
                for c in columns[1:]:  # one number for each distinct prefix, column by column
                    kept.append((key_names := np.unique(key * (len(first) + 1) + c[starts], return_inverse=True))[0])
                    key = key_names[1]
                if not len(key):
                    continue
                one = np.zeros(len(kept[-1]), np.int64)
                one[key[::-1]] = np.nonzero(starts)[0][::-1]
                spelled = pa.array([words[i] for i in first], pa.binary()).cast(pa.string())
                out = [pa.array([lang] * len(one), pa.string())]
                for c in columns:
                    taken = c[one]
                    out.append(spelled.take(pa.array(np.where(taken > 0, taken - 1, 0), mask=taken == 0)))
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.bincount(key, minlength=len(one)))],
                                                 ["lang", *WORDS, "n"])

    return run


def _bit_table(pairs: DataFrame, least: int):
    """The table of the pairs that reach the least count, as bytes: 64-bit words of it are put together by Spark, so
    that the driver gets at most ``MOST_BITS`` / 64 of them."""
    at = scratch_path(pairs.sparkSession, "pairs")
    pairs.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pair").write.parquet(at)
    found = pairs.sparkSession.read.parquet(at)
    n = found.count()
    size = LEAST_BITS
    while size < min(MOST_BITS, n * BITS_A_PAIR):
        size *= 2
    cells = found.selectExpr(f"shiftright(pair & {size - 1}, 6) AS cell", "shiftleft(1L, CAST(pair & 63 AS INT)) AS mark").groupBy(
        "cell").agg(F.bit_or("mark").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return table.astype("<i8").tobytes()


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, w1 .. w4, k, f): how often each phrase of up to four words occurs, for those that reach ``least``, and
    per language a row with k = 0 and the number of words, whatever it is.

    A-Z count as a-z. Pieces end at ``.,;:!?`` and line breaks (0x0A to 0x0D), words at spaces and tabs. A null language
    is ``und``, a null text empty. Columns besides the two are not read, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(_bit_table(rows.mapInArrow(_pairs, "pair bigint, n bigint"), least))
    names = ", ".join(f"{w} string" for w in WORDS)
    # whether a window is full is asked after the count: asked before, the two uses of the count would be two counts
    windows = rows.mapInArrow(_windows(bits), f"lang string, {names}, n bigint").groupBy("lang", *WORDS).agg(
        F.sum("n").alias("f"), F.max(F.col(WORDS[-1]).isNotNull()).alias("full"))
    # the windows are the longest phrases themselves; the rollup sums all shorter prefixes
    whole = windows.where("full").select("lang", *WORDS, F.lit(LONGEST).alias("k"), "f")
    counted = F.when(F.col("full").isNotNull(), F.col("f"))
    shorter = windows.rollup("lang", *WORDS[:-1]).agg(F.sum(counted).alias("f"), F.grouping_id().alias("rolled")).withColumn(
        "k", F.lit(LONGEST - 1) - F.bit_count("rolled"))
    # a prefix that ends in padding is a shorter one's own window
    last = F.element_at(F.array(*WORDS[:-1]), F.greatest("k", F.lit(1)))
    sums = shorter.where((F.col("k") == 0) | ((F.col("k") > 0) & last.isNotNull())).select(
        "lang", *WORDS[:-1], F.lit(None).cast("string").alias(WORDS[-1]), "k", "f")
    return whole.unionByName(sums).where((F.col("f") >= least) | (F.col("k") == 0))


def _spelled(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED,
                 top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score.

    Candidates are phrases of two to four words that occur at least ``least`` times (a). The cut after the first k words
    with l and r occurrences of its parts scores floor(2000000 * a / (l + r)); the least cut counts, the shortest
    first part of equals. Candidates inside a longer one that has at least ``covered`` per cent of their occurrences
    are dropped. Order: score and a descending, then the phrase by its UTF-8 bytes. Products are decimals of 38 digits.
    An empty table gives no rows. See ``phrase_counts`` for words, nulls and other columns.
    """
    spark = docs.sparkSession
    at = scratch_path(spark, "phrases")
    phrase_counts(docs, text, lang, least).withColumn("phrase", _spelled(*WORDS)).write.parquet(at)
    counts = spark.read.parquet(at)
    known = counts.where((F.col("k") > 0) & (F.col("k") < LONGEST))
    candidates = counts.where("k > 1")

    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array_compact(F.array(*(
        F.when(F.col("k") > c, F.struct(F.lit(c).alias("cut"), _spelled(*WORDS[:c]).alias("head"), _spelled(*WORDS[c:]).alias("tail")))
        for c in range(1, LONGEST))))).alias("x")).select("lang", "phrase", "a", "x.*")
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("up", wide("a") * F.lit(2000000)).withColumn(
        "down", wide("l") + wide("r")).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    parts = F.array_compact(F.array(*(
        F.when((F.col("k") >= b) if a else (F.col("k") > b), _spelled(*WORDS[a:b]))
        for a in range(LONGEST - 1) for b in range(a + 2, LONGEST + 1) if b - a < LONGEST)))
    inner = candidates.where("k > 2").select("lang", "f", F.explode(parts).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    share = F.lit(100).cast("decimal(3,0)") * F.coalesce(F.col("longer"), F.lit(0)).cast("decimal(19,0)") < F.lit(covered).cast("decimal(3,0)") * wide("a")
    kept = best.join(longer, ["lang", "phrase"], "left").where(share).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    firsts = kept.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(
        F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
