"""Token counts: every distinct pre-token is tokenized once, and documents add up the counts of theirs.

First all distinct pre-tokens of the corpus are gathered with their frequencies and counted once each: the
dictionary, a written table. Its ``HOT`` most frequent short entries, of bounded size, are broadcast. Then
each document's pre-token frequencies are taken: what the broadcast part covers is summed where the document is
read, the rest joins the dictionary on the pre-token. No ids are made for documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import Memo, slices
from mailsift.llm.json_bpe import read_path, special_strings, tokenizer
from mailsift.llm.pretokens import INNER_SPACE, splitter
from mailsift.session import scratch_path

#: The broadcast part of the dictionary: entries at most, and code points of an entry at most.
HOT, HOT_LENGTH = 100_000, 24
#: A task flushes its distinct pre-tokens at so many, and looks at so many rows of its input at a time.
FLUSH = 150_000
LIMIT = 1024


class Pieces:
    """Frequencies of chunks and pre-tokens of texts: chunks (cut at spaces) first, split only when distinct."""

    def __init__(self, pattern: str, special: tuple[str, ...]):
        import regex

        self.split = splitter(pattern)
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

    def parts(self, text: str) -> list[str]:
        """Pre-tokens of a text that holds special strings or odd white space; a special string is one."""
        if self.cut is None:
            return self.split(text)
        return [p for i, s in enumerate(self.cut(text)) for p in ([s] if i % 2 else self.split(s))]

    def chunks(self, text: str) -> tuple[str, list[str], list[str]]:
        """(first chunk, the chunks after a space, pre-tokens) - either chunks or pre-tokens are empty."""
        if any(s in text for s in self.special) or INNER_SPACE.search(text):
            return "", [], self.parts(text)
        first, *rest = text.split(" ")
        return first, rest, []


def _distinct(content: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(pattern, special_strings(content))
        rest: Counter = Counter()
        other: Counter = Counter()

        def rows():
            for chunk, n in rest.items():
                for p in pieces.split(" " + chunk):
                    other[p] += n
            rest.clear()
            out = pa.RecordBatch.from_arrays([pa.array(list(other), pa.string()), pa.array(list(other.values()), pa.int64())],
                                             ["piece", "n"])
            other.clear()
            return out

        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts):
                for text in texts.slice(lo, hi - lo).to_pylist():
                    first, chunks, parts = pieces.chunks(text)
                    rest.update(chunks)
                    other.update(parts)
                    if first:
                        other.update(pieces.split(first))
                if len(rest) + len(other) > FLUSH:
                    yield rows()
        yield rows()

    return run


def _count(content: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(content)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                # one pre-token at a time; special strings are tokens of their own in the library's default
                found = t.encode_batch_fast(part.column("piece").to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column("piece"), part.column("n"), pa.array([len(e) for e in found], pa.int32())],
                    ["piece", "n", "tokens"])

    return run


def dictionary(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(piece, n, tokens): all distinct pre-tokens, how often they occur, how many tokens each makes."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_path(path))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    found = rows.mapInArrow(lambda b: _distinct(*vocabulary.value)(b), "piece string, n bigint")
    return found.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(
        lambda b: _count(vocabulary.value[0])(b), "piece string, n bigint, tokens int")


def _known(vocabulary, hot):
    """(key, n_bytes, sum over the pre-tokens in the broadcast part, the other pre-tokens and their frequencies)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, pattern = vocabulary.value
        pieces, known = Pieces(pattern, special_strings(content)), hot.value

        def value(parts):
            """Tokens of the known ones, and the others."""
            return sum(known.get(p, 0) for p in parts), tuple(p for p in parts if p not in known)

        of = Memo(lambda chunk: value(pieces.split(" " + chunk)), 100_000)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                sums, sizes, others, counts = [], [], [], []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    text = text or ""
                    first, chunks, parts = pieces.chunks(text)
                    total, more = value(parts + pieces.split(first) if first else parts)
                    tail = Counter(more)
                    for chunk, n in Counter(chunks).items():
                        one, unknown = of[chunk]
                        total += n * one
                        for p in unknown:
                            tail[p] += n
                    sums.append(total)
                    sizes.append(len(text.encode("utf-8", "replace")))
                    others.append(list(tail))
                    counts.append(list(tail.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                     pa.array(others, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                    ["id", "n_bytes", "known", "pieces", "counts"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per input row.

    Null and empty texts have 0 bytes and 0 tokens. Rows that share an id (or have none) are told apart by a row number
    that is written with them, so each gets its own count. Two tables are written to the shared folder: the
    dictionary, and one row per document with the pre-tokens that the broadcast part does not cover.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_path(path))
    at = scratch_path(spark, "pieces")
    dictionary(docs, text, path).write.parquet(at)
    table = spark.read.parquet(at)
    best = table.where(F.length("piece") <= HOT_LENGTH).orderBy(F.desc("n"), "piece").limit(HOT).toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(best.column("piece").to_pylist(), best.column("tokens").to_pylist(), strict=True)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    at = scratch_path(spark, "piece-counts")
    rows.mapInArrow(lambda b: _known(vocabulary, hot)(b),
                    f"id {kind}, n_bytes bigint, known bigint, pieces array<string>, counts array<bigint>").withColumn(
        "row", F.monotonically_increasing_id()).write.parquet(at)
    known = spark.read.parquet(at)
    pairs = known.select("row", F.explode(F.arrays_zip("pieces", "counts")).alias("p")).select(
        "row", F.col("p.pieces").alias("piece"), F.col("p.counts").alias("count"))
    rest = pairs.join(table.select("piece", "tokens").hint("shuffle_hash"), "piece").groupBy("row").agg(
        F.sum(F.col("count") * F.col("tokens")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0))
    return known.select("row", "id", "n_bytes", "known").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
