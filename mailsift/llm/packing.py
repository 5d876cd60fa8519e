"""Packing by cutting-stock column generation.

Documents longer than a sequence give whole sequences and one remainder; remainders and short documents are pieces.
Piece lengths, rounded up to units, make a histogram of bounded size. A linear program over patterns (ways to
fill one sequence) covers that histogram with the fewest sequences; new patterns come from a knapsack that prices
lengths by the program's duals, until none pays. Rounded down, the patterns take most pieces; what is left is
packed first-fit by decreasing length. As documents may be cut freely, the worst filled sequences are taken apart again
and their pieces, set end to end, are cut to fill the gaps of the others. The plan is small; pieces, ranked
within their length, look up their place in it.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import Memo, held, slices
from mailsift.llm.json_bpe import rank_encoding, read_path, special_strings, tokenizer
from mailsift.llm.pretokens import Chunks
from mailsift.session import scratch_path

LENGTH, END_ID = 2048, 1
#: Lengths are rounded up to this many tokens for the program, so it has LENGTH / UNIT rows.
UNIT = 8
#: Pieces of one length are ranked in groups of about this many.
RANK_ROWS = 2_000
#: A column must pay at least this much to enter the program.
LEAST_GAIN = 1e-7


# --- ids -----------------------------------------------------------------------------------------------------------


def little(numbers: array) -> array:
    """Numbers in little-endian order on any machine."""
    if sys.byteorder != "little":
        numbers.byteswap()
    return numbers


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, content: str, pattern: str):
        self.tokenizer = tokenizer(content)
        ranks = rank_encoding(content, pattern)
        whole = lambda t: [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
        if ranks is None:
            self.chunks = whole
        else:
            encode = ranks.encode_ordinary
            value = lambda c: little(array("I", encode(c))).tobytes()
            special = special_strings(content)
            # without special strings the faster encoding has the same ids for any white space
            self.chunks = Chunks(value, lambda t: whole(t) if any(s in t for s in special) else [value(t)], special, 150_000)

    def __call__(self, text: str) -> bytes:
        return b"".join(self.chunks(text)) if text else b""


def _cut(vocabulary, length: int, end_id: int, ids_of: str):
    """``ids_of``: the pieces that carry their ids - "none", "all", or "short" for those that may be cut again."""
    end = np.array([end_id], "<u4").tobytes()
    with_ids = ids_of != "none"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, pattern = vocabulary.value
        encode = held(("pack", hashlib.sha256(content.encode()).digest()), lambda: Encoder(content, pattern))
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                at, start, size, crc, total, ids = [], [], [], [], [], []
                for i, text in enumerate(texts.slice(lo, hi - lo).to_pylist()):
                    raw = encode(text or "") + end
                    n = len(raw) // 4
                    for s in range(0, n, length):
                        piece = raw[4 * s:4 * (s + length)]
                        at.append(lo + i), start.append(s), size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece)), total.append(n)
                        ids.append(piece if ids_of == "all" or ids_of == "short" and size[-1] < length else None)
                columns = [batch.column("id").take(pa.array(at, pa.int64()))] + [
                    pa.array(c, pa.int64()) for c in (start, size, crc, total)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def cut(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH,
        end_id: int = END_ID, ids_of: str = "none") -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens[, ids]) of at most ``length`` ids. Every document ends with
    ``end_id``, so a null or empty text is one piece of one id."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_path(path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _cut(vocabulary, length, end_id, ids_of)(b),
                           f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
                           + ", ids binary" * (ids_of != "none"))


# --- the program ---------------------------------------------------------------------------------------------------


def best_pattern(prices: np.ndarray, counts: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of ``room`` units: size k+1 is worth ``prices[k]``, at most ``counts[k]`` times.

    Unbounded knapsack by dynamic programming over the room; a filling that asks for more of a size than there is
    gets cut to what there is.
    """
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        k = min(r, len(prices))
        gains = value[r - 1::-1][:k] + prices[:k]  # size s = k+1 leaves r - s
        at = int(gains.argmax())
        value[r], choice[r] = value[r - 1], -1
        if gains[at] > value[r] + 1e-12:
            value[r], choice[r] = gains[at], at
    pattern, r = np.zeros(len(prices), np.int64), room
    while r > 0:
        if choice[r] < 0:
            r -= 1
        else:
            pattern[choice[r]] += 1
            r -= choice[r] + 1
    pattern = np.minimum(pattern, counts)
    return float(pattern @ prices), pattern


def relaxed(counts: np.ndarray, room: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in the linear program that covers ``counts`` with fewest sequences.

    Revised simplex with column generation. It starts from patterns of one size each; every round prices the sizes by
    the duals, adds the best pattern and drops the one that runs out first.
    """
    sizes = np.flatnonzero(counts)
    need = counts[sizes].astype(float)
    m = len(sizes)
    basis = np.zeros((m, m))  # columns are patterns
    for j, s in enumerate(sizes):
        basis[j, j] = max(1, min(room // (s + 1), counts[s]))
    inverse = np.diag(1 / np.diag(basis)) if m else basis
    used = inverse @ need
    for n in range(rounds if m else 0):
        prices = np.zeros(len(counts))
        prices[sizes] = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = best_pattern(prices, counts, room)
        column = pattern[sizes].astype(float)
        if worth < 1 + LEAST_GAIN:
            break
        way = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.where(way > 1e-9, used / way, np.inf)
        out = int(steps.argmin())
        if not np.isfinite(steps[out]):
            break
        basis[:, out] = column
        if n % 50 == 49:
            inverse = np.linalg.inv(basis)
            used = inverse @ need
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
            step = steps[out]
            used = used - step * way
            used[out] = step
        used = np.maximum(used, 0)
    patterns = np.zeros((m, len(counts)), np.int64)
    patterns[:, sizes] = np.rint(basis.T).astype(np.int64)
    return patterns, used


@dataclass(frozen=True)
class Plan:
    """``rows``: for each size (in units, less one), ranks from ``first`` to ``end`` go, ``each`` to a sequence, to the
    sequences from ``sequence`` on; sequence -1: they are cut to fill gaps. ``gaps``: on the line of all tokens that fill
    gaps, sequences from ``sequence`` on take ``gap`` tokens each between ``start`` and ``end``."""

    rows: list[tuple[int, int, int, int, int]]
    gaps: list[tuple[int, int, int, int]]
    sequences: int


def covering(counts: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold every piece once: the program's patterns rounded down, then first-fit decreasing."""
    patterns, used = relaxed(counts, room)
    left, out = counts.copy(), []
    for pattern, times in zip(patterns, np.floor(used + 1e-9).astype(np.int64), strict=True):
        has = pattern > 0
        times = int(min(times, (left[has] // pattern[has]).min())) if has.any() else 0
        if times > 0:
            out.append((pattern, times))
            left = left - pattern * times
    while left.any():
        pattern, free = np.zeros(len(counts), np.int64), room
        for s in range(len(counts) - 1, -1, -1):
            n = min(int(left[s]), free // (s + 1))
            if n > 0:
                pattern[s] = n
                free -= n * (s + 1)
        has = pattern > 0
        times = int((left[has] // pattern[has]).min())
        out.append((pattern, times))
        left = left - pattern * times
    return out


def plan(counts: np.ndarray, room: int, unit: int = UNIT) -> Plan:
    """A place for every piece of a histogram of sizes in units."""
    counts = np.asarray(counts, np.int64)
    weight = np.arange(1, len(counts) + 1)
    uses = sorted(((room - int(p @ weight), i, p, n) for i, (p, n) in enumerate(covering(counts, room))),
                  key=lambda u: (-u[0], u[1]))
    gap, filler, apart = sum(w * n for w, _, _, n in uses), 0, {}
    for w, i, _, n in uses:  # as many of the worst filled sequences as the gaps of the rest can take
        k = min(n, (gap - filler) // room)
        if k <= 0:
            break
        apart[i] = k
        gap, filler = gap - k * w, filler + k * (room - w)
    rows, gaps, sequences, line, taken = [], [], 0, 0, np.zeros(len(counts), np.int64)
    for w, i, pattern, n in uses:
        for times, at in ((n - apart.get(i, 0), sequences), (apart.get(i, 0), -1)):
            if times <= 0:
                continue
            for s in np.flatnonzero(pattern):
                each = int(pattern[s])
                rows.append((int(s), int(taken[s]), int(taken[s]) + each * times, each, at))
                taken[s] += each * times
            if at >= 0:
                sequences += times
                if w:
                    gaps.append((line, line + w * unit * times, w * unit, at))
                    line += w * unit * times
    return Plan(rows, gaps, sequences)


# --- documents to sequences ----------------------------------------------------------------------------------------


def _fill(gaps: list[tuple[int, int, int, int]], with_ids: bool):
    """Cuts pieces at the borders of the gaps their tokens fall into; ``line`` is where a piece begins."""
    starts = np.array([g[0] for g in gaps], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("start", "length", "ids", "doc_tokens", "row", "line")}
            at, out = [], []
            for i in range(batch.num_rows):
                done, size, line, ids = 0, cols["length"][i], cols["line"][i], cols["ids"][i]
                while done < size:
                    first, _, gap, sequence = gaps[int(np.searchsorted(starts, line + done, "right")) - 1]
                    nth, inside = divmod(line + done - first, gap)
                    n = min(size - done, gap - inside)
                    piece = ids[4 * done:4 * (done + n)]
                    at.append(i)
                    out.append((cols["start"][i] + done, n, zlib.crc32(piece), cols["doc_tokens"][i], sequence + nth,
                                cols["row"][i], piece if with_ids else None))
                    done += n
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64()))]
                + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][:6 + with_ids],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "row"] + ["ids"] * with_ids)

    return run


def _sums_before(rows: DataFrame, group: list[str], bucket: str, value) -> DataFrame:
    """(group, bucket, before): the sum of ``value`` over the buckets before, within a group."""
    sums = rows.groupBy(*group, bucket).agg(value.alias("of_bucket"))
    window = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, bucket, F.coalesce(F.sum("of_bucket").over(window), F.lit(0)).alias("before"))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset): every piece's place in a sequence.

    Null and empty texts are one piece, the end id. Equal rows are equal pieces, each with a place of its own; rows
    that share an id keep theirs. An empty table gives no rows. Pieces, and then their places, are written to the
    shared folder, so that ranks refer to one fixed table; the driver gets the histogram, ``length / UNIT`` numbers.
    """
    spark = docs.sparkSession
    at = scratch_path(spark, "pieces")
    cut(docs, id_col, text, path, length, end_id, "all" if with_ids else "short").withColumn(
        "row", F.monotonically_increasing_id()).write.parquet(at)
    pieces = spark.read.parquet(at).withColumn("size", F.floor((F.col("length") - 1) / UNIT).cast("int"))
    room = length // UNIT
    counts = np.zeros(room, np.int64)
    for r in pieces.groupBy("size").count().collect():
        counts[r["size"]] = r["count"]
    made = plan(counts, room)

    # ranks: pieces of a size are numbered within buckets by a hash of the row, buckets by sums before them
    buckets = max(1, int(counts.sum()) // RANK_ROWS)
    small = pieces.select("row", "size", "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    inside = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("row")) - 1
    ranked = small.withColumn("inside", inside).join(
        _sums_before(small, ["size"], "bucket", F.count("*")), ["size", "bucket"]).withColumn(
        "rank", F.col("inside") + F.col("before")).drop("inside", "before")

    # each size has few stretches of ranks; a piece finds its own among them
    stretches = spark.createDataFrame(made.rows, "size int, first bigint, end bigint, each bigint, sequence bigint")
    per_size = stretches.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("first", "end", "each", "sequence"))).alias("s"))
    stretch = F.element_at(F.filter("s", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["end"])), 1)
    sequence = F.col("s.sequence") + F.when(F.col("s.sequence") < 0, 0).otherwise(
        F.floor((F.col("rank") - F.col("s.first")) / F.col("s.each")))
    at = scratch_path(spark, "places")
    ranked.join(F.broadcast(per_size), "size").withColumn("s", stretch).select(
        "row", "size", "length", "bucket", sequence.alias("sequence_id")).write.parquet(at)
    places = spark.read.parquet(at)

    # pieces that fill gaps, set end to end: a piece's place on the line is the sum of the lengths before it
    kept = ["id", "start", "length", "ids_crc32", "doc_tokens", "row"] + ["ids"] * with_ids
    whole = pieces.select(*kept).join(places.where("sequence_id >= 0").select("row", "sequence_id"), "row")
    cut_sizes = sorted({r[0] for r in made.rows if r[4] < 0})
    if cut_sizes:
        loose = places.where("sequence_id < 0").select("row", "length", "bucket")
        before = F.coalesce(F.sum("length").over(Window.partitionBy("bucket").orderBy("row").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        line = loose.withColumn("inside", before).join(
            _sums_before(loose, [], "bucket", F.sum("length")), "bucket").select(
            "row", (F.col("inside") + F.col("before")).alias("line"))
        gaps = made.gaps
        kind = pieces.schema["id"].dataType.simpleString()
        filled = pieces.where(F.col("size").isin(cut_sizes)).select(
            "id", "start", "length", "ids", "doc_tokens", "row").join(line, "row").mapInArrow(
            lambda b: _fill(gaps, with_ids)(b), f"id {kind}, start bigint, length bigint, ids_crc32 bigint, "
            "doc_tokens bigint, sequence_id bigint, row bigint" + ", ids binary" * with_ids)
        whole = whole.unionByName(filled)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    return whole.select(F.col("id").alias(id_col), *(c for c in kept if c not in ("id", "row")), "sequence_id",
                        F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
