"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of word shingles. Copies are one node. Every node gets a MinHash signature; nodes that share a band of it
are candidates. Candidates live in the same component of the graph that links each band bucket to its least node, so
components are brought together (large ones in pairs of blocks), and pairs are judged there: signatures are compared
a few values at a time, and a pair is dropped as soon as the posterior probability that its similarity reaches the
threshold is below the tolerance. What is left is verified on the shingle sets. Out come links per node and a
forest, never a row per pair, so a large group of near copies costs time but no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import Memo, slices, unused
from mailsift.llm.components import components
from mailsift.session import scratch_path

WIDTH, THRESHOLD = 5, 0.8
#: A pair at the threshold shares none of BANDS bands of ROWS values with probability (1 - 0.8**ROWS)**BANDS = 1.6e-6.
BANDS, ROWS = 44, 6
VALUES = BANDS * ROWS
#: Values compared before each look at the posterior, and the least posterior to go on with.
ROUND, TOLERANCE = 12, 1e-6
#: Nodes of a block, and shingles.
BLOCK_NODES, BLOCK_SHINGLES = 256, 200_000
#: From so many pairs of a block pair on, intersections are counted for all at once.
MANY_PAIRS = 2000

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None]
_ODD = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None] | np.uint32(1)


def shingler(width: int = WIDTH):
    """A function from text to the sorted distinct 64-bit hashes of its word shingles.

    Words are what ASCII white space separates. A text of fewer words than ``width`` is one shingle, one without
    words none.
    """
    word = Memo(xxhash.xxh3_64_intdigest)
    odd = np.uint64(0x9E3779B97F4A7C15)

    def shingles(text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        codes = np.fromiter(map(word.__getitem__, words), np.uint64, n)
        k = min(n, width)
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = h * odd + codes[i:n - k + 1 + i]
            h ^= h >> np.uint64(29)
        return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))

    return shingles


def signature(shingles: np.ndarray) -> bytes:
    """``VALUES`` MinHash values, 16 bits of each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        mixed = (x[None, i:i + 2048] ^ _XOR) * _ODD
        np.minimum(least, mixed.min(axis=1), out=least)
    return least.astype(np.uint16).tobytes()


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature (rows)."""
    bands = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for r in range(ROWS):
        key = (key ^ bands[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """(values compared, least matches to go on with) after each round.

    With a uniform prior, similarity after m matches of n has the distribution Beta(m + 1, n - m + 1), and reaches the
    threshold with the probability that a binomial of n + 1 trials at the threshold gives at most m.
    """
    out = []
    for n in range(ROUND, VALUES + 1, ROUND):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def linked(left: list[np.ndarray], left_sig: np.ndarray, right: list[np.ndarray], right_sig: np.ndarray, same: bool,
           threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``left`` and ``right`` shingle sets whose similarity reaches the threshold.

    ``same``: both sides are one block, and each pair of it counts once.
    """
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    small, large = np.minimum(a[:, None], b), np.maximum(a[:, None], b)
    open_ = small >= threshold * large - 1e-9
    if same:
        open_ &= np.triu(np.ones(open_.shape, bool), 1)
    lk, rk = band_keys(left_sig), band_keys(right_sig)
    shared = np.zeros(open_.shape, bool)
    for k in range(BANDS):
        shared |= lk[:, k, None] == rk[None, :, k]
    i, j = np.nonzero(open_ & shared)
    matches, done = np.zeros(len(i), np.int32), 0
    for n, least in least_matches(threshold, tolerance):
        if not len(i):
            break
        matches += (left_sig[i, done:n] == right_sig[j, done:n]).sum(axis=1, dtype=np.int32)
        done, go_on = n, matches >= least
        i, j, matches = i[go_on], j[go_on], matches[go_on]
    if len(i) <= MANY_PAIRS:
        common = np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:
        common = _all_common(left, right if not same else left)[i, j]
    keep = common >= threshold * (a[i] + b[j] - common) - 1e-9 if len(i) else np.zeros(0, bool)
    return i[keep], j[keep]


def _all_common(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over a few thousand shingles at a time."""
    sides = []
    for sets in (left, right):
        values = np.concatenate(sets)
        sides.append((values, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.float32)
    columns = []
    for values, rows in sides:
        at = np.searchsorted(shared, values)
        known = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == values) if len(shared) else np.zeros(len(values), bool)
        columns.append((at[known], rows[known]))
    for lo in range(0, len(shared), width):
        made = []
        for (at, rows), sets in zip(columns, (left, right), strict=True):
            part = np.zeros((len(sets), width), np.float32)
            inside = (at >= lo) & (at < lo + width)
            part[rows[inside], at[inside] - lo] = 1
            made.append(part)
        out += made[0] @ made[1].T
    return out.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, n, sig): a text that this task has signed already keeps sig null."""
    shingles, seen = shingler(), set()
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in slices(texts):
            sizes, sigs = [], []
            for key, text in zip(batch.column("key").slice(lo, hi - lo).to_pylist(),
                                 texts.slice(lo, hi - lo).to_pylist(), strict=True):
                s = shingles(text) if key not in seen else ()
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(key)
                sizes.append(len(s))
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("key").slice(lo, hi - lo),
                                              pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())],
                                             ["id", "key", "n", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        keys = pa.array(band_keys(sigs).reshape(-1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1) * BANDS, pa.int32()), keys)],
            ["node", "bands"])


def _judge(threshold: float, tolerance: float):
    """(node, links, least) for the nodes of each block pair that have links in it; rows come sorted by block pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler()

        def judged(lo, hi, rows):
            nodes = {}
            for node, block, sig, text in rows:
                nodes.setdefault(node, (block, sig, text))
            names = sorted(nodes)
            sides = [[x for x in names if nodes[x][0] == b] for b in dict.fromkeys((lo, hi))]
            if not all(sides):
                return []
            sets = [[shingles(nodes[x][2]) for x in side] for side in sides]
            sigs = [np.frombuffer(b"".join(nodes[x][1] for x in side), np.uint16).reshape(-1, VALUES) for side in sides]
            i, j = linked(sets[0], sigs[0], sets[-1], sigs[-1], lo == hi, threshold, tolerance)
            links, root = dict.fromkeys(names, 0), {x: x for x in names}

            def find(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for p, q in zip(i, j, strict=True):
                x, y = sides[0][p], sides[-1][q]
                links[x] += 1
                links[y] += 1
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            return [(x, n, find(x)) for x, n in links.items() if n]

        group, held = None, []
        out = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("root", "lo", "hi", "node", "block", "sig", "text")), strict=True):
                if row[:3] != group:
                    if len(held) > 1:
                        out += judged(*group[1:], held)
                    group, held = row[:3], []
                held.append(row[3:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["node", "links", "least"])
                out = []
        if len(held) > 1:
            out = judged(*group[1:], held)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["node", "links", "least"])

    return run


def text_key(text: str) -> Column:
    """What equal texts share: the MD5 digest. Null counts as empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    tolerance: float = TOLERANCE) -> DataFrame:
    """(key, first_id, copies, n_links, class_id, first_key), one row per distinct text.

    ``n_links``: other distinct texts whose shingle sets reach the threshold. ``class_id``: the least id in the text's class,
    the texts that links connect; ``first_key`` is that of the class's first text, by (first_id, key). Empty texts, and
    texts of white space only, have no shingles and so no links; equal ones are still one class. Null ids sort last and
    never are a class id unless a class has no other. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    at = scratch_path(spark, "signatures")
    rows.mapInArrow(_sign, f"id {kind}, key string, n int, sig binary").groupBy("key").agg(
        F.min("id").alias("first_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig")
    ).withColumn("node", F.monotonically_increasing_id()).write.parquet(at)
    texts = spark.read.parquet(at)

    bands = texts.where("sig is not null").select("node", "sig").mapInArrow(_bands, "node bigint, bands array<bigint>").select(
        "node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    edges = bands.join(buckets.select("band", "hub"), "band").where("node <> hub").select(
        F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    near = components(edges)

    # components of candidates come together, in blocks of bounded size; each pair of blocks is judged once
    members = near.join(texts.select("node", "first_id", "key", "n", "sig"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = near.join(texts.select("node", "n"), "node").groupBy("root").agg(blocks.alias("blocks"))
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    whole = placed.join(rows.withColumnRenamed("id", "own_id").withColumnRenamed("key", "own_key"),
                        F.col("first_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")))
    paired = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block", "sig", "text")
    at = scratch_path(spark, "links")
    paired.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(
        _judge(threshold, tolerance), "node bigint, links bigint, least bigint").write.parquet(at)
    found = spark.read.parquet(at)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = texts.select("node", "key", "first_id", "copies").join(classes, "node", "left").join(links, "node", "left").select(
        "key", "first_id", "copies", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("key").alias("key"))
    firsts = named.groupBy("root").agg(F.min(order).alias("first")).select(
        "root", F.col("first.id").alias("class_id"), F.col("first.key").alias("first_key"))
    return named.join(firsts, "root").drop("root")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                 tolerance: float = TOLERANCE) -> DataFrame:
    """(id, class_id, n_links, copies), one row per document: its near-duplicate class, the number of other
    texts it is linked to, and how many documents have just its text. See ``near_duplicates``."""
    classes = near_duplicates(docs, id_col, text, threshold, tolerance)
    return docs.select(F.col(id_col), text_key(text).alias("key")).join(classes, "key").select(
        id_col, "class_id", "n_links", "copies")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that with the least id, once however often it is repeated."""
    own, first, key = (unused(n, docs) for n in ("own_key", "first_id", "first_key"))
    firsts = near_duplicates(docs, id_col, text, threshold).where("key = first_key").select(
        F.col("first_id").alias(first), F.col("key").alias(key))
    rows = docs.withColumn(own, text_key(text))
    kept = rows.join(firsts, (F.col(own) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(first)))
    return kept.dropDuplicates([own, id_col]).select(*docs.columns)
