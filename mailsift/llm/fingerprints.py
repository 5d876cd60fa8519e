"""Order MinHash fingerprints.

A text's k-mers (runs of ``K`` tokens) are numbered by occurrence, so repeats count, and hashed once together with
that number. The hash deals them into ``BINS`` bins; in every bin the ``PICK`` smallest are selected, put back into text
order and hashed as a tuple: one component. Two texts agree in a component when the same k-mers were selected
in the same order, so the share of equal components follows the edit distance rather than the bag of k-mers.
All of it is built-in expressions over arrays; no row of a document's k-mers ever leaves its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens are runs of non-space characters, in pieces of at most this many, so unbroken text has k-mers as well.
TOKEN = r"\S{1,12}"
K, BINS_BITS, PICK = 2, 6, 2
BINS = 1 << BINS_BITS
#: Hexadecimal digits of a component; an empty bin is all dashes.
DIGITS = 4
#: Bits of a packed number: bin, hash, place in the text.
PLACE_BITS = 26
HASH_BITS = 63 - BINS_BITS - PLACE_BITS
#: Bytes of text of one slice when the order of ids is cut for finding the next document, and slices at most.
SLICE_BYTES, MOST_SLICES = 128 << 20, 20_000


def fingerprint_sql(text: str) -> str:
    """The fingerprint of a text expression, as SQL. Null counts as empty."""
    place = f"{(1 << PLACE_BITS) - 1}L"

    # transform over a one-element array binds a name to a value that is then computed once
    def let(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    kmers = (f"transform(sequence(0, greatest(size(w) - {K}, 0)), i -> "
             f"(shiftleft(shiftrightunsigned(xxhash64({', '.join(f'get(w, i + {j})' for j in range(K))}), "
             f"{PLACE_BITS + 1}), {PLACE_BITS}) | i))")
    # after sorting, one k-mer's occurrences stand side by side in text order: number them from each run's start
    starts = (f"filter(sequence(0, size(h) - 1), i -> i = 0 OR shiftrightunsigned(h[i], {PLACE_BITS}) "
              f"<> shiftrightunsigned(h[greatest(i - 1, 0)], {PLACE_BITS}))")
    numbered = (f"flatten(transform(s, (b, j) -> transform(sequence(b, coalesce(get(s, j + 1), size(h)) - 1), i -> "
                f"(shiftleft(shiftrightunsigned(xxhash64(shiftrightunsigned(h[i], {PLACE_BITS}), i - b), "
                f"{PLACE_BITS + 1}), {PLACE_BITS}) | (h[i] & {place})))))")
    heads = (f"filter(sequence(0, size(n) - 1), i -> i = 0 OR shiftrightunsigned(n[i], {HASH_BITS + PLACE_BITS}) "
             f"<> shiftrightunsigned(n[greatest(i - 1, 0)], {HASH_BITS + PLACE_BITS}))")
    picked = (f"array_sort(transform(slice(n, b + 1, least({PICK}, coalesce(get(t, j + 1), size(n)) - b)), "
              f"x -> struct(x & {place} AS p, shiftrightunsigned(x, {PLACE_BITS}) AS h)))")
    digits = f"right(lpad(hex(xxhash64(transform({picked}, x -> x.h))), 16, '0'), {DIGITS})"
    parts = (f"map_from_arrays(transform(t, b -> cast(shiftrightunsigned(n[b], {HASH_BITS + PLACE_BITS}) as int)), "
             f"transform(t, (b, j) -> {digits}))")
    empty = f"repeat('{'-' * DIGITS}', {BINS})"
    joined = f"array_join(transform(sequence(0, {BINS - 1}), b -> coalesce(m[b], '{'-' * DIGITS}')), '')"
    body = let("h", f"sort_array({kmers})", let("s", starts, let("n", f"sort_array({numbered})",
               let("t", heads, let("m", parts, joined)))))
    words = f"regexp_extract_all(coalesce({text}, ''), r'{TOKEN}', 0)"
    return let("w", words, f"CASE WHEN size(w) = 0 THEN {empty} ELSE {body} END")


def fingerprint(text: str) -> Column:
    """The fingerprint of a text column: ``BINS`` components of ``DIGITS`` hexadecimal digits. Null counts as empty."""
    return F.expr(fingerprint_sql(text))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among those that either has; two empty texts are alike (1), null sides count as empty."""
    empty = "-" * (DIGITS * BINS)
    pair = [F.sequence(F.lit(0), F.lit(BINS - 1))]
    part = lambda c, i: F.substr(F.coalesce(c, F.lit(empty)), i * DIGITS + 1, F.lit(DIGITS))
    both = F.filter(pair[0], lambda i: (part(a, i) != "-" * DIGITS) | (part(b, i) != "-" * DIGITS))
    same = F.size(F.filter(both, lambda i: part(a, i) == part(b, i)))
    return F.when(F.size(both) == 0, 1.0).otherwise(same / F.size(both)).cast("double")


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``__next_<column>`` from the next row by ``key`` (a long; null first); after the last comes the first.

    Ids are cut into slices at exact id values; a slice's first row is also dealt to the slice before it, as its
    end. So each row finds its next one inside its slice and no single task sees them all. The driver gets the slice
    borders. Equal keys are ordered by the columns.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    stats = docs.select(order.alias("k"), F.octet_length(columns[0]).alias("n")).agg(
        F.count("*").alias("rows"), F.sum("n").alias("bytes"), F.min("k").alias("least")).first()
    if not stats["rows"]:
        return docs.select("*", *(F.col(c).alias(f"__next_{c}") for c in columns))
    n = int(min(MOST_SLICES, max(8 * spark.sparkContext.defaultParallelism, (stats["bytes"] or 0) // SLICE_BYTES)))
    shares = [i / n for i in range(n)]
    cuts = docs.agg(F.percentile_approx(order, shares, max(10_000, 4 * n)).alias("c")).first()["c"]
    heads = sorted({stats["least"], *cuts})
    places = spark.createDataFrame([(k, i, (i - 1) % len(heads)) for i, k in enumerate(heads)],
                                   "__head bigint, __of int, __before int")
    # a row's slice in two looks at about sqrt(n) borders each
    wide = math.isqrt(len(heads)) + 1
    shelves = [heads[i:i + wide] for i in range(0, len(heads), wide)]
    below = lambda borders: F.size(F.filter(borders, lambda c: c <= F.col("__k"))) - 1
    shelf = below(F.lit([x[0] for x in shelves]))
    slice_no = shelf * wide + below(F.get(F.lit(shelves), shelf))
    dealt = docs.withColumn("__k", order).withColumn("__slice", slice_no.cast("int")).join(
        F.broadcast(places), F.col("__k") == F.col("__head"), "left").withColumn("__to", F.explode(F.when(
            F.col("__head").isNull(), F.array(F.struct(F.col("__slice").alias("s"), F.lit(False).alias("end")))).otherwise(
            F.array(F.struct(F.col("__slice").alias("s"), F.lit(False).alias("end")),
                    F.struct(F.col("__before").alias("s"), F.lit(True).alias("end"))))))
    window = Window.partitionBy("__to.s").orderBy("__to.end", "__k", *columns)
    following = [F.lead(c).over(window).alias(f"__next_{c}") for c in columns]
    return dealt.select(*docs.columns, "__to", "__k", *following).where(~F.col("__to.end")).drop("__to", "__k")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per document.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many of the next
    document by ascending id, or all it has. Null counts as empty; a single document is its own next. Equal texts have
    equal fingerprints.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    own = rows.withColumn("__print", fingerprint("__text"))
    n = F.length("__text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("__text"), F.lit(1), (n - quarter)), F.substr(F.col("__next___text"), F.lit(1), quarter))
    found = with_next(own, "__id", ["__text", "__print"]).select(
        "__id", n.cast("bigint").alias("n_chars"), edited.alias("__edited"), "__print", "__next___print")
    printed = found.withColumn("__edited_print", fingerprint("__edited"))
    return printed.select(
        F.col("__id").alias(id_col), "n_chars", F.sha2("__edited", 256).alias("edited_sha256"),
        F.col("__print").alias("fingerprint"), F.col("__edited_print").alias("edited_fingerprint"),
        likeness(F.col("__print"), F.col("__edited_print")).alias("near_edited"),
        likeness(F.col("__print"), F.col("__next___print")).alias("near_next"))
