"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import (bpe_transducer, collocations, conversations, fingerprints, jaccard_join, language_id, packing,
                          piece_codec, quality_classifier, quality_rules, secret_scan, sharding, token_counts)
from mailsift.llm.common import crc32_text
from mailsift.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and Jensen-Shannon verdict of every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the documents, by crc32 of the id, is held out of training."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_text("doc_id") % 4 == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), language_id.predict(spark, model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the documents, by crc32 of the id, is held out of training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc32_text("doc_id") % 5 == 0, F.lit(False))
    # labels grow with the documents: the same join at every size
    labelled = docs.where(~held_out).select("doc_id", "text").join(
        labels.select("doc_id", "quality").hint("merge"), "doc_id")
    model = quality_classifier.train(labelled)
    return docs.select("doc_id", held_out.alias("held_out"), quality_classifier.score(spark, model).alias("s")).select(
        "doc_id", "held_out", "s.score", "s.predicted")


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the transducer, hashed, and the hash of what they decode to."""
    return table(spark, sf_dir, "documents").select("doc_id", bpe_transducer.round_trip(spark).alias("r")).select("doc_id", "r.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, the hash of the spans of the fixed patterns, and all spans."""
    return table(spark, sf_dir, "documents").select("doc_id", secret_scan.scan(spark).alias("s")).select(
        "doc_id", "s.n_assign", "s.n_access", "s.n_hex", F.sha2("s.base_spans", 256).alias("base_sha256"), "s.spans")


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by near-equal bytes."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard(docs).select(
        "doc_id", F.col("shard_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their source spans, hashed, and the hash of what their ids decode to."""
    return table(spark, sf_dir, "documents").select("doc_id", piece_codec.round_trip(spark).alias("r")).select("doc_id", "r.*")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two to four words by how much they keep together."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after damage, and the cheapest edits that mend it."""
    return conversations.repair(table(spark, sf_dir, "conversations"), damage=True)


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_language_id, op3_quality_classifier, op4_bpe_transducer, op5_jaccard_join, op6_order_minhash,
    op7_token_counts, op8_secret_scan, op9_histogram_shards, op10_cutting_stock,
    op11_piece_codec, op12_collocations, op13_conversation_repair)}

#: DuckDB SQL by query, where SQL can express it; the rest is held against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op5_jaccard_join": r"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1),
words AS (
  SELECT id, list_filter(regexp_split_to_array(t, '[\x09-\x0d\x20]+'), lambda x: x <> '') AS w FROM texts),
shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (
  SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT id AS x, id AS y FROM texts UNION SELECT r.x, e.b FROM reached r JOIN edges e ON e.a = r.y),
classes AS (SELECT x AS id, min(y) AS class_id FROM reached GROUP BY x),
degrees AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT d.doc_id, k.class_id, coalesce(g.n, 0) AS n_links, t.copies
FROM documents d JOIN texts t ON t.t = coalesce(d.text, '') JOIN classes k ON k.id = t.id LEFT JOIN degrees g ON g.id = t.id
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
found AS (
  SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) AS p, 1 AS k FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: concat_ws(' ', w[i], w[i + 1]))), 2 FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))), 3 FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]))), 4 FROM words),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM found GROUP BY lang, k, p),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT * FROM f WHERE f >= 30),
candidates AS MATERIALIZED (SELECT *, string_split(p, ' ') AS x FROM frequent WHERE k >= 2),
split AS (
  SELECT lang, p, f AS a, t.cut, array_to_string(x[1:t.cut], ' ') AS head, array_to_string(x[t.cut + 1:], ' ') AS tail
  FROM candidates JOIN (VALUES (1), (2), (3)) AS t(cut) ON t.cut < k),
cuts AS (
  SELECT s.lang, s.p, s.a, s.cut, h.f AS l, r.f AS r, (2000000::HUGEINT * s.a) // (h.f::HUGEINT + r.f) AS score
  FROM split s JOIN frequent h ON h.lang = s.lang AND h.p = s.head JOIN frequent r ON r.lang = s.lang AND r.p = s.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, array_to_string(x[i:j], ' ') AS p, max(f) AS f FROM candidates
  JOIN (VALUES (1, 2), (2, 3), (3, 4), (1, 3), (2, 4)) AS t(i, j) ON j <= k AND j - i + 1 < k GROUP BY 1, 2),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.p = b.p
  WHERE coalesce(100::HUGEINT * i.f, 0) < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT n.lang, n.rank, n.p AS phrase, n.a, n.l, n.r, s.n, n.score::BIGINT AS score
FROM ranked n JOIN sizes s ON s.lang = n.lang WHERE n.rank <= 2000
""",
}
