"""The registered queries: one Spark plan per SURVEY §2 operator group, each with
an independent DuckDB statement of the same rule (``None`` where only a
rows-only check is possible).

Every query reads the driver's tables (or data Spark derives from them), so its
work grows with the scale factor; none is capped, sampled or filtered by id.
"""

from __future__ import annotations

import time

from collections.abc import Callable

from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_TOKENS, WS_CLASS
from ..functions import headers as H
from ..functions import text as X
from ..functions.scoring import fixed, format_score, score_text
from ..functions.vectors import assemble, parse_metadata, resolve_dims
from ..operators.corpus import (domain_vocab, inputs, keep_last, manifest, manifest_diff, mark_domains, new_only,
                                top_domains)
from ..operators.embed import limit_tokens, tokenizer
from ..operators.features import class_weights, join_embeddings, mean_pool, metadata_width, standardise_metadata
from ..operators.html import html_to_text
from ..operators.measure import score_histogram, status_counts, threshold_sweep
from ..operators.model import (Linear, accuracy, calibrate, classify, contract, fit_curve, load_model, predicted_class,
                               save_model, score, train, train_calibrated)
from ..operators.parse import parse_counts, parse_mail
from ..operators.route import deliver, route_tagged, tag_headers, with_verdict, write_maildir_files
from ..session import scratch_path, table
from ..sources.domains import domain_list
from ..sources.mail import list_corpus, load_corpus, scan_corpus
from ..sources.synthetic import MISMATCH_KEYS, SENDER_PAIRS, mail_body, synthetic_mail, with_page_urls
from ..sources.training import read_training, write_training
from ..streaming.arrivals import stream_arrivals
from ..streaming.score import run_to_table, stream_table
from ..streaming.statistics import run_statistics, running_sweep
from . import oracle as O
from .score import score_parsed
from .train import Trained, build_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


# ------------------------------------------------------------------ text

@register("url_domain", f"""
SELECT page_id, url, {O.url_domain('url')} AS domain FROM pages
""")
def q_url_domain(spark: SparkSession, sf: str) -> DataFrame:
    """X3 over every page URL."""
    return table(spark, sf, "pages").select("page_id", "url", X.url_domain("url").alias("domain"))


_DOC_URL_SQL = """
(SELECT d.doc_id, d.text, d.source, p.url FROM documents d
 LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages))
"""


@register("strip_urls", f"""
SELECT doc_id, {O.strip_urls("text || ' see ' || url || '. '")} AS text_out FROM {_DOC_URL_SQL} t
""")
def q_strip_urls(spark: SparkSession, sf: str) -> DataFrame:
    """X2 over every document text with one page URL appended (documents hold no URLs themselves)."""
    d = with_page_urls(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "pages"))
    return d.select("doc_id", X.strip_urls(mail_body(F.col("text"), F.col("url"))).alias("text_out"))


@register("html_text_flat", f"""
SELECT page_id, {O.html_text_flat('html')} AS text FROM pages
""")
def q_html_text_flat(spark: SparkSession, sf: str) -> DataFrame:
    """X1b (all native) over every page."""
    return table(spark, sf, "pages").select("page_id", X.html_to_text_flat("html").alias("text"))


@register("html_text", ORACLE["html_text_flat"])
def q_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """X1 (tree form, Arrow-batched pandas UDF) over every page; its oracle is the flat SQL, equal on these pages."""
    return table(spark, sf, "pages").select("page_id", html_to_text("html").alias("text"))


# ------------------------------------------------------------------ headers

# A display name made of each document's text ("Name" <addr>) for the
# senders whose address is bare in SENDER_PAIRS; quotes, brackets, backslashes
# and whitespace runs become single spaces.
_NAME_CHARS = "[" + WS_CLASS + r'"<>\\]+'
_NAMED = (0, 2, 3)


def _pairs_sql(idx: int) -> str:
    arms = []
    for i, p in enumerate(SENDER_PAIRS):
        v = "NULL" if p[idx] is None else O.lit(p[idx])
        if idx == 0 and i in _NAMED:
            name = f"trim(regexp_replace(text, {O.lit(_NAME_CHARS)}, ' ', 'g'))"
            v = f"('\"' || {name} || '\" <' || {v} || '>')"
        arms.append(f"WHEN {i} THEN {v}")
    return f"(CASE doc_id % {len(SENDER_PAIRS)} {' '.join(arms)} END)"


@register("reply_to_mismatch", f"""
SELECT doc_id, from_hdr, reply_to_hdr, from_domain, reply_to_domain,
       {O.mismatch('from_domain', 'reply_to_domain')} AS mismatch
FROM (SELECT doc_id, from_hdr, reply_to_hdr,
             {O.email_domain('from_hdr')} AS from_domain, {O.email_domain('reply_to_hdr')} AS reply_to_domain
      FROM (SELECT doc_id, {_pairs_sql(0)} AS from_hdr, {_pairs_sql(1)} AS reply_to_hdr FROM documents))
""")
def q_reply_to_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """X4 + X5 + J1 over sender headers built per document: fixed address pairs
    (doc_id mod 6), display names from the document's own text."""
    k = F.pmod(F.col("doc_id"), F.lit(len(SENDER_PAIRS)))
    name = F.trim(F.regexp_replace("text", _NAME_CHARS, " "))

    def pick(idx):
        e = None
        for i, p in enumerate(SENDER_PAIRS):
            v = F.lit(p[idx])
            if idx == 0 and i in _NAMED:
                v = F.concat(F.lit('"'), name, F.lit('" <'), v, F.lit(">"))
            e = F.when(k == i, v) if e is None else e.when(k == i, v)
        return e

    d = table(spark, sf, "documents").select("doc_id", pick(0).alias("from_hdr"), pick(1).alias("reply_to_hdr"))
    d = d.withColumn("from_domain", H.email_domain("from_hdr")).withColumn(
        "reply_to_domain", H.email_domain("reply_to_hdr"))
    return d.withColumn("mismatch", H.reply_to_mismatch("from_domain", "reply_to_domain"))


# ------------------------------------------------------------------ parse job

@register("parse_mail", f"""
SELECT t.doc_id, l.toxic::INTEGER AS label,
       {O.collapse_ws('t.text')} AS subject,
       {O.strip_urls(O.py_strip("t.text || ' see ' || t.url || '. '"))} AS body,
       (CASE WHEN t.doc_id % {len(SENDER_PAIRS)} IN ({", ".join(map(str, MISMATCH_KEYS))}) THEN 1.0 ELSE 0.0 END)::DOUBLE
         AS mismatch,
       CAST(NULL AS VARCHAR) AS parse_error
FROM {_DOC_URL_SQL} t LEFT JOIN labels l ON l.doc_id = t.doc_id
""")
def q_parse_mail(spark: SparkSession, sf: str) -> DataFrame:
    """P1-P5 over raw mail built from every document; subject, body and mismatch are known by construction."""
    raw = synthetic_mail(table(spark, sf, "documents"), table(spark, sf, "pages"), table(spark, sf, "labels"))
    # only what the result needs goes through the Python step (nothing is pruned through it)
    p = parse_mail(raw.select("doc_id", "label", "content"))
    return p.select("doc_id", "label", "subject", "body", "mismatch", "parse_error")


# ------------------------------------------------------------------ corpus

def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a flattened mail corpus: folder = source (list order = its
    number), subdir by language, basename = n_chars (so names clash), class
    from the toxic label."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    d = d.join(lab, "doc_id", "left")
    subdir = F.when(F.col("lang").isin("en", "de"), F.lit("cur")).otherwise(F.lit("new"))
    ord_ = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return d.select(
        F.when(F.col("toxic") == 1, F.lit("bad")).otherwise(F.lit("good")).alias("class"),
        F.col("n_chars").cast("string").alias("basename"),
        F.col("source").alias("folder"), ord_.alias("ord"), subdir.alias("subdir"), "lang",
        F.concat_ws("/", "source", subdir, F.concat(F.col("n_chars").cast("string"), F.lit("."),
                                                    F.col("doc_id").cast("string"))).alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        (F.lit(1704067200) + ord_ * 86400 + F.pmod(F.col("n_chars") * 7919, F.lit(86400))).cast("long").alias("mtime"),
    )


_CORPUS_SQL = """
(SELECT CASE WHEN l.toxic = 1 THEN 'bad' ELSE 'good' END AS class,
        CAST(d.n_chars AS VARCHAR) AS basename, d.source AS folder,
        CAST(regexp_extract(d.source, '[0-9]+', 0) AS INTEGER) AS ord,
        CASE WHEN d.lang IN ('en', 'de') THEN 'cur' ELSE 'new' END AS subdir, d.lang,
        d.source || '/' || (CASE WHEN d.lang IN ('en', 'de') THEN 'cur' ELSE 'new' END) || '/' ||
          CAST(d.n_chars AS VARCHAR) || '.' || CAST(d.doc_id AS VARCHAR) AS path,
        CAST(octet_length(encode(d.text)) AS BIGINT) AS length,
        CAST(1704067200 + CAST(regexp_extract(d.source, '[0-9]+', 0) AS INTEGER) * 86400
             + (d.n_chars * 7919) % 86400 AS BIGINT) AS mtime
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


@register("keep_last", f"""
SELECT class, basename, folder, ord, subdir, lang, path, length, mtime FROM (
  SELECT *, row_number() OVER (PARTITION BY class, basename ORDER BY ord DESC, subdir, path) AS rn
  FROM {_CORPUS_SQL} c) WHERE rn = 1
""")
def q_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """The latest folder wins per (class, name); names clash because n_chars is the name."""
    return keep_last(_corpus(spark, sf))


@register("manifest", f"""
SELECT class, basename, length, mtime FROM (
  SELECT *, row_number() OVER (PARTITION BY class, basename ORDER BY ord DESC, subdir, path) AS rn
  FROM {_CORPUS_SQL} c) WHERE rn = 1
ORDER BY CASE class WHEN 'good' THEN 0 WHEN 'bad' THEN 1 ELSE 2 END, class, basename
""")
def q_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """K6/O1 over the flattened corpus (whole-second mtimes, good before bad, names sorted)."""
    return manifest(keep_last(_corpus(spark, sf)), mtime="mtime")


@register("manifest_diff", f"""
WITH o AS (SELECT class, basename, length AS old_length, mtime AS old_mtime FROM (
    SELECT *, row_number() OVER (PARTITION BY class, basename ORDER BY ord ASC, subdir, path) AS rn
    FROM {_CORPUS_SQL} c WHERE lang <> 'de') WHERE rn = 1),
 n AS (SELECT class, basename, length AS new_length, mtime AS new_mtime FROM (
    SELECT *, row_number() OVER (PARTITION BY class, basename ORDER BY ord DESC, subdir, path) AS rn
    FROM {_CORPUS_SQL} c WHERE lang <> 'es') WHERE rn = 1)
SELECT coalesce(o.class, n.class) AS class, coalesce(o.basename, n.basename) AS basename,
       old_length, old_mtime, new_length, new_mtime,
       CASE WHEN old_length IS NULL THEN 'added' WHEN new_length IS NULL THEN 'removed'
            WHEN old_length <> new_length OR old_mtime <> new_mtime THEN 'changed' ELSE 'unchanged' END AS status
FROM o FULL OUTER JOIN n ON o.class = n.class AND o.basename = n.basename
""")
def q_manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Old snapshot: before the German mail arrived, earliest folder kept;
    new snapshot: without the Spanish mail, latest folder kept."""
    c = _corpus(spark, sf)
    old = manifest(keep_last(c.filter(F.col("lang") != "de").withColumn("ord", -F.col("ord"))), mtime="mtime")
    new = manifest(keep_last(c.filter(F.col("lang") != "es")), mtime="mtime")
    return manifest_diff(old, new)


@register("corpus_counts", """
SELECT label, count(*) AS files, count(*) FILTER (WHERE NOT lost) AS processed, count(*) FILTER (WHERE lost) AS errors FROM (
  SELECT 0 AS label, d.n_chars % 10 = 7 AS lost FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1
  UNION ALL
  SELECT 1 AS label, d.n_chars % 10 = 7 AS lost FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1)
GROUP BY label
""")
def q_corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    """S3 + P6: good list = quality documents, bad list = toxic ones (a document
    on both lists is parsed twice), parse, count per class. Messages of some
    lengths have lost their content and count as errors."""
    docs = table(spark, sf, "documents")
    lost = docs.where(F.pmod("n_chars", F.lit(10)) == 7).select("doc_id", F.lit(True).alias("lost"))
    mail = synthetic_mail(docs, table(spark, sf, "pages")).drop("label").join(lost, "doc_id", "left").withColumn(
        "content", F.when(F.col("lost").isNull(), F.col("content")))
    lab = table(spark, sf, "labels")
    good = mail.join(lab.filter(F.col("quality") == 1).select("doc_id"), "doc_id", "left_semi")
    bad = mail.join(lab.filter(F.col("toxic") == 1).select("doc_id"), "doc_id", "left_semi")
    parsed = parse_mail(load_corpus(good, bad).select("label", "content"))
    return parse_counts(parsed, "label")


# ------------------------------------------------------------------ metadata vectors

def _event_arrays(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    v, u = F.col("value"), F.col("user_id").cast("double")
    null = F.lit(None).cast("double")
    arr = (F.when(F.col("event_type") == "view", F.array(v))
           .when(F.col("event_type") == "click", F.array(v, null, u))
           .when(F.col("event_type") == "purchase", F.array(v, u, k, v * 2))
           .when(F.col("event_type") == "signup", F.array().cast("array<double>"))
           .otherwise(F.array(null)))
    return e.select("event_id", arr.alias("metadata_features"))


_EVENT_ARRAYS_SQL = """
(SELECT event_id, CASE event_type
    WHEN 'view' THEN [value]
    WHEN 'click' THEN [value, NULL, CAST(user_id AS DOUBLE)]
    WHEN 'purchase' THEN [value, CAST(user_id AS DOUBLE), TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), value * 2]
    WHEN 'signup' THEN []::DOUBLE[]
    ELSE [NULL]::DOUBLE[] END AS metadata_features FROM events)
"""


def _vec_text(c):
    return F.array_join(F.transform(c, lambda x: fixed(x, 4)), ",")


def _vec_text_sql(e: str) -> str:
    return f"array_to_string(list_transform({e}, lambda x: printf('%.4f', x)), ',')"


@register("metadata_width", f"""
SELECT CAST(coalesce(max(len(list_filter(metadata_features, lambda x: x IS NOT NULL))), 0) AS INTEGER) AS m
FROM {_EVENT_ARRAYS_SQL} a
""")
def q_metadata_width(spark: SparkSession, sf: str) -> DataFrame:
    """A1 over metadata arrays of every event (nulls dropped before measuring)."""
    return metadata_width(_event_arrays(spark, sf))


@register("fit_width", f"""
WITH a AS {_EVENT_ARRAYS_SQL},
 w AS (SELECT coalesce(max(len(list_filter(metadata_features, lambda x: x IS NOT NULL))), 0) AS m FROM a)
SELECT event_id, CAST(w.m AS INTEGER) AS width,
       {_vec_text_sql("list_resize(list_filter(metadata_features, lambda x: x IS NOT NULL), w.m, 0.0)")} AS vec_text
FROM a, w
""")
def q_fit_width(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's metadata padded or cut to the width of A1 (a scalar subquery, no driver round trip)."""
    s = standardise_metadata(_event_arrays(spark, sf), "metadata_features", out="vec")
    return s.select("event_id", F.size("vec").alias("width"), _vec_text(F.col("vec")).alias("vec_text"))


def _event_json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    v = fixed("value", 2)
    u = F.col("user_id").cast("string")
    j = (F.when(F.col("event_type") == "view", F.col("props"))
         .when(F.col("event_type") == "click", F.concat(F.lit("["), v, F.lit(", "), u, F.lit("]")))
         .when(F.col("event_type") == "purchase", F.concat(F.lit('["'), v, F.lit('"]')))
         .when(F.col("event_type") == "signup", F.concat(F.lit("["), v, F.lit(", null]")))
         .otherwise(F.concat(F.lit('["x'), u, F.lit('"]'))))
    return e.select("event_id", j.alias("metadata_json"))


@register("parse_metadata", f"""
WITH j AS (SELECT event_id, CASE event_type
    WHEN 'view' THEN props
    WHEN 'click' THEN '[' || printf('%.2f', value) || ', ' || CAST(user_id AS VARCHAR) || ']'
    WHEN 'purchase' THEN '["' || printf('%.2f', value) || '"]'
    WHEN 'signup' THEN '[' || printf('%.2f', value) || ', null]'
    ELSE '["x' || CAST(user_id AS VARCHAR) || '"]' END AS metadata_json FROM events),
 p AS (SELECT event_id, from_json(metadata_json, '["VARCHAR"]') AS raw FROM j),
 n AS (SELECT event_id, raw, list_transform(raw, lambda x: TRY_CAST(x AS DOUBLE)) AS nums FROM p)
SELECT event_id, {_vec_text_sql(
    "CASE WHEN raw IS NULL OR list_bool_or(list_transform(nums, lambda x: x IS NULL)) THEN [0.0, 0.0, 0.0] "
    "ELSE list_resize(nums, 3, 0.0) END")} AS vec_text
FROM n
""")
def q_parse_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """X8 over JSON metadata texts derived from every event (lists, objects, strings, nulls)."""
    j = _event_json(spark, sf)
    return j.select("event_id", _vec_text(parse_metadata("metadata_json", 3)).alias("vec_text"))


# ------------------------------------------------------------------ features

@register("mean_pool", """
SELECT label, dim, round(sum(v * m) / greatest(sum(m), 1e-9), 6) AS pooled FROM (
  SELECT label, CASE WHEN vec_id % 3 <> 0 THEN 1.0 ELSE 0.0 END AS m,
         CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings)
GROUP BY label, dim
""")
def q_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    """A3 with mask = vec_id mod 3 ≠ 0 (the mask plays the attention mask)."""
    e = table(spark, sf, "embeddings")
    mask = F.when(F.pmod("vec_id", F.lit(3)) != 0, 1.0).otherwise(0.0)
    p = mean_pool(e, "label", "embedding", mask)
    return p.select("label", F.posexplode("embedding").alias("dim", "pooled")).select(
        "label", "dim", F.round("pooled", 6).alias("pooled"))


@register("class_weights", """
SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 9) AS weight FROM (
  SELECT toxic AS label, count(*) AS n_c FROM labels GROUP BY toxic)
""")
def q_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """A2: balanced weights n / (k * n_c) from the toxic labels."""
    w = class_weights(table(spark, sf, "labels").withColumnRenamed("toxic", "label"))
    return w.select("label", "n_c", F.round("weight", 9).alias("weight"))


def _coef(i):
    """Fixed test coefficients by position: ((i mod 7) − 3) / 10."""
    return (F.pmod(i, F.lit(7)) - 3) / 10.0


@register("assemble_score", """
WITH f AS (SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL
                  THEN list_concat(CAST(e.embedding AS DOUBLE[]), [d.n_chars / 10000.0]) END AS features
           FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
 s AS (SELECT doc_id, 1.0 / (1.0 + exp(-(list_sum(list_transform(features,
          lambda x, i: x * (((i - 1) % 7) - 3) / 10.0)) + 0.1))) AS score FROM f)
SELECT doc_id, round(score, 6) AS score, CASE WHEN score IS NULL THEN '0.5000' ELSE printf('%.4f', score) END AS score_text,
       score IS NULL AS by_fallback FROM s
""")
def q_assemble_score(spark: SparkSession, sf: str) -> DataFrame:
    """J2 + X9 + E3 + E5 with fixed coefficients: embedding ‖ [n_chars/10⁴] of every record; one without an
    embedding gets the fallback score."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = table(spark, sf, "documents").select("doc_id", F.array(F.col("n_chars") / 10000.0).alias("metadata"))
    f = join_embeddings(d, e, "doc_id").select("doc_id", assemble("embedding", "metadata").alias("features"))
    dot = F.aggregate(F.transform("features", lambda x, i: x * _coef(i)), F.lit(0.0), lambda a, v: a + v)
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.lit(0.1))))
    return f.select("doc_id", F.round(s, 6).alias("score"), score_text(s).alias("score_text"),
                    s.isNull().alias("by_fallback"))


# ------------------------------------------------------------------ verdicts, tagging, routing

def _event_scores(e: DataFrame) -> DataFrame:
    """Score texts derived from events: value/500 (error events: value/100, so
    some exceed 1 → invalid); signup events stand for a failed parse below a
    value of 50 (fallback 0.5000, E5) and for an empty reply from 300 on."""
    raw = F.when(F.col("event_type") == "error", F.col("value") / 100.0).otherwise(F.col("value") / 500.0)
    failed = (F.col("event_type") == "signup") & (F.col("value") < 50)
    empty = (F.col("event_type") == "signup") & (F.col("value") >= 300)
    txt = F.when(empty, F.lit("")).otherwise(score_text(raw, failed))
    return e.select("event_id", "event_type", F.encode("props", "UTF-8").alias("content"), txt.alias("score_text"))


_EVENT_SCORES_SQL = """
(SELECT event_id, event_type, props,
   CASE WHEN event_type = 'signup' AND value >= 300 THEN ''
        WHEN event_type = 'signup' AND value < 50 THEN '0.5000'
        WHEN event_type = 'error' THEN printf('%.4f', value / 100.0)
        ELSE printf('%.4f', value / 500.0) END AS score_text
 FROM events)
"""

_VERDICT_SQL = f"""
(SELECT *, CASE WHEN error IS NOT NULL THEN 'Error' WHEN s >= 0.5 THEN 'Yes' ELSE 'No' END AS status,
        CASE WHEN error IS NOT NULL THEN NULL WHEN s >= 0.5 THEN 'spam' ELSE 'ham' END AS folder
 FROM (SELECT *, CASE WHEN score_text = '' THEN 'empty response'
                      WHEN TRY_CAST(score_text AS DOUBLE) IS NULL OR TRY_CAST(score_text AS DOUBLE) < 0
                        OR TRY_CAST(score_text AS DOUBLE) > 1 THEN 'invalid score: ' || score_text END AS error,
              TRY_CAST(score_text AS DOUBLE) AS s
       FROM {_EVENT_SCORES_SQL} e))
"""


def _tagged_events(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf, "events") if events is None else events
    v = with_verdict(_event_scores(e), "score_text", 0.5)
    t = tag_headers(v, "content", 0.5)
    return t.select("event_id", "score_text", "status", "folder", "error",
                    F.decode("tagged", "UTF-8").alias("tagged"))


_TAG_SQL = f"""
SELECT event_id, score_text, status, folder, error,
  (CASE WHEN error IS NOT NULL
        THEN 'X-Spam-Status: Error, score=0.0000, threshold=0.5000, error="' || error || '"' || chr(10)
             || 'X-Spam-Score: 0.0000' || chr(10)
        ELSE 'X-Spam-Status: ' || status || ', score=' || printf('%.4f', s) || ', threshold=0.5000' || chr(10)
             || 'X-Spam-Score: ' || printf('%.4f', s) || chr(10) END) || props AS tagged
FROM {_VERDICT_SQL} v
"""


@register("tag_headers", _TAG_SQL)
def q_tag_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict headers in front of every event's bytes."""
    return _tagged_events(spark, sf)


@register("route_counts", f"""
SELECT status, folder, count(*) AS n FROM {_VERDICT_SQL} v GROUP BY status, folder
""")
def q_route_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages per status and folder."""
    return status_counts(with_verdict(_event_scores(table(spark, sf, "events")), "score_text", 0.5))


# ------------------------------------------------------------------ shadow-mode statistics (A5)

@register("score_histogram", f"""
SELECT bin, count(*) AS n, round(bin / 30.0, 4) AS lo, round((bin + 1) / 30.0, 4) AS hi FROM (
  SELECT CAST(least(CAST(replace(score_text, '.', '') AS INTEGER) * 30 // 10000, 29) AS INTEGER) AS bin
  FROM {_VERDICT_SQL} v WHERE error IS NULL)
GROUP BY bin
""")
def q_score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A5: scores per bin of a thirtieth, decided on the four-decimal text."""
    return score_histogram(_event_scores(table(spark, sf, "events")), "score_text", 30)


_SWEEP_SQL = f"""
WITH s AS (SELECT CAST(replace(score_text, '.', '') AS INTEGER) * 300 // 10000 AS bin,
                  event_type = 'purchase' AS pos
           FROM {_VERDICT_SQL} v WHERE error IS NULL),
 g AS (SELECT range AS k FROM range(0, 301)),
 c AS (SELECT k, (SELECT count(*) FROM s WHERE bin >= k AND pos) AS tp,
              (SELECT count(*) FROM s WHERE bin >= k AND NOT pos) AS fp,
              (SELECT count(*) FROM s WHERE pos) AS p_all, (SELECT count(*) FROM s WHERE NOT pos) AS n_all FROM g)
SELECT round(k / 300.0, 4) AS threshold, tp, fp, p_all - tp AS fn, n_all - fp AS tn,
       CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision,
       CASE WHEN p_all > 0 THEN round(tp / p_all, 6) END AS recall
FROM c
"""


@register("threshold_sweep", _SWEEP_SQL)
def q_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Precision/recall at thresholds k/300 with purchase events as the positive class."""
    v = with_verdict(_event_scores(table(spark, sf, "events")), "score_text", 0.5).filter(F.col("error").isNull())
    return threshold_sweep(spark, v, F.col("event_type") == "purchase", "score_text", 300)


@register("stream_sweep", _SWEEP_SQL)
def q_stream_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """A5 as running statistics: the events arrive as files by day of the month, a few in each batch of a stream; counts per
    (bin, truth) are carried from batch to batch, and the sweep is read from the last version."""
    base = scratch_path(spark, "sweep")
    e = table(spark, sf, "events").withColumn("day", F.dayofmonth("ts"))
    # a large day is several tasks' and files
    e.hint("rebalance", F.col("day")).write.partitionBy("day").parquet(f"{base}/events")
    src = stream_table(spark, f"{base}/events", e.schema, "parquet", max_files_per_trigger=8)
    scored = _event_scores(src).where(F.col("score_text") != "")
    run_statistics(scored, F.col("event_type") == "purchase", f"{base}/counts", f"{base}/checkpoint",
                   steps=300).awaitTermination()
    return running_sweep(spark, f"{base}/counts", 300)


# ------------------------------------------------------------------ SPF (X14) and auth flags

# --- fixed test cases: (X-SPF-Status, Received-SPF list, Authentication-Results list) by doc_id % 8
SPF_CASES = (
    ("pass", [], []),
    ("softfail", [], []),
    ("none", ["fail (example.org: domain does not designate 192.0.2.1)"], []),
    (None, ["none (no SPF record)"], ["mx.example.net; spf=pass smtp.mailfrom=a.example; dkim=pass"]),
    (None, ["temperror (DNS timeout)"], []),
    (None, [], []),
    (" PASS ", [], ["mx.example.net; dkim=fail; SPF = Fail"]),
    ("bogus", ["Neutral (x)", "pass"], ["mx; spf=softfail; dmarc=pass"]),
)


def _spf_pick(k, idx):
    e = None
    for i, case in enumerate(SPF_CASES):
        v = case[idx]
        val = F.lit(v) if idx == 0 else (F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>"))
        e = F.when(k == i, val) if e is None else e.when(k == i, val)
    return e


def _spf_sql_pick(idx):
    arms = []
    for i, case in enumerate(SPF_CASES):
        v = case[idx]
        if idx == 0:
            val = "NULL" if v is None else O.lit(v)
        else:
            val = ("[" + ", ".join(O.lit(x) for x in v) + "]") if v else "[]::VARCHAR[]"
        arms.append(f"WHEN {i} THEN {val}")
    return f"(CASE doc_id % {len(SPF_CASES)} {' '.join(arms)} END)"


_SNIPPET_WS = "[" + WS_CLASS + "]+"
_SNIPPET_SQL = f"regexp_replace(text, {O.lit(_SNIPPET_WS)}, ' ', 'g')"


@register("spf_feature", f"""
SELECT doc_id, {O.spf_feature('x_spf', 'rs', 'ar')} AS spf
FROM (SELECT doc_id, {_spf_sql_pick(0)} AS x_spf,
             list_transform({_spf_sql_pick(1)}, lambda h: h || ' (' || {_SNIPPET_SQL} || ')') AS rs,
             list_transform({_spf_sql_pick(2)}, lambda h: h || ' (' || {_SNIPPET_SQL} || ')') AS ar
      FROM documents)
""")
def q_spf_feature(spark: SparkSession, sf: str) -> DataFrame:
    """X14 over header sets chosen by doc_id mod 8; every Received-SPF and
    Authentication-Results line carries a comment taken from the document."""
    k = F.pmod(F.col("doc_id"), F.lit(len(SPF_CASES)))
    snippet = F.regexp_replace("text", _SNIPPET_WS, " ")
    d = table(spark, sf, "documents").select(
        "doc_id", _spf_pick(k, 0).alias("x_spf"),
        F.transform(_spf_pick(k, 1), lambda h: F.concat(h, F.lit(" ("), snippet, F.lit(")"))).alias("rs"),
        F.transform(_spf_pick(k, 2), lambda h: F.concat(h, F.lit(" ("), snippet, F.lit(")"))).alias("ar"))
    return d.select("doc_id", H.spf_feature("x_spf", "rs", "ar").alias("spf"))


# ------------------------------------------------------------------ domain vocabulary

def _doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = with_page_urls(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "pages"))
    return d.select("doc_id", mail_body(F.col("text"), F.col("url")).alias("text"))


_TOP_SQL = f"""
SELECT domain, count(*) AS n FROM (
  SELECT unnest({O.url_domains("text || ' see ' || url || '. '")}) AS domain FROM {_DOC_URL_SQL} t)
GROUP BY domain ORDER BY n DESC, domain LIMIT 200
"""


@register("top_domains", _TOP_SQL)
def q_top_domains(spark: SparkSession, sf: str) -> DataFrame:
    """The 200 most frequent URL domains of the corpus (a top-k report)."""
    return top_domains(_doc_texts(spark, sf), "text", 200)


@register("mark_domains", f"""
WITH v AS (SELECT list(domain) AS vocab FROM ({_TOP_SQL}))
SELECT doc_id, {O.strip_urls("text || ' see ' || url || '. '", "vocab")} AS marked FROM {_DOC_URL_SQL} t, v
""")
def q_mark_domains(spark: SparkSession, sf: str) -> DataFrame:
    """URLs of vocabulary domains become [DOM_<domain>] tokens, others their domain."""
    texts = _doc_texts(spark, sf)
    vocab = domain_vocab(texts, "text", 200)
    return mark_domains(texts, "text", vocab).select("doc_id", "marked")


# ------------------------------------------------------------------ learning and scoring

@register("train_score")
def q_train_score(spark: SparkSession, sf: str) -> DataFrame:
    """E2 + E3 + E4 on the precomputed embeddings with label mod 2 as the class
    (rows-only check; the fit is verified against a Newton solve in the tests)."""
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"),
        F.pmod(F.col("label"), F.lit(2)).alias("label"))
    model = train(e, "features", "label")
    s = classify(score(e, model, "features", "score"))
    return s.select("vec_id", "label", F.round("score", 6).alias("score"), "prediction", "spam_probability",
                    "ham_probability")


@register("train_accuracy")
def q_train_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """A4: training-set accuracy of the model of ``train_score``."""
    e = table(spark, sf, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("features"), F.pmod(F.col("label"), F.lit(2)).alias("label"))
    model = train(e, "features", "label")
    return accuracy(score(e, model, "features", "score"), "score", "label")


def _parsed_corpus(spark: SparkSession, sf: str, labelled: bool = False) -> DataFrame:
    """Synthetic mail (``labelled``: only what has a label, chosen before the parse) parsed once and written as a Parquet table in the shared
    folder (``spark.checkpoint.dir``): training and scoring read the parsed
    table instead of re-parsing, and the lineage to the Python step is cut."""
    raw = synthetic_mail(table(spark, sf, "documents"), table(spark, sf, "pages"), table(spark, sf, "labels"))
    path = scratch_path(spark, "parsed")
    raw = raw.where(F.col("label").isNotNull()) if labelled else raw
    parse_mail(raw.select("doc_id", "label", "content")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register("train_text")
def q_train_text(spark: SparkSession, sf: str) -> DataFrame:
    """E1 (hashing encoder) + E2 + E3 on parsed mail labelled by ``labels.toxic`` (rows-only)."""
    parsed = _parsed_corpus(spark, sf, labelled=True)
    trained, _ = build_model(parsed, "label")
    s = score_parsed(parsed, trained)
    return s.select("doc_id", "label", F.round("score", 6).alias("score"), "score_text", "status")


@register("stream_score", _TAG_SQL)
def q_stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """The tagging of ``tag_headers`` run as a Structured Streaming query
    over the events parquet drop, written by an idempotent ``foreachBatch``
    sink to the shared folder and read back (equal to the batch result)."""
    schema = table(spark, sf, "events").schema
    # the glob matches events.parquet whether it is one file or a directory of parts
    src = stream_table(spark, f"{sf.rstrip('/')}/events.parquet*", schema, "parquet", max_files_per_trigger=64)
    out = _tagged_events(spark, sf, events=src)
    base = scratch_path(spark, "stream-score")
    q = run_to_table(out, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


# ------------------------------------------------------------------ files

def _labelled_mail(spark: SparkSession, sf: str) -> DataFrame:
    mail = synthetic_mail(table(spark, sf, "documents"), table(spark, sf, "pages"), table(spark, sf, "labels"))
    return mail.withColumn("label", F.coalesce("label", F.lit(0))).withColumn(
        "class", F.when(F.col("label") == 1, F.lit("bad")).otherwise(F.lit("good")))


_LABELLED_EXPECTED_SQL = f"""
SELECT CASE WHEN l.toxic = 1 THEN 'bad' ELSE 'good' END AS class, coalesce(l.toxic, 0)::INTEGER AS label,
       {O.collapse_ws('t.text')} AS subject,
       {O.strip_urls(O.py_strip("t.text || ' see ' || t.url || '. '"))} AS body,
       (CASE WHEN t.doc_id % {len(SENDER_PAIRS)} IN ({", ".join(map(str, MISMATCH_KEYS))}) THEN 1.0 ELSE 0.0 END)::DOUBLE
         AS mismatch
FROM {_DOC_URL_SQL} t LEFT JOIN labels l ON l.doc_id = t.doc_id
"""


#: Folders below a class that deep Maildirs deal their messages over: the folder itself, hidden and nested ones.
NESTED = ("", "/.Archive", "/2024/.Old.Lists", "/a/b/c")


def _write_maildirs(spark: SparkSession, sf: str, folder: str = "mail", nested: bool = False) -> str:
    """Deliver every message as a file into ``<base>/<folder>/<class>/new`` (bad: toxic, good: the rest), or, when
    ``nested``, into ``new`` of the folders below it; the names carry a Maildir flags part (``:2,S``) so the
    colon handling is exercised."""
    base = f"{scratch_path(spark, 'maildir')}/{folder}"
    mail = _labelled_mail(spark, sf).withColumn("path", F.col("doc_id").cast("string"))
    if nested:
        mail = mail.withColumn("class", F.concat("class", _nested_folder()))
    write_maildir_files(mail, base, "class", "path", "content", info="2,S")
    return base


def _nested_folder():
    return F.element_at(F.array(*map(F.lit, NESTED)), (F.pmod("doc_id", F.lit(len(NESTED))) + 1).cast("int"))


@register("maildir_scan", _LABELLED_EXPECTED_SQL)
def q_maildir_scan(spark: SparkSession, sf: str) -> DataFrame:
    """K5 → S2/S1 → S3 → P1: messages delivered as Maildir files (names with colons) into nested and hidden folders,
    found at any depth below the good and bad folders, labelled by list and parsed. A folder's name holds a
    pattern's signs."""
    base = _write_maildirs(spark, sf, "[Mail]", nested=True)
    corpus = scan_corpus(spark, f"{base}/good", f"{base}/bad", subdirs=("cur", "new"), any_depth=True)
    p = parse_mail(corpus.select("class", "label", "content"))
    return p.select("class", "label", "subject", "body", "mismatch")


@register("maildir_manifest", """
SELECT CASE WHEN l.toxic = 1 THEN 'bad' ELSE 'good' END AS class,
       substr(sha256(encode(d.doc_id::VARCHAR) || '\\x00'::BLOB || encode(coalesce(d.text, ''))), 1, 24) || '.mailsift:2,S' AS basename,
       strlen(coalesce(d.text, ''))::BIGINT AS length, TRUE AS in_time
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def q_maildir_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """K5 → S2 → K6 over real files: every document's text delivered as a file into nested and hidden folders, found at any
    depth; class, name, size, and whether the file's second lies within the delivery. No file is opened."""
    base = f"{scratch_path(spark, 'manifest')}/mail"
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    cls = F.when(F.col("toxic") == 1, "bad").otherwise("good")
    mail = docs.select(F.concat(cls, _nested_folder()).alias("box"), F.col("doc_id").cast("string").alias("path"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    begun = time.time()
    write_maildir_files(mail, base, "box", "path", "content", info="2,S")
    ended = time.time()
    man = manifest(list_corpus(spark, f"{base}/good", f"{base}/bad", subdirs=("cur", "new"), any_depth=True))
    return man.select("class", "basename", "length", F.col("mtime").between(int(begun) - 1, int(ended) + 1).alias("in_time"))


@register("stream_mail", _LABELLED_EXPECTED_SQL)
def q_stream_mail(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + T1: the same Maildir files read as a stream of arrivals over both folders (seen names in shared storage),
    parsed by the batch parse job and written by an idempotent foreachBatch sink."""
    base = _write_maildirs(spark, sf)
    src = stream_arrivals(spark, [f"{base}/good/new", f"{base}/bad/new"], scratch_path(spark, "arrivals"))
    cls = F.regexp_extract("path", r"/(good|bad)/new/[^/]*$", 1)
    src = src.select(cls.alias("class"), F.when(cls == "bad", 1).otherwise(0).alias("label"), "content")
    parsed = parse_mail(src).select("class", "label", "subject", "body", "mismatch")
    out = scratch_path(spark, "stream-mail")
    run_to_table(parsed, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table").drop("batch_id")


@register("training_roundtrip", f"""
SELECT subject, body, label, mismatch FROM ({_LABELLED_EXPECTED_SQL})
""")
def q_training_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K1 → S5: parsed records written as JSON lines and read back leniently."""
    p = parse_mail(_labelled_mail(spark, sf).select("label", "content"))
    path = scratch_path(spark, "training-jsonl")
    write_training(p, path)
    good, _rejects = read_training(spark, path)
    return good.select("subject", "body", "label", F.col("metadata_features")[0].alias("mismatch"))


@register("inputs", f"""
SELECT class, string_agg(folder, ',' ORDER BY ord) AS folders FROM (
  SELECT DISTINCT class, ord, folder FROM {_CORPUS_SQL} c) GROUP BY class
""")
def q_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """K7: the folders that fed each class, in list order."""
    return inputs(_corpus(spark, sf))


@register("header_features", f"""
SELECT t.doc_id, CAST(t.doc_id % 2 AS INTEGER) AS attachment_count,
       CAST(CASE WHEN t.url IS NULL THEN 0 ELSE 1 END AS INTEGER) AS links_count,
       0.0::DOUBLE AS spf, 0.0::DOUBLE AS dkim_pass, 0.0::DOUBLE AS dmarc_pass
FROM {_DOC_URL_SQL} t
""")
def q_header_features(spark: SparkSession, sf: str) -> DataFrame:
    """X15 (+X14) from parsed mail: attachments, links, SPF/DKIM/DMARC verdicts."""
    raw = synthetic_mail(table(spark, sf, "documents"), table(spark, sf, "pages"))
    p = parse_mail(raw.select("doc_id", "content"))
    return p.select(
        "doc_id", "attachment_count", X.links_count("body_raw").cast("int").alias("links_count"),
        H.spf_feature("x_spf_status", "received_spf", "authentication_results").alias("spf"),
        H.auth_pass("authentication_results", "dkim").alias("dkim_pass"),
        H.auth_pass("authentication_results", "dmarc").alias("dmarc_pass"))


@register("route_tagged", f"""
SELECT event_id, status = 'Yes' AS tagged_spam FROM {_VERDICT_SQL} v
""")
def q_route_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Find mail already tagged as spam by its header lines."""
    v = with_verdict(_event_scores(table(spark, sf, "events")), "score_text", 0.5)
    t = tag_headers(v, "content", 0.5)
    return route_tagged(t, "tagged").select("event_id", "tagged_spam")


# ------------------------------------------------------------------ sinks and model round trip (K4, K8, J3 anti join)

@register("deliver_counts", f"""
SELECT coalesce(folder, 'rejects') AS folder, count(*) AS n FROM {_VERDICT_SQL} v GROUP BY 1
""")
def q_deliver_counts(spark: SparkSession, sf: str) -> DataFrame:
    """K4: decided mail written partitioned by folder (errors to ``rejects``), read back and counted."""
    v = with_verdict(_event_scores(table(spark, sf, "events")), "score_text", 0.5)
    base = scratch_path(spark, "deliver")
    deliver(v.select("event_id", "content", "score_text", "folder", "error"), base)
    return spark.read.parquet(f"{base}/delivered").groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


@register("manifest_new", f"""
WITH o AS (SELECT class, basename FROM {_CORPUS_SQL} c WHERE lang <> 'de'),
 n AS (SELECT class, basename, length, mtime FROM (
    SELECT *, row_number() OVER (PARTITION BY class, basename ORDER BY ord DESC, subdir, path) AS rn
    FROM {_CORPUS_SQL} c) WHERE rn = 1)
SELECT class, basename, length, mtime FROM n
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.class = n.class AND o.basename = n.basename)
""")
def q_manifest_new(spark: SparkSession, sf: str) -> DataFrame:
    """Only the messages the previous manifest (before the German mail) did not have (anti join)."""
    c = _corpus(spark, sf)
    seen = c.filter(F.col("lang") != "de").select("class", "basename")
    now = manifest(keep_last(c), mtime="mtime")
    return new_only(now, seen)


@register("model_roundtrip")
def q_model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K8 + X10: the model of ``train_score`` saved with its contract, loaded
    back, dimensions resolved from the contract, and used to score (rows-only)."""
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), F.pmod("label", F.lit(2)).alias("label"))
    model = train(e, "features", "label")
    path = scratch_path(spark, "model")
    save_model(spark, model, path, contract(model, 0, model.numFeatures, "precomputed"))  # all inputs are embedding
    loaded, c = load_model(spark, path)
    emb, meta = resolve_dims(loaded.numFeatures, c)
    return score(e, loaded).select("vec_id", "label", F.round("score", 6).alias("score"),
                                   F.lit(emb).alias("embedding_dim"), F.lit(meta).alias("metadata_dim"))


# ------------------------------------------------------------------ token limit (X13) and other classifiers

@register("token_limit", r"""
WITH t AS (SELECT doc_id,
                  list_filter(regexp_split_to_array(lower(text), '[^\pL\pM\p{Nd}\p{Nl}\p{Pc}]+'), lambda x: x <> '') AS tokens
           FROM documents)
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens,
       CAST(least(len(tokens), 512) AS INTEGER) AS n_kept,
       array_to_string(tokens[1:512], ' ') AS kept
FROM t
""")
def q_token_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The encoder's tokens of every document, cut to 512."""
    tok = tokenizer("text", "tokens").transform(table(spark, sf, "documents").select("doc_id", "text"))
    kept = limit_tokens("tokens", MAX_TOKENS)
    return tok.select("doc_id", F.size("tokens").alias("n_tokens"), F.size(kept).alias("n_kept"),
                      F.array_join(kept, " ").alias("kept"))


@register("train_kinds")
def q_train_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The follow-up classifiers (linear SVM, gradient-boosted trees) next to
    the logistic model, training accuracy per kind (rows-only)."""
    e = table(spark, sf, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("features"), F.pmod("label", F.lit(2)).alias("label"))
    out = None
    for kind in ("logistic", "svm", "gbt"):
        m = train(e, "features", "label", kind=kind)
        pred = predicted_class(e, m, "features").select(
            F.lit(kind).alias("kind"), (F.col("predicted") == F.col("label")).cast("double").alias("hit"))
        acc = pred.groupBy("kind").agg(F.avg("hit").alias("accuracy"))
        out = acc if out is None else out.unionByName(acc)
    return out


# ------------------------------------------------------------------ mail of all shapes

_CRLF = "\n"


def _plain(body, charset: str = "utf-8"):
    return F.concat(F.lit(f"Content-Type: text/plain; charset={charset}\nContent-Transfer-Encoding: 8bit\n\n"), body)


def _html(body):
    return F.concat(F.lit("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), body)


def _parts(kind: str, boundary: str, *parts):
    sep = F.lit(f"\n--{boundary}\n")
    joined = [x for p in parts for x in (sep, p)]
    return F.concat(F.lit(f'Content-Type: multipart/{kind}; boundary="{boundary}"\n'), *joined,
                    F.lit(f"\n--{boundary}--\n"))


_HTML_ESCAPED = ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")
#: one byte of each charset beyond ASCII, and what it means
_ODD_BYTES = (("ibm850", "82", "é"), ("iso-8859-14", "D0", "Ŵ"))


def _mime_mail(docs: DataFrame) -> DataFrame:
    """A message of one of seven shapes around every document's whole text, by doc_id mod 7."""
    text, no = F.col("text"), F.col("doc_id").cast("string")
    escaped = text
    for a, b in _HTML_ESCAPED:
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    ascii_ = F.regexp_replace(text, "[^\\x00-\\x7f]", "?")
    only_html = _html(F.lit("<p>html form</p>"))
    tail = _plain(F.concat(F.lit("tail "), no))
    named = F.lit('Content-Type: text/plain\nContent-Disposition: inline; filename="n.txt"\n\nnot for the body')
    utf8 = lambda c: F.encode(c, "UTF-8")
    shapes = [
        utf8(_parts("alternative", "=_a", _plain(text), only_html)),
        utf8(_parts("mixed", "=_m", _parts("alternative", "=_a", only_html, _plain(text)), tail)),
        utf8(_html(F.concat(F.lit("<html><body><div>"), escaped, F.lit("</div></body></html>")))),
        utf8(_parts("mixed", "=_m", _plain(text), named)),
        *(F.concat(utf8(_plain(ascii_, charset)), F.unhex(F.lit(byte))) for charset, byte, _ in _ODD_BYTES),
        utf8(_plain(text)),
    ]
    head = F.concat(
        F.lit("Subject: =?iso-8859-1?Q?caf=E9_"), no, F.lit("?=\n"),
        F.lit("Received-SPF: "), F.when(F.col("doc_id") % 2 == 0, "pass (ok)").otherwise("fail (no)"), F.lit("\n"),
        F.lit("Authentication-Results: mx.example; dkim="), F.when(F.col("doc_id") % 3 == 0, "pass").otherwise("fail"),
        F.lit("; dmarc="), F.when(F.col("doc_id") % 5 == 0, "pass").otherwise("none"), F.lit("\nMIME-Version: 1.0\n"))
    k = F.pmod(F.col("doc_id"), F.lit(len(shapes)))
    shape = F.coalesce(*(F.when(k == i, s) for i, s in enumerate(shapes)))
    return docs.select("doc_id", F.concat(utf8(head), shape).alias("content"))


_ASCII_SQL = "regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g')"
_FLAT_SQL = "replace(replace(text, '\\n', chr(10)), chr(13), '')"
for _a, _b in ((" +", "' '"), ("\\n +", "chr(10)"), ("\\n+", "chr(10) || chr(10)")):
    _FLAT_SQL = f"regexp_replace({_FLAT_SQL}, '{_a}', {_b}, 'g')"


@register("parse_mime", f"""
SELECT doc_id, 'café ' || doc_id AS subject,
       {O.strip_urls(O.py_strip(f"""(CASE doc_id % 7
           WHEN 1 THEN text || chr(10) || 'tail ' || doc_id
           WHEN 2 THEN {_FLAT_SQL}
           WHEN 4 THEN {_ASCII_SQL} || 'é'
           WHEN 5 THEN {_ASCII_SQL} || 'Ŵ'
           ELSE text END)"""))} AS body,
       CAST(CASE WHEN doc_id % 7 = 3 THEN 1 ELSE 0 END AS INTEGER) AS attachment_count,
       CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE) AS spf,
       CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS dkim_pass,
       CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS dmarc_pass
FROM documents
""")
def q_parse_mime(spark: SparkSession, sf: str) -> DataFrame:
    """P2-P4, X14, X15 over alternative, nested, html-only, named-attachment and odd-charset mail of every document."""
    p = parse_mail(_mime_mail(table(spark, sf, "documents")))
    return p.select("doc_id", "subject", "body", "attachment_count",
                    H.spf_feature("x_spf_status", "received_spf", "authentication_results").alias("spf"),
                    H.auth_pass("authentication_results", "dkim").alias("dkim_pass"),
                    H.auth_pass("authentication_results", "dmarc").alias("dmarc_pass"))


@register("parse_robust", f"""
SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN chr(65533) || ' ' || doc_id WHEN 3 THEN NULL
         ELSE {O.strip_urls(O.py_strip(f"CASE doc_id % 4 WHEN 0 THEN text || chr(10) || chr(65533) || chr(65533) || ' ' || doc_id "
                                       f"ELSE {_ASCII_SQL} || 'ÿ' END"))} END AS body,
       CASE WHEN doc_id % 4 <> 3 THEN doc_id % 4 = 2 END AS tagged_spam, doc_id % 4 = 3 AS failed
FROM documents
""")
def q_parse_robust(spark: SparkSession, sf: str) -> DataFrame:
    """P1/P3/X1/K4b where mail is damaged: halves of surrogate pairs as HTML references and in UTF-7, a raw Latin-1 byte
    in a tagged message, and no content at all. No message ends the job."""
    text, no = F.col("text"), F.col("doc_id").cast("string")
    ascii_ = F.regexp_replace(text, "[^\\x00-\\x7f]", "?")
    utf8 = lambda c: F.encode(c, "UTF-8")
    shapes = [
        utf8(_parts("mixed", "=_m", _plain(text), _html(F.concat(F.lit("<b>&#55357;&#56832; "), no, F.lit("</b>"))))),
        utf8(_plain(F.concat(F.lit("+2D0- "), no), "utf-7")),
        F.concat(utf8(F.lit("X-Spam-Status: Yes, score=0.9\n")), utf8(_plain(ascii_, "iso-8859-1")), F.unhex(F.lit("FF"))),
        F.lit(None).cast("binary"),
    ]
    k = F.pmod(F.col("doc_id"), F.lit(len(shapes)))
    raw = table(spark, sf, "documents").select("doc_id", F.coalesce(*(F.when(k == i, s) for i, s in enumerate(shapes))).alias("content"))
    p = parse_mail(route_tagged(raw))
    return p.select("doc_id", "body", "tagged_spam", F.col("parse_error").isNotNull().alias("failed"))


# ------------------------------------------------------------------ rules around the model

@register("combined_text", """
SELECT doc_id, 'Subject: ' || coalesce(source, '') || chr(10) || coalesce(text, '') AS combined FROM documents
""")
def q_combined_text(spark: SparkSession, sf: str) -> DataFrame:
    """X6 with the source as subject and the text as body of every document."""
    return table(spark, sf, "documents").select("doc_id", X.combined_text("source", "text").alias("combined"))


_FIXED_SCORE_SQL = """
(SELECT vec_id, label, 1.0 / (1.0 + exp(-(list_sum(list_transform(CAST(embedding AS DOUBLE[]),
          lambda x, i: x * (((i - 1) % 7) - 3) / 10.0)) + 0.1))) AS s FROM embeddings)
"""


def _fixed_scores(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.model import logistic_score

    e = table(spark, sf, "embeddings")
    width = len(e.select("embedding").first()[0])
    w = [((i % 7) - 3) / 10.0 for i in range(width)]
    return e.select("vec_id", "label", logistic_score(F.col("embedding").cast("array<double>"), w, 0.1).alias("s"))


@register("classify_fixed", f"""
SELECT vec_id, CASE WHEN s > 0.5 THEN 'SPAM' ELSE 'HAM' END AS prediction, printf('%.2f', s * 100) || '%' AS spam_probability,
       printf('%.2f', (1 - s) * 100) || '%' AS ham_probability FROM {_FIXED_SCORE_SQL}
""")
def q_classify_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """E3 + E4 on fixed coefficients over every embedding."""
    return classify(_fixed_scores(spark, sf), "s").select("vec_id", "prediction", "spam_probability", "ham_probability")


@register("accuracy_fixed", f"""
SELECT avg(CASE WHEN (s > 0.5) = (label % 2 = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM {_FIXED_SCORE_SQL}
""")
def q_accuracy_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """A4 on fixed coefficients over every embedding, label mod 2 as the class."""
    return accuracy(_fixed_scores(spark, sf).withColumn("label", F.col("label") % 2), "s", "label")


# the list: every source that is a free-mail provider, with directives, comments and a whitelist
_LIST_SQL = "(SELECT DISTINCT source || '.example' AS domain FROM documents WHERE regexp_matches(source, '[02468]$') AND source <> 'src4')"


@register("domain_list_mismatch", f"""
SELECT d.doc_id, CAST(CASE WHEN f.domain IS NULL AND r.domain IS NOT NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS mismatch
FROM (SELECT doc_id, source || '.example' AS fd, 'src' || (doc_id % 20) || '.example' AS rd FROM documents) d
LEFT JOIN {_LIST_SQL} f ON f.domain = d.fd LEFT JOIN {_LIST_SQL} r ON r.domain = d.rd
""")
def q_domain_list_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """S6 + J1 + X5 with a supplied list: From in the document's source, Reply-To by doc_id mod 20."""
    docs = table(spark, sf, "documents")
    host = F.concat("source", F.lit(".example"))
    lines = docs.where(F.col("source").rlike("[02468]$")).select(
        F.concat(F.lit("freemail_domains "), host, F.lit(" # free")).alias("value")).distinct()
    lines = lines.unionByName(lines.select(F.lit("freemail_whitelist src4.example").alias("value"))).unionByName(
        lines.select(F.lit("util_rb_tld example").alias("value")))
    listed = domain_list(lines)
    d = docs.select("doc_id", host.alias("fd"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit(".example")).alias("rd"))
    d = H.flag_domains(H.flag_domains(d, "fd", listed, "from_free"), "rd", listed, "reply_free")
    return d.select("doc_id", H.reply_to_mismatch("fd", "rd", F.col("from_free"), F.col("reply_free")).alias("mismatch"))


# ------------------------------------------------------------------ an encoder that fails (E5), calibrated margins

#: Signs whose shares of a text are the embedding of ``encoder_fallback``'s encoder, and its positions for words.
_SIGNS, _POSITIONS = " etaoins", 512
_SIGN_WEIGHTS = tuple((k % 5) - 2.0 for k in range(len(_SIGNS)))


def _make_sign_encoder():
    """An encoder without truncation, as sentence encoders are: it fails on a text of more words than it has positions."""
    def encode(texts):
        if any(t.count(" ") >= _POSITIONS for t in texts):
            raise ValueError(f"more than {_POSITIONS} words")
        return [[t.count(c) / len(t) for c in _SIGNS] for t in texts]

    return encode


_COMBINED_SQL = "('Subject: ' || coalesce(source, '') || chr(10) || coalesce(text, ''))"
_SIGN_SUM_SQL = " + ".join(
    f"(length(c) - length(replace(c, '{sign}', '')))::DOUBLE / length(c) * {w}" for sign, w in zip(_SIGNS, _SIGN_WEIGHTS))


@register("encoder_fallback", f"""
SELECT doc_id, failed AS scored_by_fallback,
       CASE WHEN failed THEN '0.5000' ELSE printf('%.4f', 1.0 / (1.0 + exp(-({_SIGN_SUM_SQL} + 0.1)))) END AS score_text,
       CASE WHEN failed OR {_SIGN_SUM_SQL} + 0.1 >= 0 THEN 'Yes' ELSE 'No' END AS status
FROM (SELECT doc_id, {_COMBINED_SQL} AS c, coalesce(text, '') = '' OR len(string_split({_COMBINED_SQL}, ' ')) > {_POSITIONS} AS failed
      FROM documents)
""")
def q_encoder_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """E1 + E5 with an encoder that fails on texts of more than 512 words: each of them is told from the batch it came in
    and scored 0.5000, all others get their score (fixed coefficients)."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("subject"), F.col("text").alias("body"), F.lit(None).cast("string").alias("parse_error"),
        F.octet_length("text").alias("content_length"), F.lit(None).cast("array<double>").alias("metadata_features"))
    model = Linear(Vectors.dense(_SIGN_WEIGHTS), 0.1)
    trained = Trained(model, 0, model.numFeatures, contract(model, 0, model.numFeatures, "custom"), "custom",
                      make_encode=_make_sign_encoder)
    return score_parsed(d, trained).select("doc_id", "scored_by_fallback", "score_text", "status")


_MARGIN_BINS = 64


@register("calibrated_margins", f"""
WITH m AS (SELECT vec_id, label % 2 AS y, ln(s / (1 - s)) AS m FROM {_FIXED_SCORE_SQL}),
 q AS (SELECT vec_id, y, m / (1 + abs(m)) AS u FROM m),
 b AS (SELECT least(floor((u + 1) * {_MARGIN_BINS // 2}), {_MARGIN_BINS - 1})::INTEGER AS bin, count(*) AS n, sum(y) AS pos FROM q GROUP BY 1),
 c AS (SELECT row_number() OVER (ORDER BY bin) AS i, (bin + 0.5) / {_MARGIN_BINS // 2} - 1 AS x,
              sum(n) OVER (ORDER BY bin) AS cn, sum(pos) OVER (ORDER BY bin) AS cp, n, pos FROM b),
 r AS (SELECT j.i AS j, k.i AS k, (k.cp - j.cp + j.pos)::DOUBLE / (k.cn - j.cn + j.n) AS mean FROM c j JOIN c k ON j.i <= k.i),
 lo AS (SELECT c.i, r.j, min(r.mean) AS least FROM c JOIN r ON r.j <= c.i AND r.k >= c.i GROUP BY c.i, r.j),
 f AS (SELECT i, max(least) AS p FROM lo GROUP BY i),
 g AS (SELECT c.x, f.p, lead(c.x) OVER (ORDER BY c.i) AS x1, lead(f.p) OVER (ORDER BY c.i) AS p1 FROM c JOIN f USING (i))
SELECT vec_id, round(CASE WHEN g.x IS NULL THEN (SELECT arg_min(p, x) FROM g) WHEN x1 IS NULL THEN p
                          ELSE p + (p1 - p) * (u - g.x) / (x1 - g.x) END, 6) AS score
FROM q ASOF LEFT JOIN g ON q.u >= g.x
""")
def q_calibrated_margins(spark: SparkSession, sf: str) -> DataFrame:
    """E6's isotonic calibration of fixed margins over every embedding, label mod 2 as the class."""
    m = _fixed_scores(spark, sf).select("vec_id", (F.col("label") % 2).alias("y"),
                                        F.ln(F.col("s") / (F.lit(1.0) - F.col("s"))).alias("margin"))
    return calibrate(m, fit_curve(m, "margin", "y", _MARGIN_BINS), "margin").select("vec_id", F.round("score", 6).alias("score"))


@register("calibrated_svm", """
SELECT vec_id, TRUE AS a_probability, TRUE AS same_after_reload, TRUE AS decided FROM embeddings
""")
def q_calibrated_svm(spark: SparkSession, sf: str) -> DataFrame:
    """E6 + K8 + X12: a linear SVM calibrated out of fold on every embedding (label mod 2), saved and loaded; every score is a
    probability, the same from the loaded model, and has a verdict."""
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), F.pmod("label", F.lit(2)).alias("label"))
    model = train_calibrated(e, "features", "label")
    path = scratch_path(spark, "svm")
    save_model(spark, model, path, contract(model, 0, model.numFeatures, "precomputed"))
    loaded, _ = load_model(spark, path)
    s = with_verdict(score(score(e, model, out="before"), loaded, out="p").withColumn("score_text", score_text("p")), "score_text")
    return s.select("vec_id", F.col("p").between(0.0, 1.0).alias("a_probability"),
                    (F.col("p") == F.col("before")).alias("same_after_reload"),
                    F.col("status").isin("Yes", "No").alias("decided"))


# ------------------------------------------------------------------ the filter as a stream (T1 + T2 with a trained model)

@register("stream_filter")
def q_stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    """T1/T2 end to end: a model trained on the parsed corpus scores the Maildir
    files as they stream in (same parse, features and model as batch), tags
    them (K2/K3) and delivers them by folder (K4) through an idempotent
    foreachBatch sink; the delivered table is read back (rows-only check;
    tests compare it with the batch filter on the same model)."""
    from .score import filter_files_stream

    trained, _ = build_model(_parsed_corpus(spark, sf, labelled=True), "label")
    base = _write_maildirs(spark, sf)
    target = scratch_path(spark, "stream-filter")
    filter_files_stream(spark, trained, [f"{base}/good/new", f"{base}/bad/new"], target).awaitTermination()
    return spark.read.parquet(f"{target}/table").drop("batch_id")
