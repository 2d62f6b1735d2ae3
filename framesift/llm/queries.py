"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import bpe, context_mixing, filter_audit, host_rules, jaccard_join, langid, packing, rule_ensemble, tiff, token_edits, toxicity, warc, whitening
from framesift.llm.common import id_split, shared_folder, table


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store_text(table(spark, sf_dir, "documents"))
    found = tiff.pages(stored, keep=("doc_id", "n_bytes"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("bigint").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "compression",
        "predictor",
        "parts",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary)


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [F.col(f"_stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op4_edit_counts(spark: SparkSession, sf_dir: str, ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    """Tokens of every document before and after four edits that follow from its id and length."""
    state = token_edits.build(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    state = state.withColumnRenamed("n_tokens", "n_tokens_before").withColumn("edits", token_edits.sample_edits())
    done = token_edits.apply_edits(state, ranks, public_tokenizers.PATTERN, keep=("doc_id", "n_tokens_before"))
    return done.select("doc_id", "n_tokens_before", "n_tokens", F.length("text").cast("bigint").alias("n_chars"), "encoded_chars", F.sha2("text", 256).alias("text_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.fit(documents, table(spark, sf_dir, "labels"), id_split("doc_id", 4) != 2)
    return _scored(rule_ensemble.with_score(documents, model).withColumnRenamed("_score", "score"), 0.7)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents, id_split("doc_id", 3) != 1)
    found = langid.predict(documents, model)
    return found.select("doc_id", F.coalesce(id_split("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), settings=jaccard_join.Settings(words=3, percent=90))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), id_split("doc_id", 4) != 2)
    return _scored(toxicity.score(documents, model), 0.3)


def _scored(found: DataFrame, threshold: float) -> DataFrame:
    held_out = F.coalesce(id_split("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)", 1).try_cast("bigint")
    return found.select(
        page(F.col("record_id")).alias("page_id"),
        F.col("stated_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.substring_index("stated_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
        "valid",
    )


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model, counts = context_mixing.fit(documents, id_split("doc_id", 7) != 2)
    found = context_mixing.score(documents, model, counts)
    held_out = F.coalesce(id_split("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "total_bits", "n_bytes", "bits_per_byte")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tiff_media, op2_best_fit_packing, op3_host_rules, op4_edit_counts, op5_byte_bpe, op6_rule_ensemble, op7_language_id, op8_jaccard_join, op9_toxicity, op10_warc, op11_context_mixing, op12_whitening, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_host_rules": _OP3, "op8_jaccard_join": _OP8, "op10_warc": _OP10, "op13_filter_audit": _OP13}


_OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
t AS (SELECT rid, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w1, w2) AS times FROM t WHERE w2 IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + s) AS n FROM g, (SELECT unnest([0, 1, 2]) AS s) WHERE times > 1 GROUP BY rid),
m AS (
  SELECT rid, doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (rid)),
x AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_repeat_words > 40 * n_words AS soft_failed
  FROM m),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR soft_failed) AS DOUBLE) AS f FROM x GROUP BY host),
a AS (SELECT sum(n) AS n, sum(f) / sum(n) AS mu, sum(n * n) AS s, count(*) - 1 AS h1, sum(f * f / n) AS q FROM h),
b AS (SELECT mu, CASE WHEN mu > 0 AND mu < 1 AND n - s / n - h1 > 0 THEN ((q - n * mu * mu) / (mu * (1 - mu)) - h1) / (n - s / n - h1) ELSE 0 END AS raw FROM a),
c AS (SELECT mu, CASE WHEN mu > 0 AND mu < 1 THEN 1 / least(0.999, greatest(0.0001, raw)) - 1 ELSE 1 END AS k FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (soft_failed AND (f + mu * k) / (n + k) > 0.1) AS kept
FROM x JOIN h USING (host), c
"""


_OP8 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT rid, array_to_string(words[i : i + 2], ' ') AS shingle FROM (SELECT rid, words, unnest(range(1, greatest(1, len(words) - 2) + 1)) AS i FROM d WHERE len(words) > 0)),
t AS MATERIALIZED (SELECT DISTINCT rid, shingle FROM s),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM t GROUP BY rid),
o AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM t a JOIN t b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (rid) JOIN (SELECT r.a AS rid, min(x.doc_id) AS component_id FROM r JOIN d x ON x.rid = r.b GROUP BY r.a) c USING (rid)
"""


_OP10 = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to,
       true AS valid
FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
             sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
      FROM pages)
"""


_OP13 = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
m AS (
  SELECT doc_id, part,
         (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask
  FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS q, max(CAST(toxic = 1 AS INT)) AS t FROM labels GROUP BY doc_id),
c AS MATERIALIZED (
  SELECT part, mask, count(*) AS n, coalesce(sum(q), 0) AS good, coalesce(sum(t), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INT) AS before FROM o, range(1, 6) r(step)),
x AS (SELECT *, mask & bit > 0 AS fails, mask & before > 0 AS earlier FROM c, s)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT earlier), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT earlier), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (WHERE fails AND earlier), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (WHERE fails AND NOT earlier), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (WHERE fails AND NOT earlier), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(1, bit_count(mask))) FILTER (WHERE fails), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step
"""
