"""Registered queries of the training-data operators and the statements that check them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.llm import (
    decontamination, filter_audit, fingerprints, infill, licenses, ngram_join, quality, sentencepieces, sharding,
    suffix_dedup, token_counts, token_files, toxicity,
)
from memberlens.llm.common import read_table

BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2
SHARDS = 8


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id", "n_links"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_counts.context_limits(token_counts.histogram(token_counts.lengths(docs, public_tokenizers.path(BPE))))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write_tokens(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BPE), END_ID)
    return token_files.with_checksum(token_files.read_tokens(spark, folder))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: number and checksum of the ids, chunks, and the checksum of the decoded text."""
    encoded = sentencepieces.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return sentencepieces.decode(encoded, public_tokenizers.path(PIECES)).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        "n_chunks", F.length("decoded").alias("n_chars"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: exact hits decide ``contaminated``; ``n_near_items`` counts the items met by proximity."""
    found = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near_items",
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    scored = quality.quality(docs, read_table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", "evidence", "host_posterior", "path_posterior", F.col("quality").alias("score"),
        (F.col("quality") >= 0.5).cast("int").alias("predicted"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(read_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = infill.restored(infill.fill_in_middle(read_table(spark, sf_dir, "documents")))
    return moved.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict:
    named = [
        op1_ngram_jaccard_join, op2_token_counts, op3_token_files, op4_sentencepiece, op5_license_scan,
        op6_fingerprints, op7_decontamination, op8_quality_classifier, op9_sharding, op10_toxicity,
        op11_suffix_dedup, op12_fill_in_middle, op13_filter_audit,
    ]
    return {f.__name__: f for f in named}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) >= 5
      THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM cut),
flat AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM grams),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) + any_value(y.n) AS both_n, count(*) AS shared
  FROM flat x JOIN flat y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (both_n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
same AS (SELECT doc_id, array_to_string(w, ' ') AS words, CASE WHEN len(w) = 0 THEN doc_id
    ELSE min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS class_id FROM cut),
others AS (
  SELECT x.doc_id, count(DISTINCT y.words) AS n_links
  FROM links JOIN same x ON a = x.doc_id JOIN same y ON b = y.doc_id WHERE x.words <> y.words GROUP BY 1)
SELECT doc_id, len(g) AS n_shingles, component_id, class_id, coalesce(n_links, 0) AS n_links
FROM grams JOIN lowest ON doc_id = a JOIN same USING (doc_id) LEFT JOIN others USING (doc_id)
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(
    range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS p
  FROM b WHERE len(w) > 0),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, n FROM places JOIN phrases USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1),
sought AS (SELECT row_number() OVER () AS phrase, item_id, list_distinct(string_split(p, ' ')) AS words FROM phrases),
wanted AS (SELECT phrase, item_id, len(words) AS n, unnest(words) AS word FROM sought),
stood AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
often AS (SELECT word, count(*) AS places FROM stood GROUP BY 1),
rarest AS (
  SELECT phrase, arg_min(word, (places, word)) AS word FROM wanted LEFT JOIN often USING (word)
  GROUP BY phrase HAVING count(*) = count(places)),
spots AS (SELECT phrase, doc_id, pos AS place FROM rarest JOIN stood USING (word)),
around AS (
  SELECT s.phrase, s.doc_id, s.place, v.item_id, v.n, v.word, t.pos
  FROM spots s JOIN wanted v USING (phrase)
  JOIN stood t ON t.doc_id = s.doc_id AND t.word = v.word AND t.pos BETWEEN s.place - 40 AND s.place + 40
  QUALIFY count(DISTINCT v.word) OVER (PARTITION BY s.phrase, s.doc_id, s.place) = v.n),
stretches AS (
  SELECT x.phrase, x.doc_id, x.place, x.pos, x.item_id
  FROM around x JOIN around y ON x.phrase = y.phrase AND x.doc_id = y.doc_id AND x.place = y.place
    AND y.pos BETWEEN x.pos AND x.pos + 40
  WHERE x.place BETWEEN x.pos AND x.pos + 40
  GROUP BY ALL HAVING count(DISTINCT y.word) = any_value(x.n)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM stretches GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""


_INFILL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
    list_transform(range(0, 4), lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS r FROM units),
placed AS (
  SELECT doc_id, t, u, n, least(r[1] % (n + 1), r[2] % (n + 1)) AS low, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
      WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m,
    array_to_string(u[high + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""

_AUDIT = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM cut GROUP BY t),
marked AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT c.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(c.t, '[^A-Z]', '', 'g')) > 10 * length(c.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(c.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN c.doc_id > f.first_id THEN 16 ELSE 0 END AS fails
  FROM cut c JOIN firsts f ON c.t = f.t LEFT JOIN marked m ON c.doc_id = m.doc_id),
kinds AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM judged GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
steps AS (
  SELECT o AS filter_order, step, 1 << (ascii(o[step]) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))), 0)::BIGINT AS before
  FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders WHERE len(o) = 5)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM kinds, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": _JACCARD, "op7_decontamination": _CONTAMINATION, "op12_fill_in_middle": _INFILL,
        "op13_filter_audit": _AUDIT,
    }
