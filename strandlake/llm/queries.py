"""Registered queries of the thirteen operators: thin digests of what each operator returns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, fmindex, language, lines, lm, merkle, quality, simhash, suffixarray, urls, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language.identify(docs).select("doc_id", "language", "confidence", "n_trigrams", "kept")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's operator on web pages, with their markup language, host and address suffix."""
    pages = language.of_pages(table(spark, sf_dir, "pages"))
    return language.identify(pages, host_col="host", suffix_col="suffix").select("page_id", "language", "confidence", "n_trigrams", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("size").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixarray.dedup_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("size").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), warc.archive_folder(spark))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": tampered})


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM p),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM t, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
m AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    word_chars / nullif(n_words, 0) AS m1, n_symbols / nullif(n_words, 0) AS m2, n_dup_lines / nullif(n_lines, 0) AS m3
  FROM b),
q AS (
  SELECT lang, source, count(*) AS n, quantile_disc(m1, [0.25, 0.75]) AS q1, quantile_disc(m2, [0.25, 0.75]) AS q2, quantile_disc(m3, [0.25, 0.75]) AS q3
  FROM m WHERE NOT base_failed GROUP BY lang, source HAVING count(*) >= 30),
l AS (
  SELECT lang, quantile_disc(m1, [0.25, 0.75]) AS q1, quantile_disc(m2, [0.25, 0.75]) AS q2, quantile_disc(m3, [0.25, 0.75]) AS q3
  FROM m WHERE NOT base_failed GROUP BY lang),
f AS (
  SELECT m.*, coalesce(q.q1, l.q1) AS q1, coalesce(q.q2, l.q2) AS q2, coalesce(q.q3, l.q3) AS q3
  FROM m LEFT JOIN q ON q.lang = m.lang AND q.source = m.source LEFT JOIN l ON l.lang = m.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND m1 BETWEEN q1[1] - greatest((q1[2] - q1[1]) * 3.0, 2.5) AND q1[2] + greatest((q1[2] - q1[1]) * 3.0, 2.5)
  AND m2 BETWEEN q2[1] - greatest((q2[2] - q2[1]) * 3.0, 0.1) AND q2[2] + greatest((q2[2] - q2[1]) * 3.0, 0.1)
  AND m3 BETWEEN q3[1] - greatest((q3[2] - q3[1]) * 3.0, 0.5) AND q3[2] + greatest((q3[2] - q3[1]) * 3.0, 0.5) AS kept
FROM f
"""

OP8_SQL = r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM s),
n AS (SELECT doc_id, i, trim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g')) AS line FROM e),
o AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM n WHERE line <> ''),
r AS (
  SELECT a.doc_id, a.pos, [a.i, b.i, c.i] AS places, [a.line, b.line, c.line] AS body
  FROM o a JOIN o b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN o c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2),
k AS (
  SELECT doc_id, places, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS nth FROM r
  UNION ALL SELECT doc_id, [i], row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) FROM o WHERE length(line) >= 60),
d AS (SELECT DISTINCT doc_id, unnest(places) AS i FROM k WHERE nth > 1),
x AS (
  SELECT e.doc_id, count(*)::BIGINT AS n_lines, count(d.i)::BIGINT AS n_removed,
    coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE d.i IS NULL), '') AS kept
  FROM e LEFT JOIN d ON d.doc_id = e.doc_id AND d.i = e.i GROUP BY e.doc_id)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM s LEFT JOIN x ON x.doc_id = s.doc_id
"""

OP11_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (SELECT body, max(page_id) AS first FROM p WHERE octet_length(body) >= 1000 GROUP BY body)
SELECT p.page_id, octet_length(p.body) AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON g.body = p.body
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
o AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item
  FROM d),
k AS (SELECT lang, item FROM o GROUP BY lang, item HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.item, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.item = o.item GROUP BY ALL),
g AS (
  SELECT s.lang, s.source, coalesce(v.v, 0) AS v, coalesce(t.n, 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v ON v.lang = s.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) t ON t.lang = s.lang AND t.source = s.source),
p AS (
  SELECT g.lang, g.source, k.item, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item),
q AS (
  SELECT lang, item, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (max(l.n) + 5 * max(v.v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY lang) l USING (lang) JOIN v USING (lang) GROUP BY lang, item),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.item = x.item GROUP BY ALL
  UNION ALL SELECT p.lang, p.source, 'term', p.item, (p.p - q.q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.item = p.item WHERE p.n > 0 AND p.p > q.q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

OP13_SQL = r"""
WITH RECURSIVE c AS (
  SELECT *, row_number() OVER () AS rid,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
e AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now FROM c),
w AS (
  SELECT rid, doc_id, lang, now, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM e),
f AS (SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS claimed FROM w),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM f),
t AS (
  SELECT 0 AS lv, lang, i, n, leaf AS h FROM b
  UNION ALL SELECT lv + 1, lang, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lv, lang, i // 8, n),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lv, i, n, h FROM s
  UNION ALL SELECT lv + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 8, n),
p AS (
  SELECT rid, lang, 0 AS lv, i, n, '' AS proof, claimed AS h FROM b
  UNION ALL
  SELECT p.rid, p.lang, p.lv + 1, p.i // 8, (p.n + 7) // 8, p.proof || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i <> p.i), ''), sha256(string_agg(CASE WHEN t.i = p.i THEN p.h ELSE t.h END, '' ORDER BY t.i))
  FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.lv = p.lv AND t.i // 8 = p.i // 8 WHERE p.n > 1 GROUP BY p.rid, p.lang, p.lv, p.i, p.n, p.proof, p.h),
o AS (
  SELECT p.rid, 0 AS lv, s.i, s.n, p.proof, p.h FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL
  SELECT o.rid, o.lv + 1, o.i // 8, (o.n + 7) // 8, o.proof || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i <> o.i), ''), sha256(string_agg(CASE WHEN u.i = o.i THEN o.h ELSE u.h END, '' ORDER BY u.i))
  FROM o JOIN u ON u.lv = o.lv AND u.i // 8 = o.i // 8 WHERE o.n > 1 GROUP BY o.rid, o.lv, o.i, o.n, o.proof, o.h)
SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang JOIN o ON o.rid = f.rid AND o.n = 1, (SELECT h FROM u WHERE n = 1) r
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_url_filters, op3_quality_rules, op4_substring_dedup, op5_suffix_array_dedup, op6_simhash_near_dedup, op7_byte_bpe, op8_line_dedup, op9_lm_scoring, op10_language_id, op11_warc, op12_source_divergence, op13_merkle_manifest, language_of_pages)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op8_line_dedup": OP8_SQL, "op11_warc": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
