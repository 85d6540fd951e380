"""The queries of the operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import ann, conversations, lines, manifest, neardup, packing, pieces, pii, quality, substrings, suffix_lm, toxicity, urls
from docflow.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.clusters(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.scored(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


#: For the queries and tests; a job of its own keeps its own key.
KEY = "docflow-demo-key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = pii.mask(table(spark, sf_dir, "documents"), KEY)
    counts = [(F.size("_kinds") - F.size(F.array_remove("_kinds", kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return masked.select("doc_id", "text", *counts)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"), manifest.tampered())


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.summary(rows, conversations.repair(conversations.damaged(rows)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d
), g AS (
  SELECT rid, i, concat_ws(chr(10), w[i], w[i + 1], w[i + 2]) AS g FROM l, unnest(range(1, len(w) - 1)) AS u(i)
), m AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1
), r AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM m) GROUP BY rid
), measured AS (
  SELECT l.doc_id, l.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN r USING (rid)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY source
), moments AS (
  SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2
    - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS between_hosts FROM hosts
), prior AS (
  SELECT m, CASE WHEN between_hosts > 1e-12 THEN m * (1 - m) / between_hosts - 1 ELSE -1 END AS k FROM moments
), rates AS (
  SELECT source, CASE WHEN k > 0 THEN (f + m * k) / (n + k) ELSE m END AS host_rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_rate <= 0.5 AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""

OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ln FROM documents
), e AS (
  SELECT rid, source, i, ln[i] AS line, regexp_replace(ln[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k
  FROM d, unnest(range(1, len(ln) + 1)) AS u(i)
), c AS (
  SELECT source, k, count(DISTINCT rid) AS pages FROM e WHERE k <> '' GROUP BY source, k
), h AS (
  SELECT source, count(*) AS host_pages FROM documents GROUP BY source
), b AS (
  SELECT c.source, k FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE pages >= 10 AND pages > host_pages * 0.1::DOUBLE
), f AS (
  SELECT e.*, b.k IS NOT NULL AS gone FROM e LEFT JOIN b ON e.k = b.k AND e.source IS NOT DISTINCT FROM b.source
), t AS (
  SELECT rid, count(*) FILTER (gone)::BIGINT AS n_dropped, count(*)::BIGINT AS n_lines,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS cleaned FROM f GROUP BY rid
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE n_dropped END AS n_dropped, CASE WHEN text IS NOT NULL THEN cleaned END AS text
FROM d JOIN t USING (rid)
"""

#: CRC-32 of sums(txt), bit by bit into a table, then byte by byte; crc(txt, value).
CRC_SQL = r"""
bits(n, c, i) AS (
  SELECT n, n::BIGINT, 0 FROM range(256) AS t(n) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i + 1 FROM bits WHERE i < 8
), tab AS (
  SELECT list(c ORDER BY n) AS t FROM bits WHERE i = 8
), sums(txt, c, i) AS (
  SELECT DISTINCT txt, 4294967295::BIGINT, 1 FROM keys
  UNION ALL SELECT txt, xor(c // 256, t[1 + xor(c % 256, ascii(txt[i]))::BIGINT]), i + 1 FROM sums, tab WHERE i <= length(txt)
), crc AS (
  SELECT txt, xor(c, 4294967295) AS value FROM sums WHERE i > length(txt)
)"""

OP11_SQL = (
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS bare FROM documents
), h AS (
  SELECT doc_id, s, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) AS other FROM d
), keys AS (
  SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS txt FROM h
), """
    + CRC_SQL
    + r""", l AS (
  SELECT h.doc_id, s, leaf, CASE WHEN value % 2 = 0 THEN other ELSE leaf END AS seen, row_number() OVER (PARTITION BY s ORDER BY h.doc_id NULLS FIRST, leaf) - 1 AS r
  FROM h JOIN crc ON coalesce(h.doc_id::VARCHAR, '') = txt
), lev(s, k, w, d) AS (
  SELECT s, 0, 1::BIGINT, list(leaf ORDER BY r) FROM l GROUP BY s
  UNION ALL SELECT s, k + 1, 3 * w, list_transform(range(0, (len(d) + 2) // 3), lambda i: sha256(array_to_string(d[3 * i + 1 : 3 * i + 3], ''))) FROM lev WHERE len(d) > 1
), sub AS (
  SELECT s, d[1] AS subroot FROM lev WHERE len(d) = 1
), top(k, w, d) AS (
  SELECT 0, 1::BIGINT, list(subroot ORDER BY s) FROM sub
  UNION ALL SELECT k + 1, 3 * w, list_transform(range(0, (len(d) + 2) // 3), lambda i: sha256(array_to_string(d[3 * i + 1 : 3 * i + 3], ''))) FROM top WHERE len(d) > 1
), spots AS (
  SELECT l.s, l.r, k, l.r // w AS i, d FROM l JOIN lev USING (s) WHERE len(d) > 1
  UNION ALL SELECT l.s, l.r, 1000 + k, l.s // w, d FROM l, top WHERE len(d) > 1
), steps AS (
  SELECT s, r, row_number() OVER (PARTITION BY s, r ORDER BY k) AS n, array_to_string(d[i // 3 * 3 + 1 : i], '') AS before, array_to_string(d[i + 2 : i // 3 * 3 + 3], '') AS after FROM spots
), fold(s, r, n, acc) AS (
  SELECT s, r, 0, seen FROM l
  UNION ALL SELECT fold.s, fold.r, fold.n + 1, sha256(before || acc || after) FROM fold JOIN steps ON fold.s = steps.s AND fold.r = steps.r AND steps.n = fold.n + 1
), proof AS (
  SELECT s, r, sha256(string_agg(before || after, '' ORDER BY n)) AS proof_sha256 FROM steps GROUP BY s, r
)
SELECT l.doc_id, leaf, subroot, (SELECT d[1] FROM top WHERE len(d) = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  arg_max(acc, fold.n) AS folded_root, arg_max(acc, fold.n) = (SELECT d[1] FROM top WHERE len(d) = 1) AS verified
FROM l JOIN sub USING (s) JOIN fold ON fold.s = l.s AND fold.r = l.r LEFT JOIN proof ON proof.s = l.s AND proof.r = l.r
GROUP BY ALL
"""
)

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS u(i) WHERE doc_id IS NOT NULL
), hit AS (
  SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT rid, i + k AS j FROM hit, range(50) AS t(k)
), lists AS (
  SELECT rid, list(j) AS g FROM gone GROUP BY rid
), kept AS (
  SELECT d.rid, string_agg(w[j], ' ' ORDER BY j) AS kept FROM d, unnest(range(1, len(w) + 1)) AS u(j) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = d.rid AND gone.j = u.j) GROUP BY d.rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (rid) LEFT JOIN kept USING (rid)
"""

OP13_SQL = (
    r"""
WITH RECURSIVE keys AS (
  SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS txt FROM conversations
), """
    + CRC_SQL
    + r""", hit AS (
  SELECT conv_id, turn, value % 20 AS k, CASE WHEN value % 20 = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE value % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM conversations JOIN crc ON txt = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')
), ids AS (
  SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), r AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS p,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
  FROM hit JOIN ids ON hit.conv_id IS NOT DISTINCT FROM ids.conv_id, range(2) AS t(x) WHERE k <> 0 AND (x = 0 OR k = 3)
), f AS (
  SELECT *, role[1] AS ini, lag(role[1]) OVER (PARTITION BY c ORDER BY p) || role[1] AS pair,
    CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY p) > 1 THEN 'duplicate'
      WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c
), steps(c, p, q) AS (  -- q: for each state cost, audit and text, inserts included
  SELECT c, 0, [{'k': 0, 'a': '', 't': ''}, {'k': 99999999, 'a': '', 't': ''}, {'k': 5, 'a': 'I', 't': chr(10) || 'user:'}, {'k': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}] FROM ids
  UNION ALL
  SELECT c, p, list_concat(z[1:2], [
    list_sort([z[3], {'k': z[1].k + 5, 'a': z[1].a || 'I', 't': z[1].t || chr(10) || 'user:'}, {'k': z[2].k + 5, 'a': z[2].a || 'I', 't': z[2].t || chr(10) || 'user:'}, {'k': z[4].k + 5, 'a': z[4].a || 'I', 't': z[4].t || chr(10) || 'user:'}])[1],
    list_sort([z[4], {'k': z[3].k + 5, 'a': z[3].a || 'I', 't': z[3].t || chr(10) || 'assistant:'}, {'k': z[1].k + 10, 'a': z[1].a || 'II', 't': z[1].t || chr(10) || 'user:' || chr(10) || 'assistant:'},
      {'k': z[2].k + 10, 'a': z[2].a || 'II', 't': z[2].t || chr(10) || 'user:' || chr(10) || 'assistant:'}])[1]])
  FROM (
    SELECT c, p, CASE WHEN gone THEN list_transform(q, lambda s: {'k': s.k + 2, 'a': s.a || 'D', 't': s.t}) ELSE [
      {'k': q[1].k + 2, 'a': q[1].a || 'D', 't': q[1].t},
      list_sort([{'k': q[2].k + 2, 'a': q[2].a || 'D', 't': q[2].t}, {'k': q[1].k + m + CASE WHEN ini = 's' THEN 0 ELSE 99999999 END, 'a': q[1].a || 'K', 't': q[1].t || chr(10) || role || ':' || text}])[1],
      list_sort(list_concat([{'k': q[3].k + 2, 'a': q[3].a || 'D', 't': q[3].t}], list_transform([q[1], q[2], q[4]], lambda s: CASE WHEN ini = 'u' THEN {'k': s.k + m, 'a': s.a || 'K', 't': s.t || chr(10) || role || ':' || text}
        ELSE {'k': s.k + m + 1, 'a': s.a || 'R', 't': s.t || chr(10) || 'user:' || text} END)))[1],
      list_sort([{'k': q[4].k + 2, 'a': q[4].a || 'D', 't': q[4].t}, CASE WHEN ini = 'a' THEN {'k': q[3].k + m, 'a': q[3].a || 'K', 't': q[3].t || chr(10) || role || ':' || text}
        ELSE {'k': q[3].k + m + 1, 'a': q[3].a || 'R', 't': q[3].t || chr(10) || 'assistant:' || text} END])[1]] END AS z
    FROM (SELECT steps.c, f.p, q, role, text, ini, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS m FROM steps JOIN f ON f.c = steps.c AND f.p = steps.p + 1)
  )
), best AS (
  SELECT c, list_sort([arg_max(q, p)[1], arg_max(q, p)[4]])[1] AS b FROM steps GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.k::BIGINT AS cost, b.a AS audit, sha256(b.t[2:]) AS repaired_sha256
FROM ids LEFT JOIN counts USING (c) JOIN best USING (c)
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_jaccard_join, op2_lm_scoring, op3_quality_rules, op4_packing, op5_pii, op6_toxicity, op7_url_filters, op8_nearest_neighbours, op9_line_dedup, op10_sentencepiece, op11_merkle_manifest, op12_substring_dedup, op13_conversation_repair, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op9_line_dedup": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_conversation_repair": OP13_SQL}
