"""Queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat_format, collocations, decontaminate, filter_audit, line_dedup, mixing, order_minhash, quality_crf, rules, secrets, simhash, suffix_dedup, xent
from .common import table

QUERIES = {}
ORACLE_SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.quality_scores(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op3_decontaminate"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x80-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents
), v AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x80-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM benchmark
), m AS (
  SELECT DISTINCT least(len(w), 5) AS m FROM v WHERE len(w) > 0
), ds AS (
  SELECT DISTINCT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))) AS s FROM w, m WHERE len(w) >= m
), bs AS (
  SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))) AS s FROM (SELECT item_id, w, least(len(w), 5) AS m FROM v WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*)::DOUBLE / n AS containment
FROM ds JOIN bs USING (m, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
"""


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_digest(table(spark, sf_dir, "documents"))


ORACLE_SQL["op5_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, n, line, lower_ascii AS k FROM (
    SELECT doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents))
), f AS (
  SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (SELECT doc_id, n, line, last IS NOT NULL AND last <> doc_id AS dropped FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


@query
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_xent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xent.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    turns = turns.unionAll(probe).withColumn("parts", chat_format.text_part(F.col("text")))
    return chat_format.digest(chat_format.format_conversations(turns))


ORACLE_SQL["op2_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|\||/?INST\])', '\1\2\\\3', 'g') AS er, regexp_replace(text, '([<\[])(\\*)(/?s>|\||/?INST\])', '\1\2\\\3', 'g') AS et FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, et)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + length('<s>[INST]') + length('[/INST]') + length('</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p
), g AS (SELECT lang, m, array_to_string(w[i:i+m-1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(m) WHERE len(w) >= m)
), f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 10
), halves AS (SELECT *, array_to_string(w[:k], ' ') AS first, array_to_string(w[k+1:], ' ') AS second FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), cuts AS (
  SELECT h.lang, h.phrase, h.a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * h.a * h.a) // (l.f::HUGEINT * r.f) AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.phrase = h.first JOIN f r ON r.lang = h.lang AND r.phrase = h.second
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ext AS (SELECT lang, sub, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[:m-1], ' '), array_to_string(w[2:], ' ')]) AS sub FROM c WHERE m = 3) GROUP BY lang, sub
), kept AS (SELECT best.* FROM best LEFT JOIN ext ON ext.lang = best.lang AND ext.sub = best.phrase WHERE most IS NULL OR 100 * most < 50 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op13_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t
), m AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS s
  FROM w LEFT JOIN m USING (doc_id)
), d AS (
  SELECT part, CASE WHEN s.A THEN 'A' ELSE '' END || CASE WHEN s.B THEN 'B' ELSE '' END || CASE WHEN s.C THEN 'C' ELSE '' END || CASE WHEN s.D THEN 'D' ELSE '' END || CASE WHEN s.E THEN 'E' ELSE '' END AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (SELECT o AS filter_order, step, o[step] AS own, string_split(o[:step-1], '') AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), x AS (
  SELECT part, filter_order, step::INT AS step, own, n, good, toxic, contains(fails, own) AS hit, fails = own AS lone, len(list_intersect(before, string_split(fails, ''))) > 0 AND len(fails) > 0 AND step > 1 AS gone FROM d, s
), y AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE lone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM y
"""
