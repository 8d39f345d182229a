"""Queries of the engine's operators bound to the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import ledger, models, preference, sampling, scoring, similarity
from ..sources.tables import spread

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUOTA_SQL = """
  SELECT k, n, floor(x)::BIGINT + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, k) <= least({target}, total) - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota
  FROM (SELECT k, n, sum(n) OVER () AS total, least({target}, sum(n) OVER ())::DOUBLE * n / sum(n) OVER () AS x FROM ({sizes}))
"""


@query(f"""
WITH d AS (SELECT doc_id, lang || '/' || source AS stratum, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)),
q AS ({QUOTA_SQL.format(target=100, sizes="SELECT stratum AS k, count(*) AS n FROM d GROUP BY stratum")}),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('sample:' || doc_id), doc_id) AS rn FROM d)
SELECT doc_id, stratum, n_chars, quality FROM r JOIN q ON k = stratum WHERE rn <= quota
""")
def stratified_exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("stratum"), "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return sampling.stratified(joined, "stratum", "doc_id", 100, "sample").select("doc_id", "stratum", "n_chars", "quality")


@query(f"SELECT k AS o_orderpriority, n, quota FROM ({QUOTA_SQL.format(target=1000, sizes='SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1')})")
def apportion_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return sampling.apportion(sizes, "o_orderpriority", "n", 1000)


@query("""
SELECT reason, count(*) AS n FROM (
  SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END,
    CASE WHEN quality IS NULL THEN 'no_label' END, CASE WHEN regexp_matches(lower(text), 'password|secret') THEN 'banned_term' END], lambda x: x IS NOT NULL)) AS reason
  FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY reason
""")
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("n_chars") < 500, "short"), F.when(F.col("n_chars") > 5000, "long"), F.when(F.col("quality").isNull(), "no_label"), F.when(F.lower("text").rlike("password|secret"), "banned_term"),
    ))
    return scoring.reason_counts(docs.select(reasons.alias("reasons")), "reasons")


#: Item n-grams that are broadcast: some 100 bytes each.
MAX_BROADCAST_GRAMS = 1 << 19
NGRAM_SQL = "SELECT DISTINCT {key}, unnest(CASE WHEN len(t) < 6 THEN [] ELSE list_transform(range(1, len(t) - 4), lambda i: array_to_string(t[i:i+5], ' ')) END) AS g FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM {table})"


@query(f"""
WITH d AS ({NGRAM_SQL.format(key="doc_id", table="documents")}), b AS ({NGRAM_SQL.format(key="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS size FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, round(count(*)::DOUBLE / size, 6) AS containment FROM d JOIN b USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, size HAVING count(*) >= 0.12 * size
""")
def ngram_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows are 64-bit hashes until one is found; only the texts of hits become n-grams."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", T.token_ngrams(F.col("text"), 6).alias("gs"))
    grams = items.select("item_id", F.size("gs").alias("size"), F.explode("gs").alias("g"))
    hashes = table(spark, sf_dir, "benchmark").select(F.explode(T.window_hashes(F.col("text"), 6)).alias("h")).distinct()
    # with few items only hits are shuffled; with many, both sides are
    if grams.count() <= MAX_BROADCAST_GRAMS:
        grams, hashes = F.broadcast(grams), F.broadcast(hashes)
    hits = docs.select("doc_id", F.explode(T.window_hashes(F.col("text"), 6)).alias("h")).join(hashes, "h", "left_semi").select("doc_id").distinct()
    found = docs.join(hits, "doc_id").select("doc_id", F.explode(T.token_ngrams(F.col("text"), 6)).alias("g"))
    pairs = found.join(grams, "g").groupBy("doc_id", "item_id", "size").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.where(F.col("shared") >= 0.12 * F.col("size")).select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("size"), 6).alias("containment"))


FAMILIES = [("metal", "ring|bolt|gear"), ("colour", "red|blue|green"), ("small", "small|tiny")]


@query("""
SELECT p_partkey, CASE WHEN len(f) > 0 THEN array_to_string(f, ' > ') ELSE 'general' END AS families,
  CASE WHEN regexp_matches(lower(p_name), 'widget') THEN 'widgets' WHEN regexp_matches(lower(p_name), 'bolt') THEN 'bolts' ELSE 'other' END AS domain
FROM (SELECT *, list_filter([CASE WHEN regexp_matches(lower(p_name), 'ring|bolt|gear') THEN 'metal' END, CASE WHEN regexp_matches(lower(p_name), 'red|blue|green') THEN 'colour' END,
  CASE WHEN regexp_matches(lower(p_name), 'small|tiny') THEN 'small' END], lambda x: x IS NOT NULL) AS f FROM part)
""")
def profile_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.tag_families(name, FAMILIES, "general"), " > ").alias("families"), T.first_match(name, [("widgets", "widget"), ("bolts", "bolt")], "other").alias("domain"))


@query("""
SELECT doc_id, n_chars, CASE WHEN 3 * r < n - 1 THEN 'short' WHEN 3 * r < 2 * (n - 1) THEN 'medium' ELSE 'long' END AS tercile
FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
""")
def length_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.terciles(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "n_chars", "tercile")


@query("""
SELECT bin, count(*) AS n, round(avg(l_discount), 6) AS mean_discount FROM (
  SELECT l_discount, CASE WHEN l_quantity >= 0 AND l_quantity <= 10 THEN '(0, 10]' WHEN l_quantity > 10 AND l_quantity <= 25 THEN '(10, 25]' WHEN l_quantity > 25 AND l_quantity <= 40 THEN '(25, 40]' ELSE 'nan' END AS bin FROM lineitem)
GROUP BY bin
""")
def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_discount", T.fixed_bin(F.col("l_quantity"), [0, 10, 25, 40]).alias("bin"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' [fact] [case] [entity]', '[$€£] ?[0-9][0-9,.]*', '[amount]', 'g'), '[0-9]+(\.[0-9]+)? ?%', '[percent]', 'g'), '[0-9]{3,}', '[number]', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'), '^ | $', '', 'g')) AS clean FROM documents
""")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the SQL engine sees other word borders beside letters with accents, so its long numbers have none
    patterns = (*T.PLACEHOLDERS[:4], (r"[0-9]{3,}", "[number]"))
    text = F.concat("text", F.lit(" F12 case-7 Acme"))
    return table(spark, sf_dir, "documents").select("doc_id", T.sanitize(text, ["acme"], patterns).alias("clean"))


@query(r"""
SELECT doc_id, len(w) AS words, array_to_string(w[1:180], ' ')[1:1800] AS cut, array_to_string(w, ' ') <> rtrim(array_to_string(w[1:180], ' ')[1:1800]) AS truncated,
  CASE WHEN length(text) <= 400 THEN text ELSE text[1:294] || chr(10) || '[...]' || chr(10) || right(text, 99) END AS head_tail
FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS w FROM documents)
""".replace("array_to_string(w[1:180], ' ')[1:1800] AS cut", "rtrim(array_to_string(w[1:180], ' ')[1:1800]) AS cut"))
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(t).cast("long").alias("words"), T.truncate_words(t).alias("c"), T.head_tail(t, 400).alias("head_tail")).select("doc_id", "words", F.col("c.text").alias("cut"), F.col("c.truncated").alias("truncated"), "head_tail")


@query("SELECT o_orderkey, sha256(to_json([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority])::VARCHAR) AS run_hash FROM orders")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.run_hash(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").select("o_orderkey", "run_hash")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return ledger.latest(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def plan_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return ledger.planned(table(spark, sf_dir, "events").select("event_id", "user_id"), plan, "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "ok").otherwise("error").alias("status"))
    return ledger.pending(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("""
SELECT c_custkey, condition, sample_index, 7 + sample_index AS seed FROM customer, (VALUES ('direct'), ('structured'), ('adaptive')) v(condition), (SELECT range::INT AS sample_index FROM range(4))
""")
def job_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.expand_jobs(table(spark, sf_dir, "customer").select("c_custkey"), ["direct", "structured", "adaptive"], 4, 7)


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_custkey) - 1) % 16 AS shard FROM orders")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.shards(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 16).select("o_orderkey", "shard")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule-based predictors of quality."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", "lang", "quality", (F.col("n_chars") > 800).cast("int").alias("pred"), (~F.col("text").contains(" | ")).cast("int").alias("pred2"))


PREDICTIONS_SQL = "SELECT doc_id, lang, quality, (n_chars > 800)::INT AS pred, (NOT contains(text, ' | '))::INT AS pred2 FROM documents JOIN labels USING (doc_id)"


@query(f"SELECT lang, count(*) AS n, round(avg(quality), 9) AS mean_quality, round(avg(pred), 9) AS mean_pred FROM ({PREDICTIONS_SQL}) GROUP BY lang")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.group_means(predictions(spark, sf_dir), ["lang"], ["quality", "pred"])
    return out.select("lang", "n", F.round("mean_quality", 9).alias("mean_quality"), F.round("mean_pred", 9).alias("mean_pred"))


@query(f"""
WITH p AS ({PREDICTIONS_SQL}), c AS (
  SELECT label, count(*) FILTER (WHERE quality = label AND pred = label) AS tp, count(*) FILTER (WHERE quality = label) AS g, count(*) FILTER (WHERE pred = label) AS q FROM p, (VALUES (0), (1)) v(label) GROUP BY label)
SELECT round(sum(f * g) / sum(g), 9) AS weighted_f1, round(avg(f), 9) AS macro_f1 FROM (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(g + q, 0), 0) AS f FROM c)
""")
def f1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.f1(predictions(spark, sf_dir), "quality", "pred", [0, 1]).select(F.round("weighted_f1", 9).alias("weighted_f1"), F.round("macro_f1", 9).alias("macro_f1"))


@query(f"""
SELECT g.label AS gold, h.label AS pred, count(quality) AS n FROM (VALUES (0::BIGINT), (1::BIGINT)) g(label) CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) h(label)
LEFT JOIN ({PREDICTIONS_SQL}) p ON p.quality = g.label AND p.pred = h.label GROUP BY g.label, h.label
""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(predictions(spark, sf_dir), "quality", "pred", [0, 1])


@query(f"""
SELECT sum(n)::BIGINT AS n, round(sum(ok) / sum(n), 9) AS accuracy, round(avg(ok / n), 9) AS balanced_accuracy, round(max(n) / sum(n), 9) AS majority_accuracy
FROM (SELECT quality, count(*) AS n, count(*) FILTER (WHERE quality = pred) AS ok FROM ({PREDICTIONS_SQL}) GROUP BY quality)
""")
def majority_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.accuracy_report(predictions(spark, sf_dir), "quality", "pred")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "majority_accuracy")])


def correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("doc_id", "lang", (F.col("quality") == F.col("pred")).alias("a"), (F.col("quality") == F.col("pred2")).alias("b"))


@query(f"""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS left_only, count(*) FILTER (WHERE b AND NOT a) AS right_only FROM (SELECT quality = pred AS a, quality = pred2 AS b FROM ({PREDICTIONS_SQL}))),
m AS (SELECT *, left_only + right_only AS d, least(left_only, right_only) AS k FROM c)
SELECT n, "both", left_only, right_only, n - "both" - left_only - right_only AS neither, round((right_only - left_only) / n, 9) AS delta,
  round(CASE WHEN d = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(d + 1) - lgamma(i + 1) - lgamma(d - i + 1) - d * ln(2))))) END, 9) AS p FROM m
""")
def paired_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.paired(correctness(spark, sf_dir), "a", "b")
    return out.withColumns({"delta": F.round("delta", 9), "p": F.round("p", 9)})


@query(f"SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'left_only' WHEN b THEN 'right_only' ELSE 'neither' END AS bucket, count(*) AS n FROM (SELECT quality = pred AS a, quality = pred2 AS b FROM ({PREDICTIONS_SQL})) GROUP BY 1")
def outcome_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.outcome_buckets(correctness(spark, sf_dir), "a", "b")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bootstrap_ci(correctness(spark, sf_dir).select("lang", F.col("a").cast("double").alias("a")), "lang", "a")


@query("""
WITH a AS (SELECT lang, count(*) AS n_population FROM documents GROUP BY lang), b AS (SELECT lang, count(*) AS n_selected FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY lang)
SELECT lang, n_population, coalesce(n_selected, 0) AS n_selected, round(n_population / sum(n_population) OVER (), 9) AS share_population, round(coalesce(n_selected, 0) / sum(coalesce(n_selected, 0)) OVER (), 9) AS share_selected FROM a LEFT JOIN b USING (lang)
""")
def distribution_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = scoring.distribution(docs, docs.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_semi"), "lang")
    return out.select("lang", "n_population", "n_selected", F.round("share_population", 9).alias("share_population"), F.round("share_selected", 9).alias("share_selected"))


@query("""
SELECT word, count(DISTINCT conv_id) AS uses, round(avg(good), 9) AS accuracy FROM (
  SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word, n > 4 AS g, (n > 4)::INT AS good
  FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) USING (conv_id)) GROUP BY word HAVING count(DISTINCT conv_id) >= 8
""")
def template_use_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    size = turns.groupBy("conv_id").agg((F.count(F.lit(1)) > 4).cast("int").alias("good"))
    words = turns.select("conv_id", F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.join(size, "conv_id").groupBy("word").agg(F.count(F.lit(1)).alias("uses"), F.round(F.avg("good"), 9).alias("accuracy")).where("uses >= 8")


@query("""
WITH p AS (SELECT a.event_id, a.event_type AS t1, b.event_type AS t2, a.user_id AS u1, b.user_id AS u2, NULLIF(a.value > 20, false) AS v1, NULLIF(b.value > 20, false) AS v2 FROM events a JOIN events b ON b.event_id = a.event_id + 1)
SELECT 'event_type' AS field, count(*) FILTER (WHERE t1 = t2) AS equal, count(*) FILTER (WHERE t1 <> t2) AS different, count(*) FILTER (WHERE t1 IS NULL OR t2 IS NULL) AS missing FROM p
UNION ALL SELECT 'user_id', count(*) FILTER (WHERE u1 = u2), count(*) FILTER (WHERE u1 <> u2), count(*) FILTER (WHERE u1 IS NULL OR u2 IS NULL) FROM p
UNION ALL SELECT 'high', count(*) FILTER (WHERE v1 = v2), count(*) FILTER (WHERE v1 <> v2), count(*) FILTER (WHERE v1 IS NULL OR v2 IS NULL) FROM p
""")
def control_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", "user_id", F.when(F.col("value") > 20, True).alias("high")).alias("r"))
    pairs = rows.select("event_id", F.col("r").alias("a")).join(rows.select((F.col("event_id") - 1).alias("event_id"), F.col("r").alias("b")), "event_id")
    return preference.control_audit(pairs, "a", "b", ["event_type", "user_id", "high"])


COSINE_SQL = "round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6)"
VECTORS_SQL = "SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings"


@query(f"""
WITH v AS ({VECTORS_SQL}), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM s) SELECT query, neighbour, rank, round(score, 6) AS score FROM r WHERE rank <= 3
""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return similarity.dense_topk(vectors, vectors, 3, "vec_id", "embedding").select("query", "neighbour", "rank", F.round("score", 6).alias("score"))


@query(f"""
WITH v AS ({VECTORS_SQL}), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, a.label = b.label AS same, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY same::INT DESC, rank) AS final_rank FROM r WHERE rank <= 10) SELECT query, neighbour, final_rank FROM f WHERE final_rank <= 2
""")
def rerank_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = similarity.dense_topk(vectors, vectors, 10, "vec_id", "embedding")
    label = lambda name, out: vectors.select(F.col("vec_id").alias(name), F.col("label").alias(out))
    scored = found.join(label("query", "a"), "query").join(label("neighbour", "b"), "neighbour").withColumn("second", (F.col("a") == F.col("b")).cast("int"))
    return similarity.rerank(scored, "second", 2).select("query", "neighbour", "final_rank")


@query(f"SELECT a.vec_id AS query, b.vec_id AS neighbour, {COSINE_SQL} AS score, {COSINE_SQL} >= 0.95 AS severe FROM ({VECTORS_SQL}) a JOIN ({VECTORS_SQL}) b ON a.vec_id < b.vec_id AND {COSINE_SQL.replace(', 6)', ', 9)')} >= 0.9")
def near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    pairs = similarity.dense_topk(vectors, vectors, 0, "vec_id", "embedding", threshold=0.9).where("query < neighbour")
    return pairs.select("query", "neighbour", F.round("score", 6).alias("score"), (F.round("score", 6) >= 0.95).alias("severe"))


SHIFTED_SQL = f"SELECT vec_id, e FROM ({VECTORS_SQL}) UNION ALL SELECT vec_id + 1000000, list_transform(e, lambda x, i: CASE WHEN i = 1 THEN x + (vec_id % 7) * 0.125::DOUBLE ELSE x END) FROM ({VECTORS_SQL})"


@query(f"SELECT a.vec_id AS query, b.vec_id AS neighbour, {COSINE_SQL} AS score, {COSINE_SQL} >= 0.95 AS severe FROM ({SHIFTED_SQL}) a JOIN ({SHIFTED_SQL}) b ON a.vec_id < b.vec_id AND {COSINE_SQL.replace(', 6)', ', 9)')} >= 0.9")
def near_duplicate_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and copies of them that are moved by a known amount, so that there are pairs on both sides of the thresholds."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    moved = rows.select(F.col("vec_id") + 1000000, F.transform("e", lambda x, i: F.when(i == 0, x + (F.col("vec_id") % 7) * 0.125).otherwise(x)))
    both = rows.unionAll(moved)
    pairs = similarity.dense_topk(both, both, 0, "vec_id", "e", threshold=0.9).where("query < neighbour")
    return pairs.select("query", "neighbour", F.round("score", 6).alias("score"), (F.round("score", 6) >= 0.95).alias("severe"))


@query(f"""
WITH x AS (SELECT label, vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM ({VECTORS_SQL})), c AS (SELECT label, d, avg(x) AS c FROM x GROUP BY label, d),
s AS (SELECT label, vec_id, sum(x * c) / sqrt(sum(x * x) * sum(c * c)) AS cos FROM x JOIN c USING (label, d) GROUP BY label, vec_id)
SELECT label, count(*) AS n, round(avg(cos), 6) AS mean_cos, round(min(cos), 6) AS min_cos FROM s GROUP BY label
""")
def centroid_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.centroid_coherence(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", "n", F.round("mean_cos", 6).alias("mean_cos"), F.round("min_cos", 6).alias("min_cos"))


@query("""
WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM benchmark))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), w AS (SELECT item_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
u AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM w)
SELECT a.item_id AS query, b.item_id AS neighbour, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b USING (term) WHERE a.item_id < b.item_id GROUP BY ALL
""")
def tfidf_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = similarity.tfidf(table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("terms")), "item_id", "terms")
    return similarity.sparse_cosine(weights, weights, "item_id", "item_id").where("query < neighbour").select("query", "neighbour", F.round("score", 6).alias("score"))


@query("""
WITH n AS (SELECT n_nationkey AS step, unnest(list_distinct(string_split(lower(n_name), '_'))) AS tag FROM nation), r AS (SELECT r_regionkey AS item, lower(r_name) AS tag FROM region)
SELECT step, item, count(*) AS n_shared FROM (SELECT n_nationkey AS step, unnest(list_distinct([lower(n_name), (SELECT lower(r_name) FROM region WHERE r_regionkey = n_regionkey)])) AS tag FROM nation) JOIN r USING (tag) GROUP BY ALL
""")
def tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region")
    steps = table(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array("n_name", "r_name").alias("tags"))
    return similarity.tag_overlap(steps, regions.select("r_regionkey", F.array("r_name").alias("tags")), "n_nationkey", "r_regionkey", "tags")


@query()
def cascade_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of benchmark items, named by nations, regions or parts, against all nations and regions as items, so that every branch decides some."""
    items = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("item"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("w"), F.col("n_nationkey") % 9), F.concat(F.lit("only"), F.col("n_nationkey"))).alias("tags"))
    items = items.unionAll(items.where("item % 5 = 0").select(F.col("item") + 100, "name", F.array(F.lit("again"))))
    items = items.select("item", "name", "tags", F.col("item").alias("position"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    text = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("step"), T.tokens(F.col("text")).alias("tokens"), (F.col("item_id") % 25).alias("n_nationkey"))
    name = F.when(F.col("step") % 3 == 0, F.col("n_name")).otherwise("none of these")
    own = F.when(F.col("step") % 3 == 1, F.array(F.concat(F.lit("only"), F.col("n_nationkey")))).when(F.col("step") % 3 == 2, F.array(F.concat(F.lit("w"), F.col("step") % 12))).otherwise(F.array().cast("array<string>"))
    steps = text.join(nations, "n_nationkey").select("step", name.alias("name"), F.concat("tokens", own).alias("tags"))
    a = similarity.tfidf(steps.select("step", F.concat("tags", T.tokens(F.col("name"))).alias("terms")), "step", "terms")
    b = similarity.tfidf(items.select("item", F.concat("tags", T.tokens(F.col("name"))).alias("terms")), "item", "terms")
    scores = similarity.sparse_cosine(a, b, "step", "item").select(F.col("query").alias("step"), F.col("neighbour").alias("item"), "score")
    return similarity.cascade(steps, items, scores)


@query("""
WITH c AS (SELECT l_orderkey AS anchor, l_linenumber AS candidate, any_value(l_partkey) AS t, max(l_discount) AS s, min(l_suppkey) AS st, avg((l_returnflag = 'R')::DOUBLE) AS reward FROM lineitem GROUP BY ALL),
n AS (SELECT anchor, count(*) AS n FROM c GROUP BY anchor HAVING count(*) = 4),
r AS (SELECT c.*, row_number() OVER (PARTITION BY anchor ORDER BY reward DESC, s DESC, st, candidate) AS best, row_number() OVER (PARTITION BY anchor ORDER BY reward, s, st DESC, candidate DESC) AS worst FROM c JOIN n USING (anchor))
SELECT a.anchor, a.candidate AS chosen, b.candidate AS rejected, a.reward - b.reward AS gap FROM r a JOIN r b ON a.anchor = b.anchor AND a.best = 1 AND b.worst = 1 WHERE a.reward > b.reward
""")
def best_worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("anchor"), F.col("l_linenumber").alias("candidate"), "l_discount", "l_suppkey", "l_returnflag")
    lines = spread(lines, "anchor", "candidate")
    each = lines.groupBy("anchor", "candidate").agg(F.max("l_discount").alias("similarity"), F.min("l_suppkey").alias("steps"))
    candidates = each.select("anchor", "candidate", F.concat_ws("/", "anchor", "candidate").alias("text"), "similarity", "steps", F.col("candidate").alias("sample"))
    evaluations = lines.select("anchor", "candidate", F.lit("returned").alias("target"), (F.col("l_returnflag") == "R").alias("correct"))
    return preference.best_worst(candidates, evaluations, 4, 1)


@query("""
SELECT doc_id, source, rn AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('rr:' || doc_id), doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 150
""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 150, "rr").select("doc_id", "source", F.col("turn"))


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM documents)
WHERE m <= 5 OR list_contains(list_transform(range(5), lambda k: round_even(k * (m - 1) / 4.0, 0)::INT), i::INT)
""")
def even_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.even_examples(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 5)


@query("SELECT c_name, coalesce(try_cast(nullif(regexp_extract(c_name, '([0-9]+)$', 1), '') AS BIGINT), 1000000000000000000) AS place FROM customer")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_name", T.trailing_number(F.col("c_name")).alias("place")).orderBy("place", "c_name")


@query("SELECT c_custkey, c_name, place, row_number() OVER (ORDER BY place, c_name, c_custkey) AS rank FROM (SELECT c_custkey, c_name, coalesce(try_cast(nullif(regexp_extract(c_name, '([0-9]+)$', 1), '') AS BIGINT), 1000000000000000000) AS place FROM customer) ORDER BY rank")
def natural_sort_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name", T.trailing_number(F.col("c_name")).alias("place"))
    return sampling.ranked(names, ["place", "c_name", "c_custkey"], "rank").orderBy("rank")


@query("SELECT p_brand, 'duplicate id' AS problem FROM part GROUP BY p_brand HAVING count(*) > 1 UNION ALL SELECT p_brand, 'tags below 3' FROM part WHERE len(string_split(p_name, ' ')) < 3")
def pool_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.violations(table(spark, sf_dir, "part").select("p_brand", F.split("p_name", " ").alias("tags")), "p_brand", tags=3)


@query("SELECT s_suppkey, format('LF{:03d}', row_number() OVER (ORDER BY s_name, s_suppkey)) AS new_id FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def renumber_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "supplier")
    return preference.renumber(pool, ["s_name", "s_suppkey"], pool.where("s_acctbal < 0"), "s_suppkey", "LF").select("s_suppkey", "new_id")


@query("""
SELECT r_name AS key, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_children, (SELECT coalesce(string_agg(n_name, ',' ORDER BY n_name), '') FROM nation WHERE n_regionkey = r_regionkey) AS children FROM region
UNION ALL SELECT n_name, 0, '' FROM nation
""")
def parent_child_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = regions.select(F.col("r_name").alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("value")).unionAll(nations.select("n_name", "r_name", "n_name"))
    return preference.rollup_children(nodes, "key", "parent", "value").withColumn("children", F.array_join("children", ","))


@query("SELECT doc_id, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'train' WHEN rn <= round_even(n * 0.7, 0) THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('split:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_by_shares(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", [("train", 0.2), ("dev", 0.5), ("test", 0.3)], "split", "lang").select("doc_id", "split")


@query("SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY sha256('bal:' || doc_id), doc_id) AS rn FROM labels) WHERE rn <= 30")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 30, "bal").select("quality", "doc_id")


@query()
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.pack(sampling.batches(docs, "lang", "doc_id", "n_chars", 16 * 200_000), "batch", "doc_id", "n_chars", 200_000)


@query()
def kmeans_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.kmeans(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query()
def bisecting_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.kmeans(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, bisecting=True)


@query()
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = ledger.expand_jobs(table(spark, sf_dir, "benchmark"), ["direct", "structured"], 2, 11).withColumn("prompt", F.concat_ws(": ", "condition", "text"))
    jobs = ledger.run_hash(jobs, "item_id", "condition", "sample_index")
    return models.generate(jobs, "run_hash", "prompt", "seed")


@query("SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+')[1:2] IS NOT NULL AS ok FROM benchmark")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = models.embed(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return vectors.select("item_id", (V.norm(F.col("vector")) > 0).alias("ok"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_totalprice) AS lowest, median(o_totalprice) AS middle, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS highest FROM orders GROUP BY ALL")
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min(price).alias("lowest"), F.median(price).alias("middle"), F.round(F.avg(price), 4).alias("mean"), F.max(price).alias("highest"))


@query("SELECT nullif(regexp_extract(props, '\"k\": ([0-9]+)', 1), '')::BIGINT // 10 AS decade, count(*) AS n FROM events GROUP BY 1")
def json_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(F.floor(k / 10).cast("long").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, 'F' || row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS fact_id, fact FROM (SELECT conv_id, turn, generate_subscripts(l, 1) AS i, trim(unnest(l), ' -*' || chr(9)) AS fact FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)) WHERE fact <> '' AND lower(fact) <> 'facts:'")
def split_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.split_facts(F.col("text"))).alias("f")).select("conv_id", "turn", F.col("f.fact_id").alias("fact_id"), F.col("f.text").alias("fact"))


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def coverage_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").intersect(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT source, quality, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, source) AS rank FROM (SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source, quality)) WHERE rank <= 5")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source", "quality").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("quality").orderBy(F.desc("n"), "source"))).where("rank <= 5")
