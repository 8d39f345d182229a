"""More queries: repair of model output, batches and topics, trajectories, stores, replay and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair
from ..operators import clusters, exports, lineage, review, runs, sampling, store, topics, trajectory
from ..sources.tables import shared_folder
from .catalogue import query, table


@query("SELECT event_id, (props->>'k')::BIGINT AS k, event_type AS kind, event_id % 8 <> 0 AS repaired, event_id % 8 = 6 AS merged FROM events")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a JSON answer, intact or broken in one of seven ways."""
    member, kind = F.regexp_extract("props", r"^\{(.*)\}$", 1), F.col("event_type")
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    how = F.col("event_id") % 8
    text = F.when(how == 0, t("{", member, ', "kind": "', kind, '"}')).when(how == 1, t("{", member, ' "kind": "', kind, '"}')).when(how == 2, t("```json\n{", member, ', "kind": "', kind, '",}\n```'))
    text = text.when(how == 3, t("{", F.replace(member, F.lit('"'), F.lit("'")), ", kind: ", kind, "}")).when(how == 4, t("Answer: {", member, ', "kind": "', kind)).when(how == 5, t('{"kind": "', kind, '",, ', member, "} done"))
    text = text.when(how == 6, t("{", member, '},{"kind": "', kind, '"}')).otherwise(t("{“kind”: “", kind, "”, ", member, "]"))
    out = repair.with_object(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    get = lambda name: F.get_json_object("payload", f"$.{name}")
    return out.select("event_id", get("k").cast("long").alias("k"), get("kind").alias("kind"), F.col("payload_repaired").alias("repaired"), F.col("payload_merged").alias("merged"))


@query("""
SELECT o_orderkey, o_orderstatus AS decision,
  CASE o_orderkey % 5 WHEN 2 THEN 'No rationale supplied.' || chr(10) || 'Additional structured notes: {"clerk": "' || o_custkey || '"}' WHEN 4 THEN 'No rationale supplied.' ELSE o_orderpriority END AS rationale,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'schema_key_typo: final_decison -> final_decision|schema_key_typo: [final_rationale] -> final_rationale' WHEN 2 THEN 'missing_final_rationale_filled|direct_extra_fields_folded_into_final_rationale'
    WHEN 3 THEN 'obsolete_task_answer_removed' ELSE 'schema_metadata_removed: title|missing_final_rationale_filled|direct_extra_fields_removed' END AS actions FROM orders
""")
def answer_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a direct answer with one of five faults (or none)."""
    kind = F.col("o_orderkey") % 5
    member = lambda name, value: F.concat(F.lit(f'"{name}": "'), value, F.lit('"'))
    status, text = F.col("o_orderstatus"), F.col("o_orderpriority")
    body = F.when(kind == 0, F.concat_ws(", ", member("final_decision", status), member("final_rationale", text))).when(kind == 1, F.concat_ws(", ", member("final_decison", status), member("[final_rationale]", text)))
    body = body.when(kind == 2, F.concat_ws(", ", member("final_decision", status), member("clerk", F.col("o_custkey").cast("string")))).when(kind == 3, F.concat_ws(", ", member("task_answer", F.lit("x")), member("final_decision", status), member("final_rationale", text)))
    body = body.otherwise(F.concat_ws(", ", member("title", F.lit("t")), member("final_decision", status), member("note", F.lit(""))))
    out = repair.normalised_answers(table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("{"), body, F.lit("}")).alias("payload")), "o_orderkey", "payload")
    get = lambda name: F.get_json_object("text", f"$.{name}")
    return out.withColumn("text", repair.written(F.col("entries"))).select("o_orderkey", get("final_decision").alias("decision"), get("final_rationale").alias("rationale"), F.array_join("actions", "|").alias("actions"))


#: Least, wanted and highest number of members of a batch, as shares of a label's rows times 1,000.
BOUNDS = (60, 90, 120)


def bounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int, int]:
    rows = table(spark, sf_dir, "embeddings")
    n = rows.where("label is not null and embedding is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    return rows, *(max(1, n * share // 1000) for share in BOUNDS)


@query()
def semantic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches within the labels of embeddings: grouped k-means, then rebalancing."""
    rows, least, target, most = bounds(spark, sf_dir)
    out = clusters.family_batches(rows, "label", "vec_id", "embedding", least, target, most)
    return out.select(F.col("family").alias("label"), F.col("id").alias("vec_id"), "cluster")


@query("""
WITH n AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY label), b AS (SELECT greatest(1, max(n) * 60 // 1000) AS least, greatest(1, max(n) * 90 // 1000) AS target, greatest(1, max(n) * 120 // 1000) AS most FROM n)
SELECT label, n, CASE WHEN n <= most THEN 1 ELSE least(greatest(round_even(n / target, 0)::BIGINT, ceil(n / most)::BIGINT), n // least) END AS batches, true AS within FROM n, b
""")
def semantic_batch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and batches of each label, and whether every batch is within the bounds."""
    rows, least, target, most = bounds(spark, sf_dir)
    sizes = clusters.family_batches(rows, "label", "vec_id", "embedding", least, target, most).groupBy("family", "cluster").agg(F.count(F.lit(1)).alias("c"))
    whole = F.sum("c") <= most
    return sizes.groupBy(F.col("family").alias("label")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("batches"), (whole | ((F.min("c") >= least) & (F.max("c") <= most))).alias("within"))


@query("""
WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), x AS (SELECT label, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
c AS (SELECT label, d, sum(x) AS c FROM x GROUP BY label, d), s AS (SELECT x.label, vec_id, round(sum(x * c) / sqrt(sum(x * x) * sum(c * c)), 6) AS score FROM x JOIN c ON c.d = x.d AND c.label IS NOT DISTINCT FROM x.label GROUP BY x.label, vec_id)
SELECT label, vec_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def group_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.representatives(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 5)


@query()
def topic_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of all documents by their terms, with their sizes, top terms and representatives."""
    _, profile = topics.topic_families(table(spark, sf_dir, "documents"), "doc_id", "text", 6, components=24, max_features=4000)
    return profile.select("family", "n", F.array_join("top_terms", "|").alias("top_terms"), F.array_join("representatives", "|").alias("representatives"))


REGIONS = "(SELECT list(r_name ORDER BY r_regionkey) FROM region)"


@query(f"""
WITH c AS (SELECT c_custkey AS c, {REGIONS} AS r, 1 + c_custkey % 4 AS planned FROM customer),
k AS (SELECT *, list_filter(range(1, planned + 1), lambda k: (c + k) % 3 = 0 OR k = planned)[1] AS last FROM c), b AS (SELECT *, c % 50 = 7 AND last >= 2 AS fails FROM k)
SELECT c AS c_custkey, CASE WHEN fails THEN 'error' ELSE 'ok' END AS status, CASE WHEN NOT fails THEN CASE WHEN (c + last) % 2 = 0 THEN 'support' ELSE 'reject' END END AS answer, CASE WHEN fails THEN 'no second step' END AS error,
  array_to_string(list_transform(range(1, CASE WHEN fails THEN 2 ELSE last + 1 END), lambda k: r[(c + k) % 5 + 1]), ' > ') AS items, CASE WHEN fails THEN 4 ELSE 1 + 2 * last END AS calls FROM b
""")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's case through the call loop, with scripted models."""
    names = [r["r_name"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five rows

    def plan(records: list[dict]) -> list:
        return [[{"name": names[(r["case"] + k) % 5], "tags": []} for k in range(1, 2 + r["case"] % 4)] for r in records]

    def execute(records: list[dict]) -> list:
        return [ValueError("no second step") if r["case"] % 50 == 7 and len(r["artifacts"]) == 1 else f"done {r['item']}" for r in records]

    def judge(records: list[dict]) -> list:
        n = [(r["case"], len(r["artifacts"]), r["force"]) for r in records]
        return [{"decision": "final_answer", "answer": "support" if (c + k) % 2 == 0 else "reject", "steps": None} if force or (c + k) % 3 == 0 else {"decision": "continue", "answer": None, "steps": None} for c, k, force in n]

    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case"), F.col("c_name").alias("text"))
    items = table(spark, sf_dir, "region").select(F.col("r_name").alias("item"), F.col("r_name").alias("name"), F.array().cast("array<string>").alias("tags"), F.col("r_regionkey").alias("position"))
    out = trajectory.trajectories(cases, items, execute, judge, ["support", "reject"], shared_folder(spark), plan)
    return out.select(F.col("case").alias("c_custkey"), "status", "answer", "error", F.array_join(F.transform("artifacts", lambda a: a["item"]), " > ").alias("items"), F.col("calls").cast("long").alias("calls"))


@query("""
WITH a AS (SELECT count(DISTINCT coalesce(text, '')) AS n FROM conversations WHERE turn = 0), b AS (SELECT count(DISTINCT coalesce(text, '')) AS n FROM conversations)
SELECT 'first turns' AS run, 0::BIGINT AS hits, n AS misses FROM a UNION ALL SELECT 'all turns', a.n, b.n - a.n FROM a, b UNION ALL SELECT 'again', n, 0 FROM b
""")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over one store: what was there, and what had to be encoded."""
    turns = table(spark, sf_dir, "conversations").select("turn", "text")
    vectors = store.VectorStore(spark, shared_folder(spark), {"model": "fake", "length": 16})
    runs = [(name, *vectors.fill(rows, "text")) for name, rows in (("first turns", turns.where("turn = 0")), ("all turns", turns), ("again", turns))]
    return spark.createDataFrame(runs, "run string, hits long, misses long")


@query("""
WITH s AS (SELECT conv_id, turn, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id, i AS review, CASE WHEN i + 1 = n THEN 'final_answer' WHEN i % 3 = 2 THEN 'revise' ELSE 'continue' END AS decision, least(i + 1, 3) AS executed,
  CASE WHEN i >= 3 THEN 0 WHEN i = 0 THEN 4 WHEN i = 1 THEN 3 ELSE 2 END AS remaining, i >= 2 AS force FROM s
""")
def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as reviews of five planned steps, three of them executed: what each review was shown."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    what = lambda t, i: F.when(i + 1 == F.size("t"), "final_answer").when(i % 3 == 2, "revise").otherwise("continue")
    reviews = F.transform("t", lambda t, i: F.struct(what(t, i).alias("decision"), F.array(F.lit("x"), F.lit("y")).alias("steps")))
    text = lambda n: F.array(*[F.lit(f"s{k}") for k in range(n)])
    out = turns.select("conv_id", F.posexplode(review.review_contexts(text(5), text(3), reviews, 3)).alias("review", "c"))
    return out.select("conv_id", F.col("review").cast("long").alias("review"), "c.decision", F.col("c.executed").cast("long").alias("executed"), F.size("c.remaining").cast("long").alias("remaining"), "c.force")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS id, o_orderkey // 2 - o_custkey % 3 AS up FROM orders), r AS (SELECT id, up FROM e WHERE up > 0 UNION SELECT r.id, e.up FROM r JOIN e ON e.id = r.up WHERE e.up > 0)
SELECT id, r.up AS root FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = r.up AND e.up > 0)
""")
def lineage_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order points to one with a smaller key (which need not be there); its root is where the pointers end."""
    up = F.expr("o_orderkey div 2") - F.col("o_custkey") % 3
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), up.alias("source")).where("source > 0")
    return lineage.roots(edges)


@query("""
WITH p AS (SELECT *, left_said = gold AS x, right_said = gold AS y FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'support' ELSE 'reject' END AS gold, CASE WHEN o_orderkey % 2 = 0 THEN 'support' ELSE 'reject' END AS left_said,
  CASE WHEN o_custkey % 2 = 0 THEN 'support' ELSE 'reject' END AS right_said, o_orderkey % 5 = 0 AS made, o_orderkey % 4 = 0 AS planned FROM orders WHERE o_orderstatus <> 'P')),
c AS (SELECT *, CASE WHEN x AND y THEN 'both_correct' WHEN x THEN 'left_only' WHEN y THEN 'right_only' ELSE 'both_wrong' END AS outcome FROM p),
d AS (SELECT *, CASE WHEN outcome IN ('left_only', 'right_only') THEN CASE WHEN made AND planned THEN 'same_final_review_context_' WHEN made THEN 'same_artifacts_' WHEN planned THEN 'same_plan_and_templates_' ELSE 'changed_trajectory_' END || CASE outcome WHEN 'left_only' THEN 'regression' ELSE 'improvement' END ELSE outcome END AS category FROM c)
SELECT 'outcomes' AS section, outcome AS name, count(*)::DOUBLE AS value FROM d GROUP BY outcome UNION ALL SELECT 'categories', category, count(*)::DOUBLE FROM d GROUP BY category
UNION ALL SELECT 'flips', left_said || '->' || right_said, count(*)::DOUBLE FROM d WHERE left_said <> right_said GROUP BY 2
UNION ALL SELECT 'coverage', unnest(['left_records', 'right_records', 'left_ok', 'right_ok', 'left_only', 'right_only', 'excluded_not_ok']), unnest([count(*), count(*), count(*) FILTER (WHERE o_orderstatus <> 'P'), count(*), 0, 0, count(*) FILTER (WHERE o_orderstatus = 'P')])::DOUBLE FROM orders
UNION ALL SELECT 'metrics', unnest(['left_accuracy', 'right_accuracy']), unnest([round(avg(x::INT), 9), round(avg(y::INT), 9)]) FROM d
""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a record of two runs, whose predictions, plans and artifacts agree for some."""
    orders = table(spark, sf_dir, "orders")
    key, gold = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, "support").otherwise("reject")

    def run(side: str) -> DataFrame:
        left = side == "left"
        said = F.when((key if left else F.col("o_custkey")) % 2 == 0, "support").otherwise("reject")
        own = lambda test, name: F.array(F.when(test, name).otherwise(F.lit(f"{name} of {side}")))
        review = F.array(F.struct(F.lit("final_answer").alias("decision"), F.array().cast("array<string>").alias("steps")))
        return orders.select(
            key, F.when((F.col("o_orderstatus") == "P") & F.lit(left), "error").otherwise("ok").alias("status"), gold.alias("gold"), said.alias("prediction"), (said == gold).alias("correct"), F.concat(F.array(F.lit("s")), own(key % 4 == 0, "plan")).alias("steps"),
            F.array(F.lit("t")).alias("templates"), own(key % 5 == 0, "made").alias("artifacts"), review.alias("reviews"), F.lit(2).alias("calls"), F.array(F.lit(0.5)).alias("similarities"),
        )

    out = runs.report(run("left"), run("right"), ["o_orderkey"])
    kept = F.col("section").isin("outcomes", "categories", "flips", "coverage") | F.col("name").isin("left_accuracy", "right_accuracy")
    return out.where(kept).select("section", "name", F.round("value", 9).alias("value"))


@query("""
WITH d AS (SELECT doc_id, lang || '|' || source AS k, n_chars FROM documents), s AS (SELECT k, count(*) AS n, least(120, sum(count(*)) OVER ())::DOUBLE * count(*) / sum(count(*)) OVER () AS x FROM d GROUP BY k),
q AS (SELECT k, floor(x)::BIGINT + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, k) <= least(120, sum(n) OVER ()) - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sha256('dev:' || doc_id), doc_id) AS rn FROM d)
SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM r JOIN q USING (k) WHERE rn <= quota
""")
def ordered_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 documents by language and source, in the order of their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return sampling.ordered_subset(docs, ["lang", "source"], "doc_id", "n_chars", 120, "dev").select("doc_id", "place")


@query("""
WITH r AS (SELECT CASE WHEN doc_id % 9 = 4 THEN NULL ELSE doc_id - doc_id % 11 // 10 END AS id, text, CASE WHEN doc_id % 7 = 3 THEN 'x' ELSE sha256(coalesce(text, '')) END AS h FROM documents),
p AS (SELECT doc_id AS id, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 2 THEN '!' ELSE '' END) AS now FROM documents)
SELECT 'prompt does not match its hash' AS problem, count(*) AS n FROM r WHERE h = 'x' UNION ALL SELECT 'prompt is made otherwise today', count(*) FROM r LEFT JOIN p USING (id) WHERE now IS NULL OR now <> h
UNION ALL SELECT 'no id', count(*) FROM r WHERE id IS NULL UNION ALL SELECT 'id repeats', count(*) FROM (SELECT id FROM r WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'pool is a, not b', 1
""")
def export_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an export with faults in its ids and hashes, checked against prompts of which some have changed since."""
    docs = table(spark, sf_dir, "documents")
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    id_ = F.when(key % 9 != 4, key - F.expr("doc_id % 11 div 10"))
    rows = docs.select(id_.alias("id"), "text", F.when(key % 7 == 3, "x").otherwise(F.sha2(text, 256)).alias("prompt_hash")).withColumnRenamed("text", "prompt")
    prompts = docs.select(key.alias("id"), F.concat(text, F.when(key % 5 == 2, "!").otherwise("")).alias("prompt"))
    manifest = exports.manifest_of(rows, pool="a")
    return exports.export_problems(rows, manifest, {"pool": "b"}, prompts).select("problem", "n")
