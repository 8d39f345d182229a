"""More queries of the engine's operators bound to the driver's tables: profiles, reviews, libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import profile as P
from ..operators import library, review, sampling
from ..sources.tables import spread
from .catalogue import PREDICTIONS_SQL, predictions, query, table


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cases_sql(patterns: dict[str, str], column: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, {quoted('(?i)' + p)}) THEN {quoted(n)} END" for n, p in patterns.items()) + "], lambda x: x IS NOT NULL)"


#: A sentence for each pattern of the lexicon. The tables' prose holds hardly any of the words, so each document gets one of them (or none) by its doc_id.
OUTCOME_SENTENCES = [
    "", "Then the court held otherwise.", "His claim was dismissed.", "The defendant is not liable here.", "He shall pay in May.", "She was an evasive witness.", "Judgment in May was entered.", "He admitted liability.",
    "A judge in May preferred some testimony.", "The appeal of May was upheld.", "COSTS WERE AWARDED.", "There is no evidence to support this.", "They are entitled to it.", "Both were equally responsible.",
]
CASE_SENTENCES = [
    "", "a Breach of it", "an unpaid sum", "the premises", "an injury", "lost wages", "a shareholder", "leave was sought", "the prosecution", "a refugee", "the public officer", "his estate", "an expert", "estoppel", "an injunction",
    "LAND and trusts and loans and torts",
]
PREDICATE_SENTENCES = ["", "He was convicted.", "It is not enforceable.", "A counterclaim was made.", "By the king in 1984 at the river."]


def planted_sql(sentences: list[str]) -> str:
    return f"(coalesce(text, '') || ' ' || [{', '.join(quoted(x) for x in sentences)}][doc_id % {len(sentences)} + 1])"


def planted(sentences: list[str]) -> Column:
    """A document's text and the sentence that falls to it."""
    return F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in sentences]), (F.col("doc_id") % len(sentences) + 1).cast("int")))


def steps_sql(steps: list[tuple[str, str]]) -> str:
    return ", ".join(f"CASE WHEN list_contains(d, {quoted(a)}) THEN {quoted(b)} END" for a, b in steps)


@query(rf"""
WITH t AS (SELECT doc_id, {planted_sql(CASE_SENTENCES)} AS text, array_to_string(string_split(coalesce(text, ''), chr(10))[1:doc_id % 4], chr(10)) AS issues, CASE WHEN lang = 'en' THEN source ELSE '' END AS laws, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ';' || source END AS refs FROM documents),
b AS (SELECT *, text || ' ' || issues || ' ' || laws || ' ' || refs AS whole,
  len(list_filter(regexp_split_to_array(issues, '[\n;]+'), lambda x: trim(x, ' -' || chr(9)) <> '')) AS issue_count, len(list_filter(string_split(refs, ';'), lambda x: x <> '')) AS case_count,
  list_distinct(regexp_extract_all(text, '\b(F\d+)\b')) AS marks,
  len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '')) AS sentences FROM t),
c AS (SELECT *, CASE WHEN trim(text) = '' THEN 0 WHEN len(marks) > 0 THEN len(marks) ELSE sentences END AS fact_count, (laws <> '')::INT AS law_count, {cases_sql(lexicon.FAMILY_PATTERNS, 'whole')} AS f0 FROM b),
e AS (SELECT *, CASE WHEN len(f0) > 0 THEN f0 ELSE ['general_legal_reasoning'] END AS f FROM c),
g AS (SELECT *, list_filter([CASE WHEN issue_count = 0 THEN 'issue_spotting_gap' WHEN issue_count = 1 THEN 'focused_issue_resolution' WHEN issue_count >= 3 THEN 'multi_issue_composition' ELSE 'dual_issue_resolution' END,
  CASE WHEN law_count > 0 THEN 'supplied_rule_extraction' ELSE 'rule_recall_or_doctrine_identification' END, CASE WHEN case_count > 0 THEN 'precedent_or_analogy_handling' END, CASE WHEN list_contains(f, 'procedure_appeal') THEN 'procedural_threshold_check' END]
  || {cases_sql(lexicon.DEMAND_PATTERNS, 'whole')} || [CASE WHEN fact_count >= 12 OR length(text) >= 2200 THEN 'long_fact_filtering' END], lambda x: x IS NOT NULL) AS d FROM e)
SELECT doc_id, issue_count, law_count, case_count, fact_count, CASE WHEN law_count > 0 AND case_count > 0 THEN 'laws_and_cases' WHEN law_count > 0 THEN 'laws_only' WHEN case_count > 0 THEN 'cases_only' ELSE 'no_authorities' END AS authorities, array_to_string(f, '|') AS families, array_to_string(d, '|') AS demands,
  array_to_string(list_filter(['case_profile', CASE WHEN list_contains(d, 'issue_spotting_gap') THEN 'issue_spotting' WHEN list_contains(d, 'multi_issue_composition') THEN 'issue_decomposition' ELSE 'issue_confirmation' END, {steps_sql(lexicon.STEPS_BEFORE)},
    CASE WHEN list_contains(d, 'supplied_rule_extraction') THEN 'rule_extraction' ELSE 'rule_or_doctrine_identification' END] || list_transform(f[1:3], lambda x: 'domain_template:' || x) || [{steps_sql(lexicon.STEPS_AFTER)}, 'final_decision'], lambda x: x IS NOT NULL), ' > ') AS signature FROM g
""")
def case_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts are a document's whole text, issues its first lines (none to three), so that no text is searched twice."""
    docs = table(spark, sf_dir, "documents")
    issues = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(1), (F.col("doc_id") % 4).cast("int")), "\n")
    laws = F.when(F.col("lang") == "en", F.col("source")).otherwise("")
    refs = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat_ws(";", "lang", "source"))
    out = docs.select("doc_id", P.profile(planted(CASE_SENTENCES), issues, laws, refs).alias("p")).select("doc_id", "p.*")
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select("doc_id", long("issue_count"), "law_count", long("case_count"), long("fact_count"), P.authority_bucket(F.col("law_count"), F.col("case_count")).alias("authorities"), F.array_join("families", "|").alias("families"), F.array_join("demands", "|").alias("demands"), "signature")


@query(rf"""
WITH i AS (SELECT text AS decision, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark),
p AS (SELECT doc_id, decision, {planted_sql(OUTCOME_SENTENCES)} || CASE WHEN doc_id % 10 = 3 THEN ' ' || decision ELSE '' END AS facts FROM documents d JOIN i ON place = doc_id % n),
g AS (SELECT doc_id, facts, list_distinct(CASE WHEN len(t) < 6 THEN [] ELSE list_transform(range(1, len(t) - 4), lambda i: array_to_string(t[i:i+5], ' ')) END) AS a, list_distinct(CASE WHEN len(u) < 6 THEN [] ELSE list_transform(range(1, len(u) - 4), lambda i: array_to_string(u[i:i+5], ' ')) END) AS b
  FROM (SELECT doc_id, facts, regexp_extract_all(lower(facts), '[a-z0-9]+') AS t, regexp_extract_all(lower(decision), '[a-z0-9]+') AS u FROM p))
SELECT doc_id, array_to_string({cases_sql(lexicon.OUTCOME_PATTERNS, 'facts')} || CASE WHEN len(b) > 0 AND len(list_intersect(b, a)) / len(b) >= 0.12 THEN ['judgment_text_overlap'] ELSE [] END, '|') AS reasons FROM g
""".replace("coalesce(text, '')", "coalesce(d.text, '')"))
def leakage_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of benchmark is the decision of the documents whose doc_id leaves its place over; each tenth document quotes it."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("decision"))
    n = items.count()
    items = sampling.ranked(items, ["item_id"], "place").select("decision", (F.col("place") - 1).alias("place"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("place", F.col("doc_id") % n).join(items, "place")
    facts = F.concat(planted(OUTCOME_SENTENCES), F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit(" "), F.col("decision"))).otherwise(""))
    return docs.select("doc_id", F.array_join(P.leakage_reasons(facts, F.col("decision")), "|").alias("reasons"))


@query(rf"""
SELECT doc_id, NOT (doc_id % 50 = 0) AND NOT regexp_matches(lang || ' ' || text, {quoted('(?i)' + lexicon.CRIMINAL_TERMS)}) AS civil, regexp_matches(text, {quoted('(?i)' + lexicon.STRICT_TERMS)}) AS strict,
  regexp_matches(text, {quoted('(?i)' + lexicon.DEFENSE_FLAG)}) AS defense, regexp_matches(lower(text), '(?:\bking\b)|(?:river)') AS place, regexp_matches(lower(text), '(?:[0-9]{{4}})') AS year FROM (SELECT doc_id, lang, {planted_sql(PREDICATE_SENTENCES)} AS text FROM documents)
""")
def case_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", planted(PREDICATE_SENTENCES))
    text, plaintiff = F.col("text"), F.when(F.col("doc_id") % 50 == 0, " hksar ").otherwise(F.col("source"))
    flags = P.pattern_flags(text, {"place": [r"\bking\b", "river"], "year": ["[0-9]{4}"]})
    return docs.select("doc_id", P.is_civil(plaintiff, F.col("lang"), text).alias("civil"), (F.size(P.strict_reasons(text)) > 0).alias("strict"), P.has_defense(text).alias("defense"), *flags)


@query(r"""
SELECT conv_id, turn, lines, questions, CASE WHEN lines = 0 THEN 'none' WHEN lines <= 2 THEN 'few' ELSE 'many' END AS bucket FROM (
  SELECT conv_id, turn, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '')) AS lines,
    CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE greatest(1, len(list_filter(string_split(regexp_replace(text, ';(\s*(?:whether|if|what|the)\b)', chr(10) || '\1', 'g'), chr(10)), lambda x: trim(x, ' ') <> ''))) END AS questions FROM conversations)
""")
def issue_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.issue_lines(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lines.cast("long").alias("lines"), P.issue_questions(F.col("text")).cast("long").alias("questions"), P.issue_bucket(lines).alias("bucket"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, 'F' || l_linenumber AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r, l_linestatus FROM lineitem),
k AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS issues, count(*) FILTER (WHERE l_linenumber <= 4) AS known, sum(r) AS opposing, count(*) FILTER (WHERE l_linestatus = 'O') AS open FROM c GROUP BY 1)
SELECT o_orderkey, ((CASE o_orderstatus WHEN 'O' THEN 'support' WHEN 'F' THEN 'reject' ELSE 'pending' END) = CASE WHEN o_totalprice > 150000 THEN 'support' ELSE 'reject' END)::DOUBLE AS answer_correct, (o_orderstatus IN ('O', 'F'))::DOUBLE AS prediction_valid,
  1.0::DOUBLE AS reasoning_present, 1.0::DOUBLE AS conclusion_with_fact_rate, round(known / (n + opposing), 9) AS valid_fact_rate, (n + opposing - known)::BIGINT AS unknown_facts, round(least(issues / 3, 1.0), 9) AS issue_coverage, round(open / n, 9) AS unresolved_rate
FROM orders JOIN k ON o_orderkey = l_orderkey
""")
def record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("l_linenumber").cast("string").alias("issue_id"), F.array(F.concat(F.lit("F"), F.col("l_linenumber"))).alias("supporting"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("F99"))).otherwise(F.array().cast("array<string>")).alias("opposing"), F.when(F.col("l_linestatus") == "O", "unresolved").otherwise("established").alias("conclusion"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(one).alias("c"))
    prediction = F.when(F.col("o_orderstatus") == "O", "support").when(F.col("o_orderstatus") == "F", "reject").otherwise("pending")
    gold = F.when(F.col("o_totalprice") > 150000, "support").otherwise("reject")
    facts = F.array(*[F.lit(f"F{i}") for i in range(1, 5)])
    out = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("o_orderkey", *review.record_scores(facts, F.col("c"), prediction, gold, F.col("o_orderpriority"), F.lit(3)))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("""
SELECT v.l_orderkey AS pair_id, v.l_linenumber AS variant, v.kind, v.l_returnflag = o.l_returnflag AS same, v.kind = 'irrelevant_fact' AS expected_same, (v.l_returnflag = o.l_returnflag) = (v.kind = 'irrelevant_fact') AS success
FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'irrelevant_fact' ELSE 'changed_fact' END AS kind FROM lineitem WHERE l_linenumber = 2) v JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) o USING (l_orderkey)
""")
def perturbation_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), "l_linenumber", F.col("l_returnflag").alias("prediction"), F.when(F.col("l_linestatus") == "O", "irrelevant_fact").otherwise("changed_fact").alias("kind"))
    out = review.robustness(lines.where("l_linenumber = 1"), lines.where("l_linenumber = 2"), "pair_id")
    return out.withColumn("variant", F.lit(2)).select("pair_id", "variant", "kind", "same", "expected_same", "success")


GRID_SQL = "SELECT l_returnflag || l_linestatus || l_linenumber AS tag, CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE (count(*) % 7)::VARCHAR END AS accuracy, (count(*) % 3)::VARCHAR AS weighted_f1, (count(*) % 5)::VARCHAR AS calls FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber"


@query(f"SELECT *, row_number() OVER (ORDER BY coalesce(try_cast(accuracy AS DOUBLE), '-inf'::DOUBLE) DESC, coalesce(try_cast(weighted_f1 AS DOUBLE), '-inf'::DOUBLE) DESC, coalesce(try_cast(calls AS DOUBLE), 'inf'::DOUBLE), tag) AS place FROM ({GRID_SQL})")
def checkpoint_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(*[(n % k).cast("string").alias(c) for c, k in (("accuracy", 7), ("weighted_f1", 3), ("calls", 5))])
    rows = rows.select(F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("tag"), F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("accuracy")).alias("accuracy"), "weighted_f1", "calls")
    return review.checkpoint_ranking(rows, "tag")


@query(f"""
SELECT count(*) AS n, count(*) FILTER (WHERE a AND b) AS both_correct, count(*) FILTER (WHERE a AND NOT b) AS left_only, count(*) FILTER (WHERE b AND NOT a) AS right_only, count(*) FILTER (WHERE NOT a AND NOT b) AS neither, count(*) FILTER (WHERE a <> b) AS flips,
  round(avg(a::INT), 9) AS left_accuracy, round(avg(b::INT), 9) AS right_accuracy, round(avg(b::INT) - avg(a::INT), 9) AS delta FROM (SELECT quality = pred AS a, quality = pred2 AS b FROM ({PREDICTIONS_SQL}))
""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    run = lambda c: rows.select("doc_id", F.col("quality").alias("gold"), F.col(c).alias("prediction"))
    out = review.run_summary(review.compare_runs(run("pred"), run("pred2"), "doc_id"))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS rn FROM conversations) WHERE rn = 1")
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.ordered_distinct(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["role", "text"], ["conv_id", "turn"])


@query("SELECT l_orderkey, " + ", ".join(f"max_by(l_quantity, l_linenumber * 1000 + l_quantity) FILTER (WHERE l_returnflag = '{f}') AS \"{f}\"" for f in "ANR") + " FROM lineitem GROUP BY l_orderkey")
def condition_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pivoted(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"], "l_quantity", F.col("l_linenumber") * 1000 + F.col("l_quantity"))


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(regexp_split_to_array(coalesce(text, ''), '[\r\n]+')) AS x, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[\r\n]+'), 1) AS i FROM conversations),
f AS (SELECT conv_id, turn, trim(x, ' -*;' || chr(9)) AS line, min(i) AS i FROM l WHERE trim(x, ' -*;' || chr(9)) <> '' GROUP BY ALL)
SELECT conv_id, turn, 'A' || row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS id, line FROM f
""")
def authority_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(P.numbered_authorities(F.col("text"))).alias("a")).select("conv_id", "turn", F.col("a.id").alias("id"), F.col("a.text").alias("line"))


@query("""SELECT event_id, event_id % 3 <> 0 AS equal FROM events WHERE json_valid(props)""")
def structural_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("props").isNotNull())
    # the same object with other spacing, with its members in another order, or with one more member
    a = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit('{"z": 1, "r": '), F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    b = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit('{ "r" :'), F.col("props"), F.lit(', "z":1}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), F.col("props"), F.lit(" "))).otherwise(F.concat(F.lit('{"extra": '), F.col("props"), F.lit("}")))
    return events.select("event_id", P.answers_match(a, b).alias("equal"))


@query("""
WITH s AS (SELECT c_custkey, k::INT AS sample_index, 7 + k AS seed FROM customer, range(4) r(k)), t AS (SELECT o_custkey, (o_orderkey % 4)::INT AS k, count(*) AS attempt, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS fit FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
SELECT c_custkey, sample_index, (seed + attempt * 4)::BIGINT AS seed, attempt FROM s JOIN t ON c_custkey = o_custkey AND sample_index = k
WHERE fit = attempt AND attempt < 3 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'F' AND p.o_custkey = c_custkey AND p.o_orderkey % 4 = sample_index)
""")
def recovery_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = library.plan_slots(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    tries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 4).cast("int").alias("sample_index"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "timeout").otherwise("missing planned_steps").alias("error"))
    return library.missing_slots(slots, tries.where("status = 'F'"), tries.where("status <> 'F'"), "c_custkey").select("c_custkey", "sample_index", "seed", "attempt")


@query("SELECT l_orderkey, l_linenumber, position, target FROM lineitem JOIN (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1, o_custkey * 2]) AS target, unnest([0, 1, 2])::INT AS position FROM orders) ON o_orderkey = l_orderkey")
def evaluation_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1, F.col("o_custkey") * 2).alias("targets"))
    return library.evaluation_jobs(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), near, "l_orderkey", "targets").select("l_orderkey", "l_linenumber", "position", "target")


@query("""
WITH RECURSIVE d AS (SELECT l_orderkey, l_linenumber, l_linenumber // 2 AS up, 1 AS depth FROM lineitem UNION ALL SELECT d.l_orderkey, d.l_linenumber, p.l_linenumber // 2, d.depth + 1 FROM d JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) p ON p.l_orderkey = d.l_orderkey AND p.l_linenumber = d.up),
m AS (SELECT l_orderkey, l_linenumber, max(depth) AS depth FROM d GROUP BY ALL)
SELECT l_orderkey, l_linenumber, depth, row_number() OVER (PARTITION BY l_orderkey ORDER BY depth DESC, l_linenumber) AS place FROM m
""")
def execution_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("node"), F.expr("cast(l_linenumber div 2 as int)").alias("parent"), F.col("l_linenumber").alias("position")).distinct()
    return library.execution_order(nodes, "l_orderkey", 4).select("l_orderkey", F.col("node").alias("l_linenumber"), "depth", "place")


@query("""
SELECT DISTINCT l_orderkey AS candidate, 'unknown support' AS problem FROM lineitem JOIN supplier USING (l_suppkey) WHERE s_acctbal < 0
UNION ALL SELECT l_orderkey, 'too few' FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) < 3
UNION ALL SELECT l_orderkey, 'count differs' FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) <> count(*)
""".replace("USING (l_suppkey)", "ON s_suppkey = l_suppkey"))
def candidate_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate"), "l_suppkey"), "candidate")
    rows = lines.groupBy("candidate").agg(F.collect_list("l_suppkey").alias("support"), F.count(F.lit(1)).alias("support_count"))
    return library.candidate_problems(rows, table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("id")), 3)


@query("""
WITH c AS (SELECT 'S' || s_suppkey AS id, s_suppkey AS position FROM supplier), g AS (SELECT 'N' || n_nationkey AS id, n_nationkey AS position FROM nation),
m AS (SELECT r_regionkey AS merge, CASE WHEN r_regionkey < 3 THEN ['N' || (3 * r_regionkey + 1), 'S' || (r_regionkey + 2), 'S' || (r_regionkey + 6)] ELSE ['N' || (3 * r_regionkey + 1), 'N' || (3 * r_regionkey + 2)] END AS sources FROM region),
e AS (SELECT merge, sources, unnest(sources) AS id FROM m), a AS (SELECT merge, min(position) AS place FROM e JOIN c USING (id) GROUP BY merge)
SELECT 0 AS part, position AS place, id AS sources FROM c WHERE id NOT IN (SELECT id FROM e)
UNION ALL SELECT 0, place, array_to_string(sources, ',') FROM m JOIN a USING (merge)
UNION ALL SELECT 1, position, id FROM g WHERE position % 3 = 0
UNION ALL SELECT 2, merge, array_to_string(sources, ',') FROM m WHERE merge NOT IN (SELECT merge FROM a)
""")
def gap_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    current = table(spark, sf_dir, "supplier").select(name("S", F.col("s_suppkey")).alias("id"), F.col("s_suppkey").alias("position"))
    gaps = table(spark, sf_dir, "nation").select(name("N", F.col("n_nationkey")).alias("id"), F.col("n_nationkey").alias("position"))
    r = F.col("r_regionkey")
    merges = table(spark, sf_dir, "region").select(r.alias("merge"), F.when(r < 3, F.array(name("N", 3 * r + 1), name("S", r + 2), name("S", r + 6))).otherwise(F.array(name("N", 3 * r + 1), name("N", 3 * r + 2))).alias("sources"))
    out = library.adjudicated(current, gaps, gaps.where("position % 3 = 0"), merges)
    return out.select("part", "place", F.array_join("sources", ",").alias("sources"))


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def known_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's customer is known: the join would fail otherwise."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return review.known_only(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey").join(review.only_once(customers, "o_custkey"), "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment")


SPLITS = [("train", 0.5), ("dev", 0.15), ("test", 0.15)]


def splits_sql() -> str:
    """Quotas by largest remainder of what earlier splits have left; members by rank."""
    steps, left = [], "n"
    for name, share in SPLITS:
        target = f"round_even(({share} * (SELECT count(*) FROM documents))::DOUBLE, 0)::BIGINT"
        before = steps[-1][0] if steps else "z"
        steps.append((f"q_{name}", f"q_{name} AS (SELECT *, floor(x)::BIGINT + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, k) <= {target} - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS {name} FROM (SELECT *, ({target} * ({left}))::DOUBLE / sum({left}) OVER () AS x FROM (SELECT * EXCLUDE (x) FROM {before})))"))
        left += f" - {name}"
    return ",\n".join(s for _, s in steps)


@query(f"""
WITH d AS (SELECT doc_id, lang || '/' || source AS k FROM documents), z AS (SELECT k, count(*) AS n, 0.0::DOUBLE AS x FROM d GROUP BY k), {splits_sql()},
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY sha256('multi:' || doc_id), doc_id) AS rn FROM d)
SELECT doc_id, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + dev THEN 'dev' WHEN rn <= train + dev + test THEN 'test' ELSE 'rest' END AS split FROM r JOIN q_test USING (k)
""")
def exact_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("stratum"))
    return sampling.exact_splits(docs, "stratum", "doc_id", SPLITS, "rest", "multi").select("doc_id", "split")
