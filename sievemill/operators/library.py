"""Plans, candidates and libraries of reusable steps: sampling, recovery, adjudication, execution order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from . import similarity
from .ledger import expand_jobs


def plan_slots(anchors: DataFrame, key: str, samples: int = 4, seed: int = 7) -> DataFrame:
    """One slot a sample of each anchor, with its seed."""
    return expand_jobs(anchors, ["plan"], samples, seed).drop("condition")


def missing_slots(slots: DataFrame, present: DataFrame, failures: DataFrame, key: str, stride: int = 4, max_attempts: int = 3) -> DataFrame:
    """Slots to try again: without a candidate, with a failure for want of planned steps and fewer than max_attempts tries.

    present: key, sample_index; failures: key, sample_index, error. The seed moves by stride an attempt.
    """
    slot = [key, "sample_index"]
    tries = failures.groupBy(*slot).agg(F.count(F.lit(1)).alias("attempt"), F.count_if(F.col("error").contains("planned_steps")).alias("__fit"))
    open_ = slots.join(present.select(*slot), slot, "left_anti").join(tries, slot)
    return open_.where((F.col("__fit") == F.col("attempt")) & (F.col("attempt") < max_attempts)).withColumn("seed", F.col("seed") + F.col("attempt") * stride).drop("__fit")


def evaluation_jobs(candidates: DataFrame, neighbours: DataFrame, anchor: str, targets: str) -> DataFrame:
    """A job for each candidate and each target of its anchor; neighbours: anchor and an array of targets."""
    each = neighbours.select(anchor, F.posexplode(targets).alias("position", "target"))
    return candidates.join(each, anchor)


def evaluated(results: DataFrame, valid: list[str]) -> DataFrame:
    """results with status and correct: a call that failed is an error; an answer that is no label is completed and wrong."""
    failed = F.col("error").isNotNull()
    return results.withColumns({"status": F.when(failed, "error").otherwise("ok"), "valid": ~failed & F.coalesce(F.col("answer").isin(*valid), F.lit(False)), "correct": F.when(~failed, F.coalesce(F.col("answer").isin(*valid) & (F.col("answer") == F.col("gold")), F.lit(False)))})


def one_context(rows: DataFrame, *fields: str) -> DataFrame:
    """The one combination of the fields; fails at run time if there are more."""
    found = rows.select(*fields).distinct().limit(2).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    ok = F.when(F.col("__n") <= 1, True).otherwise(F.raise_error(F.lit("more than one context")).cast("boolean"))
    return found.where(ok).drop("__n")


def candidate_problems(candidates: DataFrame, known: DataFrame, least_support: int) -> DataFrame:
    """candidate, problem: unknown, too few or miscounted supporting ids.

    candidates: candidate, support (array), support_count; known: id. The ids are joined, so they may be any number.
    The candidates are written once, since each of the three problems would collect them again.
    """
    distinct = cut(candidates.withColumn("support", F.array_distinct("support")))
    each = distinct.select("candidate", F.explode("support").alias("id")).join(known.select("id").distinct(), "id", "left_anti").select("candidate", F.lit("unknown support").alias("problem")).distinct()
    few = distinct.where(F.size("support") < least_support).select("candidate", F.lit("too few").alias("problem"))
    wrong = distinct.where(F.size("support") != F.col("support_count")).select("candidate", F.lit("count differs").alias("problem"))
    return each.unionAll(few).unionAll(wrong)


def adjudicated(current: DataFrame, gaps: DataFrame, accepted: DataFrame, merges: DataFrame) -> DataFrame:
    """The new library: part, place, sources of each entry, in the order (part, place).

    current: id, position; gaps: id, position; accepted: id of gaps; merges: merge (its number), sources (array of ids
    of both). A merge with current entries stands at the first of them, which it replaces; then come the
    accepted gaps in their order, then merges of gaps only.
    """
    cited = merges.select("merge", F.explode("sources").alias("id"))
    anchor = cited.join(current, "id").groupBy("merge").agg(F.min("position").alias("place"))
    kept = current.join(cited.select("id"), "id", "left_anti").select(F.lit(0).alias("part"), F.col("position").cast("long").alias("place"), F.array("id").alias("sources"))
    anchored = merges.join(anchor, "merge").select(F.lit(0), F.col("place").cast("long"), "sources")
    single = gaps.join(accepted.select("id"), "id", "left_semi").select(F.lit(1), F.col("position").cast("long"), F.array("id"))
    alone = merges.join(anchor, "merge", "left_anti").select(F.lit(2), F.col("merge").cast("long"), "sources")
    return kept.unionAll(anchored).unionAll(single).unionAll(alone)


def execution_order(nodes: DataFrame, graph: str, max_depth: int = 8) -> DataFrame:
    """nodes with depth and place (from 1): children before parents, that is, the deeper first, then by position.

    nodes: graph, node, parent, position. A parent that is no node of the graph makes a root. A depth
    beyond max_depth, as in a cycle, is an error.
    """
    step = nodes.select(graph, F.col("node").alias("__at"), F.col("parent").alias("__up"), F.lit(1).alias("__there"))
    up = nodes.select("*", F.lit(1).alias("depth"), F.col("parent").alias("__at"))
    for _ in range(max_depth):
        up = up.join(step, [graph, "__at"], "left").select(*nodes.columns, (F.col("depth") + F.coalesce("__there", F.lit(0))).alias("depth"), F.col("__up").alias("__at"))
    ok = F.when(F.col("__at").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("cycle or too deep: "), F.col(graph).cast("string"))).cast("boolean"))
    up = up.where(ok).drop("__at")
    order = up.groupBy(graph).agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "position", "node"))).alias("__all"))
    return up.join(order, graph).withColumn("place", F.array_position("__all", F.struct((-F.col("depth")).alias("d"), "position", "node"))).drop("__all")


def retrieve_in_turn(steps: DataFrame, items: DataFrame, scores: DataFrame, max_steps: int = 4) -> DataFrame:
    """plan, step, item, mode, score: the cascade for the steps of each plan in turn, an item once a plan.

    steps: plan, step (unique), position (from 1), name, tags; items and scores as for similarity.cascade. If all items are used,
    all are free again. One pass a position, whatever the number of plans.
    """
    out = None
    for turn in range(1, max_steps + 1):
        now = steps.where(F.col("position") == turn)
        used = None if out is None else now.select("plan", "step").join(out.select("plan", "item"), "plan").select("step", "item")
        found = similarity.cascade(now.select("step", "name", "tags"), items, scores, used)
        # cut, as the next turn reads it more than once
        found = cut(now.select("plan", "step").join(found, "step").select("plan", "step", "item", "mode", "score"), shuffled=True)
        out = found if out is None else out.unionAll(found)
    return out
