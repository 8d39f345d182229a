"""Two runs over the same cases: pairs, why their outcomes differ, and a report of both.

A record has: the keys, status, gold, prediction, correct, steps (the plan), templates (ids in the order of use),
artifacts, reviews (array of decision and steps), calls, similarities (array of doubles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import final_context, only_once, review_contexts

FLAGS = ("plan_equal", "templates_equal", "first_artifact_equal", "first_context_equal", "artifacts_equal", "final_context_equal")


def signed(run: DataFrame, max_steps: int) -> DataFrame:
    """Records with the signatures that pairs are compared by."""
    contexts = review_contexts(F.col("steps"), F.col("artifacts"), F.col("reviews"), max_steps)
    rows = run.withColumn("_c", contexts)
    text = lambda c: F.sha2(F.coalesce(F.to_json(F.struct(c)), F.lit("")), 256)
    return rows.withColumns({
        "plan": text("steps"), "used": text("templates"), "made": text("artifacts"), "first_made": text(F.get("artifacts", 0).alias("a")),
        "first_seen": F.get("_c", 0)["signature"], "last_seen": final_context(F.col("_c")),
        "similarity": F.aggregate(F.coalesce("similarities", F.array().cast("array<double>")), F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size("similarities"), F.lit(0)),
    }).drop("_c")


def category(bucket: Column) -> Column:
    """What two trajectories had in common up to where their outcomes part: the latest equal point names it."""
    direction = F.when(bucket == "left_only", "regression").otherwise("improvement")
    reason = F.when(F.col("final_context_equal"), "same_final_review_context_").when(F.col("artifacts_equal"), "same_artifacts_").when(F.col("first_context_equal"), "same_first_review_context_")
    reason = reason.when(F.col("plan_equal") & F.col("templates_equal"), "same_plan_and_templates_").otherwise("changed_trajectory_")
    return F.when(bucket.isin("left_only", "right_only"), F.concat(reason, direction)).otherwise(bucket)


def paired(left: DataFrame, right: DataFrame, keys: list[str], max_steps: int = 4) -> DataFrame:
    """A row for each case that is ok in both runs: outcome, category, flags of equality, and both sides' numbers; another gold is an error."""
    sides = []
    for name, run in (("left", left), ("right", right)):
        own = signed(only_once(run, *keys).where("status = 'ok'"), max_steps)
        values = ["gold", "prediction", "correct", "plan", "used", "made", "first_made", "first_seen", "last_seen", "similarity", "calls"]
        sides.append(own.select(*keys, F.size("steps").alias(f"{name}_steps"), F.size("artifacts").alias(f"{name}_executed"), *[F.col(c).alias(f"{name}_{c}") for c in values]))
    same = lambda c: F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))
    where = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    ok = F.when(same("gold"), True).otherwise(F.raise_error(F.concat(F.lit("gold differs: "), where)).cast("boolean"))
    both = sides[0].join(sides[1], keys).where(ok)
    x, y = F.coalesce("left_correct", F.lit(False)), F.coalesce("right_correct", F.lit(False))
    bucket = F.when(x & y, "both_correct").when(x, "left_only").when(y, "right_only").otherwise("both_wrong")
    flags = dict(zip(FLAGS, map(same, ("plan", "used", "first_made", "first_seen", "made", "last_seen"))))
    rows = both.withColumns({"outcome": bucket, **flags}).withColumn("category", category(F.col("outcome")))
    numbers = [f"{side}_{c}" for side in ("left", "right") for c in ("prediction", "correct", "steps", "executed", "calls", "similarity")]
    return rows.select(*keys, F.col("left_gold").alias("gold"), *numbers, "outcome", *FLAGS, "category")


def report(left: DataFrame, right: DataFrame, keys: list[str], labels: tuple[str, str] = ("support", "reject"), max_steps: int = 4) -> DataFrame:
    """section, name, value: coverage, metrics of both runs and their differences, outcomes, categories, flips and agreement.

    Pairs are made once and aggregated to a few rows; a table of pairs is never read by the driver.
    """
    pairs = paired(left, right, keys, max_steps)
    row = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    # coverage: a row a case, with what each run has of it
    has = lambda run, name: run.select(*keys, F.lit(True).alias(name), (F.col("status") == "ok").alias(f"{name}_ok"))
    all_ = has(left, "left").join(has(right, "right"), keys, "full").na.fill(False)
    two = F.col("left") & F.col("right")
    cover = {"left_records": F.col("left"), "right_records": F.col("right"), "left_ok": F.col("left_ok"), "right_ok": F.col("right_ok"), "left_only": F.col("left") & ~F.col("right"), "right_only": F.col("right") & ~F.col("left"), "excluded_not_ok": two & ~(F.col("left_ok") & F.col("right_ok"))}
    coverage = all_.agg(*[F.count_if(c).alias(n) for n, c in cover.items()]).select(F.inline(F.array(*[row("coverage", n, F.col(n)) for n in cover])))
    # metrics and agreement: one aggregation over the pairs
    measures = {"n": F.count(F.lit(1))}
    for side in ("left", "right"):
        hit = lambda gold, said, side=side: F.count_if(((F.col("gold") == gold) if gold else F.lit(True)) & ((F.col(f"{side}_prediction") == said) if said else F.lit(True)))
        measures |= {f"{side}_accuracy": F.avg(F.coalesce(f"{side}_correct", F.lit(False)).cast("int")), f"{side}_mean_calls": F.avg(f"{side}_calls"), f"{side}_mean_executed": F.avg(f"{side}_executed"), f"{side}_mean_similarity": F.avg(f"{side}_similarity")}
        weighted = sum((hit(x, None) * 2.0 * hit(x, x) / F.greatest(hit(x, None) + hit(None, x), F.lit(1)) for x in labels), F.lit(0.0))
        measures[f"{side}_weighted_f1"] = weighted / F.greatest(sum((hit(x, None) for x in labels), F.lit(0)), F.lit(1))
    measures |= {f: F.count_if(f) for f in FLAGS}
    one = pairs.agg(*[m.alias(n) for n, m in measures.items()])
    one = one.withColumns({f"{m}_delta": F.col(f"right_{m}") - F.col(f"left_{m}") for m in ("accuracy", "weighted_f1")})
    names = [n for n in one.columns if n not in FLAGS]
    whole = one.select(F.inline(F.array(*[row("metrics", n, F.col(n)) for n in names], *[row("agreement", n, F.col(n)) for n in FLAGS])))
    counted = lambda section, rows, name: rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(section).alias("section"), "name", "value")
    flips = pairs.where(~F.col("left_prediction").eqNullSafe(F.col("right_prediction")))
    arrow = F.concat(F.coalesce("left_prediction", F.lit("none")), F.lit("->"), F.coalesce("right_prediction", F.lit("none")))
    return coverage.unionAll(whole).unionAll(counted("outcomes", pairs, F.col("outcome"))).unionAll(counted("categories", pairs, F.col("category"))).unionAll(counted("flips", flips, arrow))
