"""Scores of single records, comparison of two runs, and checks that stop a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import answers_match
from ..functions.text import normalize_answer, strip
from .sampling import ranked


def record_scores(facts: Column, conclusions: Column, prediction: Column, gold: Column, reasoning: Column, n_reference: Column, labels: Sequence[str] = ("support", "reject")) -> list[Column]:
    """Scores of one record, as columns.

    facts: array of ids; conclusions: array of structs with issue_id, supporting, opposing (arrays of
    fact ids) and conclusion. A rate of nothing is 1 for references to facts, 0 for conclusions with
    facts, null for issues.
    """
    cited = F.flatten(F.transform(conclusions, lambda c: F.concat(c["supporting"], c["opposing"])))
    valid = F.size(F.filter(cited, lambda x: F.array_contains(facts, x)))
    n = F.size(conclusions)
    share = lambda test: F.size(F.filter(conclusions, test)) / n
    issues = F.size(F.array_distinct(F.transform(conclusions, lambda c: c["issue_id"])))
    return [
        answers_match(prediction, gold).cast("double").alias("answer_correct"),
        F.coalesce(prediction.isin(*labels), F.lit(False)).cast("double").alias("prediction_valid"),
        (strip(reasoning) != "").cast("double").alias("reasoning_present"),
        F.when(n > 0, share(lambda c: F.size(F.concat(c["supporting"], c["opposing"])) > 0)).otherwise(0.0).alias("conclusion_with_fact_rate"),
        F.when(F.size(cited) > 0, valid / F.size(cited)).otherwise(1.0).alias("valid_fact_rate"),
        (F.size(cited) - valid).cast("long").alias("unknown_facts"),
        F.when((n > 0) & (n_reference > 0), F.least(issues / n_reference, F.lit(1.0))).alias("issue_coverage"),
        F.when(n > 0, share(lambda c: c["conclusion"] == "unresolved")).alias("unresolved_rate"),
    ]


def robustness(originals: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """key, kind, same, expected_same, success of each variant with an original: only an irrelevant_fact may not change the prediction."""
    old = originals.select(key, normalize_answer(F.col("prediction")).alias("__old"))
    same, expected = normalize_answer(F.col("prediction")) == F.col("__old"), F.col("kind").eqNullSafe(F.lit("irrelevant_fact"))
    return variants.join(old, key).select(key, "kind", same.alias("same"), expected.alias("expected_same"), (same == expected).alias("success"))


def number(c: Column) -> Column:
    return F.btrim(c.cast("string")).try_cast("double")


def checkpoint_ranking(rows: DataFrame, tag: str, name: str = "place") -> DataFrame:
    """rows with their place: accuracy and weighted F1 falling, calls rising, then the tag; what is no number comes last."""
    keyed = rows.withColumns({"__a": -F.coalesce(number(F.col("accuracy")), F.lit(float("-inf"))), "__f": -F.coalesce(number(F.col("weighted_f1")), F.lit(float("-inf"))), "__c": F.coalesce(number(F.col("calls")), F.lit(float("inf")))})
    return ranked(keyed, ["__a", "__f", "__c", tag], name).drop("__a", "__f", "__c")


def compare_runs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, gold, left and right prediction, transition of the records of both runs; a gold that differs is an error.

    left, right: key, gold, prediction, of one run each (`only_once`). A null prediction is an error
    record, and its pair is left out.
    """
    a = only_once(left, key).select(key, F.col("gold"), F.col("prediction").alias("left"))
    b = only_once(right, key).select(key, F.col("gold").alias("__gold"), F.col("prediction").alias("right"))
    ok = F.when(F.col("gold").eqNullSafe(F.col("__gold")), True).otherwise(F.raise_error(F.concat(F.lit("gold differs: "), F.col(key).cast("string"))).cast("boolean"))
    pairs = a.join(b, key).where(ok).where("left is not null and right is not null")
    x, y = F.col("left") == F.col("gold"), F.col("right") == F.col("gold")
    return pairs.select(key, "gold", "left", "right", F.when(x & y, "both_correct").when(x, "left_only").when(y, "right_only").otherwise("neither").alias("transition"), (F.col("left") != F.col("right")).alias("flipped"))


def run_summary(pairs: DataFrame) -> DataFrame:
    """One row: n, accuracy of both runs, delta, transitions and flips of compare_runs()."""
    n = lambda t: F.count_if(F.col("transition") == t)
    out = pairs.agg(F.count(F.lit(1)).alias("n"), *[n(t).alias(t) for t in ("both_correct", "left_only", "right_only", "neither")], F.count_if("flipped").alias("flips"))
    rate = lambda a: F.try_divide((F.col("both_correct") + F.col(a)).cast("double"), F.col("n").cast("double"))
    return out.withColumns({"left_accuracy": rate("left_only"), "right_accuracy": rate("right_only")}).withColumn("delta", F.col("right_accuracy") - F.col("left_accuracy"))


def only_once(df: DataFrame, *key: str) -> DataFrame:
    """df; fails at run time if a key occurs twice."""
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated: "), name))).cast("int")
    counts = df.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.count(F.lit(1)).alias("__n"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return df.join(counts, same).withColumn("__bad", checked).where("__bad is null").select(*df.columns)


def known_only(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """df; fails at run time if a key is not among the known ones."""
    marked = df.join(known.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    ok = F.when(F.col("__known"), True).otherwise(F.raise_error(F.concat(F.lit("unknown id: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return marked.where(ok).select(*df.columns)


def aligned(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """The inner join by key; fails at run time where the labels differ."""
    other = right.withColumnRenamed(label, "__label")
    ok = F.when(F.col(label).eqNullSafe(F.col("__label")), True).otherwise(F.raise_error(F.concat(F.lit("label differs: "), F.col(key).cast("string"))).cast("boolean"))
    return left.join(other, key).where(ok).drop("__label")


def covered(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows; fails at run time if a wanted key has none."""
    all_ = wanted.select(key).distinct().join(rows.withColumn("__there", F.lit(True)), key, "left")
    ok = F.when(F.col("__there"), True).otherwise(F.raise_error(F.concat(F.lit("not covered: "), F.col(key).cast("string"))).cast("boolean"))
    return all_.where(ok).select(*rows.columns)


def guard(settings: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """settings (name, value); fails at run time where a stored setting has another value, unless force."""
    if force:
        return settings
    old = stored.select("name", F.col("value").alias("__old"), F.lit(True).alias("__stored"))
    ok = F.when(F.coalesce("__stored", F.lit(False)) & ~F.col("value").eqNullSafe(F.col("__old")), F.raise_error(F.concat(F.lit("setting differs: "), F.col("name"))).cast("boolean")).otherwise(True)
    return settings.join(old, "name", "left").where(ok).select(*settings.columns)


def ordered_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by order, of each value of the keys (nulls are a value)."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return first.select("__r.*")


def pivoted(df: DataFrame, key: str, column: str, values: Sequence[str], value: str, order: Column | str) -> DataFrame:
    """One row a key with a column for each of the given values; of several rows the last by order stands."""
    return df.groupBy(key).pivot(column, list(values)).agg(F.max_by(value, order))


def review_contexts(steps: Column, artifacts: Column, reviews: Column, max_steps: int) -> Column:
    """What each review of a case was shown, replayed from the order of its reviews: array of (decision, force, executed, remaining, signature).

    steps: the planned ones; reviews: array of (decision, steps), null ones are passed over. A review after the i-th step sees
    what remains after it and must answer if nothing does or max_steps are done; a later one sees no
    steps and must answer. A revision replaces what remains. One fold a row, whatever the number of reviews.
    """
    none = F.slice(steps, F.lit(1), F.lit(0))
    n = F.coalesce(F.size(artifacts), F.lit(0))

    def fold(acc: Column, i: Column) -> Column:
        review, during = F.get(reviews, i), i < n
        shown = F.when(during, F.slice(acc["remaining"], F.lit(2), F.greatest(F.size(acc["remaining"]) - 1, F.lit(0)))).otherwise(none)
        executed = F.when(during, i + 1).otherwise(n)
        force = ~during | (F.size(shown) == 0) | (executed >= max_steps)
        signature = F.sha2(F.to_json(F.struct(F.slice(artifacts, F.lit(1), executed).alias("executed"), shown.alias("remaining"), force.alias("force"))), 256)
        context = F.struct(review["decision"].alias("decision"), force.alias("force"), executed.alias("executed"), shown.alias("remaining"), signature.alias("signature"))
        left = F.when(review["decision"] == "revise", F.coalesce(review["steps"], none)).when(during, shown).otherwise(acc["remaining"])
        moved = F.struct(left.alias("remaining"), F.array_append(acc["out"], context).alias("out"))
        return F.when(review.isNull(), acc).otherwise(moved)

    kind = F.struct(F.lit(None).cast("string").alias("decision"), F.lit(False).alias("force"), F.lit(0).alias("executed"), none.alias("remaining"), F.lit("").alias("signature"))
    start = F.struct(F.coalesce(steps, none).alias("remaining"), F.slice(F.array(kind), F.lit(1), F.lit(0)).alias("out"))
    places = F.when(F.size(reviews) > 0, F.sequence(F.lit(0), F.size(reviews) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, fold, lambda acc: acc["out"])


def final_context(contexts: Column) -> Column:
    """The signature of the last review that answered; null if none did."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(contexts, lambda c: c["decision"] == "final_answer"), lambda c: c["signature"])), -1)
