"""Plan, retrieve, execute, review: multi-call loops around models, as a frontier of open cases that shrinks each turn.

The calls are injected batch functions from records to replies; a reply that is an exception is a
failure of its case, a row and not the end of the job. All cases move together, a step a turn, so the
number of Spark jobs depends on the number of steps, not on the number of cases. Every batch of calls is a stage, which is
written under run_dir: a run that was killed goes on with the first stage that is not complete, and
no call of a complete stage is made again. Cases are dealt over all cores once, before the first stage;
calls hand their rows on, so that no later stage shuffles them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import exists
from ..sources.tables import cut, release, spread
from . import similarity

#: Distinct requests for an item that are broadcast; of more of them, only those of over OFTEN cases are, and the rest are joined.
REQUESTS, OFTEN = 1 << 16, 4096

STEP, STEP_DDL = pa.struct([("name", pa.string()), ("tags", pa.list_(pa.string()))]), "struct<name:string,tags:array<string>>"
REVIEW = pa.struct([("decision", pa.string()), ("answer", pa.string()), ("steps", pa.list_(STEP))])
REVIEW_DDL = f"struct<decision:string,answer:string,steps:array<{STEP_DDL}>>"

#: Records of a batch (dicts) to their replies, in order; a reply may be an exception.
Call = Callable[[list[dict]], list]
#: Steps (step, name, tags) and items to scores (step, item, score).
Scores = Callable[[DataFrame, DataFrame], DataFrame]


def plain(column: pa.Array) -> list:
    """The column's to_pylist(), taken a column of leaves at a time: nested records are several times cheaper so."""
    kind = column.type
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, r)) for r in zip(*map(plain, column.flatten()))]
    elif pa.types.is_list(kind):
        flat = plain(column.flatten())
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        out = [flat[i:j] for i, j in zip([0, *ends], ends)]
    elif pa.types.is_string(kind) or (not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    return [x if ok else None for x, ok in zip(out, column.is_valid().to_pylist())] if column.null_count else out


def ask(rows: DataFrame, record: Sequence[Column | str], call: Call, kind: pa.DataType, ddl: str) -> DataFrame:
    """rows with the reply and the failure of a call for each, which is shown the columns of record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = call(plain(b.column(b.num_columns - 1)))
            failed = [isinstance(x, Exception) for x in out]
            replies = [pa.array([None if f else x for x, f in zip(out, failed)], kind), pa.array([str(x) or type(x).__name__ if f else None for x, f in zip(out, failed)], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *replies], [*b.schema.names[:-1], "reply", "failure"])

    names = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.withColumn("_record", F.struct(*record)).mapInArrow(run, f"{names}, reply {ddl}, failure string")


def shared_tags(steps: DataFrame, items: DataFrame) -> DataFrame:
    """step, item, score: the share of the step's tags that the item has too."""
    n = steps.select("step", F.size("tags").alias("n"))
    found = similarity.tag_overlap(steps, items, "step", "item", "tags").join(n, "step")
    return found.select("step", "item", (F.col("n_shared") / F.greatest(F.lit(1), F.col("n"))).alias("score"))


class Run:
    """The stages of a run under run_dir, each computed once."""

    def __init__(self, run_dir: str) -> None:
        self.dir, self.n = run_dir, 0

    def stage(self, name: str, make: Callable[[], DataFrame], df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, f"{self.dir}/{self.n:02d}_{name}"
        self.n += 1
        if not exists(spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def failed(state: DataFrame) -> DataFrame:
    """Open cases whose call failed are errors."""
    bad = (F.col("status") == "open") & F.col("failure").isNotNull()
    return state.withColumns({"error": F.when(bad, F.col("failure")).otherwise(F.col("error")), "status": F.when(bad, "error").otherwise(F.col("status"))})


def planned(cases: DataFrame, planner: Call, max_steps: int) -> DataFrame:
    """The state of cases (case, text) after the planning call: at most max_steps steps remain."""
    state = ask(spread(cases.select("case", "text"), "case"), ["case", "text"], planner, pa.list_(STEP), f"array<{STEP_DDL}>")
    return failed(fresh(state, F.coalesce("reply", F.array().cast(f"array<{STEP_DDL}>")), max_steps).withColumn("calls", F.lit(1))).drop("reply", "failure")


def fresh(rows: DataFrame, steps: Column, max_steps: int) -> DataFrame:
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.withColumns({
        "remaining": F.slice(steps, 1, max_steps), "artifacts": none("struct<name:string,item:string,mode:string,score:double,result:string>"), "reviews": none("string"), "repairs": none("string"),
        "calls": F.lit(0), "status": F.lit("open"), "answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string"),
    })


def retrieved(state: DataFrame, items: DataFrame, scores: Scores) -> DataFrame:
    """state with item, mode and score for the first remaining step of every case: an item that the case has not used.

    Cases that ask for one name and tags and have used the same items are given the same, so each
    such request is answered once. A request of many cases is never a key of a shuffle.
    """
    head = F.get("remaining", 0)
    want = F.struct(head["name"].alias("name"), head["tags"].alias("tags"), F.array_sort(F.array_distinct("artifacts.item")).alias("used"))
    rows = state.withColumn("want", want)
    requests = cut(rows.groupBy("want").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.monotonically_increasing_id()), shuffled=True)
    steps = requests.select("step", "want.name", "want.tags")
    used = requests.select("step", F.explode("want.used").alias("item"))
    found = cut(requests.join(similarity.cascade(steps, items, scores(steps, items), used), "step").select("want", "n", "item", "mode", "score"), shuffled=True)
    bar = 0 if found.count() <= REQUESTS else OFTEN
    release(requests)
    often = F.broadcast(found.where(F.col("n") > bar).drop("n"))
    out = rows.join(often, "want")
    if bar:
        out = out.unionByName(rows.join(often.select("want"), "want", "left_anti").join(found.where(F.col("n") <= bar).drop("n"), "want"))
    return out.drop("want")


def executed(state: DataFrame, items: DataFrame, executor: Call, scores: Scores) -> DataFrame:
    """The state after the first remaining step of every case: an item is retrieved, and the call made."""
    head = F.get("remaining", 0)
    rows = retrieved(state, items, scores)
    done = ask(rows, ["case", "text", head.alias("step"), "item", "artifacts"], executor, pa.string(), "string")
    artifact = F.struct(head["name"].alias("name"), F.col("item").cast("string").alias("item"), "mode", "score", F.col("reply").alias("result"))
    ok = F.col("failure").isNull()
    moved = done.withColumns({"artifacts": F.when(ok, F.array_append("artifacts", artifact)).otherwise(F.col("artifacts")), "remaining": F.slice("remaining", F.lit(2), F.greatest(F.size("remaining") - 1, F.lit(0))), "calls": F.col("calls") + 1})
    return failed(moved).select(*state.columns)


def reviewed(state: DataFrame, reviewer: Call, labels: Sequence[str], max_steps: int, force: bool = False) -> DataFrame:
    """The state after a review of every case: it goes on, gets other steps, or is answered; forced: it must be answered.

    An answer that is no label ends the steps of a case, which is then reviewed once more by force.
    """
    must = F.lit(force) | (F.size("remaining") == 0) | (F.size("artifacts") >= max_steps)
    steps = F.when(F.lit(force), F.array().cast(f"array<{STEP_DDL}>")).otherwise(F.col("remaining"))
    done = ask(state, ["case", "text", "artifacts", steps.alias("remaining"), must.alias("force")], reviewer, REVIEW, REVIEW_DDL)
    what, ok = F.coalesce(F.col("reply.decision"), F.lit("")), F.col("failure").isNull()
    final, revise = ok & (what == "final_answer"), ok & (what == "revise") & ~F.lit(force)
    good = final & (F.lit(force) | F.coalesce(F.col("reply.answer").isin(*labels), F.lit(False)))
    left = F.slice(F.coalesce("reply.steps", F.array().cast(f"array<{STEP_DDL}>")), F.lit(1), F.lit(max_steps) - F.size("artifacts"))
    note = F.when(final & ~good, F.array(F.lit("final_answer_missing_label_forced_retry"))).when(revise, F.array(F.lit("remaining_trajectory_revised"))).otherwise(F.array().cast("array<string>"))
    moved = done.withColumns({
        "reviews": F.when(ok, F.array_append("reviews", what)).otherwise(F.col("reviews")), "repairs": F.concat("repairs", note), "calls": F.col("calls") + 1,
        "answer": F.when(good, F.col("reply.answer")), "remaining": F.when(final, F.array().cast(f"array<{STEP_DDL}>")).when(revise, left).otherwise(F.col("remaining")),
        "status": F.when(good, "ok").when(F.lit(force) & ok, "error").otherwise(F.col("status")), "error": F.when(F.lit(force) & ok & ~good, "ended without a final answer"),
    })
    return failed(moved).select(*state.columns)


def trajectories(cases: DataFrame, items: DataFrame, executor: Call, reviewer: Call, labels: Sequence[str], run_dir: str, planner: Call | None = None, scores: Scores = shared_tags, max_steps: int = 4, review_each: bool = True) -> DataFrame:
    """case, status, answer, error, artifacts, reviews, repairs, calls of every case (case, text; steps where no planner is given).

    items: item, name, tags, position. With review_each a review follows each step and may revise the
    steps that remain; without, all planned steps are executed and one forced review ends the case.
    """
    run = Run(run_dir)
    start = (lambda: planned(cases, planner, max_steps)) if planner else (lambda: fresh(spread(cases.select("case", "text", "steps"), "case"), F.col("steps"), max_steps).drop("steps"))
    state = run.stage("plan", start, cases)
    finished = []
    for _ in range(max_steps):
        can = (F.col("status") == "open") & (F.size("remaining") > 0) & (F.size("artifacts") < max_steps)
        open_ = state.where(can)
        if open_.isEmpty():
            break
        finished.append(state.where(~can))
        state = run.stage("execute", lambda o=open_: executed(o, items, executor, scores), cases)
        if review_each:
            alive, dead = state.where("status = 'open'"), state.where("status <> 'open'")
            finished.append(dead)
            state = run.stage("review", lambda a=alive: reviewed(a, reviewer, labels, max_steps), cases)
    finished.append(state)
    whole = finished[0]
    for part in finished[1:]:
        whole = whole.unionAll(part)
    waits = (F.col("status") == "open") & (F.size("artifacts") > 0)
    last = run.stage("final", lambda: reviewed(whole.where(waits), reviewer, labels, max_steps, force=True), cases)
    out = whole.where(~waits).unionAll(last)
    stuck = F.col("status") == "open"
    out = out.withColumns({"error": F.when(stuck, "ended without a final answer").otherwise(F.col("error")), "status": F.when(stuck, "error").otherwise(F.col("status"))})
    return out.select("case", "status", "answer", "error", "artifacts", "reviews", "repairs", "calls")


def replayed_reviews(ledger: DataFrame, reviewer: Call, labels: Sequence[str], run_dir: str) -> DataFrame:
    """case, source_answer, status, answer, error, changed: the final review of stored trajectories, made again.

    ledger: case, text, answer, artifacts of a finished run. No step is executed again; cases without artifacts
    are left out, since nothing of theirs can be reviewed. An answer that is no label is an error.
    """
    empty = F.array().cast(f"array<{STEP_DDL}>")
    rows = ledger.where(F.size("artifacts") > 0)
    state = fresh(rows.select("case", "text"), empty, 1).drop("artifacts").join(rows.select("case", "artifacts"), "case")
    done = Run(run_dir).stage("replay", lambda: reviewed(state, reviewer, labels, 0, force=True), ledger)
    valid = F.coalesce(F.col("answer").isin(*labels), F.lit(False))
    bad = (F.col("status") == "ok") & ~valid
    out = done.withColumns({"status": F.when(bad, "error").otherwise(F.col("status")), "error": F.when(bad, "the answer is no label").otherwise(F.col("error"))})
    old = rows.select("case", F.col("answer").alias("source_answer"))
    changed = F.when(F.col("status") == "ok", ~F.col("source_answer").eqNullSafe(F.col("answer")))
    return out.join(old, "case").select("case", "source_answer", "status", F.when(F.col("status") == "ok", F.col("answer")).alias("answer"), "error", changed.alias("changed"))
