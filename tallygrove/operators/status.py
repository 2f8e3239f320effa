"""The status document of batch runs, folded from an append-only log of what they did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("start", "step", "progress", "ok", "failed", "finish")


def _in_order(value: Column) -> Column:
    """The values of a group by (at, seq), nulls left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("at", "seq", value.alias("value"))))), lambda x: x["value"])


def run_status(log: DataFrame, *, error_chars: int = 300) -> DataFrame:
    """One document of each (job, run) of a log (job, run, at, seq, kind, step, done, total, error; kind is one of KINDS, (at, seq) is unique within a run).

    A step begins without progress; a failure takes the progress of the step in which it is told, and error_chars of its error. A run with a finish has failed if it
    has a failure, else it is done, and is in no step. last_done_at is when the job's latest run before it that was done ended. progress_at is the latest
    start, step or progress. Rows of other kinds count as nothing; a run without a start began at its first row. Windows are over one run, and over the runs of a job.
    """
    known = log.filter(F.col("kind").isin(*KINDS))
    begun = W.partitionBy("job", "run").orderBy("at", "seq")
    rows = known.withColumn("step_no", F.count_if(F.col("kind") == "step").over(begun))
    within = W.partitionBy("job", "run", "step_no").orderBy("at", "seq")
    is_kind = lambda *kinds: F.col("kind").isin(*kinds)
    for c in ("done", "total"):
        rows = rows.withColumn(c, F.last(F.when(is_kind("progress"), F.col(c)), ignorenulls=True).over(within))
    failure = F.when(is_kind("failed"), F.struct("step", F.substring("error", 1, error_chars).alias("error"), "at", "done", "total"))
    latest = lambda value: F.max_by(value, F.struct("at", "seq"))
    runs = rows.groupBy("job", "run").agg(
        F.coalesce(F.max(F.when(is_kind("start"), F.col("at"))), F.min("at")).alias("started_at"), F.max(F.when(is_kind("finish"), F.col("at"))).alias("finished_at"),
        F.max_by(F.when(is_kind("step"), F.struct("step", "at")), F.when(is_kind("step"), F.struct("at", "seq"))).alias("last"),
        latest(F.struct("done", "total")).alias("state_of_step"), F.max(F.when(is_kind("start", "step", "progress"), F.col("at"))).alias("progress_at"),
        _in_order(F.when(is_kind("ok"), F.col("step"))).alias("completed_steps"), _in_order(failure).alias("failures"),
    )
    state = F.when(F.col("finished_at").isNull(), "running").when(F.size("failures") > 0, "failed").otherwise("done")
    before = W.partitionBy("job").orderBy("started_at", "run").rowsBetween(W.unboundedPreceding, -1)
    told = runs.withColumn("state", state).withColumn("last_done_at", F.last(F.when(F.col("state") == "done", F.col("finished_at")), ignorenulls=True).over(before))
    return told.select(
        "job", "run", "state", "started_at", "finished_at", F.when(F.col("finished_at").isNull(), F.col("last.step")).alias("step"), F.col("last.at").alias("step_started_at"),
        F.col("state_of_step.done").alias("step_done"), F.col("state_of_step.total").alias("step_total"), "progress_at", "completed_steps", "failures", "last_done_at",
    )


def current(status: DataFrame) -> DataFrame:
    """The document of each job's latest run."""
    newest = F.max_by(F.struct(*status.columns), F.struct("started_at", "run"))
    return status.groupBy("job").agg(newest.alias("of")).select("of.*")
