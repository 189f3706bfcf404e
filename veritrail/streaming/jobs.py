"""Job rows: claiming, stages, leases and retries as batch transforms on a jobs table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The stages of a document in order.
STAGES = ("discovered", "parsed", "chunks_loaded", "first_extraction_done", "second_extraction_done", "second_extraction_skipped", "graph_committed",
          "complete", "complete_with_warnings", "failed")


def claimed(jobs: DataFrame, claimable: Column, order: Sequence[str], n: int, owner: str, id_col: str) -> DataFrame:
    """jobs with owner set on the first n claimable ones."""
    mine = jobs.where(claimable).orderBy(*order).limit(n).select(F.col(id_col).alias("_id"))
    return jobs.join(mine, jobs[id_col] == mine["_id"], "left").withColumn("owner", F.when(F.col("_id").isNotNull(), owner)).drop("_id")


def with_attempts(log: DataFrame, job: str, stage: str, order: Sequence[str]) -> DataFrame:
    """log with attempt: counted from 1 again whenever a job's stage changes."""
    own = Window.partitionBy(job).orderBy(*order)
    changed = F.coalesce(F.lag(stage).over(own) != F.col(stage), F.lit(True)).cast("int")
    runs = log.withColumn("_run", F.sum(changed).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("attempt", F.row_number().over(Window.partitionBy(job, "_run").orderBy(*order))).drop("_run")


def retry_decision(attempts: Column, cancel: Column, max_attempts: int = 3) -> Column:
    return F.when(cancel, "cancelled").when(attempts < max_attempts, "queued").otherwise("failed")


def retried(status: Column, mode: Column) -> Column:
    """struct<status, reset_counters, delete_entities> of a document for a retry mode."""
    fresh = mode.isin("start_from_beginning", "delete_entities_and_start_from_beginning")
    return F.struct(F.when(status == "processing", status).otherwise("ready_to_reprocess").alias("status"), fresh.alias("reset_counters"), (mode == "delete_entities_and_start_from_beginning").alias("delete_entities"))


def retryable(jobs: DataFrame, staged: DataFrame, on: str, kind: str = "extraction_error") -> DataFrame:
    """Jobs with a staged error; what succeeded is removed from the staging table by an anti-join on the result."""
    return jobs.join(staged.where(F.col("kind") == kind).select(on).distinct(), on, "left_semi")


def capacity(seconds: float, per_minute: int = 3) -> int:
    """How many documents fit before a deadline."""
    return int(max(0.0, seconds) * per_minute / 60)
