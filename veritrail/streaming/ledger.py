"""Usage ledgers as aggregations by day and month instead of counters that a job resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def used_tokens() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def daily_usage(events: DataFrame, limit: int) -> DataFrame:
    """user_id, day, used, remaining (never under 0)."""
    used = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(used_tokens()).alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0).cast("long")))


def monthly_usage(events: DataFrame, limit: int) -> DataFrame:
    used = events.groupBy("user_id", F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.sum(used_tokens()).alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0).cast("long")))
