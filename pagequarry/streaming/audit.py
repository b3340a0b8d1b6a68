"""The audit log as a stream: daily volumes with a watermark, and running statistics by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_volume(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, count) in append mode: a day comes out once events can't be later than it by `late`."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("count")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "count")


def stats_by_rule(events: DataFrame) -> DataFrame:
    """Running totals by rule, for update or complete mode; one row of state a rule."""
    ok = F.coalesce("success", F.lit(False))
    return events.where(F.col("event_type") == "copy").groupBy("rule_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
