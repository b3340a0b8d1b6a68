"""Operators over the audit log and request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recent_events(events: DataFrame, limit: int) -> DataFrame:
    """The latest events; ties by id. Each task keeps its own `limit` rows."""
    return events.orderBy(F.desc("ts"), "event_id").limit(limit)


def failed_events(events: DataFrame, limit: int) -> DataFrame:
    return recent_events(events.where(~F.col("success")), limit)


def events_of_rule(events: DataFrame, rule: str, limit: int) -> DataFrame:
    return recent_events(events.where(F.col("rule_name") == rule), limit)


def stats_by_rule(events: DataFrame) -> DataFrame:
    """Copies by rule: all, succeeded, failed (unknown counts as failed), and the mean of the durations that are known."""
    ok = F.coalesce("success", F.lit(False))
    return events.where(F.col("event_type") == "copy").groupBy("rule_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"))


def daily_volume(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """(day, count) of the days up to as_of."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    return events.where(F.col("ts") >= since).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("count"))


def processing_metrics(events: DataFrame, samples: int = 1000) -> DataFrame:
    """Counters, rates and durations of the last `samples` events with a duration.

    approx_p50, approx_p95 and approx_p99 are 1, 1.5 and 2 times the mean, for those who compare with such reports;
    p50, p95 and p99 are percentiles of the sample.
    """
    ok = F.coalesce("success", F.lit(False))
    counters = events.agg(F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"))
    last = events.where(F.col("duration_ms").isNotNull()).orderBy(F.desc("ts"), "event_id").limit(samples)
    d = F.col("duration_ms")
    times = last.agg(F.round(F.avg(d), 6).alias("avg_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), *[F.expr(f"percentile(duration_ms, {p})").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])
    rates = {"success_rate": F.coalesce(F.try_divide(F.col("processed") * 100.0, F.col("received")), F.lit(0.0)), "error_rate": F.coalesce(F.try_divide(F.col("failed") * 100.0, F.col("received")), F.lit(0.0))}
    approx = {"approx_p50": F.col("avg_ms"), "approx_p95": F.col("avg_ms") * 1.5, "approx_p99": F.col("avg_ms") * 2}
    return counters.join(times).withColumns(rates | approx)


def last_samples(events: DataFrame, samples: int = 1000) -> DataFrame:
    """By rule, durations of its last `samples` events with one: how many, mean, extremes and percentiles. Each task drops
    what can't be among them before rules come together."""
    w = Window.partitionBy("rule_name").orderBy(F.desc("ts"), "event_id")
    known = events.where(F.col("duration_ms").isNotNull()).select(F.coalesce("rule_name", F.lit("")).alias("rule_name"), "ts", "event_id", "duration_ms")
    last = known.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= samples)
    d = F.col("duration_ms")
    return last.groupBy("rule_name").agg(F.count(F.lit(1)).alias("samples"), F.avg(d).alias("avg_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), *[F.expr(f"percentile(duration_ms, {p})").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])


def audit_rows(events: DataFrame) -> DataFrame:
    """Events as they are appended: errors are never successes."""
    return events.withColumn("success", F.when(F.col("event_type") == "error", False).otherwise(F.col("success")))


def changed_under(files: DataFrame, prefix: str) -> DataFrame:
    return files.agg(F.count_if(F.col("path").startswith(prefix)).alias("count"))
