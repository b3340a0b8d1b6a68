import datetime

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import events as batch
from pagequarry.plans import fixtures as X
from pagequarry.streaming import audit, metrics

from .oracle import SF


@pytest.fixture(autouse=True)
def state_store(spark):
    for k, v in metrics.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in metrics.STATE_STORE:
        spark.conf.unset(k)


def run(spark, stream, checkpoint, into, mode="update"):
    """Runs a stream over what is there; returns the rows of each batch in turn."""
    batches = {}
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: batches.update({n: [tuple(r) for r in df.collect()]})).trigger(availableNow=True).queryName(into).start()
    assert q.awaitTermination(300)
    return batches


def rounded(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


def test_last_samples_equal_a_batch_window(spark, tmp_path):
    """Out of order, in several files and two runs: the state is carried on, and the last row of each rule is the batch's."""
    events = X.audit(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [events.where(F.col("event_id") % 3 == k) for k in (2, 0, 1)]
    stream = lambda: metrics.last_samples(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 100, late="60 days")
    for p in parts[:2]:
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = run(spark, stream(), str(tmp_path / "check"), "first")
    parts[2].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen |= run(spark, stream(), str(tmp_path / "check"), "second")
    assert len(seen) >= 3
    last = {r[0]: r for n in sorted(seen) for r in seen[n]}
    want = batch.last_samples(events, 100).select("rule_name", "samples", "avg_ms", "min_ms", "max_ms", "p50", "p95", "p99").collect()
    assert rounded(last.values()) == rounded(map(tuple, want)) and {r[1] for r in last.values()} == {100}


def test_idle_rules_are_cleared(spark, tmp_path):
    day = lambda d: datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(days=d)
    schema = "event_id long, ts timestamp, rule_name string, duration_ms long"
    files = [[(1, day(0), "old", 10), (2, day(0), "new", 1), (9, day(0), None, 4), (10, day(0), "x", None)], [(3, day(20), "new", 3)], [(4, day(21), "new", 5)], [(5, day(22), "old", 7)]]
    stream = lambda: metrics.last_samples(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, late="1 hour", idle="5 days")
    got = []
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = run(spark, stream(), str(tmp_path / "check"), f"idle{i}")
        got.append(sorted((r[0], r[1], r[5]) for n in sorted(seen) for r in seen[n]))
    assert got[0] == [("", 1, 4.0), ("new", 1, 1.0), ("old", 1, 10.0)]
    flat = [r for g in got[1:] for r in g]
    assert ("new", 2, 4.0) in flat and ("old", 0, None) in flat  # gone after five days without events
    assert ("old", 1, 7.0) in got[3] and ("old", 2, 8.5) not in flat  # and starts anew


def test_daily_volume_of_a_stream(spark, tmp_path):
    events = X.audit(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    seen = run(spark, audit.daily_volume(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "check"), "days", "append")
    got = dict(r for n in seen for r in seen[n])
    want = {r["day"]: r["count"] for r in batch.daily_volume(events, "2024-02-10", 100).collect()}
    assert got.items() <= want.items() and len(got) >= len(want) - 1  # the last day is still open
