import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import ranks
from pagequarry.sources import readers


def plain(rows):
    out, last = [], {}
    for k, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        last[k] = v if v is not None else last.get(k)
        out.append((k, at, last[k]))
    return out


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_fill_across_ranges(spark, share):
    """One key with nearly all rows, a null key, keys without any value."""
    rng = random.Random(int(share * 100))
    rows = [(rng.choice(["hot"] * 30 + ["a", "b", None]), i, rng.choice("xyz") if rng.random() < share else None) for i in range(3000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, at long, v string").repartition(5)
    got = ranks.filled_forward(df, ["k"], ["at"], ["v"])
    assert got.columns == ["k", "at", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


def test_fill_without_keys_of_several_columns(spark):
    rows = [(i, "p" if i % 40 == 7 else None, i if i % 100 == 3 else None) for i in range(1000)]
    got = ranks.filled_forward(spark.createDataFrame(rows, "at int, v string, w int"), [], ["at"], ["v", "w"]).collect()
    assert sorted(map(tuple, got)) == [(i, "p" if i >= 7 else None, (i - 3) // 100 * 100 + 3 if i >= 3 else None) for i in range(1000)]
    assert ranks.filled_forward(spark.createDataFrame([], "at int, v string"), [], ["at"], ["v"]).count() == 0


def test_one_log_file_in_many_splits(spark, tmp_path):
    """A file larger than a task: lines are numbered in order, and each finds the project named before it."""
    lines, want, project = [], [], None
    for i in range(5000):
        if i % 700 == 20:
            project = f"project {i}"
            lines.append(f"2025/01/01 Project changes for {project}")
        elif i % 3 == 0:
            lines.append(f"Code example created: Page ID: x|{i}, {i % 7} new code examples added")
            want.append((i + 1, project, "examples_created", f"x|{i}", i % 7))
        elif i % 3 == 1:
            lines.append(f"Page removed: Page ID: x|{i}")
            want.append((i + 1, project, "removed", f"x|{i}", None))
        else:
            lines.append("noise")
    (tmp_path / "run.log").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert spark.read.text(str(tmp_path / "run.log")).rdd.getNumPartitions() > 10
        numbered = readers.numbered_lines(spark, str(tmp_path / "run.log"))
        assert [(r["line_no"], r["line"]) for r in numbered.orderBy("line_no").collect()] == list(enumerate(lines, 1))
        got = readers.run_log(numbered).select("line_no", "project", "kind", "page_id", "count")
        assert [tuple(r) for r in got.orderBy("line_no").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ranges_share_the_work_on_one_key(spark):
    rows = spark.range(200_000).select(F.lit("one").alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 5000 == 0, F.col("id")).alias("v"))
    got = ranks.filled_forward(rows, ["k"], ["at"], ["v"])
    assert got.where(F.col("v") != F.floor(F.col("at") / 5000) * 5000).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = rows.repartitionByRange("k", "at").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 100_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
