"""Pairs whose edits are found where their row is: as if they were spread, and without writing or dealing texts."""

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import linediff
from tests.test_linediff import cases


def test_edits_are_those_of_spread_pairs(spark, monkeypatch):
    """Also for texts and lines that are null, and with some pairs of each kind."""
    split = [(p, a.split("\n"), b.split("\n")) for p, a, b in cases()]
    odd = [("n1", None, ["a"]), ("n2", ["a"], None), ("n3", [], ["x"]), ("n4", ["a", None, "b"], ["a", None]), ("n5", [None, None], [None]), ("n6", ["x"], [])]
    df = spark.createDataFrame(split + odd, "path string, a array<string>, b array<string>")
    found = []
    for most in (50_000, 40, -1):
        monkeypatch.setattr(linediff, "LINES", most)
        found.append(sorted(tuple(r) for r in linediff.line_edits(df).collect()))
    assert len(found[0]) == len(split + odd) and found[0] == found[1] == found[2]


def test_replaying_neither_writes_nor_deals_texts(spark, monkeypatch):
    df = spark.createDataFrame([(p, a.split("\n"), b.split("\n")) for p, a, b in cases()], "path string, a array<string>, b array<string>")
    monkeypatch.setattr(type(df), "checkpoint", lambda *_, **__: pytest.fail("written"))
    found = linediff.with_edits(df).select("path", "b", linediff.replayed(F.col("a"), F.col("b"), F.col("edits")).alias("made"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert all(r["made"] == r["b"] for r in found.collect())


@pytest.mark.parametrize("counted", [False, True])
def test_texts_are_neither_written_nor_dealt(spark, monkeypatch, counted):
    df = spark.createDataFrame(cases(), "path string, a string, b string").withColumns({"lines": F.lit(7)} if counted else {})
    monkeypatch.setattr(type(df), "checkpoint", lambda *_, **__: pytest.fail("written"))
    found = linediff.unified_diffs(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count()


def test_long_pairs_are_told_by_numbers_alone(spark, monkeypatch):
    """The job that looks for them has no need of the texts; long pairs are spread whatever the form."""
    df = spark.createDataFrame(cases(), "path string, a string, b string")
    lines = lambda c: F.size(F.split(c, "\n"))
    want = sorted(tuple(r) for r in linediff.unified_diffs(df).collect())
    monkeypatch.setattr(linediff, "LINES", 40)
    unread = F.when(F.assert_true(F.col("path").isNull()).isNull(), F.col("a"))
    read = df.withColumns({"lines": F.lit(7), "a": unread})
    assert linediff.unified_diffs(read).columns == ["path", "diff"]  # made without running into the texts
    got = sorted(tuple(r) for r in linediff.unified_diffs(df.withColumn("lines", lines("a") + lines("b"))).collect())
    assert got == want
