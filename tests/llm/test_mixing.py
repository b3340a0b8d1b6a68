import math
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import mixing as M

SCHEMA = "doc_id long, text string, source string"


def make(spark, n=4000, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * max(0, int(rng.paretovariate(1.2) * 5))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Round by round: share what is left by weight, fix the sources above their limit."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = {}
    while True:
        free = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        at = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if at[s] > most * sizes[s]]
        if not over:
            return at | capped
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 100}, {"a": 10, "b": 10, "c": 980}, {"a": 0, "b": 0}, {"é": 5, "z": 7, "Z": 900, "": 1, None: 3}, {f"s{i}": i * i for i in range(60)}])
def test_targets(spark, sizes):
    sums = spark.createDataFrame([("t" if s is None else "s" + s, n) for s, n in sizes.items()], "skey string, total long")
    got = {None if r["skey"] == "t" else r["skey"][1:]: r["target"] for r in M.targets(sums).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def plain_dual(sizes, target):
    """By bisection: x at which the capped tilt takes the target's words."""
    mean = sum(sizes) / len(sizes)
    lo, hi = -1e6, 1e6
    for _ in range(200):
        x = (lo + hi) / 2
        lo, hi = (lo, x) if sum(n * math.exp(max(-700, min(x * n / mean, math.log(3)))) for n in sizes) > target else (x, hi)
    return x


def test_duals_agree_with_bisection(spark):
    rng = random.Random(4)
    by_source = {f"s{k}": [1 + int(rng.paretovariate(1.1) * 4) for _ in range(200)] for k in range(12)}
    want = {k: plain_dual(v, sum(v) * (0.05 + 0.24 * i)) for i, (k, v) in enumerate(by_source.items())}
    by_size = spark.createDataFrame([(k, n) for k, v in by_source.items() for n in v], "skey string, size long").groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame([(k, len(v), sum(v), sum(v) / len(v), sum(v) * (0.05 + 0.24 * i)) for i, (k, v) in enumerate(by_source.items())], "skey string, many long, total long, mean double, target double")
    got = {r["skey"]: r["x"] for r in M.solve(by_size, table, tolerance=1e-9).collect()}
    assert got == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    df = make(spark)
    want = sorted(map(str, M.mix(df).select("doc_id", "copies").collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, M.mix(df).select("doc_id", "copies").collect())) == want


def test_many_sources_meet_the_targets(spark):
    rows = M.mix(spark.range(30000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3000).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text")))
    per = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min("size").alias("least")).toPandas()
    assert len(per) == 3000 and ((per["taken"] - per["target"]).abs() <= per["least"]).mean() > 0.99


def test_repeated_ids_of_other_texts_and_null_ids(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, i % 50, 2**60 + i]), " ".join(["w"] * rng.randint(1, 40)) + f" {i}", "a" if i % 3 else "b") for i in range(600)]
    got = M.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 600
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 45


def test_taken_words_meet_the_targets(spark):
    rows = M.mix(make(spark)).toPandas()
    assert len(rows) == 4000
    assert (rows["copies"] <= 3).all() and (rows["copies"] >= 0).all()
    assert (rows["taken"] == rows["copies"] * rows["size"]).all()
    for _, part in rows.groupby(rows["source"].fillna("none")):
        assert part["source_size"].iloc[0] == part["size"].sum()
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= max(0.01 * part["target"].iloc[0], part["size"].min() + 5)


def test_rates_are_the_dual_solution(spark):
    """The rates meet the constraint, and are an exponential tilt up to the cap."""
    rows = M.mix(make(spark)).where("size > 0").toPandas()
    for _, part in rows.groupby(rows["source"].fillna("none")):
        assert (part["rate"] * part["size"]).sum() == pytest.approx(part["target"].iloc[0], rel=2e-4)
        free = part[(part["rate"] < 3) & (part["rate"] > 1e-300)]
        logs = (free["rate"].map(math.log) / free["size"]).round(9)
        assert logs.max() - logs.min() < 1e-6


@pytest.mark.parametrize("share", [0.0001, 0.01, 0.5, 1.0, 2.5, 2.995, 2.99999])
def test_one_giant_document(spark, share):
    """A source of one document of a million words and a thousand of ten: no target is out of reach, and none raises."""
    table = spark.createDataFrame([("s", 1001, 1_010_000, 1_010_000 / 1001, 1_010_000 * share)], "skey string, many long, total long, mean double, target double")
    by_size = spark.createDataFrame([("s", 1_000_000, 1), ("s", 10, 1000)], "skey string, size long, n long")
    r = M.solve(by_size, table).first()
    taken = sum(k * n * math.exp(max(-700.0, min(r["x"] * n / r["mean"], math.log(3)))) for n, k in ((1_000_000, 1), (10, 1000)))
    assert taken == pytest.approx(r["target"], rel=2e-4)


def test_giant_document_of_a_mix(spark):
    rows = [(0, "w " * 300_000, "a")] + [(i, "w " * 10, "a" if i % 2 else "b") for i in range(1, 1200)]
    got = M.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 300_000 * (part["size"].max() > 10) + 10
    assert (got["copies"] <= 3).all() and len(got) == 1200


def test_reruns_agree(spark):
    df = make(spark, 800)
    a, b = (sorted(M.mix(x).select("doc_id", "copies").collect()) for x in (df, df.repartition(5)))
    assert a == b


def test_hot_source_nulls_repeats_and_empty(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = M.mix(spark.createDataFrame([(1, None, "a"), (2, "", "a")], SCHEMA)).collect()
    assert [r["taken"] for r in rows] == [0, 0]
    same = M.mix(spark.createDataFrame([(1, "a b c", "a")] * 20 + [(2, "a b", None)] * 10, SCHEMA).withColumn("size", F.lit(5)))
    assert same.count() == 30
