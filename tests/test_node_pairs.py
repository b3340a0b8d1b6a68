"""Nodes paired by similarity: against all pairs taken in order, and without writing them."""

import random

from pyspark.sql import functions as F

from pagequarry.operators import cdc

SCHEMA = "page_id string, sha_256_hash string, code string"


def sides(seed, n, code):
    rng = random.Random(seed)
    return [[(f"p{rng.randrange(2)}", f"{side}{i}", code(rng)) for i in range(n)] for side in ("old", "new")]


def mixed(rng):
    """Short and long texts of few lengths, some of which have no character in common with others, or a byte only."""
    kind = rng.random()
    if kind < 0.1:
        return rng.choice(["😀", "😁", "é", "è", "", "x"]) * rng.choice([1, 4, 5])
    text = list("the quick brown fox jumps over lazy dogs " * 3)[: rng.choice([9, 10, 11, 40, 41, 44, 100, 120])]
    for _ in range(rng.randrange(4)):
        text[rng.randrange(len(text))] = rng.choice("abcXYZ")
    return "".join(text)


def test_pairs_are_those_of_all_pairs_in_order(spark):
    old, new = sides(5, 120, mixed)
    a, b = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    both = a.select("page_id", F.col("sha_256_hash").alias("o"), F.col("code").alias("x")).join(b.select("page_id", F.col("sha_256_hash").alias("n"), F.col("code").alias("y")), "page_id")
    share = F.when(F.arrays_overlap(F.split("x", ""), F.split("y", "")), cdc.change_share(F.col("x"), F.col("y"))).otherwise(1.0)
    want, gone = set(), set()
    for r in both.select("o", "n", share.alias("share"), F.xxhash64("o", "n").alias("tie")).where(F.col("share") < cdc.MAX_CHANGE).orderBy("share", "tie").collect():
        if not {r["o"], r["n"]} & gone:
            want.add((r["o"], r["n"]))
            gone |= {r["o"], r["n"]}
    got = {(r["old_hash"], r["new_hash"]) for r in cdc.diff_nodes(a, b).where("status = 'updated'").collect()}
    assert len(want) > 50 and got == want


def test_pairs_are_not_written(spark, monkeypatch):
    """Two hundred nodes a side, all similar: what is kept has a row an item at most, not a row a pair."""
    rows = []

    def counted(df, keep=cdc.kept):
        out = keep(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(cdc, "kept", counted)
    old, new = ([("p", f"{side}{i}", "a" * (1000 + 2 * i + (side == "new"))) for i in range(200)] for side in ("old", "new"))
    found = cdc.diff_nodes(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA))
    assert found.where("status = 'updated'").count() > 190 and max(rows) <= 400
