import random
import re

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import paths
from pagequarry.sources import text_index

WORDS = ["alpha", "Alphabet", "été", "ÉTÉ", "straße", "a_b", "x-1", "ΟΔΟΣ", "odd\nline", "Kelvin", "İstanbul", "the", "THE", "them", "ab", "日本語", "c++"]


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "", ", "]).join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(400)] + [(400, None), (401, "x" * 50_000 + " needle in the end"), (402, "ab"), (403, "")]
    return spark.createDataFrame(rows, "id long, content string").repartition(4)


@pytest.fixture(scope="module")
def index(files, tmp_path_factory):
    return text_index.write(files, f"file://{tmp_path_factory.mktemp('index')}/i", blocks=32)


@pytest.mark.parametrize("needle", ["alpha", "ALPHA", "the", "été", "Été", "straße", "a_b", "x-1", "οδος", "ΟΔΟΣ", "odd\nline", "Kelvin", "kelvin", "istanbul", "İst", "needle in", "nowhere", "ab", "a", "日本語", "c++", "+, a", "thethe"])
def test_hits_are_those_of_a_plain_search(files, index, needle):
    for whole in (True, False):
        for ignore in (True, False):
            plain = paths.search(files.select(F.col("id").cast("string").alias("path"), "content"), needle, whole, ignore).where("found")
            assert sorted(r["id"] for r in index.search(needle, whole, ignore).collect()) == sorted(int(r["path"]) for r in plain.collect()), (whole, ignore)


def test_only_some_blocks_are_read(index):
    found = index.near("needle in the end")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block#\d+ (= \d+\)|IN )", plan), plan
    assert "PushedFilters: [In(gram" in index.candidates("needle")._jdf.queryExecution().executedPlan().toString()
