import random

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import edits
from pagequarry.operators import cdc


def plain(a: bytes, b: bytes) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def changed(rng, a: bytes, letters: bytes, n: int) -> bytes:
    b = bytearray(a)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4 and b:
            del b[rng.randrange(len(b))]
        elif kind < 0.8 or not b:
            b.insert(rng.randint(0, len(b)), rng.choice(letters))
        else:
            b[rng.randrange(len(b))] = rng.choice(letters)
    return bytes(b)


@pytest.mark.parametrize("most", [0, 3, 1500])
@pytest.mark.parametrize("stride", [1, 256])
def test_common_length_is_that_of_all_pairs_of_places(monkeypatch, most, stride):
    """By paths, by bit vectors and by both; with the limit below, at and above the length."""
    monkeypatch.setattr(edits, "MOST_EDITS", most)
    monkeypatch.setattr(edits, "SHORT", 0 if stride == 1 else 30)
    monkeypatch.setattr(edits, "STRIDE", stride)
    rng = random.Random(most + stride)
    for _ in range(400):
        letters = rng.choice([b"ab", b"abcd", bytes(range(256))])
        a = bytes(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        b = changed(rng, a, letters, rng.randint(0, 40))
        best = plain(a, b)
        assert edits.common_length(a, b) == best
        for least in (best - 1, best, best + 1, rng.randint(0, 60)):
            assert edits.common_length(a, b, least) == (best if best >= least else None)


def test_long_equal_stretches():
    """Runs beyond one comparison on many diagonals, and equal ends."""
    block = bytes(random.Random(1).choices(b"etaoin shrdlu", k=30_000))
    a, b = block + b"Q" + block + b"tail", block + block + b"RS" + b"tail"
    assert edits.common_length(a, b) == 60_004
    assert edits.common_length(b"a" * 50_000 + b"b", b"a" * 49_000 + b"cb") == 49_001
    assert edits.common_length(block, b"Z" * 30_000, 1) is None


def test_counts_of_columns(spark):
    rows = [(1, "kitten", "sitting"), (2, "", "ab"), (3, "ab", ""), (4, None, "a"), (5, "same", "same"), (6, "aé", "ae"), (7, "x" * 10, "y" * 10)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r["id"]: (r["e"]["deleted"], r["e"]["inserted"]) if r["e"] else None for r in df.select("id", edits.edit_counts(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {1: (2, 3), 2: (0, 2), 3: (2, 0), 4: None, 5: (0, 0), 6: (2, 1), 7: (10, 10)}
    limited = {r["id"]: r["e"] is not None for r in df.select("id", edits.edit_counts(F.col("a"), F.col("b"), 0.3).alias("e")).collect()}
    assert limited == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False}


def test_similarity_at_the_limit(spark):
    """Ten characters: 0, 1 and 2 changed are similar, 3 and 4 aren't; one more is, and nothing left isn't."""
    old = "1234567890"
    rows = [(old, True), ("1234567891", True), ("1234567812", True), ("1234567hsl", False), ("1234561234", False), ("12345678901", True), ("abcdefghij", False), ("abcdefghijk", False), ("1234567", False), ("12345678", True)]
    df = spark.createDataFrame([(old, new, want) for new, want in rows], "a string, b string, want boolean")
    got = df.select("b", "want", (cdc.change_share(F.col("a"), F.col("b")) < cdc.MAX_CHANGE).alias("got")).collect()
    assert [(r["b"], r["got"]) for r in got] == [(r["b"], r["want"]) for r in got]
    wide = df.where("b = '1234561234'").select(cdc.edit_share("a", "b", 0.5)).first()[0]
    assert wide == 0.4
