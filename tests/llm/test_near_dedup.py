import random
import re
from itertools import combinations

import numpy as np
import pytest

from pagequarry.llm import near_dedup as N
from pagequarry.llm.common import word_hashes

SCHEMA = "doc_id long, text string"


def plain_sets(rows, n):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def plain_components(rows, n, percent=80):
    sets = plain_sets(rows, n)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    out = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "a b c d"), (6, "a b c d e")]
    for base in range(12):
        words = [word() for _ in range(rng.choice((12, 40, 150, 400)))]
        for _ in range(12):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            out.append((len(out) + base * 100, " ".join(w)))
    for k in range(25):  # a chain: neighbours are near, the ends aren't
        out.append((5000 + k, " ".join(f"c{j}" for j in range(k * 4, k * 4 + 120))))
    out += [(6000 + k, out[20][1].upper()) for k in range(60)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shingle", [4, 5])
def test_components_agree_with_all_pairs(spark, rows, shingle):
    want, sets = plain_components(rows, shingle), plain_sets(rows, shingle)
    got = {r["doc_id"]: r for r in N.find(spark.createDataFrame(rows, SCHEMA), shingle).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in got)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """With few neighbours tried in each bucket, the exhaustive search has to find what they miss."""
    monkeypatch.setattr(N, "NEAR", 1)
    monkeypatch.setattr(N, "HOT", 20)
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(11)
    base = [f"w{j}" for j in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(100)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in N.find(spark.createDataFrame(rows, SCHEMA), 5).collect()}
    assert got == plain_components(rows, 5)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        both = int(1000 * 2 * share / (1 + share))
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - both : 2000 - both])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = N.estimate(np.array([(N.registers(a) == N.registers(b)).sum()]), np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(est - exact) < 0.13


def test_word_hashes_tell_words_apart():
    h, off = word_hashes(["a ab", None, "", " ab\ta ", "A"], lower=True)
    assert off.tolist() == [0, 2, 2, 2, 4, 5]
    assert h[0] == h[3] == h[4] and h[1] == h[2] and h[0] != h[1]


def row_components(rows, n, percent=80):
    """Names by row, of rows (doc_id, text) that may repeat ids: the smallest id of the rows that can be reached."""
    comps = plain_components(list(enumerate(t for _, t in rows)), n, percent)
    sets = plain_sets(list(enumerate(t for _, t in rows)), n)
    members = {}
    for k, c in comps.items():
        members.setdefault(c, []).append(rows[k][0])
    names = {c: min((i for i in ids if i is not None), default=None) for c, ids in members.items()}
    return [rows[k][0] if not sets[k] else names[comps[k]] for k in range(len(rows))]


def test_repeated_and_null_ids_agree_with_all_pairs(spark, rows):
    rng = random.Random(8)
    odd = [(rng.choice([None, i, i % 7, 2**60 + i % 5]), t) for i, t in rows]
    want = sorted((str(r[0]), str(w), r[0] == w) for r, w in zip(odd, row_components(odd, 5)))
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in N.find(spark.createDataFrame(odd, SCHEMA)).collect())
    assert got == want


def test_deduplicate_keeps_one_row_of_every_component(spark, rows):
    rng = random.Random(9)
    odd = [(rng.choice([None, i, i % 7]), t) for i, t in rows]
    odd += odd[:30]
    left = [tuple(r) for r in N.deduplicate(spark.createDataFrame([(i, t, "x") for i, t in odd], SCHEMA + ", text_hash string")).select("doc_id", "text").collect()]
    sets = plain_sets(list(enumerate(t for _, t in odd)), 5)
    comps = plain_components(list(enumerate(t for _, t in odd)), 5)
    assert sum(1 for _, t in left if (t or "").strip()) == len({comps[k] for k in sets if sets[k]})
    assert sum(1 for _, t in left if not (t or "").strip()) == sum(1 for k in sets if not sets[k])
    smallest = {}
    for k, (i, _) in enumerate(odd):
        if sets[k] and i is not None:
            smallest[comps[k]] = min(i, smallest.get(comps[k], i))
    assert sorted(i for i, t in left if (t or "").strip() and i is not None) == sorted(smallest.values())


def test_texts_under_one_id_stay_apart(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (2, c)], SCHEMA)
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in N.find(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False)]
    assert sorted(tuple(r) for r in N.deduplicate(df).collect()) == sorted([(1, a), (1, b), (2, c)])


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    got = {r["doc_id"]: r["component_id"] for r in N.find(spark.createDataFrame([(1, long), (2, long.upper()), (3, long + " end"), (4, long[: len(long) // 2])], SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_empty_table_repeats_and_null_ids(spark):
    assert N.find(spark.createDataFrame([], SCHEMA)).count() == 0 and N.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = N.find(spark.createDataFrame([(7, "a b c d e f")] * 4 + [(9, "a b c d e f"), (None, "a b c d e f")], SCHEMA)).collect()
    assert len(rows) == 6 and {r["component_id"] for r in rows} == {7} and sorted(r["kept"] for r in rows) == [False, False, True, True, True, True]
    nameless = N.find(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e g"), (None, "")], SCHEMA)).collect()
    assert all(r["component_id"] is None and r["kept"] for r in nameless)
