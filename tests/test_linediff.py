import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import linediff


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("cells", [1, 50, 1 << 22])
def test_matches_are_longest(monkeypatch, cells):
    monkeypatch.setattr(linediff, "CELLS", cells)
    rng = np.random.default_rng(cells)
    for _ in range(150):
        x, y = rng.integers(0, 6, rng.integers(0, 25)), rng.integers(0, 6, rng.integers(0, 25))
        pairs = linediff.matched(x, y)
        assert len(pairs) == plain_length(x.tolist(), y.tolist()) and all(x[i] == y[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_chains_are_longest():
    rng = np.random.default_rng(2)
    for _ in range(100):
        to = rng.permutation(rng.integers(0, 40))
        chain = linediff.rising(np.arange(len(to)), to)
        best = [1] * len(to)
        for i in range(len(to)):
            best[i] = 1 + max((best[j] for j in range(i) if to[j] < to[i]), default=0)
        assert len(chain) == max(best, default=0) and (np.diff(to[chain]) > 0).all()


def cases():
    rng = random.Random(4)
    out = [("a", "a\nb\nc", "a\nb\nc"), ("b", "", "x"), ("c", "x", ""), ("d", "a\na\na", "a\na"), ("e", "one\ntwo\nthree", "three\ntwo\none"), ("f", "x\n", "x"), ("g", "ü\n\n\n", "\n\nü")]
    for k in range(40):
        a = [rng.choice(["", "a", "b", f"line {rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.choice(["a", "new", f"line {rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 3))]
        out.append((f"r{k}", "\n".join(a), "\n".join(b)))
    return out


def applied(a: list[str], diff: str) -> list[str]:
    """A unified diff carried out on lines, checking every line that it names."""
    out, at = [], 0
    for line in diff.split("\n")[2:]:
        if line.startswith("@@"):
            lo, n = (line.split(" ")[1][1:].split(",") + ["1"])[:2]
            start = int(lo) - (n != "0")
            out, at = out + a[at:start], start
        elif line[0] in " -":
            assert a[at] == line[1:]
            at += 1
            out += [line[1:]] * (line[0] == " ")
        else:
            out.append(line[1:])
    return out + a[at:]


@pytest.mark.parametrize("context", [0, 1, 3])
def test_diffs_make_the_other_text(spark, context):
    rows = cases()
    found = linediff.unified_diffs(spark.createDataFrame(rows, "path string, a string, b string"), context).collect()
    got = {r["path"]: r["diff"] for r in found}
    assert set(got) == {p for p, a, b in rows if a != b}
    for p, a, b in rows:
        if a != b:
            assert applied(a.split("\n"), got[p]) == b.split("\n"), p


def test_form_is_the_usual_one(spark):
    """Where one line changes there is one way to say so: headers, spans and context."""
    lines = [f"l{i}" for i in range(30)]
    changed = ["first", *lines[:9], "changed", *lines[10:14], *lines[15:]]
    rows = [("p", "\n".join(lines), "\n".join(changed))]
    got = linediff.unified_diffs(spark.createDataFrame(rows, "path string, a string, b string")).first()["diff"]
    assert got.split("\n") == list(difflib.unified_diff(lines, changed, "a", "b", lineterm=""))


def test_one_long_pair_without_unique_lines(spark):
    """No anchors: the gap is the text. Edits are fewest."""
    rng = random.Random(6)
    a = [rng.choice("abcd") for _ in range(3000)]
    b = a[:1000] + a[1010:2000] + ["z"] * 5 + a[2000:]
    df = spark.createDataFrame([("p", a, b)], "path string, a array<string>, b array<string>")
    row = df.join(linediff.line_edits(df), "path").select("b", "edits", linediff.replayed(F.col("a"), F.col("b"), F.col("edits")).alias("made")).first()
    assert row["made"] == b
    assert sum(e["a_end"] - e["a"] for e in row["edits"]) == 10 and sum(e["b_end"] - e["b"] for e in row["edits"]) == 5
