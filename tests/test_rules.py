import random
import re

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import paths, rules

SCHEMA = "workflow string, idx int, kind string, pattern string, target string, excludes array<string>"


@pytest.mark.parametrize(("pattern", "start"), [("^a/b", "a/b"), ("a", ""), ("^ab*", "a"), ("^ab+c", "ab"), (r"^a\.b", "a.b"), (r"^a\d", "a"), ("^a|b", ""), ("^a(b|c)d", "a"), ("^(a|b)", ""), ("^ab{0,2}", "a"), ("(?i)^a", ""), ("^a(?i)b", ""), ("^a[|]b", "a"), ("", ""), ("^x/(?P<n>[0-9]+)", "x/"), ("^ab?", "a")])
def test_literal_starts(pattern, start):
    assert rules.literal_start(pattern) == start


def some_rules(rng, n):
    out = []
    for i in range(n):
        d = f"d{rng.randint(0, 5)}"
        kind, pattern, target = rng.choice(
            [
                ("move", rng.choice([d, d + "/", "d1/e2", "d1/e2/f3.py", ""]), "to/" + d),
                ("copy", f"{d}/e{rng.randint(0, 3)}/f{rng.randint(0, 4)}.py", "copied"),
                ("prefix", rng.choice([d + "/e", d, "d"]), "p/${relative_path}"),
                ("glob", rng.choice([f"{d}/**/*.py", "**/f3.*", f"{d}/e?/f[0-2].py", d + "/{e1,e2}/*"]), "g/${relative_path}.${ext}"),
                ("regex", rng.choice([rf"^{d}/(?P<x>e\d)/(?P<y>.*)$", r"f(?P<z>\d)\.py", "(", f"^{d}/e1|nothing"]), rng.choice(["r/${x}/${filename}", "r/${z}", "${dir}/new"])),
            ]
        )
        out.append({"workflow": f"w{i % 3}", "idx": i, "kind": kind, "pattern": pattern, "target": target, "excludes": rng.choice([[], ["e3"], ["(", r"f4\."]])})
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("most", [0, 200_000])
def test_table_of_rules_equals_expressions(spark, monkeypatch, seed, most):
    monkeypatch.setattr(rules, "MAX_BROADCAST", most)
    rng = random.Random(seed)
    some = some_rules(rng, 100 if seed == 1 else 12)
    names = [f"d{a}/e{b}/f{c}.{x}" for a in range(6) for b in range(4) for c in range(5) for x in ("py", "txt")] + ["d1", "d1/", "top.py", "", "d2/f3.py"]
    files = spark.createDataFrame([(p, i) for i, p in enumerate(names + names[:5])], "path string, size int")
    table = spark.createDataFrame([tuple(r[c] for c in ("workflow", "idx", "kind", "pattern", "target", "excludes")) for r in some], SCHEMA)
    got, want = rules.apply(files, rules.compiled(table)), paths.apply_rules(files, some)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_hundred_thousand_rules(spark):
    """Each path meets the rules that share its beginning, and no others."""
    n = F.col("id")
    table = spark.range(100_000).select(F.lit("w").alias("workflow"), n.cast("int").alias("idx"), F.lit("move").alias("kind"), F.concat(F.lit("repo/folder"), n.cast("string")).alias("pattern"), F.concat(F.lit("t"), n.cast("string")).alias("target"), F.array().cast("array<string>").alias("excludes"))
    files = spark.range(5000).select(F.concat(F.lit("repo/folder"), (n * 20).cast("string"), F.lit("/a.py")).alias("path"))
    got = rules.apply(files, rules.compiled(table))
    assert got.count() == 5000 and got.where(F.concat(F.lit("t"), F.regexp_extract("path", r"folder(\d+)", 1), F.lit("/a.py")) != F.col("target")).count() == 0
    with pytest.raises(Exception, match="no such kind"):
        rules.apply(files, rules.compiled(spark.createDataFrame([("w", 0, "odd", "a", "b", [])], SCHEMA))).count()


def test_globs_begin_as_their_rules_say():
    for pattern in ("a/*b", "a\\*b", "{x,y}/z", "a[0-9]"):
        start, expression, _, _ = rules._compiled("glob", pattern)
        assert re.match("^" + re.escape(start), expression.removeprefix("^").replace("\\", "")) or expression.startswith("^" + re.escape(start))
