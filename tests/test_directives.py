import random

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import directives

from . import plain_rst


def some_text(rng):
    """Directives nested and side by side, options, blank lines, tabs, entries; whatever indentation."""
    out = []
    for _ in range(rng.randint(0, 40)):
        lead = rng.choice(["", "", "   ", "      ", "\t", "  "])
        kind = rng.choice("code-block literalinclude io-code-block input output include toctree figure note".split())
        out.append(lead + rng.choice([f".. {kind}::", f".. {kind}:: /a/{rng.randint(0, 9)}.rst", f".. {kind}::  x ", ":language: py", ":start-after: s", ":dedent:", "text", "Home </index>", "", "  ", "a: b", ".. not a directive", ":option: twice"]))
    return "\n".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    fixed = ["", "\n", ".. code-block::", ".. code-block:: js\n\n   a\n\n     b\n\nend", ".. io-code-block::\n\n   .. input:: /f.sh\n\n   .. output::\n      :language: json\n\n      {}\n", ".. toctree::\n   :maxdepth: 1\n\n   /a\n   B </b>\nafter", ".. include:: \n.. include:: /x.rst"]
    return dict(enumerate(fixed + [some_text(rng) for _ in range(250)]))


def test_examples_of_any_text(spark, texts):
    files = spark.createDataFrame([*texts.items(), (-1, None)], "path int, content string").repartition(4)
    got = {}
    for r in directives.example_table(files).collect():
        got.setdefault(r["path"], []).append((r["directive"], r["index"], r["sub"], r["language"], r["content"], r["includes"], dict(r["options"])))
    for k, text in texts.items():
        want = [(e["directive"], e["index"], e["sub"], e["language"], e["content"], e["includes"], e["options"]) for e in plain_rst.code_examples(text)]
        assert sorted(got.get(k, []), key=str) == sorted(want, key=str), text


def test_references_of_any_text(spark, texts):
    flat = {k: t for k, t in texts.items() if sum("toctree::" in x for x in t.split("\n")) < 2}  # one within another is an entry
    got = {}
    for r in directives.edge_table(spark.createDataFrame(list(flat.items()), "path int, content string")).collect():
        got.setdefault(r["source"], []).append((r["directive"], r["ref"], r["line"]))
    assert len(flat) > 100
    for k, text in flat.items():
        assert sorted(got.get(k, [])) == sorted((e["directive"], e["ref"], e["line"]) for e in plain_rst.include_edges(text)), text


def test_parts_of_included_files(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(300):
        content = "\n".join(rng.choice(["# start", "  # start x", "end", "    code", "\ttab", "", "   ", "é end é"]) for _ in range(rng.randint(0, 8)))
        options = {k: v for k, v in (("start-after", rng.choice(["start", "nowhere", "", "é"])), ("end-before", rng.choice(["end", "start", "none"])), ("dedent", ""), ("language", "py")) if rng.random() < 0.5}
        rows.append((content, options, plain_rst.included_part(content, options)))
    df = spark.createDataFrame(rows, "content string, options map<string,string>, want string")
    got = df.select("*", directives.included_part(F.col("content"), F.col("options")).alias("got")).collect()
    for r in got:
        assert r["got"] == r["want"], r
    assert None in {r["got"] for r in got}


def test_long_files(spark):
    """Ten thousand lines with a thousand directives are a matter of seconds."""
    text = "\n".join(f"Text {i}\n\n.. code-block:: js\n   :copyable:\n\n   line {i}\n\n     more\n\n.. include:: /f{i}.rst\n" for i in range(1000))
    files = spark.createDataFrame([("p", text)], "path string, content string")
    assert directives.example_table(files).where("directive = 'code-block' AND content LIKE 'line%more'").count() == 1000
    assert directives.edge_table(files).count() == 1000


def test_stays_in_the_engine(spark, texts):
    files = spark.createDataFrame([(0, "x")], "path int, content string")
    for df in (directives.example_table(files), directives.edge_table(files), directives.replacement_table(files)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
