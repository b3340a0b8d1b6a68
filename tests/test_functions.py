import hashlib

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import directives, rst
from pagequarry.functions import scalars as S
from pagequarry.functions import vocabulary as V

from . import plain_rst


def values(spark, column, rows, schema="a string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_hash_and_ids(spark):
    assert values(spark, S.code_hash(F.col("a")), [" x\n", "　y "]) == [hashlib.sha256(b).hexdigest() for b in (b"x", b"y")]
    assert values(spark, S.page_key(F.col("a")), ["p/docs/v1/a/b", "a/b/c", "x"]) == ["a|b", "", ""]
    assert values(spark, S.last_segment(F.col("a")), ["http://x.y/docs/v1/", "v2"]) == ["v1", "v2"]


def test_languages(spark):
    assert values(spark, S.catalogue_language(F.col("a")), ["js", "", "JS", "golang", "python", None]) == ["javascript", "undefined", "undefined", "go", "python", "undefined"]
    assert values(spark, S.tree_language(F.col("a")), [" JS ", "none", "Elm", "ps1"]) == ["javascript", "undefined", "elm", "powershell"]
    assert values(spark, S.language_of_path(F.col("a")), ["a/b.sh", "x.py", "dir.d/file", "y.unknown"]) == ["shell", "python", "undefined", "undefined"]
    assert values(spark, S.language_bucket(F.col("a")), ["bash", "yaml", "go", "x"]) == ["shell", "json-like", "drivers-minus-js", ""]


def test_categories(spark):
    words = V.RuleWords(syntax_prefixes=("tool ",))
    df = spark.createDataFrame([("tool run", "shell"), ("tool run", "python"), ("npm install", "shell"), ("import x", "python"), ("db.c.aggregate([])", "javascript"), ("{ _id: 1 }", "json"), ("x" * 60 + "warning", "text"), ("{ $match: { a: <value> } }", "text"), ("{ $match: 1 }", "text"), ("é" * 24 + "abcmake x", "text")], "c string, l string")
    got = [r[0] for r in df.select(S.rule_category(F.col("c"), F.col("l"), words)).collect()]
    assert got == [V.SYNTAX, V.UNCATEGORIZED, V.OTHER_COMMAND, V.USAGE, V.USAGE, V.RETURN_OBJECT, V.UNCATEGORIZED, V.SYNTAX, V.USAGE, V.UNCATEGORIZED]
    assert values(spark, S.author_category(F.col("a")), ["A Syntax thing", "command", "odd", None]) == [V.SYNTAX, V.OTHER_COMMAND, "", ""]
    full = spark.createDataFrame([("zzz", "text", "", V.USAGE), ("zzz", "text", "", "nonsense"), ("npm i", "shell", "syntax", None)], "c string, l string, a string, m string")
    got = [tuple(r[0]) for r in full.select(S.assigned_category(F.col("c"), F.col("l"), F.col("a"), F.col("m"))).collect()]
    assert got == [(V.USAGE, True), (V.UNCATEGORIZED, True), (V.SYNTAX, False)]


def test_versions_slugs_paths(spark):
    df = spark.createDataFrame([("v1.2.3", "2.0.0"), ("1.2.3", "1.3.0"), ("1.2.3", "1.2.4"), ("1.2.3", "v1.2.3"), ("1.2", "1.2.3")], "a string, b string")
    assert [r[0] for r in df.select(S.update_type(F.col("a"), F.col("b"))).collect()] == ["major", "minor", "patch", "none", "unknown"]
    assert values(spark, S.slug(F.col("a")), ["Deploy a Cluster / Now_!", "--a-b--"]) == ["deploy-a-cluster-now", "ab"]
    assert values(spark, S.fill_path("out/${dir}/${filename}.${ext}", F.col("a")), ["x/y.py"]) == ["out/x/y.py.py"]
    assert values(spark, S.fill_path("${nothing}", F.col("a")), ["x"]) == [None]
    assert values(spark, S.emphasized_lines(F.col("a")), [([[1, 3], [7, 7]],), ([[1]],)], "a array<array<int>>") == [[1, 2, 3, 7], None]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("a/*.py", ["a/x.py"], ["a/b/x.py", "b/x.py"]), ("a/**/x.?s", ["a/x.js", "a/b/c/x.ts"], ["a/x.jss"]), ("**/*.{md,txt}", ["x.md", "a/b.txt"], ["a.rst"]), ("[!a]b", ["cb"], ["ab"]), ("a+b", ["a+b"], ["aab"])],
)
def test_globs(spark, glob, yes, no):
    got = values(spark, F.rlike("a", F.lit(S.glob_pattern(glob))), yes + no)
    assert got == [True] * len(yes) + [False] * len(no)


def test_words_and_parts(spark):
    assert values(spark, S.whole_word(F.col("a"), "curl"), ["use curl now", "libcurl", "CURL", "curl_x", "(curl)"]) == [True, False, True, False, True]
    assert values(spark, S.part_of(F.col("a"), "curl", ignore_case=False), ["libcurl", "CURL"]) == [True, False]
    with pytest.raises(ValueError):
        S.whole_word(F.col("a"), "")


RST = """Title
=====

.. code-block:: python
   :copyable: false

   x = 1
     y

.. literalinclude:: /includes/a.js
   :language: js
   :start-after: start
   :dedent:

.. io-code-block::

   .. input::
      :language: sh

      run

   .. output:: /out.txt

.. code-block:: js

   z

.. include:: /steps/one.rst

.. toctree::
   :maxdepth: 1

   Home </index>
   /guide

Do it
-----

.. procedure::

   .. step:: First

      Text.

   .. step:: Second

      More.

1. one
2. two

   inner
"""


def test_directives_and_examples():
    found = plain_rst.parse_directives(RST)
    assert [d["kind"] for d in found] == ["code-block", "literalinclude", "io-code-block", "code-block"]
    assert found[0]["content"] == "x = 1\n  y" and found[0]["options"] == {"copyable": "false"} and found[0]["line"] == 4
    got = [(e["directive"], e["index"], e["sub"], e["language"], e["content"]) for e in plain_rst.code_examples(RST)]
    assert got == [("code-block", 1, "", "python", "x = 1\n  y"), ("literalinclude", 1, "", "js", ""), ("io-code-block", 1, "input", "sh", "run"), ("code-block", 2, "", "js", "z")]


def test_included_parts():
    text = "a\n// start\n    b\n      c\n// end\nd"
    assert plain_rst.included_part(text, {"start-after": "start", "end-before": "// end", "dedent": ""}) == "b\n  c"
    assert plain_rst.included_part(text, {"start-after": "nowhere"}) is None
    assert plain_rst.included_part(text, {}) == text


def test_edges_and_procedures(spark):
    got = [(e["directive"], e["ref"]) for e in plain_rst.include_edges(RST)]
    assert got == [("literalinclude", "/includes/a.js"), ("io-code-block", "/out.txt"), ("include", "/steps/one.rst"), ("toctree", "/index"), ("toctree", "/guide")]
    p = rst.procedures(RST)
    assert [(x["kind"], x["title"], [s["title"] for s in x["steps"]]) for x in p] == [("directive", "Do it", ["First", "Second"]), ("ordered-list", "Do it", ["one", "two"])]
    assert p == rst.procedures(RST) and p[0]["variations"] == [""]
    files = spark.createDataFrame([("a.rst", RST), ("b.rst", None)], "path string, content string")
    assert directives.example_table(files).count() == 4 and directives.edge_table(files).count() == 5
    assert sorted(r["steps"] for r in rst.procedure_table(files).collect()) == [2, 2]


def test_markers_variables_and_trees(spark):
    assert [rst.next_marker(m) for m in ("1", "9", "a", "z", "Z")] == ["2", "10", "b", "aa", "AA"]
    yaml = spark.createDataFrame([("f", "ref: x\nreplacement:\n  name: 'value'\n  other: b c\nlast: 1\n")], "path string, content string")
    assert sorted(tuple(r)[1:] for r in directives.replacement_table(yaml).collect()) == [("name", "value"), ("other", "b c")]
    tree = '{"type":"root","children":[{"type":"code","lang":"js","value":"1"},{"type":"section","children":[{"type":"code","value":"2"}]},{"type":"code","lang":"py","value":"3"}]}'
    assert [n["value"] for n in rst.ast_nodes(tree, kind="code")] == ["1", "2", "3"]
    assert rst.ast_nodes("not json") == []
    pages = spark.createDataFrame([("p", tree)], "path string, content string")
    assert [r["language"] for r in rst.code_node_table(pages).collect()] == ["js", "", "py"]


def test_lists_and_their_markers():
    text = "1. a\n\n   in a\n#. b\n\n7. c\nafter\n\nx. one\n"
    found = rst.procedures(text)
    assert [[s["title"] for s in p["steps"]] for p in found] == [["a", "2. b", "c"], ["one"]]
    assert found[0]["steps"][0]["content"] == "in a"
    steps, kind, after = rst.list_steps(["y. a", "#. b", "#. c"], 0)
    assert ([s["title"] for s in steps], kind, after) == (["a", "z. b", "aa. c"], "lettered", 3)


def test_steps_hold_variations_and_lists():
    text = ".. procedure::\n\n   .. step:: S\n\n      General.\n\n      .. tabs::\n\n         .. tab:: A\n            :tabid: a\n\n            In a.\n\n      1. sub\n      2. sub\n\n      .. selected-content::\n         :selections: x, y\n\n         For x.\n"
    step = rst.procedures(text)[0]["steps"][0]
    assert step["content"] == "General.\n\n1. sub\n2. sub"
    assert step["variations"] == [("tabs", {"a": "In a."}), ("selected-content", {"x, y": "For x."})]
    assert [(k, len(s)) for k, s in step["subs"]] == [("numbered", 2)]
    assert rst.procedures(text)[0]["variations"] == ["a"]
    assert rst.procedure_text(rst.procedures(text)[0], "a").endswith("      2. sub\n\n      In a.\n")


def test_a_tutorials_own_procedure_comes_first():
    step = "      .. step:: S\n\n         .. selected-content::\n            :selections: b\n\n            B\n\n         .. selected-content::\n            :selections: a\n\n            A\n"
    found = rst.procedures(f"T\n==\n\n.. composable-tutorial::\n   :options: o\n\n   .. procedure::\n\n{step}\n")
    assert [(p["kind"], p["title"], p["variations"], p["group"]) for p in found] == [("tutorial", "T", ["a", "b"], 4)]
    assert rst.procedures("no procedures\n") == [] == rst.procedures("")


def test_equal_procedures_share_their_hash():
    make = lambda title, text: rst.procedures(f"{title}\n=====\n\n.. procedure::\n\n   .. step:: S\n\n      {text}\n")[0]["hash"]
    assert make("A", "x") == make("B", "x") != make("A", "y")
