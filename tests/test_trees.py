import re

from pyspark.sql import functions as F

from pagequarry.functions import directives, rst
from pagequarry.operators import includes
from pagequarry.plans import tree_queries as T

SF = "/root/testdata/sf0.001"


def plain_expansion(path, files, trail=()):
    """Line by line, as it reads."""
    out = []
    text = rst.rendered_steps(files[path]) if "steps-" in path else files[path]
    for line in text.split("\n"):
        m = re.match(r"^(\s*)\.\. include::\s*(\S.*?)\s*$", line)
        target = None
        if m:
            target = T.ROOT + m[2].lstrip("/").replace("steps/", "steps-").replace(".rst", ".yaml" if "steps/" in m[2] else ".rst")
        if not m or target not in files or target in (path, *trail):
            out.append(line)
        else:
            out += [m[1] + x if x.strip() else "" for x in plain_expansion(target, files, (path, *trail))]
    return out


def test_includes_are_put_in_place(spark):
    files = {r["path"]: r["content"] for r in T._files(spark, SF).collect()}
    got = {r["path"]: r["content"] for r in T.expanded_pages(spark, SF).collect()}
    assert len(got) == 200
    for path, content in got.items():
        assert content.split("\n") == plain_expansion(path, files), path


def test_cycles_and_missing_files_stay(spark):
    got = {r["path"]: r["content"] for r in includes.expand_includes(T._shared(spark)).collect()}
    assert got[T.ROOT + "includes/x1.rst"] == "one\ntwo\n.. include:: /includes/x1.rst\nend"
    alone = spark.createDataFrame([("a/source/f.txt", ".. include:: /nothing.rst\nx"), ("a/source/empty.txt", "")], "path string, content string")
    assert {r["path"]: r["content"] for r in includes.expand_includes(alone).collect()} == {"a/source/f.txt": ".. include:: /nothing.rst\nx", "a/source/empty.txt": ""}
    assert includes.expand_includes(alone.limit(0)).count() == 0


def test_missing_tags_and_files_leave_examples_out(spark):
    page = "a/source/p.txt"
    text = ".. literalinclude:: /c.py\n   :start-after: no such tag\n\n.. literalinclude:: /absent.py\n\n.. literalinclude:: /c.py\n   :language: py\n"
    files = spark.createDataFrame([(page, text), ("a/source/c.py", "x = 1\n")], "path string, content string")
    from pagequarry.operators import ingest

    found = ingest.included_examples(directives.example_table(files.where(F.col("path") == page)), files).collect()
    assert [(r["index"], r["content"], r["language"]) for r in found] == [(3, "x = 1", "py")]
