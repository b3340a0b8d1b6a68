"""File trees listed by tasks: what Spark's own reader finds, without an index of all files in the driver."""

import pytest
from pyspark.sql import functions as F

from pagequarry.sources import readers

FILES = {"a.rst": "é\n", "B.MD": "two", "x y+z/c(1).txt": "", "d/e/f/g.txt": "deep", "d/e/n.png": "no", "_hidden/h.rst": "no", "d/.h.rst": "no", "d/_h.rst": "no", "d/_k=1.rst": "yes", "d/_metadata.txt": "no", "_metadata/m.txt": "yes", "d/h.rst._COPYING_": "no", "none/.rst": "no"}


@pytest.fixture
def tree(tmp_path):
    for name, text in FILES.items():
        at = tmp_path / "t" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    (tmp_path / "t/empty").mkdir()
    (tmp_path / "t/link.txt").symlink_to(tmp_path / "t/d/e/f/g.txt")
    (tmp_path / "t/gone.txt").symlink_to(tmp_path / "nowhere")
    return tmp_path / "t"


@pytest.mark.parametrize("recursive", [True, False])
@pytest.mark.parametrize("extensions", [(".rst", ".txt", ".md"), ()])
def test_files_are_those_of_sparks_reader(spark, tree, monkeypatch, recursive, extensions):
    monkeypatch.setattr(readers, "BATCH_FILES", 2)
    index = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(str(tree))
    want = {r["path"].removeprefix(f"file:{tree}/"): bytes(r["content"]).decode() for r in index.collect()}
    want |= {"x y+z/c(1).txt": ""} if recursive else {}  # empty files are files; the index leaves them out
    want = {p: t for p, t in want.items() if not extensions or p.lower().endswith(extensions)}
    for path in (str(tree), f"file://{tree}/"):
        rows = readers.file_tree(spark, path, extensions, recursive).collect()
        assert len(rows) == len(want) >= 3 and {r["path"]: r["content"] for r in rows} == want


def test_driver_has_no_index_of_files(spark, tree):
    found = readers.file_tree(spark, str(tree))
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    assert found.where(F.col("path") == "d/e/f/g.txt").count() == 1


def test_parts_of_a_table_and_other_paths(spark, tree):
    (tree / "k=1").mkdir()
    (tree / "k=1/p.txt").write_text("part")
    assert "k=1/p.txt" in {r["path"] for r in readers.file_tree(spark, str(tree)).collect()}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.file_tree(spark, str(tree / "absent"))
    assert readers.file_tree(spark, str(tree / "empty")).count() == 0
    assert [r["content"] for r in readers.file_tree(spark, str(tree / "a.rst")).collect()] == ["é\n"]
