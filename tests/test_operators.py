import datetime
import difflib
import json
import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import catalog, cdc, deps, graph, includes, linediff, paths, ranks, reports, updates
from pagequarry.plans import cdc_queries
from pagequarry.plans import fixtures as X
from pagequarry.sources import readers, sinks
from pagequarry.streaming import audit

SF = "/root/testdata/sf0.001"


def test_node_diff_rows(spark):
    old = [("p", "h1", "print(1)"), ("p", "h1", "print(1)"), ("p", "h2", "aaaaaaaaaabbbbbbbbbb"), ("p", "h3", "gone gone gone")]
    new = [("p", "h1", "print(1)"), ("p", "h4", "aaaaaaaaaabbbbbbbbbbcc"), ("p", "h5", "x")]
    schema = "page_id string, sha_256_hash string, code string"
    got = {tuple(r)[1:] for r in cdc.diff_nodes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {("h1", "h1", 2, 1, "unchanged"), ("h2", "h4", 1, 1, "updated"), ("h3", None, 1, 0, "removed"), (None, "h5", 0, 1, "new")}


@pytest.mark.parametrize(("old", "new", "near"), [("abcdefghij" * 10, "abcdefghij" * 10 + "k", True), ("abcdefghij" * 10, "abcdefghij" * 12, True), ("abcdefghij" * 10, "abcdefghij" * 13, False), ("abcde" * 4, "abcdX" + "abcde" * 3, True), ("aaaa", "bbbb", False)])
def test_similarity(spark, old, new, near):
    side = lambda h, c: spark.createDataFrame([("p", h, c)], "page_id string, sha_256_hash string, code string")
    assert ("updated" in {r["status"] for r in cdc.diff_nodes(side("a", old), side("b", new)).collect()}) == near


def test_matching_is_one_to_one_and_ignores_order(spark):
    pairs = spark.createDataFrame([(a, b, (a * 7 + b * 3) % 11) for a in range(12) for b in range(12) if (a + b) % 3], "a long, b long, w long").withColumn("rank", F.struct("w", "a", "b"))
    got = [sorted((r["a"], r["b"]) for r in cdc.one_to_one(df, "a", "b").collect()) for df in (pairs, pairs.orderBy(F.desc("w")).repartition(3))]
    assert got[0] == got[1]
    assert len({a for a, _ in got[0]}) == len(got[0]) == len({b for _, b in got[0]})


def test_ranks_and_matching_of_one_large_group(spark):
    """Ten thousand pages of equal counts that share one word: all are matched, in few rounds."""
    rows = spark.range(10_000)
    side = lambda kind: rows.select(F.concat(F.lit("a|tutorial-"), F.lit(kind), F.col("id").cast("string")).alias("page_id"), *[F.lit(1).alias(c) for c in ("code_count", "literal_count", "io_count")])
    got = cdc.page_moves(side("x"), side("y")).collect()
    assert len(got) == len({r["old_id"] for r in got}) == len({r["new_id"] for r in got}) == 10_000
    ranked = ranks.ranked(spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") % 50).alias("v"), "id").repartition(7), ["k"], ["v", "id"]).collect()
    for k in range(3):
        own = sorted((r["v"], r["id"], r["rank"]) for r in ranked if r["k"] == k)
        assert [r[2] for r in own] == list(range(len(own)))
    assert ranks.ranked(spark.range(0), [], ["id"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_edit_share_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    pairs = []
    for _ in range(60):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 3)):
            b[rng.randrange(len(b))] = rng.choice("abcdxyz")
        pairs.append(("".join(a), "".join(b)))
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(cdc.edit_share("a", "b")).collect()]
    for (a, b), share in zip(pairs, got, strict=True):
        same = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        best = (len(a) - same) / len(a)
        assert (share < cdc.MAX_CHANGE) >= (best < cdc.MAX_CHANGE)  # trimming equal ends never makes a match worse


def test_include_paths_cut_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d.txt"), ("d.txt", "e.txt")], "source string, target string")
    rows = graph.include_paths(edges, spark.createDataFrame([("a",)], "node string")).collect()
    assert sorted("".join(x[0] for x in r["path"]) for r in rows if r["is_cut"]) == ["abca", "aca"]
    assert graph.include_stats(graph.include_paths(edges, spark.createDataFrame([("a",)], "node string"))).first()["files"] == 5
    assert {r["page"] for r in graph.pages_using(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), "c").collect()} == {"d.txt"}


def test_manifests_and_parsers(spark):
    names = ["a/package.json", "node_modules/x/package.json", "b/app.csproj", "pom.xml", "README.md", "c/go.mod"]
    got = {r["path"]: (r["type"], r["dir"]) for r in deps.manifests(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {"a/package.json": ("npm", "a"), "b/app.csproj": ("nuget", "b"), "pom.xml": ("maven", "."), "c/go.mod": ("go", "c")}
    one = lambda c: spark.createDataFrame([("f", c)], "path string, content string")
    assert {tuple(r)[1:] for r in deps.npm_dependencies(one('{"dependencies":{"a":"^1.2.3"},"devDependencies":{"b":"~2.0.0"}}')).collect()} == {("a", "1.2.3", False), ("b", "2.0.0", True)}
    assert {tuple(r)[1:] for r in deps.pip_requirements(one("# c\nx==1.0\ny[z]>=2.1,<3\n-r other\nq\n")).collect()} == {("x", "1.0"), ("y", "2.1"), ("q", None)}
    assert {tuple(r)[1:] for r in deps.go_requirements(one("module m\nrequire (\n\tex.com/a v1.2.3\n\tex.com/b v0.1.0 // indirect\n)")).collect()} == {("ex.com/a", "v1.2.3", True), ("ex.com/b", "v0.1.0", False)}
    assert {tuple(r)[1:] for r in deps.maven_dependencies(one("<dependency><groupId>g</groupId><artifactId>a</artifactId><version> 1 </version></dependency>")).collect()} == {("g:a", "1")}
    assert {tuple(r)[1:] for r in deps.nuget_references(one('<PackageReference Include="P" Version="3.1.0" />')).collect()} == {("P", "3.1.0")}


def test_version_comparison(spark):
    files = spark.createDataFrame([("p/manual/a", "x"), ("p/v8/a", "x"), ("p/v7/a", "y")], "path string, content string")
    compared = paths.compare_versions(files, "p/{version}/a", ["manual", "v8", "v7", "v6"], "manual")
    assert {r["version"]: r["status"] for r in compared.collect()} == {"manual": "matches", "v8": "matches", "v7": "differs", "v6": "not found"}
    assert tuple(paths.comparison_totals(compared).first()) == (2, 1, 1)


def test_includes_resolve(spark):
    edges = spark.createDataFrame([("c/p/source/x/a.txt", "/inc/b"), ("c/p/source/x/a.txt", "near.rst"), ("c/p/source/x/a.txt", "none")], "source string, ref string")
    files = spark.createDataFrame([("c/p/source/inc/b.rst",), ("c/p/source/x/near.rst",)], "path string")
    assert {r["ref"]: r["target"] for r in includes.resolve_includes(edges, files).collect()} == {"/inc/b": "c/p/source/inc/b.rst", "near.rst": "c/p/source/x/near.rst", "none": None}


def test_current_versions_only(spark):
    files = spark.createDataFrame([(f"content/{p}",) for p in ("a/current/source/x.txt", "a/v1/source/x.txt", "b/source/x.txt", "b/source/code-examples/y.txt", "top.txt", "code-examples/source/z.txt")], "path string")
    assert sorted((r["project"], r["version"]) for r in paths.counted_pages(files, current_only=True).collect()) == [("a", "current"), ("b", None)]
    assert paths.counted_pages(files).count() == 3


def test_upper_median(spark):
    rows = [("c", "x" * n, None) for n in (1, 2, 3, 4)] + [("d", "x" * n, None) for n in (5, 5, 9)]
    got = {r["collection"]: r["median_length"] for r in catalog.code_lengths(spark.createDataFrame(rows, "collection string, code string, is_removed boolean")).collect()}
    assert got == {"c": 3, "d": 5}


def test_summaries_and_languages_map(spark):
    when = datetime.datetime(2025, 1, 1)
    schema = readers.SUMMARIES
    old = spark.createDataFrame([("a", {"v1": (1, 2, when)})], schema)
    new = spark.createDataFrame([("a", {"v2": (3, 4, when + datetime.timedelta(1))}), ("b", {"v1": (5, 6, when)})], schema)
    got = updates.upsert_summary(old, new)
    assert {r["collection"]: sorted(r["version"]) for r in got.collect()} == {"a": ["v1", "v2"], "b": ["v1"]}
    assert {r["collection"]: r["latest_version"] for r in catalog.latest_version(got).collect()} == {"a": "v2", "b": "v1"}
    df = spark.createDataFrame([([{"a": 1}, {"b": 2}, {"a": 3}],)], "l array<map<string,int>>")
    assert df.select(catalog.languages_map(F.col("l"))).first()[0] == {"a": 3, "b": 2}


def test_readers(spark, tmp_path):
    (tmp_path / "pages.ndjson").write_text('{"type":"metadata","data":{}}\n{"type":"page","data":{"page_id":"a/b/c/d","github_username":"bot","ast":{"type":"root"},"deleted":true}}\n{"type":"page","data":{"page_id":"x","github_username":"man"}}')
    rows = readers.page_stream(spark, str(tmp_path / "pages.ndjson"))
    assert sorted((r["page_id"], r["deleted"]) for r in rows.collect()) == [("a/b/c/d", True), ("x", False)]
    assert [r["page_id"] for r in readers.pages_by_author(rows, ["bot"]).collect()] == ["a/b/c/d"]
    (tmp_path / "projects.json").write_text('{"data":[{"project":"p","branches":[{"gitBranchName":"m","active":true,"fullUrl":"http://x/p/","isStableBranch":true}]},{"project":"q","branches":[{"gitBranchName":"a","active":false,"fullUrl":"http://x/q/v1","isStableBranch":true},{"gitBranchName":"b","active":true,"fullUrl":"http://x/q/v2/","isStableBranch":true}]},{"project":"ignored","branches":[]}]}')
    assert sorted(tuple(r) for r in readers.projects(spark, str(tmp_path / "projects.json"), ["ignored"]).collect()) == [("p", "main", "http://x/p"), ("q", "v2", "http://x/q/v2")]
    tree = tmp_path / "t" / "sub"
    tree.mkdir(parents=True)
    (tree / "a.rst").write_text("one\ntwo")
    (tree / "b.png").write_text("no")
    files = readers.file_tree(spark, str(tmp_path / "t"))
    assert [r["path"] for r in files.collect()] == ["sub/a.rst"]
    assert [(r["line_no"], r["line"]) for r in readers.lines(files).collect()] == [(1, "one"), (2, "two")]
    log = spark.createDataFrame([("f", 1, "Project changes for alpha"), ("f", 2, "Code example created: Page ID: x|y, 3 new code examples added"), ("f", 3, "Project changes for beta"), ("f", 4, "Page removed: Page ID: z")], "path string, line_no int, line string")
    assert [tuple(r)[2:] for r in readers.run_log(log).orderBy("line_no").collect()] == [("alpha", "examples_created", "x|y", 3), ("beta", "removed", "z", None)]
    assert readers.with_defaults([{"a": 1, "n": {"x": 1, "y": 2}}, {"a": None, "n": {"y": 3}}]) == {"a": 1, "n": {"x": 1, "y": 3}}


def test_configuration_and_stored_answers(spark, tmp_path):
    documents = {"base": {"repo": "r", "opts": {"a": 1, "b": 2}}, "own": {"$ref": "base", "opts": {"b": 3}}, "loop": {"$ref": "loop"}}
    assert readers.resolved({"flows": [{"$ref": "own", "name": "x"}]}, documents) == {"flows": [{"repo": "r", "opts": {"a": 1, "b": 3}, "name": "x"}]}
    for bad in ("loop", "absent"):
        with pytest.raises(ValueError):
            readers.resolved({"$ref": bad}, documents)
    answer = lambda *nodes: json.dumps({"data": {"repository": {"pullRequest": {"files": {"edges": [{"node": n} for n in nodes]}}}}})
    node = lambda p, t: {"path": p, "changeType": t, "additions": 1, "deletions": 2}
    (tmp_path / "answers.json").write_text(answer(node("a", "ADDED"), node("b", "DELETED")) + "\n" + answer(node("c", "MODIFIED")))
    assert sorted(tuple(r) for r in readers.changed_files(spark, str(tmp_path / "answers.json")).collect()) == [("a", "added", 1, 2), ("b", "deleted", 1, 2), ("c", "modified", 1, 2)]


def test_files_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.txt", "é1"), ("b.txt", None)], "path string, content string")
    sinks.write_files(rows, f"file://{tmp_path}/dry", dry_run=True)
    assert not (tmp_path / "dry").exists()
    for _ in range(2):
        assert sorted(tuple(r) for r in sinks.write_files(rows, f"file://{tmp_path}/out").collect()) == [("b.txt", 0), ("x/a.txt", 3)]
    assert (tmp_path / "out/x/a.txt").read_text() == "é1" and (tmp_path / "out/b.txt").read_text() == ""
    with pytest.raises(ValueError):
        sinks.write_files(rows.unionByName(rows), f"file://{tmp_path}/out")


def test_unified_diffs(spark):
    rows = spark.createDataFrame([("p", "a\nb", "a\nc"), ("q", "a", "a"), ("r", None, "x")], "path string, a string, b string")
    got = {r["path"]: r["diff"].split("\n")[3:] for r in linediff.unified_diffs(rows).collect()}
    assert got == {"p": [" a", "-b", "+c"], "r": ["-", "+x"]}


def test_strict_counts_leave_pages_of_equal_counts(spark):
    stored, incoming, nodes = cdc_queries._snapshots(spark, SF)
    at = F.lit("2025-06-02").cast("date")
    same = stored.where("page_id = 'pg2'")
    five = nodes.where("page_id = 'pg2'").limit(5)
    changed = lambda strict: cdc.update_pages(same, incoming, five, at, strict).first()["date_last_updated"].month == 6
    assert changed(False) and not changed(True)


def test_sinks_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("b", 5)], "key string, count long")
    sinks.append(df, str(tmp_path / "m"), "key")
    sinks.append(df, str(tmp_path / "m"), "key")
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    assert reports.table_text(reports.by_count(df, "key"), ["key"]) == "key  count\n---  -----\na    2\nb    5"
    feedback = spark.range(500).select((F.col("id") % 3).cast("string").alias("docs_property"), F.lit("u").alias("url"), F.lit("c").alias("comment"), "id")
    numbered = sorted((r["entry_number"], r["docs_property"]) for r in sinks.numbered_feedback(feedback).collect())
    assert [n for n, _ in numbered] == list(range(1, 501)) and [p for _, p in numbered] == sorted(p for _, p in numbered)


def test_stream_agrees_with_batch(spark, tmp_path):
    events = X.audit(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = audit.stats_by_rule(stream).writeStream.outputMode("complete").format("memory").queryName("rules").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from pagequarry.operators.events import stats_by_rule

    key = ["rule_name", "total", "succeeded", "failed"]
    assert sorted(spark.table("rules").select(*key).collect()) == sorted(stats_by_rule(events).select(*key).collect())


def test_filters_reach_the_scan(spark):
    df = catalog.category_by_product(X.nodes(spark, SF), "Usage example")
    plan = df._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert "n_chars" not in read and "text" not in read


def test_library_works_without_the_llm_folder():
    code = "import sys; sys.modules['pagequarry.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'category_counts' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')], q"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
