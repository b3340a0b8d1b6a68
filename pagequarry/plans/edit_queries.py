"""Edit scripts and line diffs over whole tables, with SQL that works them out by all pairs of places or by replaying."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions.edits import edit_counts
from pagequarry.operators import cdc, linediff
from pagequarry.plans import fixtures as X
from pagequarry.plans.registry import query

#: Names of parts and the name of the next part; a row of the table of common lengths a character of the first.
COMMON = """WITH RECURSIVE p AS (SELECT a.p_partkey AS k, a.p_name || ' ' || a.p_type AS x, b.p_name || ' ' || b.p_type AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
t AS (SELECT k, x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0) AS r FROM p
 UNION ALL SELECT k, x, y, i + 1, list_transform(range(0, length(y) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda q: greatest(r[q + 1], CASE WHEN q > 0 AND substr(y, CAST(q AS BIGINT), 1) = substr(x, i + 1, 1) THEN r[q] + 1 ELSE 0 END)))) FROM t WHERE i < length(x)),
c AS (SELECT k, x, y, CAST(r[length(y) + 1] AS BIGINT) AS common FROM t WHERE i = length(x))"""


def _neighbours(spark, sf_dir):
    part = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_type").alias("x"))
    return part.join(part.select((F.col("k") - 1).alias("k"), F.col("x").alias("y")), "k")


@query(COMMON + " SELECT k, length(x) - common AS deleted, length(y) - common AS inserted FROM c")
def edit_scripts(spark, sf_dir):
    """Bytes that a shortest edit script from each part's name to the next one's deletes and inserts."""
    return _neighbours(spark, sf_dir).select("k", edit_counts(F.col("x"), F.col("y")).alias("e")).select("k", "e.deleted", "e.inserted")


@query(COMMON + " SELECT k, CASE WHEN length(x) <> length(y) THEN abs(length(y) - length(x)) / length(x) < 0.3 AND common > 0 ELSE (length(x) - common) / length(x) < 0.3 END AS similar FROM c")
def similar_names(spark, sf_dir):
    """Whether a part's name passes as the next one's, changed."""
    return _neighbours(spark, sf_dir).select("k", (cdc.change_share(F.col("x"), F.col("y")) < cdc.MAX_CHANGE).alias("similar"))


#: Every document against an edited version of it and against the next document. The edited one has lines taken out, doubled,
#: put in and, in every third document, in reverse order.
VERSIONS = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
e AS (SELECT doc_id, a, flatten(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i % 7 = 3 THEN CAST([] AS VARCHAR[]) WHEN i % 5 = 2 THEN [a[i], a[i]] WHEN i % 11 = 4 THEN ['new ' || i, a[i]] ELSE [a[i]] END)) AS b FROM d),
v AS (SELECT 'edited ' || doc_id AS path, a, CASE WHEN doc_id % 3 = 0 THEN list_reverse(b) ELSE b END AS b FROM e UNION ALL SELECT 'next ' || x.doc_id, x.a, y.a FROM d x JOIN d y ON y.doc_id = x.doc_id + 1)"""


def _versions(spark, sf_dir):
    """(path, a, b, lines): texts go through the join as they are, and the number of lines of both is known without them."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n", F.size(F.split("text", "\n")))
    i = lambda k: k + 1
    edit = lambda x, k: F.when(i(k) % 7 == 3, F.array().cast("array<string>")).when(i(k) % 5 == 2, F.array(x, x)).when(i(k) % 11 == 4, F.array(F.concat(F.lit("new "), i(k).cast("string")), x)).otherwise(F.array(x))
    a = d.select("doc_id", F.split("text", "\n").alias("a"))
    b = F.flatten(F.transform("a", edit))
    edited = a.select(F.concat(F.lit("edited "), F.col("doc_id").cast("string")).alias("path"), "a", F.when(F.col("doc_id") % 3 == 0, F.reverse(b)).otherwise(b).alias("b"))
    edited = edited.withColumn("lines", F.size("a") + F.size("b"))
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"), F.col("n").alias("m"))
    pairs = d.join(following, "doc_id").select(F.concat(F.lit("next "), F.col("doc_id").cast("string")).alias("path"), F.split("text", "\n").alias("a"), F.split("next", "\n").alias("b"), (F.col("n") + F.col("m")).alias("lines"))
    return edited.unionByName(pairs)


@query(VERSIONS + " SELECT path, sha256(array_to_string(b, chr(10))) AS made, CAST(len(b) - len(a) AS BIGINT) AS net, a = b AS same FROM v")
def line_diffs_replayed(spark, sf_dir):
    """What the edits of each pair make of its first text: the second one."""
    edited = linediff.with_edits(_versions(spark, sf_dir))
    made = F.array_join(linediff.replayed(F.col("a"), F.col("b"), F.col("edits")), "\n")
    net = F.aggregate("edits", F.lit(0).cast("long"), lambda n, e: n + (e["b_end"] - e["b"]) - (e["a_end"] - e["a"]))
    return edited.select("path", F.sha2(made.cast("binary"), 256).alias("made"), net.alias("net"), (F.size("edits") == 0).alias("same"))


@query(VERSIONS + " SELECT CAST(count(*) FILTER (a <> b) AS BIGINT) AS differ, CAST(sum(len(b) - len(a)) AS BIGINT) AS net FROM v")
def unified_diff_totals(spark, sf_dir):
    """Pairs that differ, and lines added less lines taken away, counted in the text of their unified diffs."""
    rows = _versions(spark, sf_dir).select("path", F.array_join("a", "\n").alias("a"), F.array_join("b", "\n").alias("b"), "lines")
    lines = F.slice(F.split("diff", "\n"), 3, 1 << 30)
    signs = linediff.unified_diffs(rows).select("path", F.size(F.filter(lines, lambda x: x.startswith("+"))).alias("plus"), F.size(F.filter(lines, lambda x: x.startswith("-"))).alias("minus"))
    return signs.agg(F.count(F.lit(1)).alias("differ"), F.sum(F.col("plus") - F.col("minus")).cast("long").alias("net"))
