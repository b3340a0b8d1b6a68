"""Depth-first order of trees as numbers, so that what lies below a node is a range.

Sizes of subtrees are summed from the deepest level up; numbers are given from the roots down: a node's number is its parent's
plus one plus the sizes of its earlier siblings. Rounds are the depth of the deepest tree; each touches one level. Every tree
is numbered on its own, from 0, so any number of roots shares the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.operators.ranks import kept


def include_tree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, parent, node, ordinal, depth, is_cut): what each root follows, a row a visit.

    edges: source, target, ordinal (the place of the inclusion in its file). roots: node. A file that its own path already
    holds is a leaf, cut. ids are ordinals joined by dots; a root's is empty, and its parent null.
    """
    links = edges.select("source", "target", F.col("ordinal").alias("__ordinal")).distinct()
    none = F.lit(None).cast("string")
    frontier = kept(roots.select("node").distinct().select(F.col("node").alias("root"), F.lit("").alias("id"), none.alias("parent"), "node", F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("depth"), F.lit(False).alias("is_cut"), F.array("node").alias("path")))
    found = frontier
    while True:
        step = frontier.where(~F.col("is_cut")).join(links, F.col("node") == F.col("source"))
        child = F.concat_ws(".", F.nullif(F.col("id"), F.lit("")), F.col("__ordinal").cast("string"))
        frontier = kept(step.select("root", child.alias("id"), F.col("id").alias("parent"), F.col("target").alias("node"), F.col("__ordinal").cast("long").alias("ordinal"), (F.col("depth") + 1).alias("depth"), F.array_contains("path", F.col("target")).alias("is_cut"), F.concat("path", F.array("target")).alias("path")))
        if not frontier.limit(1).count():
            return found.drop("path")
        found = found.unionByName(frontier)


def folder_tree(paths: DataFrame) -> DataFrame:
    """(root, id, parent, node, ordinal, depth, is_file): the folders and files of a column `path`, below the root ''.

    Names take the order of their text; ids are whole paths, those of folders with a slash at the end.
    """
    parts = F.split("path", "/")
    n = F.size(parts)
    entry = lambda i: F.struct(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < n, "/").otherwise("")).alias("id"), F.when(i == 1, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i - 1), "/"), F.lit("/"))).alias("parent"), parts[i - 1].alias("node"), i.alias("depth"), (i == n).alias("is_file"))
    rows = paths.select("path").where(F.col("path") != "").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), n), entry)).alias("e")).select("e.*").distinct()
    root = paths.sparkSession.createDataFrame([("", None, "", 0, False)], "id string, parent string, node string, depth int, is_file boolean")
    both = root.unionByName(rows)
    return both.select(F.lit("").alias("root"), "id", "parent", "node", F.col("id").alias("ordinal"), "depth", "is_file")


def numbered(tree: DataFrame) -> DataFrame:
    """tree (root, id, parent, ordinal, depth and others) with `enter` and `leave`: a node's place in depth-first order within
    its root's tree, from 0, and that of the last node below it (its own if there is none). (root, id) is unique; siblings are
    ordered by ordinal."""
    rows = kept(tree)
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return rows.withColumns({"enter": F.lit(0).cast("long"), "leave": F.lit(0).cast("long")})
    sizes, below = [], None
    for d in range(deepest, -1, -1):
        level = rows.where(F.col("depth") == d).select("root", "id", "parent", "ordinal")
        if below is not None:
            sums = below.groupBy("root", F.col("parent").alias("id")).agg(F.sum("size").alias("__below"))
            level = level.join(sums, ["root", "id"], "left").withColumn("size", F.coalesce("__below", F.lit(0)) + 1).drop("__below")
        else:
            level = level.withColumn("size", F.lit(1).cast("long"))
        below = kept(level)
        sizes.append(below)
    earlier = Window.partitionBy("root", "parent").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)  # siblings
    done = above = None
    for level in reversed(sizes):
        before = level.withColumn("__before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        if above is None:
            placed = before.select("root", "id", F.lit(0).cast("long").alias("enter"), "size")
        else:
            placed = before.join(above.select("root", F.col("id").alias("parent"), F.col("enter").alias("__enter")), ["root", "parent"]).select("root", "id", (F.col("__enter") + 1 + F.col("__before")).alias("enter"), "size")
        above = kept(placed)
        done = above if done is None else done.unionByName(above)
    return rows.join(done, ["root", "id"]).withColumn("leave", F.col("enter") + F.col("size") - 1).drop("size")


def below(labels: DataFrame, of: DataFrame) -> DataFrame:
    """(above, root, id, ...): for each row (root, id) of `of`, all rows of labels under it, itself included; no rounds.

    Within a root the test is a range; roots are joined by equality.
    """
    tops = labels.join(of.select("root", "id").distinct(), ["root", "id"], "left_semi").select(F.col("root").alias("__root"), F.col("id").alias("above"), F.col("enter").alias("__lo"), F.col("leave").alias("__hi"))
    joined = labels.join(tops, (F.col("root") == F.col("__root")) & F.col("enter").between(F.col("__lo"), F.col("__hi")))
    return joined.drop("__root", "__lo", "__hi")


def users_below(folders: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """(source) of the edges (source, target) whose target lies below a folder of labels (folder_tree, numbered)."""
    of = folders.sparkSession.createDataFrame([("", folder)], "root string, id string")
    inside = below(folders.where(F.col("is_file") | (F.col("id") == folder)), of).where("is_file").select(F.col("id").alias("target"))
    return edges.join(inside, "target", "left_semi").select("source").distinct()
