"""Include and usage graphs over edges (source, target): paths with cut cycles, closures, reverse usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.ranks import kept


def closure(edges: DataFrame, roots: DataFrame, terminal: str | None = None) -> DataFrame:
    """(root, node, depth): what each root reaches, with the least depth; the root itself has depth 0.

    Breadth first: each round joins the frontier alone and drops what has been seen, so rounds are the greatest depth and
    a cycle ends by itself. terminal: a suffix of nodes from which no edge is followed.
    """
    links = edges.select("source", "target").distinct()
    frontier = kept(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier  # a union of frontiers, none of which is written again
    while True:
        if terminal is not None:
            frontier = frontier.where(~F.col("node").endswith(terminal) | (F.col("depth") == 0))
        step = frontier.join(links, F.col("node") == F.col("source")).select("root", F.col("target").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = kept(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)


def include_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, node, depth, is_cut): every path from the roots; a node that its own path already holds is a leaf (cut)."""
    links = edges.select("source", "target")
    frontier = kept(roots.select(F.array("node").alias("path"), "node", F.lit(0).alias("depth"), F.lit(False).alias("is_cut")))
    found = frontier
    while True:
        step = frontier.where(~F.col("is_cut")).join(links, F.col("node") == F.col("source"))
        frontier = kept(step.select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_contains("path", F.col("target")).alias("is_cut")))
        if not frontier.limit(1).count():
            return found
        found = found.unionByName(frontier)


def include_stats(paths: DataFrame) -> DataFrame:
    """Distinct files, edges along the tree (repeats count) and greatest depth."""
    return paths.agg(F.countDistinct("node").alias("files"), F.count_if(F.col("depth") > 0).alias("edges"), F.max("depth").alias("max_depth"))


def usages(edges: DataFrame, target: str, directive: str | None = None) -> DataFrame:
    """Edges that lead to a file directly, of one type of directive if one is named."""
    found = edges.where(F.col("target") == target)
    return found if directive is None else found.where(F.col("directive") == directive)


def usages_by_file(found: DataFrame) -> DataFrame:
    """(source, directive, usages) of usages, counted anew after whatever filter."""
    return found.groupBy("source", "directive").agg(F.count(F.lit(1)).alias("usages"))


def pages_using(edges: DataFrame, target: str, page_suffix: str = ".txt") -> DataFrame:
    """Pages that use a file directly or through others; pages end the search."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    roots = edges.sparkSession.createDataFrame([(target,)], "node string")
    return closure(back, roots, terminal=page_suffix).where((F.col("depth") > 0) & F.col("node").endswith(page_suffix)).select(F.col("node").alias("page"), "depth")


def usage_totals(edges: DataFrame) -> DataFrame:
    """Usages and distinct files by directive type, and over all in the row whose type is null."""
    return edges.rollup("directive").agg(F.count(F.lit(1)).alias("usages"), F.countDistinct("source").alias("files"))
