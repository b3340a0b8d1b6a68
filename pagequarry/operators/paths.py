"""Operators over file listings: rules on paths, search, counts of pages and tested examples, version comparison."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import scalars as S
from pagequarry.operators.ranks import ranked

def valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches any regular expression of a list; invalid ones are passed over."""
    out = F.lit(False)
    for p in patterns:
        if valid_pattern(p):
            out = out | F.rlike(path, F.lit(S.java_groups(p)))
    return out


def rule_target(path: Column, rule: dict) -> Column:
    """Target of a path under one rule (kind, pattern, target, excludes), null where the rule doesn't hold.

    move: the path is the pattern or lies beneath it; what follows is kept. copy: equality. prefix: no boundary of parts
    is asked for. glob and regex: the target is a template; a glob gives ${relative_path}, a regex its named groups.
    """
    kind, pattern, target = rule["kind"], rule["pattern"], rule["target"]
    if kind == "move":
        base = pattern.rstrip("/")
        hit = F.when(path == base, target).when(path.startswith(base + "/"), F.concat(F.lit(target), F.substring(path, F.lit(len(base) + 1), F.length(path))))
    elif kind == "copy":
        hit = F.when(path == pattern, target)
    elif kind == "prefix":
        rest = F.regexp_replace(F.substring(path, F.lit(len(pattern) + 1), F.length(path)), "^/", "")
        hit = F.when(path.startswith(pattern), S.fill_path(target, path, {"relative_path": rest}))
    elif kind == "glob":
        fixed = re.split(r"[*?\[{]", pattern)[0]
        lead = fixed[: fixed.rfind("/") + 1]
        rest = F.substring(path, F.lit(len(lead) + 1), F.length(path))
        hit = F.when(F.rlike(path, F.lit(S.glob_pattern(pattern))), S.fill_path(target, path, {"relative_path": rest}))
    elif kind == "regex":
        names = list(re.compile(pattern).groupindex.items()) if valid_pattern(pattern) else []
        java = S.java_groups(pattern)
        groups = {name: F.regexp_extract(path, java, i) for name, i in names}
        hit = F.when(F.rlike(path, F.lit(java)), S.fill_path(target, path, groups)) if valid_pattern(pattern) else F.lit(None).cast("string")
    else:
        raise ValueError(f"no such kind of rule: {kind}")
    return F.when(~excluded(path, rule.get("excludes", [])), hit)


def apply_rules(files: DataFrame, rules: list[dict]) -> DataFrame:
    """(path, ..., workflow, rule_idx, target) by the first rule of each workflow that holds; no join, one expression.

    Rules are a configuration, not data: each becomes an expression of the plan.
    """
    flows: dict[str, list[tuple[int, dict]]] = {}
    for i, r in enumerate(rules):
        flows.setdefault(r.get("workflow", ""), []).append((r.get("idx", i), r))
    tried = []
    for flow, own in flows.items():
        hits = [(i, rule_target(F.col("path"), r)) for i, r in sorted(own, key=lambda x: x[0])]
        first = F.coalesce(*[F.when(h.isNotNull(), F.struct(F.lit(flow).alias("workflow"), F.lit(i).alias("rule_idx"), h.alias("target"))) for i, h in hits])
        tried.append(first)
    found = files.withColumn("m", F.explode(F.array_compact(F.array(*tried))))
    return found.select(*files.columns, "m.workflow", "m.rule_idx", "m.target")


def uploads(matched: DataFrame, *by: str) -> DataFrame:
    """Files queued by the columns `by` (repo and branch; workflow if none are named): how many, and their targets in order.

    A queue is one commit, so its targets belong together.
    """
    return matched.groupBy(*(by or ("workflow",))).agg(F.count(F.lit(1)).alias("files"), F.sort_array(F.collect_list("target")).alias("targets"))


def upload_commits(matched: DataFrame, *by: str, most: int = 1000) -> DataFrame:
    """uploads in commits of at most `most` files: the columns `by`, commit (from 0), files and targets in order. A queue of
    any size so spreads over rows."""
    keys = list(by or ("workflow",))
    numbered = ranked(matched.select(*keys, "target"), keys, ["target"]).withColumn("commit", F.floor(F.col("rank") / most))
    return numbered.groupBy(*keys, "commit").agg(F.count(F.lit(1)).alias("files"), F.sort_array(F.collect_list("target")).alias("targets"))


def deprecations(known: DataFrame, removed: DataFrame, at: Column) -> DataFrame:
    """known (filename, repo, branch, deleted_on) with an entry for each target of removed (target, repo, branch) added."""
    new = removed.select(F.col("target").alias("filename"), "repo", "branch", at.alias("deleted_on"))
    return known.unionByName(new)


def without_excluded(found: DataFrame, globs: list[str], column: str = "source") -> DataFrame:
    """Rows whose path in column matches none of the globs."""
    out = F.lit(False)
    for g in globs:
        out = out | F.rlike(F.col(column), F.lit(S.glob_pattern(g)))
    return found.where(~out)


def search(files: DataFrame, needle: str, whole: bool = True, ignore_case: bool = True) -> DataFrame:
    """(path, language, found) by file. files: path, content."""
    hit = S.whole_word(F.col("content"), needle, ignore_case) if whole else S.part_of(F.col("content"), needle, ignore_case)
    return files.select("path", S.language_of_path(F.col("path")).alias("language"), F.coalesce(hit, F.lit(False)).alias("found"))


def search_report(found: DataFrame) -> DataFrame:
    """Files scanned and containing, by language and over all (language null)."""
    return found.rollup("language").agg(F.count(F.lit(1)).alias("scanned"), F.count_if("found").alias("containing"))


def counted_pages(files: DataFrame, exclude_dirs: list[str] = (), current_only: bool = False) -> DataFrame:
    """(path, project, version) of the pages of a tree: .txt files under content/<project>/[<version>/]source/.

    `code-examples` directly under content/ or content/<project>/source/ doesn't count, nor do files directly in
    content/; exclude_dirs are left out wherever they stand. current_only keeps of projects that have versions only
    the current ones, and all others whole.
    """
    path = F.col("path")
    parts = F.split(path, "/")
    is_page = path.startswith("content/") & path.endswith(".txt") & F.array_contains(parts, "source")
    pruned = (parts[1] == "code-examples") | ((parts[2] == "source") & (parts[3] == "code-examples"))
    rows = files.where(is_page & ~F.coalesce(pruned, F.lit(False)) & ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in exclude_dirs]).cast("array<string>")))
    rows = rows.select("path", S.project_of_path(path).alias("project"), S.version_of_path(path).alias("version")).where(F.col("project").isNotNull())
    if current_only:
        versioned = rows.groupBy("project").agg(F.max(F.col("version").isNotNull()).alias("versioned"))
        rows = rows.join(versioned, "project").where(~F.col("versioned") | F.col("version").isin("current", "manual")).drop("versioned")
    return rows


def page_counts(rows: DataFrame) -> DataFrame:
    """Counts by (project, version), by project (version null and level 1) and over all (level 2)."""
    g = F.grouping_id().alias("g")
    counts = rows.rollup("project", "version").agg(F.count(F.lit(1)).alias("count"), g)
    return counts.select("project", "version", F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).otherwise(2).alias("level"), "count")


def tested_examples(files: DataFrame, products: DataFrame, without_outputs: bool = False, special: dict[str, str] | None = None) -> DataFrame:
    """(product, count) of files content/code-examples/tested/<language>/<product>/*, by the products known.

    products: product, extensions (array). Files named *output* don't count with without_outputs. special: languages whose
    files count for a product of their own, whatever the folder beneath.
    """
    parts = F.split("path", "/")
    rows = files.where(F.col("path").startswith("content/code-examples/tested/") & (F.size(parts) > 5)).select("path", F.coalesce(S.lookup(parts[3], special) if special else F.lit(None).cast("string"), parts[4]).alias("product"), S.file_extension(F.col("path")).alias("ext"))
    if without_outputs:
        rows = rows.where(~F.element_at(F.split("path", "/"), -1).contains("output"))
    known = rows.join(products, "product").where(F.array_contains("extensions", F.col("ext")) | F.col("extensions").isNull())
    return known.groupBy("product").agg(F.count(F.lit(1)).alias("count"))


def compare_versions(files: DataFrame, path: str, versions: list[str], base: str) -> DataFrame:
    """(version, status) of a file across versions against a base: matches, differs, or not found.

    files: path, content. path holds {version} where the version stands; versions are the caller's short list.
    """
    spark = files.sparkSession
    wanted = spark.createDataFrame([(v, path.replace("{version}", v)) for v in versions], "version string, path string")
    held = files.join(F.broadcast(wanted), "path").select("version", F.sha2(F.col("content").cast("binary"), 256).alias("h"))
    against = held.where(F.col("version") == base).agg(F.max("h").alias("b"))
    joined = wanted.join(held, "version", "left").join(F.broadcast(against))
    status = F.when(F.col("h").isNull(), "not found").when(F.col("h") == F.col("b"), "matches").otherwise("differs")
    return joined.select("version", status.alias("status"))


def compare_trees(files: DataFrame, versions: list[str], base: str) -> DataFrame:
    """(path, version, status) of every path in every version against a base version: matches, differs, not found, or, where
    the base itself lacks the file, no base. files: path (without the version), version, content."""
    wanted = F.array(*[F.lit(v) for v in versions])  # the caller's short list
    held = files.select("path", "version", F.sha2(F.col("content").cast("binary"), 256).alias("h"))
    grid = held.select("path").distinct().select("path", F.explode(wanted).alias("version"))
    against = held.where(F.col("version") == base).select("path", F.col("h").alias("b"))
    joined = grid.join(held, ["path", "version"], "left").join(against, "path", "left")
    status = F.when(F.col("h").isNull(), "not found").when(F.col("b").isNull(), "no base").when(F.col("h") == F.col("b"), "matches").otherwise("differs")
    return joined.select("path", "version", status.alias("status"))


def comparison_totals(compared: DataFrame) -> DataFrame:
    return compared.agg(*[F.count_if(F.col("status") == s).alias(s.replace(" ", "_")) for s in ("matches", "differs", "not found")])
