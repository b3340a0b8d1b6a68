"""Rules on paths as a table: any number of them, found by the beginnings of paths.

Every rule has a literal beginning that all paths under it share (empty for patterns that begin anywhere). The beginnings are
the trie: a path is exploded to those of its beginnings whose length some rule has, and an equi-join finds the rules whose
beginning it is. Only these are tried, and the first of each workflow that holds decides. So work goes by paths and the rules
near them, not by paths times rules, and the plan doesn't grow with the rules. A rule without a literal beginning meets every
path, as it must.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import scalars as S
from pagequarry.operators.paths import valid_pattern
from pagequarry.operators.ranks import kept

KINDS = ("move", "copy", "prefix", "glob", "regex")
COMPILED = "workflow string, idx int, kind string, start string, pattern string, target string, cut int, names array<struct<name:string,at:int>>, excludes array<string>"
#: Rules up to this number, counted first, are broadcast; more are joined by shuffling.
MAX_BROADCAST = 200_000


def literal_start(pattern: str) -> str:
    """What every match of a regular expression begins with, as far as can be told by looking; '' if it may begin anywhere."""
    if not pattern.startswith("^") or "|" in re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)", "", pattern) or re.search(r"\(\?[a-zA-Z-]+[:)]", pattern):
        return ""
    out, i = "", 1
    while i < len(pattern):
        c, n = pattern[i], 1
        if c == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            c, n = pattern[i + 1], 2
        elif c in "\\.[](){}^$*+?|":
            break
        if pattern[i + n : i + n + 1] in ("*", "?", "{"):
            break
        out += c
        i += n
        if pattern[i : i + 1] == "+":
            break
    return out


def _compiled(kind: str, pattern: str) -> tuple[str, str | None, int, list[dict]] | None:
    """start, expression, characters before the relative path, named groups."""
    if kind == "move":
        return pattern.rstrip("/"), None, 0, []
    if kind in ("copy", "prefix"):
        return pattern, None, len(pattern), []
    if kind == "glob":
        fixed = re.split(r"[*?\[{\\]", pattern)[0]
        lead = re.split(r"[*?\[{]", pattern)[0]
        return fixed, S.glob_pattern(pattern), lead.rfind("/") + 1, []
    if not valid_pattern(pattern):
        return None  # such a rule never holds
    return literal_start(pattern), S.java_groups(pattern), 0, [{"name": n, "at": i} for n, i in re.compile(pattern).groupindex.items()]


def compiled(rules: DataFrame) -> DataFrame:
    """Rules (workflow, idx, kind, pattern, target, excludes) ready to apply; their kinds are those of paths.rule_target."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                if r.kind not in KINDS:
                    raise ValueError(f"no such kind of rule: {r.kind}")
                found = _compiled(r.kind, r.pattern)
                if found is not None:
                    start, expression, cut, names = found
                    rows.append((r.workflow, r.idx, r.kind, start, expression, r.target, cut, names, [S.java_groups(e) for e in (r.excludes if r.excludes is not None else []) if valid_pattern(e)]))
            yield pd.DataFrame(rows, columns=["workflow", "idx", "kind", "start", "pattern", "target", "cut", "names", "excludes"])

    return rules.select("workflow", "idx", "kind", "pattern", "target", "excludes").mapInPandas(run, COMPILED)


def apply(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ..., workflow, rule_idx, target) by the first rule (compiled) of each workflow that holds; a repeated path is
    decided once. Of two rules of one idx the one with the lesser target counts."""
    rules = kept(rules)
    lengths = sorted(r[0] for r in rules.select(F.length("start").alias("n")).distinct().collect())  # numbers up to the longest path
    size = F.length("path")
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= size), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = files.select("path").distinct().select("path", F.explode(starts).alias("start"))
    near = tried.join(F.broadcast(rules) if rules.count() <= MAX_BROADCAST else rules, "start")
    path, start, kind, target = F.col("path"), F.col("start"), F.col("kind"), F.col("target")
    rest = F.substring(path, F.col("cut") + 1, size)
    fits = F.rlike(path, F.col("pattern"))
    groups = F.aggregate("names", S.fill_names(target, path), lambda t, g: F.replace(t, F.concat(F.lit("${"), g["name"], F.lit("}")), F.call_function("regexp_extract", path, F.col("pattern"), g["at"])))
    filled = lambda t: F.when(~t.contains("${"), t)
    hit = (
        F.when(kind == "move", F.when(path == start, target).when(path.startswith(F.concat(start, F.lit("/"))), F.concat(target, F.substring(path, F.length(start) + 1, size))))
        .when(kind == "copy", F.when(path == start, target))
        .when(kind == "prefix", S.fill_path(target, path, {"relative_path": F.regexp_replace(rest, "^/", "")}))
        .when(kind == "glob", F.when(fits, S.fill_path(target, path, {"relative_path": rest})))
        .otherwise(F.when(fits, filled(groups)))
    )
    held = near.where(~F.exists("excludes", lambda e: F.rlike(path, e))).select("path", "workflow", "idx", hit.alias("target")).where(F.col("target").isNotNull())
    first = held.groupBy("path", "workflow").agg(F.min(F.struct("idx", "target")).alias("m")).select("path", "workflow", F.col("m.idx").alias("rule_idx"), "m.target")
    return files.join(first, "path").select(*files.columns, "workflow", "rule_idx", "target")
