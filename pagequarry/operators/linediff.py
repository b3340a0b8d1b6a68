"""Line diffs as Spark jobs: anchors by one aggregate over lines, gaps as rows of their own, hunks by array expressions.

A text's lines are numbered from 0. Lines that stand exactly once on both sides of a pair are candidates; the longest chain
of them that rises on both sides are the anchors (patience diff). Between anchors lie gaps, which don't know each other: each
is a row, and its own longest common subsequence is found in whatever task it lands. A pair of long texts so spreads over
lines first and gaps later; only the numbers of its anchors and edits, and its two texts, are ever in one row. A pair of up
to LINES lines takes the same steps where its row is, and its texts are neither written nor dealt.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.edits import common_head
from pagequarry.operators.ranks import staged

EDITS = "array<struct<a:int,a_end:int,b:int,b_end:int>>"
#: Cells of a table of common lengths that a gap may take; a larger gap is halved at the best place first.
CELLS = 1 << 22
#: Lines of both texts of a pair up to which it is one unit of work.
LINES = 50_000


def rising(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Indices of a longest chain of places that rises in both; at is ascending. By piles, with a binary search a place."""
    tops: list[int] = []
    top_values: list[int] = []
    before = np.full(len(at), -1)
    for i, v in enumerate(to.tolist()):
        p = bisect_left(top_values, v) if not top_values or v < top_values[-1] else len(top_values)
        before[i] = tops[p - 1] if p else -1
        if p == len(tops):
            tops.append(i)
            top_values.append(v)
        else:
            tops[p], top_values[p] = i, v
    chain, i = [], tops[-1] if tops else -1
    while i >= 0:
        chain.append(i)
        i = int(before[i])
    return np.array(chain[::-1], dtype=np.int64)


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common lengths of all of x with every prefix of y, a row at a time."""
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for v in x:
        best = np.where(y == v, row[:-1] + 1, 0)
        row[1:] = np.maximum(row[1:], np.maximum.accumulate(best))
    return row


def matched(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence of two arrays of numbers, in order; space is linear beyond CELLS."""
    if not len(x) or not len(y):
        return []
    if (len(x) + 1) * (len(y) + 1) > CELLS and len(x) > 1:
        half = len(x) // 2
        cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        return matched(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in matched(x[half:], y[cut:])]
    rows = [np.zeros(len(y) + 1, dtype=np.int32)]
    for v in x:
        row = rows[-1].copy()
        row[1:] = np.maximum(row[1:], np.maximum.accumulate(np.where(y == v, rows[-1][:-1] + 1, 0)))
        rows.append(row)
    i, j, out = len(x), len(y), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def gap_edits(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Edits (a, a_end, b, b_end) that make the lines b of a, by a longest common subsequence of lines."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(line, len(number)) for line in lines], dtype=np.int64) for lines in (a, b))
    head = common_head(x.tobytes(), y.tobytes()) // 8
    x, y = x[head:], y[head:]
    tail = common_head(x[::-1].tobytes(), y[::-1].tobytes()) // 8
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    both = np.intersect1d(x, y)  # lines of one side only can't match
    at, to = np.flatnonzero(np.isin(x, both)), np.flatnonzero(np.isin(y, both))
    pairs = [(int(at[i]), int(to[j])) for i, j in matched(x[at], y[to])] + [(len(x), len(y))]
    out, i, j = [], 0, 0
    for p, q in pairs:
        if p > i or q > j:
            out.append((i + head, p + head, j + head, q + head))
        i, j = p + 1, q + 1
    return out


def pair_edits(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Edits that make the lines b of a: anchors first, then each gap between them."""

    def once(lines: list[str]) -> dict[str, int]:
        at: dict[str, int] = {}
        for i, line in enumerate(lines):
            at[line] = -1 if line in at else i
        return {line: i for line, i in at.items() if i >= 0}

    if a == b:
        return []
    there = once(b)
    found = [(i, there[line]) for line, i in once(a).items() if line in there]
    chain = rising(np.array([i for i, _ in found]), np.array([j for _, j in found])).tolist()
    out, i, j = [], 0, 0
    for p, q in [found[k] for k in chain] + [(len(a), len(b))]:
        if p > i and q > j:
            out += [(x + i, x_end + i, y + j, y_end + j) for x, x_end, y, y_end in gap_edits(a[i:p], b[j:q])]
        elif p > i or q > j:
            out.append((i, p, j, q))
        i, j = p + 1, q + 1
    return out


def anchors(pairs: DataFrame) -> DataFrame:
    """(path, anchors): places (a, b), in order, of lines that stand once on both sides and keep their order. pairs: path, a,
    b (arrays of lines). A path without any is left out."""
    lines = lambda side: pairs.select("path", F.posexplode(side).alias("at", "line"), F.lit(side == "a").alias("in_a"))
    in_a = F.col("in_a")
    once = lines("a").unionByName(lines("b")).groupBy("path", "line").agg(F.count_if(in_a).alias("n"), F.count_if(~in_a).alias("m"), F.max(F.when(in_a, F.col("at"))).alias("a"), F.max(F.when(~in_a, F.col("at"))).alias("b"))
    listed = once.where("n = 1 AND m = 1").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("found"))  # one text's lines

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def chain(found: pd.Series) -> pd.Series:
        return pd.Series([rising(np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows])).tolist() for rows in found])

    return listed.withColumn("chain", chain("found")).select("path", F.transform("chain", lambda i: F.element_at("found", i + 1)).alias("anchors"))


def line_edits(pairs: DataFrame) -> DataFrame:
    """(path, edits) of the pairs (path, a, b: arrays of lines): edits (a, a_end, b, b_end), in order, say that lines a to
    a_end of the one are replaced by lines b to b_end of the other. No edits for equal texts. Paths are unique."""
    return with_edits(pairs).select("path", "edits")


def _long(pairs: DataFrame) -> Column:
    return F.coalesce((F.col("lines") if "lines" in pairs.columns else F.size("a") + F.size("b")) > LINES, F.lit(False))


def with_edits(pairs: DataFrame, any_long: bool | None = None) -> DataFrame:
    """(path, a, b, edits) of the pairs of line_edits. lines: the number of lines of both texts, if pairs has that column;
    it tells whether any pair is longer than LINES without looking at texts. any_long: that is known already."""

    @F.pandas_udf(EDITS)
    def here(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None or y is None else _structs(pair_edits(list(x), list(y))) for x, y in zip(a, b, strict=True)])

    long = _long(pairs)
    near = pairs.where(~long).select("path", "a", "b", here("a", "b").alias("edits"))
    if not (pairs.where(long).select("path").limit(1).count() if any_long is None else any_long):
        return near
    far = staged(pairs.where(long).select("path", "a", "b"))
    return near.unionByName(far.join(_spread_edits(far), "path"))


def _structs(edits: list[tuple[int, int, int, int]]) -> list[dict[str, int]]:
    return [dict(zip(("a", "a_end", "b", "b_end"), e, strict=True)) for e in edits]


def _spread_edits(pairs: DataFrame) -> DataFrame:
    """line_edits of long texts: by lines, then by gaps."""
    ends = F.array(F.struct(F.size("a").alias("a"), F.size("b").alias("b")))
    marks = F.concat(F.coalesce("anchors", F.array().cast("array<struct<a:int,b:int>>")), ends)
    edge = lambda i, side: F.when(i == 0, F.lit(0)).otherwise(F.element_at("marks", F.greatest(i, F.lit(1)))[side] + 1)
    gap = lambda m, i: F.struct(edge(i, "a").alias("a"), m["a"].alias("a_end"), edge(i, "b").alias("b"), m["b"].alias("b_end"))
    held = staged(pairs.join(anchors(pairs), "path", "left").withColumn("marks", marks).withColumn("gaps", F.filter(F.transform("marks", gap), lambda g: (g["a"] < g["a_end"]) | (g["b"] < g["b_end"]))).drop("anchors", "marks"))
    both = lambda g: (g["a"] < g["a_end"]) & (g["b"] < g["b_end"])
    cut = lambda side, g: F.slice(side, g[side] + 1, g[f"{side}_end"] - g[side])
    rows = held.select("path", F.explode(F.transform(F.filter("gaps", both), lambda g: F.struct(g.alias("g"), cut("a", g).alias("x"), cut("b", g).alias("y")))).alias("r")).select("path", "r.*")

    @F.pandas_udf(EDITS)
    def within(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_structs(gap_edits(list(p), list(q))) for p, q in zip(x, y, strict=True)])

    # Gaps are dealt anew, so that those of one text don't stay together.
    found = rows.repartition("path", F.col("g.a")).select("path", "g", within("x", "y").alias("e"))
    moved = F.transform("e", lambda e: F.struct((e["a"] + F.col("g.a")).alias("a"), (e["a_end"] + F.col("g.a")).alias("a_end"), (e["b"] + F.col("g.b")).alias("b"), (e["b_end"] + F.col("g.b")).alias("b_end")))
    listed = found.groupBy("path").agg(F.flatten(F.collect_list(moved)).alias("inner"))  # one text's edits
    plain = F.filter("gaps", lambda g: ~both(g))
    return held.select("path", plain.alias("plain")).join(listed, "path", "left").select("path", F.sort_array(F.concat("plain", F.coalesce("inner", F.array().cast(EDITS)))).alias("edits"))


def replayed(a: Column, b: Column, edits: Column) -> Column:
    """The lines that edits make of a, taking what they insert from b."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, e: F.struct(e["a_end"].alias("at"), F.concat(s["out"], F.slice(a, s["at"] + 1, e["a"] - s["at"]), F.slice(b, e["b"] + 1, e["b_end"] - e["b"])).alias("out"))
    return F.aggregate(edits, start, step, lambda s: F.concat(s["out"], F.slice(a, s["at"] + 1, F.size(a) - s["at"])))


def hunks(edits: Column, context: int = 3) -> Column:
    """Edits in groups: two of them stand in one hunk if no more than twice the context lies between."""
    near = lambda h, e: e["a"] - F.element_at(h, -1)["a_end"] <= 2 * context
    none = F.array().cast(f"array<{EDITS}>")
    join = lambda hs, e: F.when((F.size(hs) > 0) & near(F.element_at(hs, -1), e), F.concat(F.slice(hs, 1, F.size(hs) - 1), F.array(F.concat(F.element_at(hs, -1), F.array(e))))).otherwise(F.concat(hs, F.array(F.array(e))))
    return F.aggregate(edits, none, join)


def unified(path_a: Column, path_b: Column, a: Column, b: Column, edits: Column, context: int = 3) -> Column:
    """A unified diff as text; empty where there are no edits."""
    signed = lambda sign, lines, lo, hi: F.transform(F.slice(lines, lo + 1, hi - lo), lambda x: F.concat(F.lit(sign), x))
    span = lambda lo, n: F.concat(F.when(n == 0, lo).otherwise(lo + 1).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))))

    def text(h: Column) -> Column:
        first, last = F.element_at(h, 1), F.element_at(h, -1)
        lo, hi = F.greatest(first["a"] - context, F.lit(0)), F.least(last["a_end"] + context, F.size(a))
        lo_b, hi_b = first["b"] - (first["a"] - lo), last["b_end"] + (hi - last["a_end"])
        start = F.struct(lo.alias("at"), F.array().cast("array<string>").alias("out"))
        step = lambda s, e: F.struct(e["a_end"].alias("at"), F.concat(s["out"], signed(" ", a, s["at"], e["a"]), signed("-", a, e["a"], e["a_end"]), signed("+", b, e["b"], e["b_end"])).alias("out"))
        body = F.aggregate(h, start, step, lambda s: F.concat(s["out"], signed(" ", a, s["at"], hi)))
        head = F.concat(F.lit("@@ -"), span(lo, hi - lo), F.lit(" +"), span(lo_b, hi_b - lo_b), F.lit(" @@"))
        return F.array_join(F.concat(F.array(head), body), "\n")

    parts = F.transform(hunks(edits, context), text)
    heads = F.array(F.concat(F.lit("--- "), path_a), F.concat(F.lit("+++ "), path_b))
    return F.when(F.size(edits) > 0, F.array_join(F.concat(heads, parts), "\n")).otherwise(F.lit(""))


def unified_diffs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """(path, diff) of the pairs (path, a, b) of texts that differ; a null text counts as empty. Paths are unique.
    lines: as for with_edits."""
    lines = lambda side: F.split(F.coalesce(side, F.lit("")), "\n")
    rows = pairs.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", lines("a").alias("a"), lines("b").alias("b"), *[c for c in pairs.columns if c == "lines"])
    # Before the texts are compared, numbers alone tell.
    any_long = pairs.where(_long(pairs)).select("path").limit(1).count() > 0 if "lines" in pairs.columns else None
    return with_edits(rows, any_long).select("path", unified(F.lit("a"), F.lit("b"), F.col("a"), F.col("b"), F.col("edits"), context).alias("diff"))
