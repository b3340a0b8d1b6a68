"""Reports for people: bordered tables as rows of lines, made where the data is, and small results as text. A limit guards
each collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.ranks import ranked

MAX_ROWS = 10_000

# Wording of the reports, and headings and widths of their columns.
WORDING = {
    "counts of": " Counts for: ",
    "total by": "Total code examples by ",
    "lengths": "Minimum, median, and maximum code character count, and one-line count, by collection.",
    "mean": "Aggregate ",
    "short": "Total one-line count across collections: ",
    "changes": "Recently Updated Pages in Collection ",
    "mismatches": "Pages with Node/Lang array count mismatch in Collection ",
}
SHARE_COLUMNS = [("count", "Count", 15), ("share", "% of Total", 18)]
LENGTH_COLUMNS = [("collection", "Project", 25), ("min_length", "Min", 10), ("median_length", "Med", 10), ("max_length", "Max", 10), ("short_count", "One line", 10)]
CHANGE_COLUMNS = [("page_id", "Page ID", 70), ("added", "Added", 15), ("updated", "Updated", 15), ("removed", "Removed", 15)]
USAGE_COLUMNS = [("product", "Product", 30), ("sub_product", "Sub Product", 30), ("page_id", "Page ID", 70), ("count", "Count", 15)]
PRODUCT_COLUMNS = [("product", "Product", 30), ("product_count", "Count", 18), ("sub_product", "Sub-product", 25), ("count", "Count", 18)]
MISMATCH_COLUMNS = [("page_id", "Page Ids", 70)]


def table_text(df: DataFrame, order: list[str], limit: int = MAX_ROWS) -> str:
    """The first rows in the order given as a text table; a last line tells if there are more."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    cells = [[("" if v is None else str(v)) for v in r] for r in rows[:limit]]
    widths = [max(len(c), *(len(r[i]) for r in cells)) if cells else len(c) for i, c in enumerate(df.columns)]
    out = ["  ".join(c.ljust(w) for c, w in zip(df.columns, widths, strict=True)).rstrip(), "  ".join("-" * w for w in widths)]
    out += ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join(out + ([f"... more than {limit} rows"] if len(rows) > limit else []))


def by_count(df: DataFrame, *ties: str) -> DataFrame:
    """Greatest count first; equal counts by the keys given."""
    return df.orderBy(F.desc("count"), *ties)


def by_product(df: DataFrame) -> DataFrame:
    """By product, "None" last within it, then by sub-product."""
    return df.orderBy("product", F.col("sub_product") == "None", "sub_product")


def bordered(rows: DataFrame, columns: list[tuple[str, str, int]], order: list[Column], groups: tuple[str, ...] = (), above: list[Column] = (), below: list[Column] = ()) -> DataFrame:
    """(*groups, section, rank, line): a table with borders for each group, in the order of section and rank.

    columns: name, heading and width; longer cells widen their row alone. above and below: lines before and after a group's
    table, from aggregates over its rows. Rows of one group are numbered by ranges, so a group may be of any size.
    """
    cell = lambda text, width: F.concat(F.lit("| "), F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text), F.lit(" "))
    row = lambda texts: F.concat(*[cell(t, w) for t, (_, _, w) in zip(texts, columns, strict=True)], F.lit("|"))
    border = F.lit("".join("+" + "-" * (w + 2) for _, _, w in columns) + "+")
    keyed = rows.withColumns({f"__o{i}": o for i, o in enumerate(order)})
    numbered = ranked(keyed, list(groups), [f"__o{i}" for i in range(len(order))])
    texts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n, _, _ in columns]
    body = numbered.select(*groups, F.lit(2).alias("section"), "rank", row(texts).alias("line"))
    frame = [*[(0, a) for a in above], (1, border), (1, row([F.lit(h) for _, h, _ in columns])), (1, border), (3, border), *[(4, b) for b in below]]
    lines = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).cast("long").alias("rank"), t.alias("line")) for i, (s, t) in enumerate(frame)])
    made = rows.groupBy(*groups).agg(lines.alias("lines"))
    return body.unionByName(made.select(*groups, F.explode("lines").alias("l")).select(*groups, "l.*"))


def text_of(lines: DataFrame, *groups: str, limit: int = MAX_ROWS) -> str:
    """The lines of bordered tables as one text; a last line tells if there are more than `limit`."""
    found = [r["line"] for r in lines.orderBy(*groups, "section", "rank").limit(limit + 1).collect()]
    return "\n".join(found[:limit] + (["..."] if len(found) > limit else []))


def _share(rows: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    totals = rows.groupBy(*groups).agg(F.sum("count").alias("__all"))
    joined = rows.join(totals, list(groups)) if groups else rows.join(F.broadcast(totals))  # one row without groups
    return joined.withColumn("share", F.format_string("%.1f%%", F.col("count") * 100.0 / F.col("__all"))).drop("__all")


def count_table(counts: DataFrame, label: str, heading: str, width: int = 30) -> DataFrame:
    """Counts (key, count) with shares of their sum, greatest first; a key `total` isn't listed."""
    rows = _share(counts.where(F.col("key") != "total"), ())
    above = [F.lit(label), F.concat(F.lit(WORDING["total by"]), F.lit(heading), F.lit(": "), F.sum("count").cast("string"))]
    return bordered(rows, [("key", heading, width), *SHARE_COLUMNS], [-F.col("count"), F.col("key")], above=above)


def nested_count_tables(counts: DataFrame, label: str, heading: str, *groups: str, width: int = 30) -> DataFrame:
    """A count_table for each value of one group column or each pair of two."""
    rows = _share(counts, groups)
    name = F.concat_ws(" - ", *groups)
    above = [F.concat(F.lit(label + WORDING["counts of"]), name), F.concat(F.lit(WORDING["total by"]), F.col(groups[-1]), F.lit(": "), F.sum("count").cast("string"))]
    return bordered(rows, [("key", heading, width), *SHARE_COLUMNS], [-F.col("count"), F.col("key")], groups, above)


def length_table(lengths: DataFrame) -> DataFrame:
    """Code lengths by collection (catalog.code_lengths) with the means of each, rounded down, and all short ones."""
    mean = lambda c: F.floor(F.avg(c)).cast("string")
    below = [F.concat(F.lit(f"{WORDING['mean']}{n}: "), mean(c)) for n, c in (("min", "min_length"), ("median", "median_length"), ("max", "max_length"))]
    below.append(F.concat(F.lit(WORDING["short"]), F.sum("short_count").cast("string")))
    return bordered(lengths, LENGTH_COLUMNS, [F.col("collection")], above=[F.lit(WORDING["lengths"])], below=below)


def change_tables(changes: DataFrame) -> DataFrame:
    """Pages changed (collection, page_id, added, updated, removed) by collection."""
    return bordered(changes, CHANGE_COLUMNS, [F.col("page_id")], ("collection",), [F.concat(F.lit(WORDING["changes"]), F.col("collection"))])


def page_usage_tables(pages: DataFrame, kind: str = "Applied Usage Example") -> DataFrame:
    """New examples by page (collection, product, sub_product, page_id, count), a table a collection with its sum below."""
    above = [F.concat(F.lit(f"Total new {kind} Counts by Page in Collection "), F.col("collection"))]
    below = [F.concat(F.lit(f"Total new {kind.lower()} counts in collection "), F.col("collection"), F.lit(": "), F.sum("count").cast("string"))]
    return bordered(pages, USAGE_COLUMNS, [F.col("page_id")], ("collection",), above, below)


def product_table(products: DataFrame) -> DataFrame:
    """Counts by product and sub-product (product, product_count, sub_product, count): by product, "None" last within it."""
    return bordered(products, PRODUCT_COLUMNS, [F.col("product"), F.col("sub_product") == "None", F.col("sub_product")], below=[F.concat(F.lit("Total: "), F.sum("count").cast("string"))])


def mismatch_tables(pages: DataFrame) -> DataFrame:
    """Pages (collection, page_id) whose nodes and language counts disagree, by collection."""
    return bordered(pages, MISMATCH_COLUMNS, [F.col("page_id")], ("collection",), [F.concat(F.lit(WORDING["mismatches"]), F.col("collection"))])
