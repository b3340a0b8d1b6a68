"""Reporting operators over code nodes: each takes a DataFrame of nodes (or pages) and returns a tidy one.

Nodes come one a row (`explode_nodes` makes them of nested pages), with the columns collection, page_id, code, language,
category, is_removed, instances_on_page, product, sub_product, date_added, date_updated, date_removed, sha_256_hash.
Every aggregation is one hash aggregate with map-side partial sums, keyed by at most three columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions import vocabulary as V
from pagequarry.functions.scalars import focus_area

# --- what the operators share --------------------------------------------------------------------------------------


def explode_nodes(pages: DataFrame) -> DataFrame:
    """One row a node; pages whose nodes are null or empty have none."""
    held = [c for c in pages.columns if c != "nodes"]
    return pages.select(*held, F.explode("nodes").alias("node")).select(*held, "node.*")


def explode_matching(pages: DataFrame, test) -> DataFrame:
    """The nodes for which test (a function of a node's column) holds, one a row; pages without any go before they are exploded."""
    held = [c for c in pages.columns if c != "nodes"]
    some = pages.where(F.exists("nodes", lambda n: F.coalesce(test(n), F.lit(False))))
    return some.select(*held, F.explode(F.filter("nodes", test)).alias("node")).select(*held, "node.*")


def not_summary(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.where(F.col(key) != "summaries")


def has_nodes(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("nodes").isNotNull() & (F.size("nodes") > 0))


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.coalesce("is_removed", F.lit(False)))


def with_code(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("code").isNotNull() & (F.col("code") != ""))


def recent(column: str, as_of: str, days: int = 7) -> Column:
    """Whether a date lies within the days up to as_of; unknown dates don't."""
    return F.coalesce(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days), F.lit(False))


def in_month(column: str, year: int, month: int) -> Column:
    first = F.lit(f"{year:04d}-{month:02d}-01").cast("date")
    return (F.col(column) >= first) & (F.col(column) < F.add_months(first, 1))


def instances(column: str = "instances_on_page") -> Column:
    """How often a node stands on its page: unset and 0 count as once."""
    return F.when(F.col(column) != 0, F.col(column)).otherwise(F.lit(1)).cast("long")


def split_removed(pages: DataFrame) -> DataFrame:
    """Pages with the arrays live_nodes and removed_nodes."""
    gone = lambda n: F.coalesce(n["is_removed"], F.lit(False))
    return pages.withColumns({"live_nodes": F.filter("nodes", lambda n: ~gone(n)), "removed_nodes": F.filter("nodes", gone)})


def language_rows(pages: DataFrame) -> DataFrame:
    """One row for each entry of every map in a page's array of language totals."""
    held = [c for c in ("collection", "page_id", "product", "sub_product") if c in pages.columns]
    entries = pages.select(*held, F.explode("languages").alias("m")).select(*held, F.explode("m").alias("language", "v"))
    return entries.select(*held, "language", F.col("v.total").alias("total"), F.col("v.literal_includes").alias("literal_includes"), F.col("v.io_code_block").alias("io_code_block"))


def first_language_rows(pages: DataFrame) -> DataFrame:
    """Like language_rows, with only the first entry of each map, and totals above 0."""
    held = [c for c in ("collection", "page_id", "product", "sub_product") if c in pages.columns]
    first = pages.select(*held, F.explode("languages").alias("m")).select(*held, F.get(F.map_entries("m"), F.lit(0)).alias("e"))
    return first.select(*held, F.col("e.key").alias("language"), F.col("e.value.total").alias("total")).where("total > 0")


def languages_map(languages: Column) -> Column:
    """One map of an array of maps; the last entry of a key counts."""
    entries = F.flatten(F.transform(languages, F.map_entries))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def count_by(nodes: DataFrame, *keys: str) -> DataFrame:
    return nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


# --- counts --------------------------------------------------------------------------------------------------------


def category_counts(nodes: DataFrame, complex_length: int = 500) -> DataFrame:
    """(key, count) by category, with the rows `total` and `complex examples` (usage examples of that length or more).

    The two extra rows come from the same aggregate: each node is expanded to the keys that it counts for.
    """
    keys = F.array_compact(F.array(F.col("category"), F.lit("total"), F.when((F.col("category") == V.USAGE) & (F.length("code") >= complex_length), "complex examples")))
    return count_by(with_code(live(nodes)).select(F.explode(keys).alias("key")), "key")


def language_counts(pages: DataFrame, total: bool = True) -> DataFrame:
    """(language, count) as summed from the pages' language totals; languages that sum to 0 stay."""
    rows = language_rows(pages)
    if total:
        rows = rows.select(F.explode(F.array("language", F.lit("total"))).alias("language"), "total")
    return rows.groupBy("language").agg(F.sum("total").alias("count"))


def node_language_counts(nodes: DataFrame) -> DataFrame:
    return count_by(live(nodes), "language")


def language_counts_of_pages_with_nodes(pages: DataFrame) -> DataFrame:
    return language_counts(has_nodes(pages), total=False)


def specific_language_count(pages: DataFrame, language: str) -> DataFrame:
    return language_rows(pages).where(F.col("language") == language).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("count"))


def category_language_counts(nodes: DataFrame) -> DataFrame:
    return count_by(live(nodes), "category", "language")


def product_category_counts(nodes: DataFrame) -> DataFrame:
    return count_by(live(nodes), "product", "category")


def product_language_counts(pages: DataFrame) -> DataFrame:
    return first_language_rows(pages).groupBy("product", "language").agg(F.sum("total").alias("count"))


def sub_product_category_counts(nodes: DataFrame) -> DataFrame:
    return count_by(live(nodes).where(F.col("sub_product").isNotNull()), "product", "sub_product", "category")


def sub_product_language_counts(pages: DataFrame) -> DataFrame:
    rows = first_language_rows(pages).withColumn("sub_product", F.coalesce("sub_product", F.lit("")))
    return rows.groupBy("product", "sub_product", "language").agg(F.sum("total").alias("count"))


def category_by_product(nodes: DataFrame, category: str) -> DataFrame:
    return count_by(live(nodes).where(F.col("category") == category), "product")


def collection_totals(pages: DataFrame) -> DataFrame:
    """(collection, count) of code nodes, with a row `total`."""
    rows = pages.select(F.explode(F.array("collection", F.lit("total"))).alias("collection"), "code_nodes_total")
    return rows.groupBy("collection").agg(F.sum("code_nodes_total").alias("count"))


def code_lengths(nodes: DataFrame, short: int = 80) -> DataFrame:
    """Least, upper median and greatest code length by collection, and how many are below `short`.

    The upper median is found from counts by length, of which there are few whatever the number of nodes: the first
    length whose running count passes half. A collection is one window, over its distinct lengths only.
    """
    lengths = with_code(live(nodes)).groupBy("collection", F.length("code").alias("n")).agg(F.count(F.lit(1)).alias("many"))
    w = Window.partitionBy("collection").orderBy("n")
    run = lengths.withColumn("upto", F.sum("many").over(w)).withColumn("all", F.sum("many").over(Window.partitionBy("collection")))
    # Position floor(n / 2) counted from 0 lies in the first group whose running count is above it.
    return run.groupBy("collection").agg(F.min("n").alias("min_length"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median_length"), F.max("n").alias("max_length"), F.sum(F.when(F.col("n") < short, F.col("many")).otherwise(0)).alias("short_count"))


def mean_of_lengths(lengths: DataFrame) -> DataFrame:
    """Whole means of the collections' figures; no row without collections."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), *[F.floor(F.avg(c)).cast("long").alias(c) for c in ("min_length", "median_length", "max_length")]).where("n > 0").drop("n")


def one_liners(nodes: DataFrame, short: int = 80) -> DataFrame:
    """(collection, count) of live usage examples below `short`, with a row `total` that is there even if it is 0."""
    rows = with_code(live(nodes)).where((F.col("category") == V.USAGE) & (F.length("code") < short))
    keyed = rows.select(F.explode(F.array("collection", F.lit("total"))).alias("collection"), F.lit(1).alias("n"))
    none = nodes.sparkSession.createDataFrame([("total", 0)], "collection string, n int")
    return keyed.unionByName(none).groupBy("collection").agg(F.sum("n").alias("count"))


def recent_activity(nodes: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Nodes added, updated and removed on each page in the days up to as_of; pages with none are left out."""
    flags = {k: recent(f"date_{k}", as_of, days) for k in ("added", "updated", "removed")}
    rows = nodes.where(flags["added"] | flags["updated"] | flags["removed"])
    return rows.groupBy("collection", "page_id").agg(*[F.count_if(f).alias(k) for k, f in flags.items()])


def usage_examples_by_page(nodes: DataFrame, when: Column, longer_than: int | None = None) -> DataFrame:
    """Usage examples by (product, sub_product or "None", page): how many, and their ids in order."""
    rows = nodes.where(when & (F.col("category") == V.USAGE))
    if longer_than is not None:
        rows = rows.where(F.length("code") > longer_than)
    return rows.groupBy("product", F.coalesce("sub_product", F.lit("None")).alias("sub_product"), "page_id").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("node_id")).alias("node_ids"))


def new_applied_usage(nodes: DataFrame, as_of: str, days: int = 7, longer_than: int = 300) -> DataFrame:
    return usage_examples_by_page(nodes, recent("date_added", as_of, days), longer_than)


def monthly_usage(nodes: DataFrame, year: int, month: int) -> DataFrame:
    return usage_examples_by_page(nodes, in_month("date_added", year, month))


def product_rollup(by_page: DataFrame, areas: list[tuple[str, str]] = ()) -> DataFrame:
    """Sums by (product, sub_product) and by product, where sub_product is null; pages of an area count for that."""
    rows = by_page.withColumn("sub_product", focus_area(F.col("page_id"), F.col("sub_product"), list(areas)))
    return rows.rollup("product", "sub_product").agg(F.sum("count").alias("count"), F.grouping_id().alias("g")).where("g < 3").select("product", "sub_product", "count")


def _section(nodes: DataFrame, as_of: str, page_pattern: str, days: int, least: int) -> DataFrame:
    short_usage = (F.col("category") == V.USAGE) & (F.length("code") < least)
    return live(nodes).where(recent("date_added", as_of, days) & F.rlike(F.col("page_id"), F.lit(page_pattern)) & ~short_usage)


def unique_examples_by_page(nodes: DataFrame, as_of: str, page_pattern: str, days: int = 7, least: int = 300) -> DataFrame:
    """Distinct hashes and all instances of recent nodes by page; short usage examples don't count."""
    return _section(nodes, as_of, page_pattern, days, least).groupBy("page_id").agg(F.countDistinct("sha_256_hash").alias("unique_count"), F.sum(instances()).alias("instance_count"))


def unique_examples_by_category(nodes: DataFrame, as_of: str, page_pattern: str, days: int = 7, least: int = 300) -> DataFrame:
    """The same by category: nodes, distinct hashes and instances."""
    return _section(nodes, as_of, page_pattern, days, least).groupBy("category").agg(F.count(F.lit(1)).alias("node_count"), F.countDistinct("sha_256_hash").alias("distinct_hashes"), F.sum(instances()).alias("instance_count"))


def unique_examples_total(nodes: DataFrame, as_of: str, page_pattern: str, days: int = 7, least: int = 300) -> DataFrame:
    return _section(nodes, as_of, page_pattern, days, least).agg(F.countDistinct("sha_256_hash").alias("unique_count"), F.coalesce(F.sum(instances()), F.lit(0)).alias("instance_count"))


def language_mismatch(pages: DataFrame) -> DataFrame:
    """Pages whose live nodes are another number than their language totals; no shuffle, arrays only."""
    n = F.size(F.filter("nodes", lambda x: ~F.coalesce(x["is_removed"], F.lit(False)))).cast("long")
    sums = F.transform("languages", lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, v: a + F.when(v["total"] > 0, v["total"]).otherwise(0)))
    total = F.aggregate(sums, F.lit(0).cast("long"), lambda a, x: a + x)
    return has_nodes(pages).select("collection", "page_id", n.alias("node_count"), total.alias("language_total")).where("node_count <> language_total")


def missing_product(pages: DataFrame) -> DataFrame:
    """Pages without a product by collection; collections with none are left out."""
    rows = pages.where(F.col("product").isNull() | (F.col("product") == ""))
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("page_id")).alias("page_ids"))


def url_matches(pages: DataFrame, part: str, column: str = "page_url") -> DataFrame:
    return pages.where(F.rlike(F.col(column), F.lit("(?i)" + part)))


def string_in_code(nodes: DataFrame, part: str) -> DataFrame:
    """(collection, count) of nodes whose code matches, every collection listed."""
    return nodes.groupBy("collection").agg(F.count_if(F.rlike(F.col("code"), F.lit("(?i)" + part))).alias("count"))


def counts_and_pages(nodes: DataFrame, *keys: str) -> DataFrame:
    """Nodes, and the pages that they stand on, by keys."""
    return nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.countDistinct("page_id").alias("pages"))


def feedback_counts(feedback: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """(docs_property, count) of comments with any word of include and none of exclude, whatever the case."""
    text = F.col("comment")
    hit = F.rlike(text, F.lit("(?i)" + "|".join(include)))
    miss = F.rlike(text, F.lit("(?i)" + "|".join(exclude))) if exclude else F.lit(False)
    return count_by(feedback.where(text.isNotNull() & hit & ~miss), "docs_property")


def dense_language_histogram(nodes: DataFrame, languages: list[str] = V.LANGUAGES) -> DataFrame:
    """(page_id, language, total) for every page and language of a fixed list; others count as undefined."""
    known = F.when(F.col("language").isin(languages), F.col("language")).otherwise("undefined")
    counts = nodes.groupBy("page_id", known.alias("language")).agg(F.sum(instances()).alias("n"))
    by_page = counts.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("m"))
    listed = F.explode(F.array(*[F.lit(x) for x in languages]))
    return by_page.select("page_id", "m", listed.alias("language")).select("page_id", "language", F.coalesce(F.try_element_at("m", F.col("language")), F.lit(0)).alias("total"))


def code_node_count(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("page_id").agg(F.sum(instances()).alias("count"))


def unique_nodes(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """One row for each hash on a page: how often it stands there, and the id of its last node."""
    return nodes.groupBy("page_id", "sha_256_hash").agg(F.count(F.lit(1)).alias("instances_on_page"), F.max(order).alias("node_id"))


def latest_version(summaries: DataFrame) -> DataFrame:
    """The version of a summary's map that was updated last; ties go to the greater name."""
    rows = summaries.select("collection", F.explode("version").alias("name", "info"))
    return rows.groupBy("collection").agg(F.max_by("name", F.struct("info.last_updated_at_utc", "name")).alias("latest_version"))


def with_percent(counts: DataFrame, key: str, specials: tuple[str, ...] = ("total", "complex examples")) -> DataFrame:
    """Counts with their share of all as text; special rows are neither counted nor listed."""
    rows = counts.where(~F.col(key).isin(*specials))
    total = rows.agg(F.sum("count").alias("all"))
    return rows.join(F.broadcast(total)).select(key, "count", F.format_string("%.1f%%", 100.0 * F.col("count") / F.col("all")).alias("percent"))
