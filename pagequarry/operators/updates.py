"""Bulk updates as rewrites: each returns the table as it is after the update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.scalars import sub_product_of_url


def add_product_names(pages: DataFrame, products: DataFrame, dirs: list[tuple[str, str]] = (), dirs_of: str | None = None, most_products: int = 10_000) -> DataFrame:
    """product and sub_product by collection (products: collection, product, sub_product), not found → empty.

    In the collection dirs_of, directories within the URL set the sub-product, whatever their case; the last one wins.
    The dimension is broadcast after its rows have been counted.
    """
    bounded = products.select("collection", F.col("product").alias("__p"), F.col("sub_product").alias("__s"))
    small = bounded.limit(most_products + 1).count() <= most_products
    joined = pages.drop("product", "sub_product").join(F.broadcast(bounded) if small else bounded, "collection", "left")
    sub = F.col("__s")
    if dirs_of is not None:
        sub = F.when(F.col("collection") == dirs_of, F.coalesce(sub_product_of_url(F.col("page_url"), list(dirs), ignore_case=True), sub)).otherwise(sub)
    return joined.withColumns({"product": F.coalesce("__p", F.lit("")), "sub_product": F.coalesce(sub, F.lit(""))}).drop("__p", "__s")


def change_value(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def change_project_name(pages: DataFrame, old: str, new: str) -> DataFrame:
    """The collection's pages under another name, in the column project_name too where there is one."""
    out = change_value(pages, "collection", old, new)
    return change_value(out, "project_name", old, new) if "project_name" in pages.columns else out


def rename_field(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.withColumnRenamed(old, new)


def rename_value(pages: DataFrame, old: str, new: str, field: str = "category") -> DataFrame:
    """A value of a field within the nodes; the array is mapped in place."""
    return pages.withColumn("nodes", F.transform("nodes", lambda n: n.withField(field, F.when(n[field] == old, F.lit(new)).otherwise(n[field]))))


def upsert_summary(summaries: DataFrame, incoming: DataFrame) -> DataFrame:
    """Summaries (collection, version: map) with incoming ones laid over: new collections and versions come in, known
    versions are replaced."""

    def merged(old, new):
        kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
        return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))

    joined = summaries.alias("a").join(incoming.alias("b"), F.col("a.collection") == F.col("b.collection"), "full")
    return joined.select(F.coalesce("a.collection", "b.collection").alias("collection"), merged(F.col("a.version"), F.col("b.version")).alias("version"))


def delete_page(pages: DataFrame, ids: DataFrame) -> DataFrame:
    return pages.join(ids.select("page_id").distinct(), "page_id", "left_anti")


def bulk_write(stored: DataFrame, inserted: DataFrame, replaced: DataFrame) -> DataFrame:
    """Stored rows with replaced ones in place of those of the same page_id, and inserted ones added."""
    known = replaced.join(stored.select("page_id").distinct(), "page_id", "left_semi").select(*stored.columns)
    return delete_page(stored, replaced).unionByName(known).unionByName(inserted.select(*stored.columns))
