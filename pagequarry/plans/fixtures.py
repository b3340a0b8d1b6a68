"""Projections of the driver's tables onto the data model, as expressions that Spark and other SQL engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2025-11-20"

NODES = {
    "collection": "source",
    "page_id": "source || '|' || lang || '|' || CAST(doc_id % 10 AS STRING)",
    "node_id": "doc_id",
    "code": "text",
    "language": "lang",
    "category": "CASE doc_id % 5 WHEN 0 THEN 'Usage example' WHEN 1 THEN 'Syntax example' WHEN 2 THEN 'Example return object' WHEN 3 THEN 'Example configuration object' ELSE 'Other command' END",
    "is_removed": "CASE doc_id % 7 WHEN 0 THEN true WHEN 1 THEN false END",
    "instances_on_page": "CAST(doc_id % 3 AS BIGINT)",
    "product": "CASE WHEN lang = 'es' THEN NULL WHEN lang = 'fr' AND doc_id % 2 = 0 THEN '' ELSE 'product ' || lang END",
    "sub_product": "CASE doc_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'streams' END",
    "date_added": "DATE '2025-09-01' + CAST(doc_id % 90 AS INT)",
    "date_updated": "CASE WHEN doc_id % 4 = 0 THEN DATE '2025-09-01' + CAST(doc_id % 90 + 5 AS INT) END",
    "date_removed": "CASE WHEN doc_id % 7 = 0 THEN DATE '2025-09-01' + CAST(doc_id % 90 + 7 AS INT) END",
    "sha_256_hash": "HASH",
}
AUDIT = {
    "event_id": "event_id",
    "ts": "ts",
    "event_type": "CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'copy' WHEN event_type = 'view' THEN 'deprecation' ELSE 'error' END",
    "rule_name": "'rule ' || CAST(user_id % 20 AS STRING)",
    "success": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type <> 'error' END",
    "duration_ms": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(FLOOR(value) AS BIGINT) END",
    "source_path": "'examples/' || CAST(user_id AS STRING) || '/' || event_type || '.py'",
}


def select_list(columns: dict[str, str], spark: bool) -> str:
    """The columns as a SELECT list for Spark or for DuckDB."""
    digest = "sha2(trim(text), 256)" if spark else "sha256(trim(text))"
    return ", ".join(f"{(digest if v == 'HASH' else v)} AS {k}" for k, v in columns.items())


def cte(name: str, columns: dict[str, str], table: str) -> str:
    return f"{name} AS (SELECT {select_list(columns, False)} FROM {table})".replace("AS STRING", "AS VARCHAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _projected(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr("sha2(trim(text), 256)" if v == "HASH" else v).alias(k) for k, v in columns.items()])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a code node."""
    return _projected(table(spark, sf_dir, "documents"), NODES)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(table(spark, sf_dir, "events"), AUDIT)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page, its nodes as an array, and language totals as an array of single-entry maps."""
    flat = nodes(spark, sf_dir)
    inner = ["node_id", "code", "language", "category", "is_removed", "instances_on_page", "date_added", "date_updated", "date_removed", "sha_256_hash"]
    counts = flat.groupBy("collection", "page_id", "language").agg(F.sum(F.when(F.col("instances_on_page") > 0, F.col("instances_on_page")).otherwise(1)).alias("n"))
    entry = F.create_map("language", F.struct(F.lit(0).cast("long").alias("literal_includes"), F.lit(0).cast("long").alias("io_code_block"), F.col("n").alias("total")))
    languages = counts.groupBy("collection", "page_id").agg(F.collect_list(entry).alias("languages"))
    grouped = flat.groupBy("collection", "page_id").agg(F.sort_array(F.collect_list(F.struct(*inner))).alias("nodes"), F.count(F.lit(1)).alias("code_nodes_total"), F.max("product").alias("product"), F.max("sub_product").alias("sub_product"))
    return grouped.join(languages, ["collection", "page_id"])
