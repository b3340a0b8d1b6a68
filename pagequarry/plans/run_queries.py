"""Runs over stored pages as queries: versions of a store, batches laid over each other, pages that changed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagequarry.operators import cdc
from pagequarry.operators.ranks import own_folder
from pagequarry.plans import fixtures as X
from pagequarry.plans.registry import query
from pagequarry.plans.source_queries import _page_lines
from pagequarry.sources import snapshots
from pagequarry.streaming import ingest


def _store(spark):
    return snapshots.Store(spark, f"{own_folder(spark)}/store-{uuid.uuid4().hex}")


#: A day's customers and the next day's: some are gone, some new, some have another balance.
DAYS = "WITH a AS (SELECT * FROM customer WHERE c_custkey % 7 <> 3), b AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 <> 4)"


@query(DAYS + " SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' WHEN a.c_acctbal = b.c_acctbal THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.c_custkey = b.c_custkey")
def version_changes(spark, sf_dir):
    """Two versions of a table published, read back by number and by backup, and compared."""
    customers, k, store = X.table(spark, sf_dir, "customer"), F.col("c_custkey"), _store(spark)
    store.publish({"customer": customers.where(k % 7 != 3)}, on=0)
    store.backup("2025-01-01", 2)
    store.publish({"customer": customers.where(k % 11 != 4).withColumn("c_acctbal", F.when(k % 5 == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))}, on=1)
    return snapshots.compared(store.read("customer", "backup_2025-01-01"), store.read("customer", 2), "c_custkey")


@query("WITH p AS (SELECT doc_id % 97 AS page, max(doc_id) AS doc_id FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1) SELECT 'p' || page AS page_id, sha256(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS sha_256_hash, CAST(2 AS BIGINT) AS instances_on_page, CAST(2 AS BIGINT) AS code_nodes_total FROM p JOIN documents USING (doc_id) WHERE p.doc_id % 7 <> 0")
def ingested_in_batches(spark, sf_dir):
    """Documents as page lines, laid over a store in three batches by third of the ids; a page's last line decides, and the
    second batch comes twice. Live nodes of the pages that are left."""
    lines = _page_lines(spark, sf_dir, page="doc_id % 97").withColumn("_metadata", F.struct(F.col("doc_id").alias("file_modification_time"), F.lit("f").alias("file_path"), F.lit(0).alias("file_block_start")))
    store, span = _store(spark), X.table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] // 3 + 1
    for n, number in ((0, 0), (1, 1), (1, 1), (2, 2)):
        batch = ingest.placed(lines.where(F.floor(F.col("doc_id") / span) == n))
        ingest.upsert(batch, number, store, "documents", F.lit("2025-06-01").cast("timestamp"), buckets=16)
    return cdc.live_nodes(store.read("pages")).join(store.read("pages").select("page_id", "code_nodes_total"), "page_id").select("page_id", "n.sha_256_hash", "n.instances_on_page", "code_nodes_total")


@query("WITH " + X.cte("nodes", X.NODES, "documents") + """, o AS (SELECT page_id, sha_256_hash AS h, sum(CASE WHEN instances_on_page > 1 THEN instances_on_page ELSE 1 END) AS n FROM nodes WHERE NOT coalesce(is_removed, false) GROUP BY ALL),
i AS (SELECT page_id, sha_256_hash AS h, count(*) AS n FROM nodes WHERE NOT coalesce(is_removed, false) AND instances_on_page < 2 AND NOT (page_id LIKE '%7' AND node_id % 50 = 7) GROUP BY ALL),
f AS (SELECT page_id, coalesce(o.n, 0) AS a, coalesce(i.n, 0) AS b FROM o FULL JOIN i USING (page_id, h))
SELECT page_id, CAST(sum(a) AS BIGINT) AS old_n, CAST(sum(b) AS BIGINT) AS new_n FROM f GROUP BY 1 HAVING max(CASE WHEN a <> b THEN 1 ELSE 0 END) = 1""")
def changed_pages(spark, sf_dir):
    """Stored pages against incoming nodes, without those that stand twice and some of page 7's."""
    rows = X.nodes(spark, sf_dir).where(~F.coalesce("is_removed", F.lit(False)) & (F.col("instances_on_page") < 2))
    incoming = rows.where(~(F.col("page_id").endswith("7") & (F.col("node_id") % 50 == 7)))
    return cdc.changed_pages(X.pages(spark, sf_dir), incoming)
