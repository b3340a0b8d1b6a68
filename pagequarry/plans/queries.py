"""Queries over the driver's tables, one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import scalars as S
from pagequarry.functions import vocabulary as V
from pagequarry.operators import catalog, cdc, deps, events, graph, ingest, paths, rules, trees, updates
from pagequarry.operators.ranks import own_folder
from pagequarry.plans import fixtures as X
from pagequarry.plans.registry import ORACLES, QUERIES, query
from pagequarry.sources import sinks, text_index

NODES = "WITH " + X.cte("nodes", X.NODES, "documents")
LIVE = NODES + ", live AS (SELECT * FROM nodes WHERE coalesce(is_removed, false) = false)"
CODED = LIVE + ", coded AS (SELECT * FROM live WHERE code IS NOT NULL AND code <> '')"
AUDIT = "WITH " + X.cte("audit", X.AUDIT, "events")
#: Language totals of a page, one row an entry.
ENTRIES = NODES + ", entries AS (SELECT collection, page_id, language, CAST(sum(CASE WHEN instances_on_page > 0 THEN instances_on_page ELSE 1 END) AS BIGINT) AS total FROM nodes GROUP BY ALL), pg AS (SELECT collection, page_id, max(product) AS product, max(sub_product) AS sub_product, count(*) AS code_nodes_total FROM nodes GROUP BY ALL)"
COUNT = "CAST(count(*) AS BIGINT) AS count"
SINCE = f"DATE '{X.AS_OF}' - INTERVAL 7 DAY"
INST = "CASE WHEN instances_on_page <> 0 THEN instances_on_page ELSE 1 END"


# --- counts --------------------------------------------------------------------------------------------------------


@query(CODED + f" SELECT category AS key, {COUNT} FROM coded GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM coded UNION ALL SELECT 'complex examples', count(*) FROM coded WHERE category = 'Usage example' AND length(code) >= 500")
def category_counts(spark, sf_dir):
    return catalog.category_counts(X.nodes(spark, sf_dir))


@query(CODED + f" SELECT category AS key, {COUNT} FROM coded GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM coded UNION ALL SELECT 'complex examples', count(*) FROM coded WHERE category = 'Usage example' AND length(code) >= 500")
def category_counts_nested(spark, sf_dir):
    return catalog.category_counts(catalog.explode_nodes(X.pages(spark, sf_dir)))


@query(ENTRIES + " SELECT language, CAST(sum(total) AS BIGINT) AS count FROM entries GROUP BY 1 UNION ALL SELECT 'total', CAST(sum(total) AS BIGINT) FROM entries")
def language_counts(spark, sf_dir):
    return catalog.language_counts(X.pages(spark, sf_dir))


@query(ENTRIES + " SELECT language, CAST(sum(total) AS BIGINT) AS count FROM entries GROUP BY 1")
def language_counts_with_nodes(spark, sf_dir):
    return catalog.language_counts_of_pages_with_nodes(X.pages(spark, sf_dir))


@query(LIVE + f" SELECT language, {COUNT} FROM live GROUP BY 1")
def node_language_counts(spark, sf_dir):
    return catalog.node_language_counts(X.nodes(spark, sf_dir))


@query(ENTRIES + " SELECT CAST(coalesce(sum(total), 0) AS BIGINT) AS count FROM entries WHERE language = 'de'")
def specific_language(spark, sf_dir):
    return catalog.specific_language_count(X.pages(spark, sf_dir), "de")


@query(LIVE + f" SELECT category, language, {COUNT} FROM live GROUP BY ALL")
def category_language(spark, sf_dir):
    return catalog.category_language_counts(X.nodes(spark, sf_dir))


@query(LIVE + f" SELECT product, category, {COUNT} FROM live GROUP BY ALL")
def product_category(spark, sf_dir):
    return catalog.product_category_counts(X.nodes(spark, sf_dir))


@query(ENTRIES + " SELECT product, language, CAST(sum(total) AS BIGINT) AS count FROM entries JOIN pg USING (collection, page_id) WHERE total > 0 GROUP BY ALL")
def product_language(spark, sf_dir):
    return catalog.product_language_counts(X.pages(spark, sf_dir))


@query(LIVE + f" SELECT product, sub_product, category, {COUNT} FROM live WHERE sub_product IS NOT NULL GROUP BY ALL")
def subproduct_category(spark, sf_dir):
    return catalog.sub_product_category_counts(X.nodes(spark, sf_dir))


@query(ENTRIES + " SELECT product, coalesce(sub_product, '') AS sub_product, language, CAST(sum(total) AS BIGINT) AS count FROM entries JOIN pg USING (collection, page_id) WHERE total > 0 GROUP BY ALL")
def subproduct_language(spark, sf_dir):
    return catalog.sub_product_language_counts(X.pages(spark, sf_dir))


@query(LIVE + f" SELECT product, {COUNT} FROM live WHERE category = 'Usage example' GROUP BY ALL")
def category_by_product(spark, sf_dir):
    return catalog.category_by_product(X.nodes(spark, sf_dir), V.USAGE)


@query(NODES + f" SELECT collection, {COUNT} FROM nodes GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM nodes")
def collection_totals(spark, sf_dir):
    return catalog.collection_totals(X.pages(spark, sf_dir))


LENGTHS = CODED + ", lengths AS (SELECT collection, CAST(min(length(code)) AS BIGINT) AS min_length, CAST(list_sort(list(length(code)))[count(*) // 2 + 1] AS BIGINT) AS median_length, CAST(max(length(code)) AS BIGINT) AS max_length, CAST(count(*) FILTER (length(code) < 80) AS BIGINT) AS short_count FROM coded GROUP BY 1)"


@query(LENGTHS + " SELECT * FROM lengths")
def code_lengths(spark, sf_dir):
    return catalog.code_lengths(X.nodes(spark, sf_dir)).select("collection", *[F.col(c).cast("long").alias(c) for c in ("min_length", "median_length", "max_length", "short_count")])


@query(LENGTHS + " SELECT CAST(floor(avg(min_length)) AS BIGINT) AS min_length, CAST(floor(avg(median_length)) AS BIGINT) AS median_length, CAST(floor(avg(max_length)) AS BIGINT) AS max_length FROM lengths")
def mean_code_lengths(spark, sf_dir):
    return catalog.mean_of_lengths(catalog.code_lengths(X.nodes(spark, sf_dir)))


@query(CODED + f", o AS (SELECT * FROM coded WHERE category = 'Usage example' AND length(code) < 80) SELECT collection, {COUNT} FROM o GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM o")
def one_liners(spark, sf_dir):
    return catalog.one_liners(X.nodes(spark, sf_dir))


@query(NODES + f" SELECT collection, page_id, CAST(count(*) FILTER (date_added >= {SINCE}) AS BIGINT) AS added, CAST(count(*) FILTER (date_updated >= {SINCE}) AS BIGINT) AS updated, CAST(count(*) FILTER (date_removed >= {SINCE}) AS BIGINT) AS removed FROM nodes WHERE date_added >= {SINCE} OR date_updated >= {SINCE} OR date_removed >= {SINCE} GROUP BY ALL")
def recent_activity(spark, sf_dir):
    return catalog.recent_activity(X.nodes(spark, sf_dir), X.AS_OF)


USAGE_BY_PAGE = "SELECT product, coalesce(sub_product, 'None') AS sub_product, page_id, CAST(count(*) AS BIGINT) AS count, array_to_string(list_sort(list(node_id)), ',') AS node_ids FROM nodes WHERE category = 'Usage example' AND {} GROUP BY ALL"


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("node_ids", F.array_join(F.col("node_ids").cast("array<string>"), ","))


@query(NODES + " " + USAGE_BY_PAGE.format(f"date_added >= {SINCE} AND length(code) > 300"))
def new_applied_usage(spark, sf_dir):
    return _joined(catalog.new_applied_usage(X.nodes(spark, sf_dir), X.AS_OF))


@query(NODES + " " + USAGE_BY_PAGE.format("date_added >= DATE '2025-10-01' AND date_added < DATE '2025-11-01'"))
def monthly_usage(spark, sf_dir):
    return _joined(catalog.monthly_usage(X.nodes(spark, sf_dir), 2025, 10))


AREA = "CASE WHEN contains(page_id, 'src1') THEN 'first area' WHEN contains(page_id, 'src2') THEN 'second area' ELSE coalesce(sub_product, 'None') END"


@query(NODES + f", u AS (SELECT product, {AREA} AS sub_product FROM nodes WHERE category = 'Usage example' AND date_added >= DATE '2025-10-01' AND date_added < DATE '2025-11-01') SELECT product, sub_product, {COUNT} FROM u GROUP BY ALL UNION ALL SELECT product, NULL, count(*) FROM u GROUP BY product")
def product_rollup(spark, sf_dir):
    return catalog.product_rollup(catalog.monthly_usage(X.nodes(spark, sf_dir), 2025, 10), [("src1", "first area"), ("src2", "second area")])


SECTION = LIVE + f", s AS (SELECT * FROM live WHERE date_added >= {SINCE} AND regexp_matches(page_id, 'src1') AND NOT (category = 'Usage example' AND length(code) < 300))"


@query(SECTION + f" SELECT page_id, CAST(count(DISTINCT sha_256_hash) AS BIGINT) AS unique_count, CAST(sum({INST}) AS BIGINT) AS instance_count FROM s GROUP BY 1")
def unique_examples_page(spark, sf_dir):
    return catalog.unique_examples_by_page(X.nodes(spark, sf_dir), X.AS_OF, "src1")


@query(SECTION + f" SELECT category, CAST(count(*) AS BIGINT) AS node_count, CAST(count(DISTINCT sha_256_hash) AS BIGINT) AS distinct_hashes, CAST(sum({INST}) AS BIGINT) AS instance_count FROM s GROUP BY 1")
def unique_examples_category(spark, sf_dir):
    return catalog.unique_examples_by_category(X.nodes(spark, sf_dir), X.AS_OF, "src1")


@query(SECTION + f" SELECT CAST(count(DISTINCT sha_256_hash) AS BIGINT) AS unique_count, CAST(coalesce(sum({INST}), 0) AS BIGINT) AS instance_count FROM s")
def unique_examples_total(spark, sf_dir):
    return catalog.unique_examples_total(X.nodes(spark, sf_dir), X.AS_OF, "src1")


@query(ENTRIES + ", n AS (SELECT collection, page_id, CAST(count(*) FILTER (coalesce(is_removed, false) = false) AS BIGINT) AS node_count FROM nodes GROUP BY ALL), t AS (SELECT collection, page_id, CAST(sum(total) AS BIGINT) AS language_total FROM entries GROUP BY ALL) SELECT * FROM n JOIN t USING (collection, page_id) WHERE node_count <> language_total")
def lang_mismatch(spark, sf_dir):
    return catalog.language_mismatch(X.pages(spark, sf_dir))


@query(ENTRIES + " SELECT collection, CAST(count(*) AS BIGINT) AS count, array_to_string(list_sort(list(page_id)), ',') AS page_ids FROM pg WHERE product IS NULL OR product = '' GROUP BY 1")
def missing_product(spark, sf_dir):
    return catalog.missing_product(X.pages(spark, sf_dir)).withColumn("page_ids", F.array_join("page_ids", ","))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)EXAMPLE\\.com/.*ref')")
def url_match(spark, sf_dir):
    return catalog.url_matches(X.table(spark, sf_dir, "pages"), r"EXAMPLE\.com/.*ref", "url").select("page_id", "url")


@query(NODES + " SELECT collection, CAST(count(*) FILTER (regexp_matches(code, '(?i)license|que des')) AS BIGINT) AS count FROM nodes GROUP BY 1")
def string_in_code(spark, sf_dir):
    return catalog.string_in_code(X.nodes(spark, sf_dir), "license|que des")


@query("SELECT role AS docs_property, CAST(count(*) AS BIGINT) AS count FROM conversations WHERE text IS NOT NULL AND regexp_matches(text, '(?i)thing|que') AND NOT regexp_matches(text, '(?i)andth') GROUP BY 1")
def feedback_counts(spark, sf_dir):
    rows = X.table(spark, sf_dir, "conversations").select(F.col("text").alias("comment"), F.col("role").alias("docs_property"))
    return catalog.feedback_counts(rows, ["thing", "que"], ["andth"])


@query("SELECT CAST(row_number() OVER (ORDER BY role, conv_id, turn) AS BIGINT) AS entry_number, role AS docs_property, conv_id AS url, turn AS comment FROM conversations")
def feedback_report(spark, sf_dir):
    rows = X.table(spark, sf_dir, "conversations").select(F.col("role").alias("docs_property"), F.col("conv_id").alias("url"), F.col("turn").alias("comment"), F.lit(0).alias("id"))
    return sinks.numbered_feedback(rows).withColumn("entry_number", F.col("entry_number").cast("long"))


HISTOGRAM = "SELECT p.page_id, l.language, CAST(coalesce(h.total, 0) AS BIGINT) AS total FROM (SELECT DISTINCT page_id FROM nodes) p CROSS JOIN (SELECT unnest(['en', 'de', 'undefined', 'xx']) AS language) l LEFT JOIN h USING (page_id, language)"


@query(NODES + f", h AS (SELECT page_id, CASE WHEN language IN ('en', 'de', 'undefined', 'xx') THEN language ELSE 'undefined' END AS language, sum({INST}) AS total FROM nodes GROUP BY ALL) " + HISTOGRAM)
def dense_language_histogram(spark, sf_dir):
    return catalog.dense_language_histogram(X.nodes(spark, sf_dir), ["en", "de", "undefined", "xx"])


@query(NODES + f" SELECT page_id, CAST(sum({INST}) AS BIGINT) AS count FROM nodes GROUP BY 1")
def code_node_counts(spark, sf_dir):
    return catalog.code_node_count(X.nodes(spark, sf_dir))


@query(NODES + " SELECT page_id, sha_256_hash, CAST(count(*) AS BIGINT) AS instances_on_page, max(node_id) AS node_id FROM nodes GROUP BY ALL")
def unique_nodes(spark, sf_dir):
    return catalog.unique_nodes(X.nodes(spark, sf_dir))


@query(LIVE + " SELECT language AS key, CAST(count(*) AS BIGINT) AS count, printf('%.1f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS percent FROM live GROUP BY 1")
def pct_of_total(spark, sf_dir):
    return catalog.with_percent(catalog.node_language_counts(X.nodes(spark, sf_dir)).withColumnRenamed("language", "key"), "key")


# --- updates -------------------------------------------------------------------------------------------------------


@query(NODES + " SELECT page_id, CASE WHEN category = 'Other command' THEN 'Command' ELSE category END AS category, CAST(count(*) AS BIGINT) AS count FROM nodes GROUP BY ALL")
def rename_value(spark, sf_dir):
    renamed = updates.rename_value(X.pages(spark, sf_dir), "Other command", "Command")
    return catalog.count_by(catalog.explode_nodes(renamed), "page_id", "category")


@query(ENTRIES + ", d AS (SELECT DISTINCT source AS collection, 'product of ' || source AS p FROM documents WHERE source LIKE 'src1%') SELECT page_id, coalesce(p, '') AS product, CASE WHEN collection = 'src1' AND contains(lower(page_id), '|de') THEN 'german' WHEN collection = 'src1' AND contains(lower(page_id), '|e') THEN 'other' ELSE '' END AS sub_product FROM pg LEFT JOIN d USING (collection)")
def product_backfill(spark, sf_dir):
    pages = X.pages(spark, sf_dir).withColumn("page_url", F.col("page_id"))
    dim = X.table(spark, sf_dir, "documents").where(F.col("source").startswith("src1")).select(F.col("source").alias("collection"), F.concat(F.lit("product of "), "source").alias("product"), F.lit("").alias("sub_product")).distinct()
    return updates.add_product_names(pages, dim, [("|E", "other"), ("|De", "german")], "src1").select("page_id", "product", "sub_product")


@query(NODES + " SELECT CASE WHEN collection = 'src3' THEN 'renamed' ELSE collection END AS collection, CAST(count(*) AS BIGINT) AS count FROM nodes GROUP BY 1")
def change_project_name(spark, sf_dir):
    return catalog.count_by(updates.change_project_name(X.nodes(spark, sf_dir), "src3", "renamed"), "collection")


@query("SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 10 = 3 THEN 'replaced' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey > 0")
def bulk_write(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderstatus").alias("state"))
    tenth = F.col("page_id") % 10
    stored = updates.delete_page(rows, rows.where(tenth == 0))
    return updates.bulk_write(stored, rows.where((tenth == 0) & (F.col("page_id") > 0)).select((-F.col("page_id")).alias("page_id"), F.lit("new").alias("state")), rows.where(tenth == 3).withColumn("state", F.lit("replaced")))


# --- events --------------------------------------------------------------------------------------------------------

OK = "coalesce(success, false)"


@query(AUDIT + f" SELECT rule_name, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER ({OK}) AS BIGINT) AS succeeded, CAST(count(*) FILTER (NOT {OK}) AS BIGINT) AS failed, round(avg(duration_ms), 6) AS avg_duration_ms FROM audit WHERE event_type = 'copy' GROUP BY 1")
def audit_stats(spark, sf_dir):
    return events.stats_by_rule(X.audit(spark, sf_dir))


@query(AUDIT + " SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS count FROM audit WHERE ts >= DATE '2024-01-30' - INTERVAL 14 DAY GROUP BY 1")
def audit_daily(spark, sf_dir):
    return events.daily_volume(X.audit(spark, sf_dir), "2024-01-30", 14)


EVENT = "SELECT event_id, event_type, rule_name FROM audit"


@query(AUDIT + f" {EVENT} ORDER BY ts DESC, event_id LIMIT 50")
def audit_recent(spark, sf_dir):
    return events.recent_events(X.audit(spark, sf_dir), 50).select("event_id", "event_type", "rule_name")


@query(AUDIT + f" {EVENT} WHERE success = false ORDER BY ts DESC, event_id LIMIT 50")
def audit_failed(spark, sf_dir):
    return events.failed_events(X.audit(spark, sf_dir), 50).select("event_id", "event_type", "rule_name")


@query(AUDIT + f" {EVENT} WHERE rule_name = 'rule 7' ORDER BY ts DESC, event_id LIMIT 20")
def audit_of_rule(spark, sf_dir):
    return events.events_of_rule(X.audit(spark, sf_dir), "rule 7", 20).select("event_id", "event_type", "rule_name")


@query(AUDIT + f""", last AS (SELECT duration_ms AS d FROM audit WHERE duration_ms IS NOT NULL ORDER BY ts DESC, event_id LIMIT 1000), c AS (SELECT CAST(count(*) AS BIGINT) AS received, CAST(count(*) FILTER ({OK}) AS BIGINT) AS processed, CAST(count(*) FILTER (NOT {OK}) AS BIGINT) AS failed FROM audit),
t AS (SELECT round(avg(d), 6) AS avg_ms, min(d) AS min_ms, max(d) AS max_ms, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.95) AS p95, quantile_cont(d, 0.99) AS p99 FROM last)
SELECT c.*, t.*, processed * 100.0::DOUBLE / received AS success_rate, failed * 100.0::DOUBLE / received AS error_rate, avg_ms AS approx_p50, avg_ms * 1.5 AS approx_p95, avg_ms * 2 AS approx_p99 FROM c, t""")
def request_metrics(spark, sf_dir):
    rounded = lambda df: df.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})
    return rounded(events.processing_metrics(X.audit(spark, sf_dir)))


@query(AUDIT + ", n AS (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY ts DESC, event_id) AS i FROM audit WHERE duration_ms IS NOT NULL) SELECT rule_name, CAST(count(*) AS BIGINT) AS samples, round(avg(duration_ms), 6) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99 FROM n WHERE i <= 100 GROUP BY 1")
def rule_durations(spark, sf_dir):
    found = events.last_samples(X.audit(spark, sf_dir), 100)
    return found.withColumns({c: F.round(c, 6) for c in ("avg_ms", "p50", "p95", "p99")})


# --- change detection ----------------------------------------------------------------------------------------------

SNAP = NODES + ", o AS (SELECT page_id, sha_256_hash AS h, count(*) AS n FROM nodes WHERE node_id % 3 <> 0 GROUP BY ALL), i AS (SELECT page_id, sha_256_hash AS h, count(*) AS n FROM nodes WHERE node_id % 3 <> 1 GROUP BY ALL)"


@query(SNAP + " SELECT page_id, h AS sha_256_hash, CAST(coalesce(o.n, 0) AS BIGINT) AS old_count, CAST(coalesce(i.n, 0) AS BIGINT) AS new_count, CASE WHEN o.n IS NULL THEN 'new' WHEN i.n IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM o FULL JOIN i USING (page_id, h)")
def node_diff(spark, sf_dir):
    rows = X.nodes(spark, sf_dir)
    third = F.col("node_id") % 3
    return cdc.classify_nodes(rows.where(third != 0), rows.where(third != 1))


@query()
def node_diff_fuzzy(spark, sf_dir):
    rows = X.nodes(spark, sf_dir)
    third = F.col("node_id") % 3
    return cdc.diff_nodes(rows.where(third != 0), rows.where(third != 1))


@query("WITH s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), i AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS deleted FROM orders WHERE o_orderkey % 3 <> 1) SELECT coalesce(s.k, i.k) AS page_id, CASE WHEN deleted THEN 'deleted' WHEN s.k IS NOT NULL AND i.k IS NOT NULL THEN 'existing' WHEN i.k IS NULL THEN 'removed' ELSE 'new' END AS status FROM s FULL JOIN i ON s.k = i.k")
def page_status(spark, sf_dir):
    keys = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"))
    third = F.col("page_id") % 3
    return cdc.classify_pages(keys.where(third != 0), keys.where(third != 1).withColumn("deleted", F.col("page_id") % 7 == 0))


#: Moves between rows of `sides` (g: what has to agree, w: a rare word, id, is_old), all of which share one common word.
#: First every row whose rare word is on both sides takes that one, and the others take the common one; then what is left.
MOVES = """, live AS (SELECT *, EXISTS (SELECT 1 FROM sides t WHERE t.g = s.g AND t.w = s.w AND t.is_old <> s.is_old) AS own FROM sides s),
r AS (SELECT *, row_number() OVER (PARTITION BY g, own, CASE WHEN own THEN w END, is_old ORDER BY id) AS r FROM live),
p1 AS (SELECT o.g, o.id AS old_id, n.id AS new_id FROM r o JOIN r n ON o.is_old AND NOT n.is_old AND o.g = n.g AND o.own = n.own AND (NOT o.own OR o.w = n.w) AND o.r = n.r),
q AS (SELECT *, row_number() OVER (PARTITION BY g, is_old ORDER BY id) AS r FROM sides WHERE id NOT IN (SELECT old_id FROM p1 UNION SELECT new_id FROM p1)),
m AS (SELECT * FROM p1 UNION ALL SELECT o.g, o.id, n.id FROM q o JOIN q n ON o.is_old AND NOT n.is_old AND o.g = n.g AND o.r = n.r)"""
PAGES_MOVED = "WITH sides AS (SELECT (p_size, p_partkey % 2) AS g, p_partkey // 5 AS w, 'a|old|guide-w' || (p_partkey // 5) || '-o' || p_partkey AS id, true AS is_old FROM part WHERE p_partkey % 5 < 3 UNION ALL SELECT (p_size, p_partkey % 2), p_partkey // 5, 'a|new|guide-w' || (p_partkey // 5) || '-n' || p_partkey, false FROM part WHERE p_partkey % 5 > 0)"
LOG_MOVED = "WITH sides AS (SELECT ('p' || (p_partkey % 3), p_size) AS g, p_brand AS w, 'x|' || p_brand || '|k' || p_partkey AS id, p_partkey % 2 = 0 AS is_old FROM part)"


@query(PAGES_MOVED + MOVES + " SELECT old_id, new_id FROM m")
def page_moves(spark, sf_dir):
    """Rare words first, then what is left by the word that all names share."""
    part = X.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    side = lambda kind, which: part.where(which).select(F.concat(F.lit(f"a|{kind}|guide-w"), F.floor(k / 5).cast("string"), F.lit("-" + kind[0]), k.cast("string")).alias("page_id"), F.col("p_size").cast("long").alias("code_count"), (k % 2).alias("literal_count"), F.lit(0).cast("long").alias("io_count"))
    return cdc.page_moves(side("old", k % 5 < 3), side("new", k % 5 > 0), parent=False)


# --- graphs --------------------------------------------------------------------------------------------------------

EDGES = "WITH RECURSIVE e AS (SELECT o_orderkey // 10 AS source, o_orderkey AS target FROM orders WHERE o_orderkey > 0), r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.source = r.node)"


def _edges(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.floor(F.col("o_orderkey") / 10).alias("source"), F.col("o_orderkey").alias("target"))


@query(EDGES + " SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def include_closure(spark, sf_dir):
    return graph.closure(_edges(spark, sf_dir), spark.createDataFrame([(1,)], "node long")).select("node", "depth")


@query(EDGES + " SELECT CAST(count(DISTINCT node) AS BIGINT) AS files, CAST(count(*) FILTER (depth > 0) AS BIGINT) AS edges, max(depth) AS max_depth FROM r")
def include_stats(spark, sf_dir):
    return graph.include_stats(graph.include_paths(_edges(spark, sf_dir), spark.createDataFrame([(1,)], "node long")))


@query("WITH RECURSIVE e AS (SELECT o_orderkey // 10 AS source, o_orderkey AS target FROM orders WHERE o_orderkey > 0), r AS (SELECT CAST(777 AS BIGINT) AS node, 0 AS depth UNION SELECT e.source, r.depth + 1 FROM r JOIN e ON e.target = r.node) SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY 1")
def reverse_usage(spark, sf_dir):
    back = _edges(spark, sf_dir).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return graph.closure(back, spark.createDataFrame([(777,)], "node long")).where("depth > 0").select("node", "depth")


@query("SELECT event_type AS directive, CAST(count(*) AS BIGINT) AS usages, CAST(count(DISTINCT user_id) AS BIGINT) AS files FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*), count(DISTINCT user_id) FROM events")
def usage_totals(spark, sf_dir):
    return graph.usage_totals(X.table(spark, sf_dir, "events").select(F.col("event_type").alias("directive"), F.col("user_id").alias("source")))


@query("""WITH k AS (SELECT o_orderkey AS node, CAST(o_orderkey AS VARCHAR) AS t FROM orders WHERE o_orderkey > 0), a AS (SELECT CAST(unnest(list_transform(range(1, length(t) + 1), lambda i: left(t, i))) AS BIGINT) AS node FROM k), s AS (SELECT node, count(*) AS n FROM a GROUP BY 1),
o AS (SELECT CAST(left(t, 1) AS BIGINT) AS root, node, length(t) - 1 AS depth, row_number() OVER (PARTITION BY left(t, 1) ORDER BY t) - 1 AS enter FROM k) SELECT root, node, CAST(depth AS INTEGER) AS depth, CAST(enter AS BIGINT) AS enter, CAST(enter + n - 1 AS BIGINT) AS leave FROM o JOIN s USING (node)""")
def include_order(spark, sf_dir):
    """Depth-first order of nine trees of inclusions, with the range below each file."""
    edges = _edges(spark, sf_dir).where("target >= 10").withColumn("ordinal", (F.col("target") % 10).cast("int"))
    roots = spark.createDataFrame([(k,) for k in range(1, 10)], "node long")
    return trees.numbered(trees.include_tree(edges, roots)).select("root", "node", "depth", "enter", "leave")


@query("SELECT DISTINCT CAST(event_id AS VARCHAR) AS source FROM events WHERE event_type = 'view' AND user_id % 10 = 3")
def users_below_folder(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("source"), F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string"), F.lit("/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit(".rst")).alias("target"))
    labels = trees.numbered(trees.folder_tree(e.select(F.col("target").alias("path"))))
    return trees.users_below(labels, e, "d3/view/")


# --- paths ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])que des([^A-Za-z0-9_]|$)')")
def indexed_search(spark, sf_dir):
    """word_search's hits, by an index of three-character pieces that is written first."""
    files = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    index = text_index.write(files, f"{own_folder(spark)}/index-{uuid.uuid4().hex}", blocks=64)
    return index.search("que des").select(F.col("id").alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'ouvre') OR contains(lower(text), 'the w')")
def indexed_parts(spark, sf_dir):
    files = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    index = text_index.write(files, f"{own_folder(spark)}/index-{uuid.uuid4().hex}", blocks=64)
    return index.search("ouvre", whole=False).unionByName(index.search("THE w", whole=False)).select(F.col("id").alias("doc_id")).distinct()


@query("SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])que des([^A-Za-z0-9_]|$)') AS found FROM documents")
def word_search(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", S.whole_word(F.col("text"), "que des").alias("found"))


FILES = AUDIT + ", f AS (SELECT DISTINCT source_path AS path FROM audit)"
RULES = [
    {"workflow": "a", "idx": 0, "kind": "move", "pattern": "examples/1", "target": "moved"},
    {"workflow": "a", "idx": 1, "kind": "glob", "pattern": "examples/**/cl*.py", "target": "out/${relative_path}", "excludes": ["/2[0-9]*/", "("]},
    {"workflow": "b", "idx": 0, "kind": "regex", "pattern": "^examples/(?P<user>[0-9]+)/(?P<kind>view|error)\\.py$", "target": "by-kind/${kind}/${user}.${ext}"},
    {"workflow": "b", "idx": 1, "kind": "prefix", "pattern": "examples/3", "target": "three/${filename}"},
]


@query(
    FILES
    + r""" SELECT path, 'a' AS workflow, CASE WHEN path LIKE 'examples/1/%' THEN 0 ELSE 1 END AS rule_idx, CASE WHEN path LIKE 'examples/1/%' THEN 'moved' || substr(path, 11) ELSE 'out/' || substr(path, 10) END AS target FROM f
 WHERE path LIKE 'examples/1/%' OR (regexp_matches(path, '^examples/(.*/)?cl[^/]*\.py$') AND NOT regexp_matches(path, '/2[0-9]*/'))
 UNION ALL SELECT path, 'b', CASE WHEN regexp_matches(path, '^examples/[0-9]+/(view|error)\.py$') THEN 0 ELSE 1 END, CASE WHEN regexp_matches(path, '^examples/[0-9]+/(view|error)\.py$') THEN 'by-kind/' || split_part(split_part(path, '/', 3), '.', 1) || '/' || split_part(path, '/', 2) || '.py' ELSE 'three/' || split_part(path, '/', 3) END FROM f
 WHERE regexp_matches(path, '^examples/[0-9]+/(view|error)\.py$') OR path LIKE 'examples/3%'"""
)
def path_rules(spark, sf_dir):
    return paths.apply_rules(X.audit(spark, sf_dir).select(F.col("source_path").alias("path")).distinct(), RULES)


@query(
    AUDIT
    + r""", f AS (SELECT DISTINCT source_path AS path FROM audit), u AS (SELECT DISTINCT user_id FROM events)
 SELECT path, 'w' || (n % 3) AS workflow, CAST(CASE WHEN n % 2 = 0 THEN 2 * n ELSE 2 * n + 1 END AS INTEGER) AS rule_idx, CASE WHEN n % 2 = 0 THEN 'moved/' || n || substr(path, 9 + length(CAST(n AS VARCHAR)) + 1) ELSE 'typed/' || split_part(path, '/', 3) || '.' || n END AS target
 FROM (SELECT path, CAST(split_part(path, '/', 2) AS BIGINT) AS n FROM f) WHERE n % 2 = 0 OR path NOT LIKE '%view%'"""
)
def path_rules_of_table(spark, sf_dir):
    """Two rules a user, as a table: its folder is moved, or else its files, but for views, are renamed by a pattern."""
    users = X.table(spark, sf_dir, "events").select("user_id").distinct()
    n, text = F.col("user_id"), F.col("user_id").cast("string")
    none = F.array().cast("array<string>")
    move = users.where(n % 2 == 0).select(F.concat(F.lit("w"), (n % 3).cast("string")).alias("workflow"), (2 * n).cast("int").alias("idx"), F.lit("move").alias("kind"), F.concat(F.lit("examples/"), text).alias("pattern"), F.concat(F.lit("moved/"), text).alias("target"), none.alias("excludes"))
    named = users.select(F.concat(F.lit("w"), (n % 3).cast("string")).alias("workflow"), (2 * n + 1).cast("int").alias("idx"), F.lit("regex").alias("kind"), F.concat(F.lit("^examples/"), text, F.lit(r"/(?P<name>\w+\.py)$")).alias("pattern"), F.concat(F.lit("typed/${name}."), text).alias("target"), F.array(F.lit("view")).alias("excludes"))
    return rules.apply(X.audit(spark, sf_dir).select(F.col("source_path").alias("path")).distinct(), rules.compiled(move.unionByName(named)))


TREE = "concat('content/p', {k} % 7, CASE WHEN {k} % 3 = 0 THEN '/current' WHEN {k} % 3 = 1 THEN '/v' || ({k} % 4) ELSE '' END, '/source/', CASE WHEN {k} % 11 = 0 THEN 'code-examples/' ELSE '' END, 'page', {k}, '.txt')"


@query("WITH f AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT 'p' || (k % 7) AS project, CASE WHEN k % 3 = 0 THEN 'current' WHEN k % 3 = 1 THEN 'v' || (k % 4) END AS version FROM f WHERE NOT (k % 11 = 0 AND k % 3 = 2)) SELECT project, version, 0 AS level, CAST(count(*) AS BIGINT) AS count FROM t GROUP BY ALL UNION ALL SELECT project, NULL, 1, count(*) FROM t GROUP BY project UNION ALL SELECT NULL, NULL, 2, count(*) FROM t")
def count_pages(spark, sf_dir):
    files = X.table(spark, sf_dir, "orders").select(F.expr(TREE.format(k="o_orderkey")).alias("path"))
    return paths.page_counts(paths.counted_pages(files))


@query("SELECT 'prod' || (o_orderkey % 4) AS product, CAST(count(*) AS BIGINT) AS count FROM orders WHERE o_orderkey % 4 < 2 AND o_orderkey % 3 <> 0 GROUP BY 1")
def count_tested_examples(spark, sf_dir):
    files = X.table(spark, sf_dir, "orders").select(F.expr("concat('content/code-examples/tested/lang/prod', o_orderkey % 4, '/f', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '.md' ELSE '.py' END)").alias("path"))
    known = spark.createDataFrame([("prod0", [".py"]), ("prod1", [".py", ".js"])], "product string, extensions array<string>")
    return paths.tested_examples(files, known)


@query("SELECT url, split_part(rtrim(url, '/'), '/', -1) AS last, regexp_extract(split_part(rtrim(url, '/'), '/', -1), '(\\.[^./]*)$', 1) AS ext FROM pages")
def url_parts(spark, sf_dir):
    last = S.last_segment(F.col("url"))
    return X.table(spark, sf_dir, "pages").select("url", last.alias("last"), S.file_extension(last).alias("ext"))


@query("SELECT p_name AS name, CAST(p_size % 3 AS VARCHAR) || '.' || (p_partkey % 4) || '.' || (p_partkey % 5) AS current, CASE WHEN p_partkey % 9 = 0 THEN '1.2' ELSE CAST(p_size % 2 AS VARCHAR) || '.' || (p_partkey % 3) || '.' || (p_partkey % 7) END AS latest, CASE WHEN p_partkey % 9 = 0 THEN 'unknown' WHEN p_size % 3 <> p_size % 2 THEN 'major' WHEN p_partkey % 4 <> p_partkey % 3 THEN 'minor' WHEN p_partkey % 5 <> p_partkey % 7 THEN 'patch' ELSE 'none' END AS update_type FROM part")
def update_types(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    current = F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_partkey") % 4).cast("string"), (F.col("p_partkey") % 5).cast("string"))
    latest = F.when(F.col("p_partkey") % 9 == 0, "1.2").otherwise(F.concat_ws(".", (F.col("p_size") % 2).cast("string"), (F.col("p_partkey") % 3).cast("string"), (F.col("p_partkey") % 7).cast("string")))
    rows = part.select(F.col("p_name").alias("name"), current.alias("current"), latest.alias("latest"))
    return rows.withColumn("update_type", S.update_type(F.col("current"), F.col("latest")))


#: The head: the longest prefix of whole characters within 50 bytes. Then the stage rule, anywhere in the text.
HEAD_SQL = "substr(text, 1, len(list_filter(range(1, 51), lambda i: i <= length(text) AND strlen(substr(text, 1, i)) <= 50)))"
STAGE_SQL = r"(?s)\$[a-zA-Z]{2,}: ?(.*?<.+?>)?"


@query(rf"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, coalesce({HEAD_SQL}, '') AS head FROM documents)
SELECT doc_id, CASE WHEN starts_with(text, 'import ') OR starts_with(text, 'from ') OR contains(head, 'License') THEN 'Usage example' WHEN contains(head, 'warning') OR contains(head, 'deprecated') OR contains(head, '_id') THEN 'Example return object'
 WHEN regexp_extract(text, '{STAGE_SQL}', 1) <> '' THEN 'Syntax example' WHEN regexp_matches(text, '{STAGE_SQL}') THEN 'Usage example' ELSE 'Uncategorized' END AS category FROM h""")
def rule_categories_of_all(spark, sf_dir):
    """Over every document: heads of several bytes a character, and the stage rule."""
    words = V.RuleWords(usage_prefixes=("import ", "from "), command_prefixes=(), usage_strings=("License",), command_strings=())
    return X.table(spark, sf_dir, "documents").select("doc_id", S.rule_category(F.col("text"), F.col("lang"), words).alias("category"))


@query(ORACLES["rule_categories_of_all"])
def rule_categories(spark, sf_dir):
    return rule_categories_of_all(spark, sf_dir)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", S.json_field(F.col("props"), "k", "bigint").alias("k"))


@query(NODES + " SELECT page_id, CAST(sum(length(code)) AS BIGINT) AS chars FROM nodes WHERE page_id <> 'summaries' GROUP BY 1")
def page_chars(spark, sf_dir):
    return catalog.explode_nodes(catalog.not_summary(X.pages(spark, sf_dir))).groupBy("page_id").agg(F.sum(F.length("code")).alias("chars"))


# --- at the scale of orders and line items ----------------------------------------------------------------------------


@query("SELECT l_returnflag AS category, l_linestatus AS language, CAST(count(*) AS BIGINT) AS count, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS pages FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' GROUP BY ALL")
def line_category_language(spark, sf_dir):
    lines = X.table(spark, sf_dir, "lineitem").where("l_shipdate >= DATE '1995-01-01'")
    return catalog.counts_and_pages(lines.select(F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("language"), F.col("l_orderkey").alias("page_id")), "category", "language")


# --- ingest --------------------------------------------------------------------------------------------------------


@query(NODES + ", u AS (SELECT page_id, sha_256_hash, count(*) AS n FROM nodes GROUP BY ALL) SELECT page_id, CAST(count(*) AS BIGINT) AS unique_nodes, CAST(sum(n) AS BIGINT) AS code_nodes_total FROM u GROUP BY 1")
def new_pages(spark, sf_dir):
    rows = X.nodes(spark, sf_dir).select("page_id", "sha_256_hash", "code", "language")
    made = ingest.new_pages(rows, rows.select("page_id").distinct(), F.lit(X.AS_OF).cast("date"))
    return made.select("page_id", F.size("nodes").cast("long").alias("unique_nodes"), "code_nodes_total")


@query(NODES + f", h AS (SELECT page_id, CASE WHEN language IN ('en', 'de', 'undefined', 'xx') THEN language ELSE 'undefined' END AS language, sum({INST}) AS total FROM nodes GROUP BY ALL) " + HISTOGRAM)
def languages_arrays(spark, sf_dir):
    made = ingest.languages_array(X.nodes(spark, sf_dir), ["en", "de", "undefined", "xx"])
    return catalog.language_rows(made.withColumn("collection", F.lit(""))).select("page_id", "language", "total")


@query("SELECT event_type AS kind, 'user ' || (user_id % 10) AS project, CAST(sum(event_id % 4) AS BIGINT) AS total, CAST(count(DISTINCT user_id) AS BIGINT) AS pages FROM events GROUP BY ALL")
def run_counters(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select(F.concat(F.lit("user "), F.col("user_id") % 10).alias("project"), F.col("event_type").alias("kind"), F.col("user_id").alias("page_id"), (F.col("event_id") % 4).alias("count"))
    return ingest.run_counters(rows)


@query(LOG_MOVED + MOVES + " SELECT g[1] AS project, old_id, new_id FROM m")
def log_moves(spark, sf_dir):
    """All ids share the part x, some the brand as well."""
    part = X.table(spark, sf_dir, "part")
    side = lambda rest: part.where(F.col("p_partkey") % 2 == rest).select(F.concat(F.lit("p"), (F.col("p_partkey") % 3).cast("string")).alias("project"), F.concat(F.lit("x|"), "p_brand", F.lit("|k"), F.col("p_partkey").cast("string")).alias("page_id"), F.col("p_size").alias("count"))
    return ingest.log_moves(side(0), side(1))


@query(NODES + " SELECT 'language' AS kind, language AS key, CAST(count(*) AS BIGINT) AS count FROM nodes GROUP BY 2 UNION ALL SELECT 'directive', category, count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'file', page_id, count(*) FROM nodes GROUP BY 2")
def extraction_report(spark, sf_dir):
    return ingest.extraction_report(X.nodes(spark, sf_dir).select("language", F.col("category").alias("directive"), F.col("page_id").alias("path")))


@query("SELECT CASE WHEN starts_with(p_name, 'p') THEN 'package.json' ELSE 'pom.xml' END AS filename, CASE WHEN starts_with(p_name, 'p') THEN 'npm' ELSE 'maven' END AS type, CAST(count(*) AS BIGINT) AS count FROM part WHERE p_partkey % 4 <> 0 GROUP BY ALL")
def manifests(spark, sf_dir):
    name = F.when(F.col("p_name").startswith("p"), "package.json").otherwise("pom.xml")
    files = X.table(spark, sf_dir, "part").select(F.concat(F.lit("d/"), F.when(F.col("p_partkey") % 4 == 0, "node_modules/").otherwise(""), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"))
    return deps.manifests(files).groupBy("filename", "type").agg(F.count(F.lit(1)).alias("count"))


# The other catalogues register themselves.
from pagequarry.plans import cdc_queries, edit_queries, report_queries, run_queries, scalar_queries, source_queries, tree_queries  # noqa: E402, F401
