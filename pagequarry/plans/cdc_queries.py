"""Change detection over whole pages: what a run makes of stored pages, their nodes and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import catalog, cdc, ingest
from pagequarry.plans import fixtures as X
from pagequarry.plans.registry import query

#: Eight slots a page. A slot's code is a run of one letter whose length doubles from slot to slot, so that no two slots
#: are similar; an updated one grows by one letter, or, in slot 4, changes one letter at equal length.
#: Slot 0 stays, 1 and 4 are updated, 2 and 5 are removed, 3 and 6 are new, 7 had been removed before.
#: Of page numbers modulo 4: 0 loses all its nodes, 1 gets its first ones, 2 changes, 3 comes in as it was.
SLOTS = "SELECT CAST(p_partkey // 8 AS BIGINT) AS page, CAST(p_partkey % 8 AS INTEGER) AS slot FROM part"
OLD_CODE = "repeat('a', CAST(30 * pow(2, slot) AS INTEGER))"
NEW_CODE = "CASE WHEN slot = 1 THEN repeat('a', 61) WHEN slot = 4 THEN repeat('a', 479) || 'b' ELSE " + OLD_CODE + " END"


def _slots(spark, sf_dir):
    k = F.col("p_partkey")
    return X.table(spark, sf_dir, "part").select(F.floor(k / 8).alias("page"), (k % 8).cast("int").alias("slot"))


def _nodes(rows, code, removed, at):
    long = lambda x: F.lit(x).cast("long")
    day = F.lit(at).cast("date")
    return rows.select(
        "page", "slot", F.concat(F.lit("pg"), F.col("page").cast("string")).alias("page_id"), F.expr(code).alias("code"), F.lit("python").alias("language"), F.lit(".py").alias("file_extension"), F.lit("Usage example").alias("category"), F.sha2(F.expr(code).cast("binary"), 256).alias("sha_256_hash"), F.lit(False).alias("llm_categorized"),
        day.alias("date_added"), F.lit(None).cast("date").alias("date_updated"), F.when(removed, day).alias("date_removed"), removed.alias("is_removed"), F.when(removed, long(0)).otherwise(long(1)).alias("instances_on_page"),
    )


FIELDS = ["code", "language", "file_extension", "category", "sha_256_hash", "llm_categorized", "date_added", "date_updated", "date_removed", "is_removed", "instances_on_page"]


def _snapshots(spark, sf_dir):
    """Stored pages, incoming pages and incoming nodes."""
    rows = _slots(spark, sf_dir)
    kind = F.col("page") % 4
    old = _nodes(rows.where((kind != 1) & F.col("slot").isin(0, 1, 2, 4, 5, 7)), OLD_CODE, F.col("slot") == 7, "2025-01-01")
    grouped = old.groupBy("page", "page_id").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("nodes"), F.sum("instances_on_page").alias("code_nodes_total"))
    pages = rows.select("page", F.concat(F.lit("pg"), F.col("page").cast("string")).alias("page_id")).distinct()
    first = F.array(F.lit("k"))
    stored = pages.join(grouped, ["page", "page_id"], "left").select("page_id", "nodes", F.coalesce("code_nodes_total", F.lit(0)).alias("code_nodes_total"), first.alias("keywords"), F.lit("2025-01-01").cast("date").alias("date_last_updated"))
    code = F.expr(f"CASE WHEN page % 4 = 3 THEN {OLD_CODE} ELSE {NEW_CODE} END")
    arriving = rows.where(((kind == 2) | (kind == 1)) & F.col("slot").isin(0, 1, 3, 4, 6) | ((kind == 3) & F.col("slot").isin(0, 1, 2, 4, 5)))
    nodes = _nodes(arriving, "''", F.lit(False), "2025-06-01").drop("code", "sha_256_hash").withColumn("code", code)
    # Slot 3 stands on its page twice.
    twice = nodes.withColumn("n", F.explode(F.when(F.col("slot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    nodes = twice.withColumn("sha_256_hash", F.sha2(F.col("code").cast("binary"), 256)).select("page_id", *FIELDS)
    incoming = pages.select("page_id", F.when(F.col("page") % 8 == 3, F.array(F.lit("k"), F.lit("l"))).otherwise(first).alias("keywords"))
    return stored, incoming, nodes


UPDATED = f"""WITH s AS ({SLOTS}), c AS (SELECT *, page % 4 AS kind, {OLD_CODE} AS old_code, {NEW_CODE} AS new_code FROM s),
n AS (SELECT page, CASE WHEN kind IN (1, 2) AND slot IN (1, 4) THEN new_code ELSE old_code END AS code,
 CASE WHEN slot = 7 OR kind = 0 OR (kind = 2 AND slot IN (2, 5)) THEN true ELSE false END AS is_removed, CASE WHEN slot = 7 THEN 0 WHEN kind = 0 OR (kind = 2 AND slot IN (2, 5)) THEN 0 WHEN slot = 3 THEN 2 ELSE 1 END AS instances,
 CASE WHEN kind = 1 OR (kind = 2 AND slot IN (3, 6)) THEN '2025-06-02' ELSE '2025-01-01' END AS added, CASE WHEN kind = 2 AND slot IN (1, 4) THEN '2025-06-02' ELSE '' END AS updated, CASE WHEN slot = 7 THEN '2025-01-01' WHEN kind = 0 OR (kind = 2 AND slot IN (2, 5)) THEN '2025-06-02' ELSE '' END AS removed
 FROM c WHERE CASE kind WHEN 0 THEN slot IN (0, 1, 2, 4, 5, 7) WHEN 1 THEN slot IN (0, 1, 3, 4, 6) WHEN 2 THEN true ELSE slot IN (0, 1, 2, 4, 5, 7) END)"""


@query(UPDATED + " SELECT 'pg' || page AS page_id, sha256(code) AS sha_256_hash, is_removed, CAST(instances AS BIGINT) AS instances_on_page, added, updated, removed FROM n")
def updated_nodes(spark, sf_dir):
    """All four branches of an existing page: all removed, all new, mixed, unchanged."""
    made = cdc.update_pages(*_snapshots(spark, sf_dir), F.lit("2025-06-02").cast("date"))
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    nodes = catalog.explode_nodes(made.select("page_id", "nodes"))
    return nodes.select("page_id", "sha_256_hash", "is_removed", "instances_on_page", day("date_added").alias("added"), day("date_updated").alias("updated"), day("date_removed").alias("removed"))


PAGE_ROWS = "SELECT 'pg' || page AS page_id, CAST({} AS BIGINT) AS code_nodes_total, CASE WHEN page % 8 = 3 THEN 2 ELSE 1 END AS keywords, CASE WHEN page % 4 < 3 OR page % 8 = 3 THEN '2025-06-02' ELSE '2025-01-01' END AS day FROM n GROUP BY page"


@query(UPDATED + " " + PAGE_ROWS.format("sum(instances)"))
def updated_pages(spark, sf_dir):
    made = cdc.update_pages(*_snapshots(spark, sf_dir), F.lit("2025-06-02").cast("date"))
    return made.select("page_id", "code_nodes_total", F.size("keywords").alias("keywords"), F.date_format("date_last_updated", "yyyy-MM-dd").alias("day"))


@query(f"WITH s AS ({SLOTS}) SELECT 'pg' || page AS page_id, sha256({OLD_CODE}) AS old_hash, sha256({NEW_CODE}) AS new_hash, CAST(1 AS BIGINT) AS old_count, CAST(1 AS BIGINT) AS new_count, CASE WHEN slot = 0 THEN 'unchanged' ELSE 'updated' END AS status FROM s WHERE slot IN (0, 1, 4) AND page % 4 = 2 UNION ALL SELECT 'pg' || page, sha256({OLD_CODE}), NULL, 1, 0, 'removed' FROM s WHERE slot IN (2, 5) AND page % 4 = 2 UNION ALL SELECT 'pg' || page, NULL, sha256({OLD_CODE}), 0, CASE WHEN slot = 3 THEN 2 ELSE 1 END, 'new' FROM s WHERE slot IN (3, 6) AND page % 4 = 2")
def node_diff_similar(spark, sf_dir):
    """Exact matches, similar ones by length or by edit, and the rest, with how often each stands on its page."""
    stored, _, nodes = _snapshots(spark, sf_dir)
    mixed = lambda df: df.where(F.substring("page_id", 3, 20).cast("long") % 4 == 2)
    return cdc.diff_nodes(mixed(cdc.live_nodes(stored).select("page_id", "n.*")), mixed(nodes))


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'new|' || p_partkey ELSE 'old|' || p_partkey END AS page_id, CASE WHEN p_partkey % 4 = 0 THEN 'http://x/new/' || p_partkey ELSE 'http://x/old/' || p_partkey END AS page_url, p_name AS product FROM part")
def moved_pages(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda kind, sep: F.concat(F.lit(kind + sep), k.cast("string"))
    part = X.table(spark, sf_dir, "part")
    stored = part.select(name("old", "|").alias("page_id"), F.concat(F.lit("http://x/"), name("old", "/")).alias("page_url"), F.col("p_name").alias("product"))
    moves = part.where(k % 4 == 0).select(name("old", "|").alias("old_id"), name("new", "|").alias("new_id"))
    return cdc.move_pages(stored, moves, F.current_timestamp(), F.lit("http://x/"))


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'new|' || p_partkey ELSE 'old|' || p_partkey END AS page_id, CASE p_partkey % 4 WHEN 0 THEN 'moved' WHEN 1 THEN 'removed' WHEN 2 THEN 'existing' ELSE 'new' END AS status FROM part")
def page_states(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda kind: F.concat(F.lit(kind + "|"), k.cast("string"))
    part = X.table(spark, sf_dir, "part")
    stored = part.where(k % 4 != 3).select(name("old").alias("page_id"))
    incoming = part.where(k % 4 != 1).select(F.when(k % 4 == 0, name("new")).otherwise(name("old")).alias("page_id"), F.lit(False).alias("deleted"))
    moves = part.where(k % 4 == 0).select(name("old").alias("old_id"), name("new").alias("new_id"))
    return cdc.page_states(stored, incoming, moves)


@query("WITH " + X.cte("nodes", X.NODES, "documents") + " SELECT page_id, CAST(count(*) FILTER (NOT coalesce(is_removed, false)) AS BIGINT) AS live, CAST(count(*) FILTER (is_removed) AS BIGINT) AS removed FROM nodes GROUP BY 1")
def live_and_removed(spark, sf_dir):
    return catalog.split_removed(X.pages(spark, sf_dir)).select("page_id", F.size("live_nodes").cast("long").alias("live"), F.size("removed_nodes").cast("long").alias("removed"))


@query("SELECT 'p' AS project, CASE event_id % 4 WHEN 0 THEN 'Page removed: Page ID: x' || user_id WHEN 1 THEN 'Code example created: Page ID: x' || user_id || ', ' || event_id || ' new code examples added' WHEN 2 THEN 'Page moved: Old page ID: o, new page ID: x' || user_id ELSE 'odd: Page ID: x' || user_id END AS message FROM events")
def change_messages(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "page removed").when(e % 4 == 1, "examples created").when(e % 4 == 2, "page moved").otherwise("odd")
    rows = X.table(spark, sf_dir, "events").select(F.lit("p").alias("project"), kind.alias("kind"), F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("page_id"), F.lit("o").alias("old"), F.lit(None).cast("string").alias("new"), e.alias("n"))
    return cdc.change_messages(rows)


@query("SELECT 'p' || (p_partkey % 3) AS project, 'n' || p_partkey AS page_id FROM part WHERE p_partkey % 5 <> 0")
def usage_without_moves(spark, sf_dir):
    k = F.col("p_partkey")
    rows = X.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), (k % 3).cast("string")).alias("project"), F.concat(F.lit("n"), k.cast("string")).alias("page_id"), k.alias("k"))
    moves = rows.where(F.col("k") % 5 == 0).select("project", F.lit("o").alias("old_id"), F.col("page_id").alias("new_id"))
    return ingest.usage_without_moves(rows.drop("k"), moves)


@query("SELECT 'pg' || (p_partkey // 8) AS page_id, CAST(100 AS BIGINT) AS code_nodes_total, CAST(5 AS BIGINT) AS counted FROM part WHERE p_partkey % 8 = 0 AND (p_partkey // 8) % 4 <> 1 AND (p_partkey // 8) % 3 = 0")
def inconsistent_pages(spark, sf_dir):
    stored, _, _ = _snapshots(spark, sf_dir)
    page = F.substring("page_id", 3, 20).cast("long")
    live = stored.withColumn("nodes", F.filter("nodes", lambda n: ~n["is_removed"])).where(page % 4 != 1)
    return ingest.inconsistent_pages(live.withColumn("code_nodes_total", F.when(page % 3 == 0, F.lit(100).cast("long")).otherwise(F.col("code_nodes_total"))))


@query("WITH " + X.cte("nodes", X.NODES, "documents") + " SELECT page_id, CAST(count(*) AS BIGINT) AS count FROM nodes WHERE category = 'Usage example' AND length(code) > 3000 GROUP BY 1")
def long_usage_examples(spark, sf_dir):
    """Nodes of nested pages by a test on the array's elements."""
    long = lambda n: (n["category"] == "Usage example") & (F.length(n["code"]) > 3000)
    return catalog.count_by(catalog.explode_matching(X.pages(spark, sf_dir), long), "page_id")
