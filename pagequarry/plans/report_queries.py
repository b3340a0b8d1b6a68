"""Reports as people read them, and what readers and sinks make of files: written from the tables first, then read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagequarry.functions import scalars as S
from pagequarry.operators import catalog, deps, events, paths, reports
from pagequarry.operators.ranks import own_folder
from pagequarry.plans import fixtures as X
from pagequarry.plans.registry import query
from pagequarry.plans.source_queries import _page_lines
from pagequarry.sources import lines_source, readers, sinks, snapshots
from pagequarry.streaming import audit

NODES = "WITH " + X.cte("nodes", X.NODES, "documents")
CODED = NODES + ", coded AS (SELECT * FROM nodes WHERE coalesce(is_removed, false) = false AND code IS NOT NULL AND code <> '')"


def _folder(spark, name):
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _cell(text: str, width: int) -> str:
    return f"'| ' || CASE WHEN length({text}) < {width} THEN rpad({text}, {width}, ' ') ELSE {text} END || ' '"


def _table_sql(columns: list[tuple[str, str, int]], order: str, rows: str, above: list[str] = (), below: list[str] = (), group: str = "") -> str:
    """SQL of the lines that reports.bordered makes of the table `rows`; columns' names are expressions of text."""
    part, first = (f"PARTITION BY {group} ", f"{group}, ") if group else ("", "")
    border = "'" + "".join("+" + "-" * (w + 2) for _, _, w in columns) + "+'"
    line = lambda cells: " || ".join(_cell(c, w) for c, (_, _, w) in zip(cells, columns, strict=True)) + " || '|'"
    tail = f"FROM {rows}" + (f" GROUP BY {group}" if group else " HAVING count(*) > 0")
    out = [f"SELECT {first}2 AS section, CAST(row_number() OVER ({part}ORDER BY {order}) - 1 AS BIGINT) AS rank, {line([c for c, _, _ in columns])} AS line FROM {rows}"]
    frame = [*[(0, a) for a in above], (1, border), (1, line([f"'{h}'" for _, h, _ in columns])), (1, border), (3, border), *[(4, b) for b in below]]
    out += [f"SELECT {first}{s}, CAST({i} AS BIGINT), {t} {tail}" for i, (s, t) in enumerate(frame)]
    return " UNION ALL ".join(out)


SHARE = "printf('%.1f%%', count * 100.0 / a)"
COUNTS = [("key", "Category", 30), ("CAST(count AS VARCHAR)", "Count", 15), ("share", "% of Total", 18)]


@query(CODED + ", c AS (SELECT category AS key, count(*) AS count FROM coded GROUP BY 1), r AS (SELECT key, count, printf('%.1f%%', count * 100.0 / (SELECT sum(count) FROM c)) AS share FROM c) " + _table_sql(COUNTS, "count DESC, key", "r", ["'By category'", "'Total code examples by Category: ' || CAST(sum(count) AS BIGINT)"]))
def console_counts(spark, sf_dir):
    counts = catalog.category_counts(X.nodes(spark, sf_dir)).where(~F.col("key").isin("total", "complex examples"))
    return reports.count_table(counts, "By category", "Category")


@query(NODES + ", c AS (SELECT collection, language AS key, count(*) AS count FROM nodes GROUP BY ALL), r AS (SELECT collection, key, count, printf('%.1f%%', count * 100.0 / sum(count) OVER (PARTITION BY collection)) AS share FROM c) " + _table_sql([("key", "Language", 30), *COUNTS[1:]], "count DESC, key", "r", ["'Language Counts for: ' || collection", "'Total code examples by ' || collection || ': ' || CAST(sum(count) AS BIGINT)"], group="collection"))
def console_nested_counts(spark, sf_dir):
    counts = X.nodes(spark, sf_dir).groupBy("collection", F.col("language").alias("key")).agg(F.count(F.lit(1)).alias("count"))
    return reports.nested_count_tables(counts, "Language", "Language", "collection")


@query(NODES + ", c AS (SELECT collection, language, category AS key, count(*) AS count FROM nodes GROUP BY ALL), r AS (SELECT collection, language, key, count, printf('%.1f%%', count * 100.0 / sum(count) OVER (PARTITION BY collection, language)) AS share FROM c) " + _table_sql(COUNTS, "count DESC, key", "r", ["'Category Counts for: ' || collection || ' - ' || language", "'Total code examples by ' || language || ': ' || CAST(sum(count) AS BIGINT)"], group="collection, language"))
def console_pair_counts(spark, sf_dir):
    counts = X.nodes(spark, sf_dir).groupBy("collection", "language", F.col("category").alias("key")).agg(F.count(F.lit(1)).alias("count"))
    return reports.nested_count_tables(counts, "Category", "Category", "collection", "language")


_MEANS = [f"'Aggregate {n}: ' || CAST(floor(avg({c})) AS BIGINT)" for n, c in (("min", "lo"), ("median", "med"), ("max", "hi"))]


@query(CODED + ", n AS (SELECT collection, length(code) AS n, row_number() OVER (PARTITION BY collection ORDER BY length(code)) - 1 AS i, count(*) OVER (PARTITION BY collection) AS k FROM coded), r AS (SELECT collection, min(n) AS lo, min(CASE WHEN i = k // 2 THEN n END) AS med, max(n) AS hi, count(*) FILTER (n < 80) AS one FROM n GROUP BY 1) " + _table_sql([("collection", "Project", 25), ("CAST(lo AS VARCHAR)", "Min", 10), ("CAST(med AS VARCHAR)", "Med", 10), ("CAST(hi AS VARCHAR)", "Max", 10), ("CAST(one AS VARCHAR)", "One line", 10)], "collection", "r", ["'Minimum, median, and maximum code character count, and one-line count, by collection.'"], [*_MEANS, "'Total one-line count across collections: ' || CAST(sum(one) AS BIGINT)"]))
def console_lengths(spark, sf_dir):
    return reports.length_table(catalog.code_lengths(X.nodes(spark, sf_dir)))


@query(NODES + ", r AS (SELECT collection, page_id, count(*) FILTER (node_id % 3 = 0) AS a, count(*) FILTER (node_id % 3 = 1) AS u, count(*) FILTER (node_id % 3 = 2) AS d FROM nodes GROUP BY ALL) " + _table_sql([("page_id", "Page ID", 70), ("CAST(a AS VARCHAR)", "Added", 15), ("CAST(u AS VARCHAR)", "Updated", 15), ("CAST(d AS VARCHAR)", "Removed", 15)], "page_id", "r", ["'Recently Updated Pages in Collection ' || collection"], group="collection"))
def console_changes(spark, sf_dir):
    k = F.col("node_id") % 3
    changes = X.nodes(spark, sf_dir).groupBy("collection", "page_id").agg(F.count_if(k == 0).alias("added"), F.count_if(k == 1).alias("updated"), F.count_if(k == 2).alias("removed"))
    return reports.change_tables(changes)


PAGE_USE = NODES + ", r AS (SELECT collection, page_id, coalesce(max(product), '') AS product, coalesce(max(sub_product), 'None') AS sub_product, count(*) AS count FROM nodes GROUP BY collection, page_id) "


def _page_use(spark, sf_dir):
    return X.nodes(spark, sf_dir).groupBy("collection", "page_id").agg(F.coalesce(F.max("product"), F.lit("")).alias("product"), F.coalesce(F.max("sub_product"), F.lit("None")).alias("sub_product"), F.count(F.lit(1)).alias("count"))


@query(PAGE_USE + _table_sql([("product", "Product", 30), ("sub_product", "Sub Product", 30), ("page_id", "Page ID", 70), ("CAST(count AS VARCHAR)", "Count", 15)], "page_id", "r", ["'Total new Usage Example Counts by Page in Collection ' || collection"], ["'Total new usage example counts in collection ' || collection || ': ' || CAST(sum(count) AS BIGINT)"], "collection"))
def console_page_usage(spark, sf_dir):
    return reports.page_usage_tables(_page_use(spark, sf_dir), "Usage Example")


@query(PAGE_USE + ", q AS (SELECT product, sum(count) AS pc FROM r GROUP BY 1), s AS (SELECT product, sub_product, pc, sum(count) AS count FROM r JOIN q USING (product) GROUP BY ALL) " + _table_sql([("product", "Product", 30), ("CAST(CAST(pc AS BIGINT) AS VARCHAR)", "Count", 18), ("sub_product", "Sub-product", 25), ("CAST(CAST(count AS BIGINT) AS VARCHAR)", "Count", 18)], "product, sub_product = 'None', sub_product", "s", below=["'Total: ' || CAST(sum(count) AS BIGINT)"]))
def console_products(spark, sf_dir):
    rows = _page_use(spark, sf_dir)
    products = rows.groupBy("product").agg(F.sum("count").alias("product_count"))
    return reports.product_table(rows.groupBy("product", "sub_product").agg(F.sum("count").alias("count")).join(products, "product"))


@query(NODES + ", p AS (SELECT collection, page_id, sum(CASE WHEN instances_on_page > 0 THEN instances_on_page ELSE 1 END) AS total, count(*) FILTER (coalesce(is_removed, false) = false) AS n FROM nodes GROUP BY ALL), r AS (SELECT collection, page_id FROM p WHERE total <> n) " + _table_sql([("page_id", "Page Ids", 70)], "page_id", "r", ["'Pages with Node/Lang array count mismatch in Collection ' || collection"], group="collection"))
def console_mismatches(spark, sf_dir):
    return reports.mismatch_tables(catalog.language_mismatch(X.pages(spark, sf_dir)).select("collection", "page_id"))


# --- texts and listings --------------------------------------------------------------------------------------------


@query("WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, list_transform(l, lambda x: CASE WHEN trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '' THEN '' ELSE x END) AS s, list_transform(l, lambda x: CASE WHEN trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '' THEN '' WHEN length(x) < 3 THEN chr(9) || x ELSE substr(x, 4) END) AS t FROM d) SELECT doc_id, sha256(array_to_string(s, chr(10))) AS spaces, sha256(array_to_string(t, chr(10))) AS tabs FROM b WHERE len(list_filter(s, lambda x: x <> '')) > 0")
def dedented(spark, sf_dir):
    """Documents indented by blanks and by a tab that counts for four places, and dedented again."""
    lines = F.split("text", "\n")
    set_in = lambda by: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(by), x)), "\n")
    h = lambda c: F.sha2(c.cast("binary"), 256)
    some = F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) != ""
    return X.table(spark, sf_dir, "documents").where(some).select("doc_id", h(S.dedent(set_in("  \t "))).alias("spaces"), h(S.dedent(set_in("\t"), tab=4)).alias("tabs"))


@query("SELECT 'go/' || (p_partkey % 5) AS path, 'example.org/m' || p_partkey AS name, 'v1.' || (p_partkey % 3) || '.0' AS current, 'v1.1.' || (p_partkey % 2) AS latest, CASE WHEN p_partkey % 3 <> 1 THEN 'minor' WHEN p_partkey % 2 = 1 THEN 'patch' ELSE 'none' END AS update_type FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 UNION ALL SELECT 'net/' || (p_partkey % 5), 'Pkg.' || p_partkey, '2.0.' || (p_partkey % 4), '3.0.0', 'major' FROM part WHERE p_partkey % 4 <> 0")
def listed_updates(spark, sf_dir):
    """Two tools' lists of newer versions; of the first one, direct dependencies only."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    part = X.table(spark, sf_dir, "part").withColumn("g", (k % 5).cast("string"))
    go = F.concat(F.lit("example.org/m"), text, F.lit(" v1."), (k % 3).cast("string"), F.lit(".0"), F.when(k % 4 != 0, F.concat(F.lit(" [v1.1."), (k % 2).cast("string"), F.lit("]"))).otherwise(""))
    net = F.when(k % 4 != 0, F.concat(F.lit("   > Pkg."), text, F.lit("    2.*    2.0."), (k % 4).cast("string"), F.lit("    3.0.0"))).otherwise(F.concat(F.lit("Project `p"), text, F.lit("` has updates")))
    listing = lambda kind, line: part.groupBy(F.concat(F.lit(kind), "g").alias("path")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    direct = part.where(k % 7 != 0).select(F.concat(F.lit("go/"), "g").alias("path"), F.concat(F.lit("example.org/m"), text).alias("name"))
    return deps.listed_updates(listing("go/", go), "go", direct).unionByName(deps.listed_updates(listing("net/", net), "dotnet"))


TREES = "WITH f AS (SELECT 'p' || (doc_id // 4) AS path, ['manual', 'v1', 'v2', 'v3'][doc_id % 4 + 1] AS version, text FROM documents WHERE doc_id % 13 <> 5), g AS (SELECT DISTINCT path, unnest(['manual', 'v1', 'v2', 'v3']) AS version FROM f), s AS (SELECT g.path, g.version, CASE WHEN f.text IS NULL THEN 'not found' WHEN b.text IS NULL THEN 'no base' WHEN f.text = b.text THEN 'matches' ELSE 'differs' END AS status FROM g LEFT JOIN f USING (path, version) LEFT JOIN f b ON b.path = g.path AND b.version = 'manual')"


def _compared(spark, sf_dir):
    k = F.col("doc_id")
    names = F.array(*[F.lit(v) for v in ("manual", "v1", "v2", "v3")])
    files = X.table(spark, sf_dir, "documents").where(k % 13 != 5).select(F.concat(F.lit("p"), F.floor(k / 4).cast("string")).alias("path"), F.element_at(names, (k % 4 + 1).cast("int")).alias("version"), F.col("text").alias("content"))
    return paths.compare_trees(files, ["manual", "v1", "v2", "v3"], "manual")


@query(TREES + " SELECT path, version, status FROM s")
def compared_trees(spark, sf_dir):
    """Every four documents as one file in four versions, against the first; some are missing."""
    return _compared(spark, sf_dir)


@query(TREES + " SELECT count(*) FILTER (status = 'matches') AS matches, count(*) FILTER (status = 'differs') AS differs, count(*) FILTER (status = 'not found') AS not_found FROM s")
def compared_tree_totals(spark, sf_dir):
    return paths.comparison_totals(_compared(spark, sf_dir))


@query("WITH n AS (SELECT 'r' || (o_orderkey % 3) AS repo, 'out/' || o_orderkey AS target, (row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY 'out/' || o_orderkey) - 1) // 100 AS c FROM orders) SELECT repo, CAST(c AS BIGINT) AS commit, CAST(count(*) AS BIGINT) AS files, string_agg(target, ',' ORDER BY target) AS targets FROM n GROUP BY ALL")
def upload_commits(spark, sf_dir):
    """Upload queues of any size, in commits of a hundred files."""
    k = F.col("o_orderkey").cast("string")
    rows = X.table(spark, sf_dir, "orders").select(F.concat(F.lit("out/"), k).alias("target"), F.concat(F.lit("r"), (F.col("o_orderkey") % 3).cast("string")).alias("repo"))
    return paths.upload_commits(rows, "repo", most=100).withColumn("targets", F.array_join("targets", ","))


@query("SELECT count(*) FILTER (o_orderpriority LIKE '1%') AS count FROM orders")
def changed_under(spark, sf_dir):
    files = X.table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"))
    return events.changed_under(files, "1")


# --- readers and sinks ---------------------------------------------------------------------------------------------


@query("SELECT 'p' || doc_id AS page_id, doc_id % 7 = 0 AS deleted FROM documents WHERE doc_id % 5 <> 0")
def page_lines_source(spark, sf_dir):
    """Page lines written as files and read by the page_lines source, in stretches of a few lines."""
    folder = _folder(spark, "lines")
    _page_lines(spark, sf_dir).select("value").write.text(folder)
    lines_source.register(spark)
    found = spark.read.format("page_lines").option("split_bytes", 200_000).load(folder).where("type = 'page'")
    return found.select(F.get_json_object("data", "$.page_id").alias("page_id"), F.get_json_object("data", "$.deleted").cast("boolean").alias("deleted"))


@query("SELECT 'n' || n_nationkey AS project, CASE WHEN n_nationkey % 3 = 0 THEN 'main' ELSE 'v' || n_nationkey END AS version, 'http://x/n' || n_nationkey || '/v' || n_nationkey AS url FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey <> 7")
def projects(spark, sf_dir):
    """Project lists as a service answers them, a file each."""
    k, text, folder = F.col("n_nationkey"), F.col("n_nationkey").cast("string"), _folder(spark, "projects")
    branch = lambda active, name: F.struct(F.lit(name).alias("gitBranchName"), active.alias("active"), F.concat(F.lit("http://x/n"), text, F.lit("/v"), text, F.lit("/")).alias("fullUrl"), F.lit(True).alias("isStableBranch"))
    branches = F.when(k % 3 == 0, F.array(branch(k % 5 != 0, "m"))).otherwise(F.array(branch(F.lit(False), "old"), branch(k % 5 != 0, "new")))
    project = F.struct(F.concat(F.lit("n"), text).alias("project"), F.lit("r").alias("repoName"), branches.alias("branches"))
    sinks.write_files(X.table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), text, F.lit(".json")).alias("path"), F.to_json(F.struct(F.array(project).alias("data"))).alias("content")), folder)
    return readers.projects(spark, folder, ["n7"])


@query("SELECT 'd' || (p_partkey % 3) || '/f' || p_partkey || '.rst' AS path, p_name AS content FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'd' || (p_partkey % 3) || '/f' || p_partkey || '.MD', p_name FROM part WHERE p_partkey % 4 = 1")
def file_tree(spark, sf_dir):
    """Files written to a tree and read back, but for those of other kinds."""
    k, folder = F.col("p_partkey"), _folder(spark, "tree")
    name = F.concat(F.lit("d"), (k % 3).cast("string"), F.lit("/f"), k.cast("string"), F.when(k % 2 == 0, ".rst").when(k % 4 == 1, ".MD").otherwise(".png"))
    sinks.write_files(X.table(spark, sf_dir, "part").select(name.alias("path"), F.col("p_name").alias("content")), folder)
    return readers.file_tree(spark, folder)


@query("SELECT 'f' || o_orderkey AS path, CASE o_orderkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS status, CAST(o_orderkey % 10 AS INTEGER) AS additions, CAST(o_orderkey % 4 AS INTEGER) AS deletions FROM orders")
def changed_files(spark, sf_dir):
    """Pages of answers on a pull request's files, twenty files a page."""
    k, folder = F.col("o_orderkey"), _folder(spark, "answers")
    node = F.struct(F.struct(F.concat(F.lit("f"), k.cast("string")).alias("path"), F.when(k % 3 == 0, "ADDED").when(k % 3 == 1, "DELETED").otherwise("MODIFIED").alias("changeType"), (k % 10).cast("int").alias("additions"), (k % 4).cast("int").alias("deletions")).alias("node"))
    pages = X.table(spark, sf_dir, "orders").groupBy(F.floor(k / 20).alias("page")).agg(F.collect_list(node).alias("edges"))
    wrapped = F.struct(F.struct(F.struct(F.struct(F.col("edges")).alias("files")).alias("pullRequest")).alias("repository"))
    pages.select(F.to_json(F.struct(wrapped.alias("data"))).alias("value")).write.text(folder)
    return readers.changed_files(spark, folder)


@query("SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, 'r' || (o_custkey % 5) AS repo, CAST(sum(o_orderkey % 10) AS BIGINT) AS views, CAST(count(*) AS BIGINT) AS sources FROM orders GROUP BY ALL")
def repo_metrics(spark, sf_dir):
    """Metrics of repositories as JSON rows: views by day, and how many sources they came from."""
    k, folder = F.col("o_orderkey"), _folder(spark, "metrics")
    source = F.array(F.struct(F.lit("s").alias("name"), (k % 10).alias("count"), F.lit(1).alias("uniques")))
    rows = X.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.lit("o").alias("owner"), F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string")).alias("repo"), (k % 10).alias("viewCount"), source.alias("referralSources"))
    rows.write.json(folder)
    found = readers.repo_metrics(spark, folder)
    return found.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"), "repo").agg(F.sum("viewCount").alias("views"), F.sum(F.size("referralSources")).alias("sources"))


@query("SELECT 'backup_2025-01-0' || (r_regionkey + 1) AS backup, CAST(r_regionkey + 1 AS INTEGER) AS version, CAST(count(*) AS BIGINT) AS count FROM region JOIN nation ON n_regionkey <= r_regionkey WHERE r_regionkey >= 2 GROUP BY ALL")
def rotated_backups(spark, sf_dir):
    """A version and a backup a day, five days, of which the last three are kept; each is read through its backup."""
    nation, store = X.table(spark, sf_dir, "nation"), snapshots.Store(spark, _folder(spark, "backups"))
    for day in range(5):
        store.publish({"nation": nation.where(F.col("n_regionkey") <= day)})
        left = store.backup(f"2025-01-0{day + 1}", 3)
    out = None
    for name in left:
        n = store.read("nation", name).agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("backup"), F.lit(store.manifest(name)["number"]).alias("version"), "count")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT l_returnflag, CAST(2 * count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1")
def appended_rows(spark, sf_dir):
    """Rows appended twice to a table in parts."""
    folder, rows = _folder(spark, "appended"), X.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey")
    sinks.append(rows, folder, "l_returnflag")
    sinks.append(rows, folder, "l_returnflag")
    return spark.read.schema(rows.schema).parquet(folder).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("count"))


@query("WITH " + X.cte("audit", X.AUDIT, "events") + " SELECT rule_name, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (coalesce(success, false)) AS BIGINT) AS succeeded, CAST(count(*) FILTER (NOT coalesce(success, false)) AS BIGINT) AS failed FROM audit WHERE event_type = 'copy' GROUP BY 1")
def streamed_stats(spark, sf_dir):
    """Running totals by rule of a stream over files of events, as they stand when it has read all."""
    folder = _folder(spark, "stream")
    rows = X.audit(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(4).write.parquet(f"{folder}/in")
    stream = audit.stats_by_rule(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in"))
    put = lambda df, n: df.write.parquet(f"{folder}/out/batch={n}")
    run = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    totals = spark.read.parquet(f"{folder}/out")
    return totals.where(F.col("batch") == totals.agg(F.max("batch")).first()[0]).drop("batch")
