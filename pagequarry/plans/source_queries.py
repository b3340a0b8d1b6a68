"""Readers' parsing as queries: page lines, run logs, lines of files, authors, stored answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import ingest
from pagequarry.plans import fixtures as X
from pagequarry.plans.registry import query
from pagequarry.sources import readers


def _page_lines(spark, sf_dir, page="doc_id"):
    """Lines of JSON (value) of each doc_id as a service sends them; every fifth is no page. page: its number."""
    k = F.col("doc_id")
    code = F.struct(F.lit("code").alias("type"), F.col("lang").alias("lang"), F.concat(F.lit(" "), "text").alias("value"))
    section = F.struct(F.lit("section").alias("type"), F.array(code).alias("children"))
    ast = F.concat(F.lit('{"type":"root","children":['), F.to_json(section), F.lit(","), F.to_json(code), F.lit("]}"))
    who = F.when(k % 3 == 0, '"bot"').when(k % 3 == 1, '"man"').otherwise("null")
    line = F.concat(F.lit('{"type":"'), F.when(k % 5 == 0, "asset").otherwise("page"), F.lit('","data":{"page_id":"p'), F.expr(page).cast("string"), F.lit('","github_username":'), who, F.lit(',"deleted":'), F.when(k % 7 == 0, "true").otherwise("false"), F.lit(',"ast":'), ast, F.lit("}}"))
    return X.table(spark, sf_dir, "documents").select("doc_id", line.alias("value"))


@query("SELECT 'p' || doc_id AS page_id, CASE doc_id % 3 WHEN 0 THEN 'bot' WHEN 1 THEN 'man' END AS github_username, doc_id % 7 = 0 AS deleted FROM documents WHERE doc_id % 5 <> 0")
def page_stream(spark, sf_dir):
    return readers.pages_of_lines(_page_lines(spark, sf_dir)).select("page_id", "github_username", "deleted")


@query("SELECT 'p' || doc_id AS page_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 = 1")
def pages_by_author(spark, sf_dir):
    """The first author of the list that has pages."""
    return readers.pages_by_author(readers.pages_of_lines(_page_lines(spark, sf_dir)), ["absent", "man", "bot"]).select("page_id")


@query("SELECT 'p' || doc_id AS page_id, sha256(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS sha_256_hash, CAST(2 AS BIGINT) AS n FROM documents WHERE doc_id % 5 <> 0")
def code_nodes_of_trees(spark, sf_dir):
    """Code nodes found at two depths of each page's tree, trimmed and hashed."""
    nodes = ingest.code_nodes(readers.pages_of_lines(_page_lines(spark, sf_dir)))
    return nodes.groupBy("page_id", "sha_256_hash").agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_no AS INTEGER) AS line_no, line FROM l")
def file_lines(spark, sf_dir):
    return readers.lines(X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@query("""WITH l AS (SELECT 'log' || (user_id % 3) AS path, event_id, CASE event_id % 10 WHEN 0 THEN 'P' || event_id END AS p, CASE event_id % 10 WHEN 1 THEN 'removed' WHEN 2 THEN 'examples_created' WHEN 3 THEN 'usage_added' END AS kind FROM events)
SELECT path, CAST(event_id AS INTEGER) AS line_no, last_value(p IGNORE NULLS) OVER (PARTITION BY path ORDER BY event_id) AS project, kind, 'x|' || event_id AS page_id, CASE WHEN kind <> 'removed' THEN event_id % 7 END AS count FROM l QUALIFY kind IS NOT NULL""")
def run_log(spark, sf_dir):
    e = F.col("event_id")
    n = e.cast("string")
    line = F.when(e % 10 == 0, F.concat(F.lit("Project changes for P"), n)).when(e % 10 == 1, F.concat(F.lit("Page removed: Page ID: x|"), n)).when(e % 10 == 2, F.concat(F.lit("Code example created: Page ID: x|"), n, F.lit(", "), (e % 7).cast("string"), F.lit(" new code examples added")))
    line = line.when(e % 10 == 3, F.concat(F.lit("Applied usage example added: Page ID: x|"), n, F.lit(", "), (e % 7).cast("string"), F.lit(" new"))).otherwise("noise")
    rows = X.table(spark, sf_dir, "events").select(F.concat(F.lit("log"), (F.col("user_id") % 3).cast("string")).alias("path"), e.cast("int").alias("line_no"), line.alias("line"))
    return readers.run_log(rows)


@query("SELECT 'v' || (n_nationkey % 2) AS version, CAST(n_nationkey AS BIGINT) AS total_page_count FROM nation WHERE n_nationkey = 6")
def summary_lookup(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    info = F.struct(n.alias("total_page_count"), n.alias("total_code_count"), F.lit("2025-01-01").cast("timestamp").alias("last_updated_at_utc"))
    rows = X.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("collection"), F.create_map(F.concat(F.lit("v"), (n % 2).cast("string")), info).alias("version"))
    return readers.summary_of(rows, "n6").select("version", "total_page_count")


@query("SELECT p_partkey AS page_id FROM part")
def page_keys(spark, sf_dir):
    return readers.page_keys(X.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "page_id"))
