"""Scalar functions and small dimension joins as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions import scalars as S
from pagequarry.functions import vocabulary as V
from pagequarry.operators import catalog, deps, ingest, paths, updates
from pagequarry.plans import fixtures as X
from pagequarry.plans.registry import query
from pagequarry.sources import sinks

IDS = "SELECT o_orderkey AS k, 'proj/docs/v' || (o_orderkey % 3) || '/a' || (o_orderkey % 5) || '/b' || o_orderkey AS id FROM orders"


@query(f"WITH s AS ({IDS}) SELECT k, 'a' || (k % 5) || '|b' || k AS page_key, 'http://x.y/z/a' || (k % 5) || '/b' || k AS page_url, 'http://x.y/a' || (k % 5) || '/b' || k AS key_url, 'b' || k AS last FROM s")
def page_ids(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("'proj/docs/v' || (o_orderkey % 3) || '/a' || (o_orderkey % 5) || '/b' || o_orderkey").alias("id"))
    i = F.col("id")
    return rows.select("k", S.page_key(i).alias("page_key"), S.page_url(i, F.lit("http://x.y/z/")).alias("page_url"), S.key_url(S.page_key(i), F.lit("http://x.y")).alias("key_url"), S.last_segment(F.concat(i, F.lit("/"))).alias("last"))


@query("SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12288)) AS trimmed, sha256(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12288))) AS hash FROM documents")
def code_hashes(spark, sf_dir):
    padded = F.concat(F.lit("　\n\t "), F.col("text"), F.lit(" 　\r\n"))
    return X.table(spark, sf_dir, "documents").select("doc_id", S.trim_space(padded).alias("trimmed"), S.code_hash(padded).alias("hash"))


#: raw spelling, in a catalogue, its extension there, in a source tree, its extension there, bucket
SPELLINGS = [
    ("js", "javascript", ".js", "javascript", ".js", ""), ("", "undefined", ".txt", "undefined", ".txt", ""), ("JS", "undefined", ".txt", "javascript", ".js", ""), ("golang", "go", ".go", "go", ".go", ""),
    ("python", "python", ".py", "python", ".py", "drivers-minus-js"), ("cs", "csharp", ".cs", "csharp", ".cs", ""), ("console", "shell", ".sh", "console", ".sh", ""), ("ini", "text", ".txt", "ini", ".txt", ""),
    ("c++", "undefined", ".txt", "cpp", ".cpp", ""), ("yaml", "yaml", ".yaml", "yaml", ".txt", "json-like"), ("bash", "bash", ".sh", "bash", ".sh", "shell"), ("none", "undefined", ".txt", "undefined", ".txt", ""),
    ("ps1", "undefined", ".txt", "powershell", ".ps1", ""), ("http", "text", ".txt", "http", ".txt", ""), ("javascript", "javascript", ".js", "javascript", ".js", "javascript"), ("undefined", "undefined", ".txt", "undefined", ".txt", "undefined"),
]
LISTED = ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in row) + ")" for i, row in enumerate(SPELLINGS))


@query(f"WITH v(i, raw, catalogue, catalogue_ext, tree, tree_ext, bucket) AS (VALUES {LISTED}) SELECT event_id, v.* EXCLUDE (i) FROM events JOIN v ON event_id % {len(SPELLINGS)} = i")
def language_spellings(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(r[0]) for r in SPELLINGS]), (F.col("event_id") % len(SPELLINGS)).cast("int"))
    rows = X.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    r = F.col("raw")
    return rows.select("event_id", "raw", S.catalogue_language(r).alias("catalogue"), S.catalogue_extension(r).alias("catalogue_ext"), S.tree_language(r).alias("tree"), S.tree_extension(r).alias("tree_ext"), S.language_bucket(r).alias("bucket"))


@query("""WITH s AS (SELECT event_id, event_id % 3 AS o, event_id % 4 AS c, event_id % 5 AS p FROM events),
l AS (SELECT event_id, CASE o WHEN 0 THEN 'go' WHEN 1 THEN NULL END AS opt, CASE c WHEN 0 THEN 'java' WHEN 1 THEN 'ruby' END AS child, CASE p WHEN 0 THEN 'python' WHEN 1 THEN 'shell' WHEN 2 THEN 'cpp' END AS file FROM s)
SELECT event_id, coalesce(file, 'undefined') AS of_path, coalesce(opt, file, child, 'undefined') AS of_include, coalesce(opt, child, file, 'undefined') AS of_io FROM l""")
def block_languages(spark, sf_dir):
    e = F.col("event_id")
    option = F.when(e % 3 == 0, "golang").when(e % 3 == 1, "")
    child = F.when(e % 4 == 0, "java").when(e % 4 == 1, "ruby")
    path = F.when(e % 5 == 0, "/includes/a.py").when(e % 5 == 1, "x.sh").when(e % 5 == 2, "d.d/y.cpp").otherwise("z")
    return X.table(spark, sf_dir, "events").select("event_id", S.language_of_path(path).alias("of_path"), S.include_language(option, path, child).alias("of_include"), S.io_language(option, child, path).alias("of_io"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-' || (p_partkey % 7) AS slug, 'f' || p_partkey || '.code-block.' || (p_size) || CASE WHEN p_partkey % 2 = 0 THEN '.input.py' ELSE '.txt' END AS file, sha256(p_name || '|A|x|B|y') AS hash FROM part")
def output_names(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    path, sub, language = F.concat(F.lit("content/p/source/f"), k.cast("string"), F.lit(".txt")), F.when(k % 2 == 0, "input").otherwise(""), F.when(k % 2 == 0, "py").otherwise("")
    title = F.concat(F.initcap("p_name"), F.lit(" / _ "), (k % 7).cast("string"), F.lit("!"))
    steps = F.array(F.struct(F.lit("A").alias("title"), F.lit("x").alias("content")), F.struct(F.lit("B").alias("title"), F.lit("y").alias("content")))
    return part.select("p_partkey", S.slug(title).alias("slug"), S.output_name(path, F.lit("code-block"), F.col("p_size"), sub, language).alias("file"), S.procedure_hash(F.col("p_name"), steps).alias("hash"))


WORDINGS = ["A syntax example", "Usage of it", "what it returns", "some configuration", "other command", "nothing", ""]


@query("""WITH s AS (SELECT event_id, event_id % 7 AS w, event_id % 3 AS c, event_id % 2 AS m FROM events), a AS (SELECT *, CASE w WHEN 0 THEN 'Syntax example' WHEN 1 THEN 'Usage example' WHEN 2 THEN 'Example return object' WHEN 3 THEN 'Example configuration object' WHEN 4 THEN 'Other command' ELSE '' END AS author, CASE c WHEN 0 THEN 'Other command' WHEN 1 THEN 'Usage example' ELSE 'Uncategorized' END AS ruled FROM s)
SELECT event_id, author, ruled, CASE WHEN author <> '' THEN author WHEN ruled <> 'Uncategorized' THEN ruled WHEN m = 0 THEN 'Syntax example' ELSE 'Uncategorized' END AS category, author = '' AND ruled = 'Uncategorized' AS by_model FROM a""")
def assigned_categories(spark, sf_dir):
    """Author's wording, rules, then what a model said, in that order."""
    e = F.col("event_id")
    wording = F.get(F.array(*[F.lit(x) for x in WORDINGS]), (e % 7).cast("int"))
    code, model = F.when(e % 3 == 0, "npm install x").when(e % 3 == 1, "import x").otherwise("zzz"), F.when(e % 2 == 0, V.SYNTAX).otherwise("nonsense")
    decided = S.assigned_category(code, F.lit("text"), wording, model)
    return X.table(spark, sf_dir, "events").select("event_id", S.author_category(wording).alias("author"), S.rule_category(code, F.lit("text")).alias("ruled"), decided.alias("d")).select("event_id", "author", "ruled", "d.category", "d.by_model")


@query("SELECT p_partkey, 'a,b' || (p_partkey % 3) || ',c d' AS keywords, CASE WHEN p_partkey % 4 = 0 THEN 'Search' WHEN p_partkey % 4 = 1 THEN 'Streams' END AS sub_product, CASE WHEN p_partkey % 3 = 0 THEN 'Vectors' WHEN p_partkey % 2 = 0 THEN 'own' END AS area FROM part")
def url_dimensions(spark, sf_dir):
    k = F.col("p_partkey")
    url = F.when(k % 4 == 0, "http://x/docs/Atlas-Search/a").when(k % 4 == 1, "http://x/atlas-search/streams/b").otherwise("http://x/other")
    dirs = [("atlas-search", "Search"), ("/streams/", "Streams")]
    meta = F.concat(F.lit(" a , b"), (k % 3).cast("string"), F.lit(",\tc d"))
    area = S.focus_area(F.when(k % 3 == 0, "x|vector|y").otherwise("x"), F.when(k % 2 == 0, "own"), [("vector", "Vectors")])
    return X.table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.keywords(meta), ",").alias("keywords"), S.sub_product_of_url(url, dirs, ignore_case=True).alias("sub_product"), area.alias("area"))


# --- updates -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS page_id, CASE WHEN p_size % 3 = 0 THEN 'renamed' ELSE 'c' || (p_size % 3) END AS collection, CASE WHEN p_size % 3 = 0 THEN 'renamed' ELSE 'c' || (p_size % 3) END AS project_name, CASE WHEN p_partkey % 2 = 0 THEN 'Usage example' ELSE 'other' END AS category FROM part")
def renamed_values(spark, sf_dir):
    """A project's name, then a value within the nodes of its pages, and a field."""
    size = F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string"))
    node = F.struct(F.when(F.col("p_partkey") % 2 == 0, "Task-based usage").otherwise("other").alias("kind"))
    pages = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), size.alias("collection"), size.alias("project_name"), F.array(node).alias("nodes"))
    named = updates.rename_field(updates.change_project_name(pages, "c0", "renamed"), "page", "page_id")
    return updates.rename_value(named, "Task-based usage", "Usage example", "kind").select("page_id", "collection", "project_name", F.get("nodes", F.lit(0))["kind"].alias("category"))


SUMMARIES = "(SELECT n_name AS collection, 'v' || (n_nationkey % 3) AS version, CAST(n_nationkey AS BIGINT) AS pages, n_nationkey % 2 AS kind FROM nation)"


@query(f"WITH s AS {SUMMARIES}, o AS (SELECT * FROM s WHERE pages % 4 <> 0), i AS (SELECT collection, CASE WHEN kind = 0 THEN version ELSE 'v9' END AS version, pages + 100 AS pages FROM s WHERE pages % 4 <> 1), u AS (SELECT collection, version, pages FROM i UNION ALL SELECT o.collection, o.version, o.pages FROM o WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.collection = o.collection AND i.version = o.version)) SELECT * FROM u")
def upserted_summaries(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    info = lambda pages: F.struct(pages.alias("total_page_count"), F.lit(0).cast("long").alias("total_code_count"), F.lit("2025-01-01").cast("timestamp").alias("last_updated_at_utc"))
    version = F.concat(F.lit("v"), (n % 3).cast("string"))
    rows = X.table(spark, sf_dir, "nation")
    old = rows.where(n % 4 != 0).select(F.col("n_name").alias("collection"), F.create_map(version, info(n)).alias("version"))
    new = rows.where(n % 4 != 1).select(F.col("n_name").alias("collection"), F.create_map(F.when(n % 2 == 0, version).otherwise("v9"), info(n + 100)).alias("version"))
    return updates.upsert_summary(old, new).select("collection", F.explode("version").alias("version", "s")).select("collection", "version", F.col("s.total_page_count").alias("pages"))


@query("SELECT n_regionkey AS collection, 'v' || arg_max(n_nationkey, (n_nationkey % 7, 'v' || n_nationkey)) AS latest_version FROM nation GROUP BY 1")
def latest_versions(spark, sf_dir):
    n = F.col("n_nationkey")
    day = F.date_add(F.lit("2025-01-01").cast("date"), (n % 7).cast("int")).cast("timestamp")
    info = F.struct(F.lit(0).alias("total_page_count"), day.alias("last_updated_at_utc"))
    rows = X.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("collection")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("v"), n.cast("string")), info))).alias("version"))
    return catalog.latest_version(rows)


@query("SELECT 'pg' || p_partkey AS page_id, unnest(['en', 'de']) AS language, CAST(0 AS BIGINT) AS total FROM part")
def empty_languages(spark, sf_dir):
    """Pages without code, as they are stored: every language with zeros."""
    pages = X.table(spark, sf_dir, "part").select(F.concat(F.lit("pg"), F.col("p_partkey").cast("string")).alias("page_id"), F.explode(ingest.empty_languages(["en", "de"])).alias("m"))
    return pages.select("page_id", F.explode("m").alias("language", "s")).select("page_id", "language", F.col("s.total").alias("total"))


# --- paths ---------------------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'python' WHEN doc_id % 3 = 1 THEN 'shell' ELSE 'undefined' END AS language, CAST(count(*) AS BIGINT) AS scanned, CAST(count(*) FILTER (contains(lower(text), 'que des')) AS BIGINT) AS containing FROM documents GROUP BY 1 UNION ALL SELECT NULL, count(*), count(*) FILTER (contains(lower(text), 'que des')) FROM documents")
def search_report(spark, sf_dir):
    k = F.col("doc_id")
    files = X.table(spark, sf_dir, "documents").select(F.concat(F.lit("a/"), k.cast("string"), F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".sh").otherwise(".zzz")).alias("path"), F.col("text").alias("content"))
    return paths.search_report(paths.search(files, "que des", whole=False))


@query("SELECT 'p' || (o_orderkey % 7) AS project, CASE WHEN o_orderkey % 7 < 6 THEN 'current' END AS version, CAST(count(*) AS BIGINT) AS count FROM orders WHERE (o_orderkey % 7 = 6 OR o_orderkey % 3 = 0) AND o_orderkey % 5 <> 0 GROUP BY ALL")
def current_pages(spark, sf_dir):
    """Six projects have versions and keep the current one; the seventh has none and is counted whole. Excluded folders are left out."""
    tree = "concat('content/p', o_orderkey % 7, CASE WHEN o_orderkey % 7 = 6 THEN '' WHEN o_orderkey % 3 = 0 THEN '/current' ELSE '/v' || (o_orderkey % 4) END, '/source/', CASE WHEN o_orderkey % 5 = 0 THEN 'drafts/' ELSE '' END, 'page', o_orderkey, '.txt')"
    files = X.table(spark, sf_dir, "orders").select(F.expr(tree).alias("path"))
    kept = paths.counted_pages(files, exclude_dirs=["drafts"], current_only=True)
    return kept.groupBy("project", "version").agg(F.count(F.lit(1)).alias("count"))


@query("SELECT 'r' || (o_orderkey % 3) AS repo, CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE 'dev' END AS branch, CAST(count(*) AS BIGINT) AS files, string_agg('out/' || o_orderkey, ',' ORDER BY 'out/' || o_orderkey) AS targets FROM orders GROUP BY ALL")
def upload_queues(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = X.table(spark, sf_dir, "orders").select(F.concat(F.lit("out/"), k.cast("string")).alias("target"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("repo"), F.when(k % 2 == 0, "main").otherwise("dev").alias("branch"))
    return paths.uploads(rows, "repo", "branch").withColumn("targets", F.array_join("targets", ","))


@query("SELECT 'f' || p_partkey AS filename, 'r' AS repo, 'main' AS branch, CASE WHEN p_partkey % 3 = 0 THEN '2025-01-01' ELSE '2025-02-02' END AS deleted_on FROM part WHERE p_partkey % 3 < 2")
def deprecation_list(spark, sf_dir):
    k = F.col("p_partkey")
    rows = X.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), k.cast("string")).alias("target"), F.lit("r").alias("repo"), F.lit("main").alias("branch"), k.alias("k"))
    known = rows.where(F.col("k") % 3 == 0).select(F.col("target").alias("filename"), "repo", "branch", F.lit("2025-01-01").alias("deleted_on"))
    return paths.deprecations(known, rows.where(F.col("k") % 3 == 1), F.lit("2025-02-02"))


@query("SELECT p_partkey, 'lib/f' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 4 <> 1 AND p_partkey % 10 <> 3")
def paths_not_excluded(spark, sf_dir):
    k = F.col("p_partkey")
    rows = X.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(k % 4 == 1, "lib/gen/x/f").otherwise("lib/f"), k.cast("string"), F.lit(".py")).alias("path"))
    return paths.without_excluded(rows, ["lib/gen/**", "lib/f*3.py"], "path")


@query("WITH v(version, m) AS (VALUES ('v1', 2), ('v2', 3), ('v3', 0)) SELECT version, CASE WHEN m = 0 THEN 'not found' WHEN m = 2 THEN 'matches' ELSE 'differs' END AS status FROM v UNION ALL SELECT 'manual', 'matches'")
def version_statuses(spark, sf_dir):
    one = X.table(spark, sf_dir, "documents").where("doc_id IN (1, 2, 3)")
    which = F.when(F.col("doc_id") == 1, F.array(F.lit("manual"), F.lit("v1"))).when(F.col("doc_id") == 2, F.array(F.lit("v2"))).otherwise(F.array().cast("array<string>"))
    files = one.select(F.explode(which).alias("v"), "doc_id").select(F.concat(F.lit("p/"), "v", F.lit("/source/a.rst")).alias("path"), F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("content"))
    return paths.compare_versions(files, "p/{version}/source/a.rst", ["manual", "v1", "v2", "v3"], "manual")


@query("SELECT CAST(2 AS BIGINT) AS matches, CAST(1 AS BIGINT) AS differs, CAST(1 AS BIGINT) AS not_found")
def version_totals(spark, sf_dir):
    return paths.comparison_totals(version_statuses(spark, sf_dir))


# --- dependencies --------------------------------------------------------------------------------------------------

MANIFESTS = "SELECT p_partkey AS k, p_size AS a, p_partkey % 10 AS b FROM part"


@query(f"WITH s AS ({MANIFESTS}) SELECT 'd' || k AS path, 'x' || b AS name, a || '.0.' || b AS version, false AS is_dev FROM s UNION ALL SELECT 'd' || k, 'y', '1.' || b || '.0', true FROM s")
def npm_dependencies(spark, sf_dir):
    return deps.npm_dependencies(_manifests(spark, sf_dir, '{"dependencies": {"x%d": "^%d.0.%d"}, "devDependencies": {"y": "~1.%d.0"}}', "b", "a", "b", "b"))


@query(f"WITH s AS ({MANIFESTS}) SELECT 'd' || k AS path, 'x' || b AS name, a || '.0' AS version FROM s UNION ALL SELECT 'd' || k, 'y-z', NULL FROM s")
def pip_requirements(spark, sf_dir):
    return deps.pip_requirements(_manifests(spark, sf_dir, "# all\nx%d>=%d.0,<99\n-r other.txt\n\ny-z[extra]\n", "b", "a"))


@query(f"WITH s AS ({MANIFESTS}) SELECT 'd' || k AS path, 'ex.com/x' || b AS name, 'v' || a || '.1.0' AS version, true AS is_direct FROM s UNION ALL SELECT 'd' || k, 'ex.com/y', 'v0.' || b || '.0', false FROM s")
def go_requirements(spark, sf_dir):
    return deps.go_requirements(_manifests(spark, sf_dir, "module m\n\nrequire (\n\tex.com/x%d v%d.1.0\n\tex.com/y v0.%d.0 // indirect\n)\n", "b", "a", "b"))


@query(f"WITH s AS ({MANIFESTS}) SELECT 'd' || k AS path, 'org.g:x' || b AS name, a || '.2' AS version FROM s")
def maven_dependencies(spark, sf_dir):
    return deps.maven_dependencies(_manifests(spark, sf_dir, "<project><dependency>\n<groupId>org.g</groupId>\n<artifactId>x%d</artifactId><version> %d.2 </version></dependency></project>", "b", "a"))


@query(f"WITH s AS ({MANIFESTS}) SELECT 'd' || k AS path, 'X.Y' || b AS name, a || '.3.0' AS version FROM s")
def nuget_references(spark, sf_dir):
    return deps.nuget_references(_manifests(spark, sf_dir, '<ItemGroup><PackageReference Include="X.Y%d" Version="%d.3.0" /></ItemGroup>', "b", "a"))


def _manifests(spark, sf_dir, template, *columns):
    rows = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("a"), (F.col("p_partkey") % 10).alias("b"))
    return rows.select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("path"), F.format_string(template, *columns).alias("content"))


@query("WITH s AS (SELECT 'n' || p_partkey AS name, '1.' || (p_partkey % 4) || '.0' AS current, '1.' || (p_partkey % 3) || '.' || (p_partkey % 2) AS latest, p_partkey AS k FROM part) SELECT name, current, latest, CASE WHEN k % 4 <> k % 3 THEN 'minor' ELSE 'patch' END AS update_type FROM s WHERE current <> latest AND k % 5 = 0")
def direct_updates(spark, sf_dir):
    k = F.col("p_partkey")
    rows = X.table(spark, sf_dir, "part").select(F.concat(F.lit("n"), k.cast("string")).alias("name"), k.alias("k"))
    version = lambda a, b: F.concat_ws(".", F.lit("1"), (F.col("k") % a).cast("string"), b)
    current = rows.select("name", version(4, F.lit("0")).alias("current"))
    latest = rows.select("name", version(3, (F.col("k") % 2).cast("string")).alias("latest"))
    return deps.updates(current, latest, rows.where(F.col("k") % 5 == 0))


# --- sinks' rows ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN false ELSE event_id % 2 = 0 END AS success, '2025-03-01 00:00:00' AS stamped FROM events")
def appended_audit(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 2 == 0).alias("success"))
    return sinks.audit_row(rows, F.lit("2025-03-01").cast("timestamp")).select("event_id", "success", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamped"))
