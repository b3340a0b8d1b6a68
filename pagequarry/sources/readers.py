"""Readers: pages, summaries, file trees, page streams as JSON lines, project lists, run logs."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.operators.ranks import filled_forward, ranked, staged

LANGUAGE_COUNTS = "struct<literal_includes:bigint,io_code_block:bigint,total:bigint>"
NODE = "struct<code:string,language:string,file_extension:string,category:string,sha_256_hash:string,llm_categorized:boolean,date_added:timestamp,date_updated:timestamp,date_removed:timestamp,is_removed:boolean,instances_on_page:bigint>"
PAGES = f"collection string, page_id string, code_nodes_total bigint, io_code_blocks_total bigint, literal_includes_total bigint, date_added timestamp, date_last_updated timestamp, page_url string, project_name string, product string, sub_product string, keywords array<string>, date_removed timestamp, is_removed boolean, languages array<map<string,{LANGUAGE_COUNTS}>>, nodes array<{NODE}>"
SUMMARIES = "collection string, version map<string,struct<total_page_count:bigint,total_code_count:bigint,last_updated_at_utc:timestamp>>"


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARIES).parquet(path)


def page_keys(pages_: DataFrame) -> DataFrame:
    """Ids alone; the scan reads that column only."""
    return pages_.select("page_id")


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON lines {type, data}: page_id, github_username, deleted, and the tree as JSON text.

    Each line is parsed once. Lines of other types are passed over. A last line without a line end counts like any other.
    """
    return pages_of_lines(spark.read.text(path))


def pages_of_lines(lines_: DataFrame) -> DataFrame:
    """page_stream over lines (value)."""
    parsed = lines_.select(F.from_json("value", "type string, data struct<page_id:string,github_username:string,deleted:boolean,ast:string>").alias("j")).where("j.type = 'page'")
    return parsed.select("j.data.page_id", "j.data.github_username", F.coalesce("j.data.deleted", F.lit(False)).alias("deleted"), "j.data.ast")


def pages_by_author(pages_: DataFrame, order: list[str], scope: str | None = None) -> DataFrame:
    """Pages of the first author of `order` that has any; if none has, those of all others. scope: a column within which
    that is decided."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col("github_username") == name, i).otherwise(rank)
    keys = [scope] if scope else []
    ranked = pages_.withColumn("__rank", rank)
    least = ranked.groupBy(*keys).agg(F.min("__rank").alias("__least"))
    joined = ranked.join(F.broadcast(least), keys) if keys and least.limit(10_001).count() <= 10_000 else ranked.join(least, keys) if keys else ranked.join(F.broadcast(least))
    return joined.where("__rank = __least").drop("__rank", "__least")


def projects(spark: SparkSession, path: str, ignored: list[str]) -> DataFrame:
    """(project, version, url) of a project list: the first active and stable branch; its name is `main` if it is the only
    branch, else the last part of its URL. Ignored names and projects without such a branch are left out."""
    branch = "struct<gitBranchName:string,active:boolean,fullUrl:string,isStableBranch:boolean>"
    raw = spark.read.schema(f"data array<struct<project:string,repoName:string,branches:array<{branch}>>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("data").alias("p")).select("p.project", "p.branches").where(~F.col("project").isin(ignored))
    chosen = F.get(F.filter("branches", lambda b: b["active"] & b["isStableBranch"]), F.lit(0))
    rows = rows.withColumn("b", chosen).where(F.col("b").isNotNull())
    url = F.regexp_replace("b.fullUrl", "/$", "")
    return rows.select("project", F.when(F.size("branches") == 1, "main").otherwise(F.element_at(F.split(url, "/"), -1)).alias("version"), url.alias("url"))


#: Files read by a task, about, and files and bytes that are handed on at a time.
TASK_FILES, BATCH_FILES, BATCH_BYTES = 20_000, 1_000, 8_000_000


def _hidden(name: str, is_folder: bool) -> bool:
    """Names that Spark's readers pass over."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def _listed(level: DataFrame, base: str) -> DataFrame:
    """(path, is_folder) of what stands in the folders (path, relative to base) of level, by tasks, in batches."""

    def run(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                names, folders = [], []
                with os.scandir(f"{base}/{folder}") as entries:
                    for e in entries:
                        is_folder = e.is_dir()
                        if not _hidden(e.name, is_folder) and (is_folder or e.is_file()):
                            names.append(f"{folder}/{e.name}" if folder else e.name)
                            folders.append(is_folder)
                        if len(names) == BATCH_FILES:
                            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_())], ["path", "is_folder"])
                            names, folders = [], []
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_())], ["path", "is_folder"])

    return staged(level.repartition(level.sparkSession.sparkContext.defaultParallelism, "path").mapInArrow(run, "path string, is_folder boolean"))


def _contents(files: DataFrame, base: str) -> DataFrame:
    """(path, content as bytes) of files (path, relative to base)."""

    def run(batches):
        names, held, size = [], [], 0
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with open(f"{base}/{name}", "rb") as f:
                    held.append(f.read())
                names.append(name)
                size += len(held[-1])
                if size >= BATCH_BYTES or len(names) == BATCH_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["path", "content"])
                    names, held, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["path", "content"])

    return files.mapInArrow(run, "path string, content binary")


def _of_kind(path: Column, extensions: tuple[str, ...]) -> Column:
    keep = F.lit(not extensions)
    for e in extensions:
        keep = keep | F.lower(path).endswith(e)
    return keep


def file_tree(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".rst", ".txt", ".md"), recursive: bool = True) -> DataFrame:
    """(path, content) of text files below a folder, paths relative to it.

    A folder in a file system that all tasks have at the same place (file:) is listed by tasks, a level at a time, and only
    numbers of files reach the driver. Other stores go through Spark's own index, which holds every file in the driver and
    leaves empty ones out.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file" and fs.exists(at) and fs.getFileStatus(at).isDirectory():
        base = fs.makeQualified(at).toUri().getPath().rstrip("/")
        found, level = None, spark.createDataFrame([("",)], "path string")
        while found is None or recursive and level.limit(1).count():
            entries = _listed(level, base)
            files, level = entries.where("NOT is_folder").select("path"), entries.where("is_folder").select("path")
            found = files if found is None else found.unionByName(files)
        if recursive or not level.where("path LIKE '%=%'").limit(1).count():  # else folders are parts of a table
            found = found.where(_of_kind(F.concat(F.lit(f"{base}/"), "path"), extensions))
            tasks = max(spark.sparkContext.defaultParallelism, found.count() // TASK_FILES + 1)
            return _contents(found.repartition(tasks), base).select("path", F.decode("content", "UTF-8").alias("content"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*").load(path)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    return files.where(_of_kind(F.col("path"), extensions)).select(F.regexp_replace(F.col("path"), rf"^[a-z0-9]+:/*{root}/", "").alias("path"), F.decode("content", "UTF-8").alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no from 1, line) of files (path, content)."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 1, line) of text files of any size: splits are read by different tasks and numbered by ranges."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return ranked(rows, ["path"], ["block", "at"]).select("path", (F.col("rank") + 1).alias("line_no"), "line")


# Kinds of log lines by pattern; the first group is the page, the second a number if there is one.
LOG_LINES = {"removed": r"Page removed: Page ID: (\S+)", "new_page": r"Page created: Page ID: ([^,\s]+)", "examples_created": r"Code example created: Page ID: ([^,\s]+), (\d+)", "examples_removed": r"Code example removed: Page ID: ([^,\s]+), (\d+)", "usage_added": r"Applied usage example added: Page ID: ([^,\s]+), (\d+)"}
# Fixed value: the line that names the project of those after it.
LOG_PROJECT = r"Project changes for (.+)$"


def run_log(log_lines: DataFrame) -> DataFrame:
    """(path, line_no, project, kind, page_id, count) of a run's log: each line belongs to the project named last before it.

    Lines that say nothing are dropped first. The state runs along one file, but a file's lines spread over ranges, and only
    the last project of each range is carried on (`filled_forward`).
    """
    project = F.nullif(F.regexp_extract("line", LOG_PROJECT, 1), F.lit(""))
    kind, page, count = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, p in LOG_LINES.items():
        hit = F.rlike(F.col("line"), F.lit(p))
        kind = F.when(hit, k).otherwise(kind)
        page = F.when(hit, F.regexp_extract("line", p, 1)).otherwise(page)
        if r"(\d+)" in p:
            count = F.when(hit, F.regexp_extract("line", p, 2)).otherwise(count)
    rows = log_lines.select("path", "line_no", project.alias("project"), kind.alias("kind"), page.alias("page_id"), count.cast("long").alias("count"))
    known = rows.where(F.col("kind").isNotNull() | F.col("project").isNotNull())
    return filled_forward(known, ["path"], ["line_no"], ["project"]).where(F.col("kind").isNotNull())


def feedback(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType().add("_id", "string").add("comment", "string").add("category", "string").add("createdAt", "timestamp").add("page", T.StructType().add("title", "string").add("slug", "string").add("url", "string").add("docs_property", "string"))
    return spark.read.schema(schema).json(path).withColumn("docs_property", F.col("page.docs_property"))


def repo_metrics(spark: SparkSession, path: str) -> DataFrame:
    counts = "array<struct<name:string,count:bigint,uniques:bigint>>"
    rows = spark.read.schema(f"date string, owner string, repo string, clones bigint, viewCount bigint, uniqueViews bigint, stars bigint, forks bigint, watchers bigint, referralSources {counts}, topPaths {counts}").json(path)
    return rows.withColumn("date", F.to_timestamp("date"))


def with_defaults(layers: list[dict]) -> dict:
    """Configuration by precedence: later layers lie over earlier ones, key by key, nested ones too; null is no value."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = with_defaults([out[k], v])
            elif v is not None:
                out[k] = v
    return out


def resolved(value, documents: dict[str, dict], path: str = ""):
    """A configuration with every {"$ref": name} replaced by that document, whose own references count as well.

    What stands beside a reference lies over the document. A reference to a document above it is an error.
    """
    if isinstance(value, list):
        return [resolved(v, documents, path) for v in value]
    if not isinstance(value, dict):
        return value
    own = {k: resolved(v, documents, path) for k, v in value.items() if k != "$ref"}
    if "$ref" not in value:
        return own
    name = value["$ref"]
    if f"|{name}|" in path or name not in documents:
        raise ValueError(f"cannot resolve {name}")
    return with_defaults([resolved(documents[name], documents, f"{path}|{name}|"), own])


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, additions, deletions) of the stored answers of a paged query on a pull request's files."""
    node = "struct<path:string,changeType:string,additions:int,deletions:int>"
    schema = f"data struct<repository:struct<pullRequest:struct<files:struct<edges:array<struct<node:{node}>>>>>>"
    rows = spark.read.schema(schema).json(path).select(F.explode("data.repository.pullRequest.files.edges").alias("e"))
    return rows.select("e.node.path", F.lower("e.node.changeType").alias("status"), "e.node.additions", "e.node.deletions")


def summary_of(summaries_: DataFrame, collection: str) -> DataFrame:
    """(version, total_page_count, total_code_count, last_updated_at_utc) of a collection's summary, a row a version."""
    return summaries_.where(F.col("collection") == collection).select(F.explode("version").alias("version", "s")).select("version", "s.*")
