"""Page lines as a stream: each arriving file's pages are laid over the stored ones, once.

Files of page lines are a Structured Streaming source. Every micro-batch keeps the last line of each page, reads the stored
pages of the buckets that these belong to, makes of them what a run makes (new, updated, deleted pages, node by node), and
publishes those buckets as one version of a store. The version carries a mark with the batch's number, so a batch that comes
again after a crash finds itself done and changes nothing; the commit is one rename, so a crash within it leaves the version
before. Buckets without arriving pages are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.operators import cdc, ingest
from pagequarry.sources import readers
from pagequarry.sources.snapshots import Store

NODE_FIELDS = "array<struct<code:string,language:string,file_extension:string,category:string,sha_256_hash:string,llm_categorized:boolean,date_added:timestamp,date_updated:timestamp,date_removed:timestamp,is_removed:boolean,instances_on_page:bigint>>"
STORED = f"page_id string, github_username string, code_nodes_total bigint, keywords array<string>, date_added timestamp, date_last_updated timestamp, languages array<map<string,{readers.LANGUAGE_COUNTS}>>, nodes {NODE_FIELDS}"
PLACE = ["arrived", "file", "block"]


def page_lines(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """Pages of arriving files (readers.pages_of_lines) with the place of each line, in the order of arrival."""
    reader = spark.readStream.format("text")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return placed(reader.load(path))


def placed(lines: DataFrame) -> DataFrame:
    """Pages of lines read from files, with their places."""
    where = [F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    parsed = lines.select(F.from_json("value", "type string, data struct<page_id:string,github_username:string,deleted:boolean,ast:string>").alias("j"), *where).where("j.type = 'page' AND j.data.page_id IS NOT NULL")
    return parsed.select("j.data.page_id", "j.data.github_username", F.coalesce("j.data.deleted", F.lit(False)).alias("deleted"), "j.data.ast", *PLACE)


def latest(pages: DataFrame) -> DataFrame:
    """The last line of each page, by the place of its file's stretch and by the order within."""
    pages = pages.withColumn("__line", F.monotonically_increasing_id())
    held = [c for c in pages.columns if c not in ("page_id", "__line", *PLACE)]
    return pages.groupBy("page_id").agg(F.max_by(F.struct(*held), F.struct(*PLACE, "__line")).alias("p")).select("page_id", "p.*")


def laid_over(stored: DataFrame, arriving: DataFrame, at: Column) -> DataFrame:
    """Stored pages (STORED) after the pages of arriving (page_id, github_username, deleted, ast) came in; one row a page."""
    live = arriving.where(~F.col("deleted"))
    started = live.join(stored.select("page_id"), "page_id", "left_anti").select("page_id", "github_username")
    empty = {"code_nodes_total": F.lit(0).cast("long"), "keywords": F.array().cast("array<string>"), "date_added": at, "date_last_updated": at, "languages": ingest.empty_languages(), "nodes": F.array().cast(NODE_FIELDS)}
    started = started.withColumns(empty).select(*[F.col(c).cast(stored.schema[c].dataType) for c in stored.columns])
    there = stored.join(arriving.where("deleted").select("page_id"), "page_id", "left_anti").unionByName(started)
    none = F.lit(None).cast("timestamp")
    nodes = ingest.code_nodes(live.select("page_id", "ast")).withColumns({"date_added": none, "date_updated": none, "date_removed": none, "is_removed": F.lit(False), "instances_on_page": F.lit(1).cast("long")})
    made = cdc.update_pages(there, live.select("page_id", F.array().cast("array<string>").alias("keywords")), nodes, at)
    counted = ingest.languages_array(cdc.live_nodes(made.join(live.select("page_id"), "page_id", "left_semi")).select("page_id", "n.*")).withColumnRenamed("languages", "__counted")
    touched = live.select("page_id", F.lit(True).alias("__touched"))
    joined = made.join(counted, "page_id", "left").join(touched, "page_id", "left")
    return joined.withColumn("languages", F.when(F.col("__touched"), F.coalesce("__counted", ingest.empty_languages())).otherwise(F.col("languages"))).select(*stored.columns)


def upsert(batch: DataFrame, batch_id: int, store: Store, name: str, at: Column | None = None, buckets: int = 64, table: str = "pages") -> bool:
    """Lay a batch of page lines over a store's pages; False if that batch of the stream `name` has been laid already.

    buckets: into how many parts page ids are hashed; it may not change over a store's life.
    """
    spark = batch.sparkSession
    before = store.manifest()
    if before.get("marks", {}).get(name, -1) >= batch_id:
        return False
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int")
    arriving = cdc.kept(latest(batch))
    touched = {r[0] for r in arriving.select(bucket.alias("b")).distinct().collect()}  # at most `buckets` numbers
    if touched:
        stored = store.read(table, parts=touched) if table in before.get("tables", {}) else spark.createDataFrame([], STORED)
        made = laid_over(stored, arriving, at if at is not None else F.current_timestamp())
        store.publish_parts(table, made.withColumn("__bucket", bucket), "__bucket", touched, label=f"{name} {batch_id}", on=before.get("number", 0), marks={name: batch_id})
    return True


def start(pages: DataFrame, store: Store, checkpoint: str, name: str = "pages", at: Column | None = None, buckets: int = 64, once: bool = False) -> StreamingQuery:
    """Run the stream of pages (page_lines) into a store. once: take what is there and end."""
    writer = pages.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: upsert(batch, batch_id, store, name, at, buckets))
    return (writer.trigger(availableNow=True) if once else writer).start()
