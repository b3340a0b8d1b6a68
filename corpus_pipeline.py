"""A corpus pipeline of five stages: quality, near duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of docs, in their order; extra columns pass through. Rows are told apart by doc_id and text, so neither a repeated nor a
null id drags other texts along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import decontamination, mixing, near_dedup, quality_model, sharding
from pagequarry.llm.common import read_table, stage

#: Lists of ids up to this length, counted first, are broadcast; longer ones are joined by shuffling.
MAX_BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and hash of the text are in rows (doc_id, text_hash)."""
    gone = stage(rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "pipeline-gone")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    return docs.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone, same, "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, gives THRESHOLD or more."""
    weights = quality_model.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_model.score(docs, weights, into="__score").where(F.col("__score") >= quality_model.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one of the smallest doc_id, once."""
    return near_dedup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without(docs, decontamination.matches(docs, read_table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.max("copies").alias("__copies"))
    copies = stage(copies.where("__copies <> 1"), "pipeline-copies")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    joined = docs.join(F.broadcast(copies) if copies.count() <= MAX_BROADCAST_IDS else copies, same, "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    return joined.where(F.col("__copies") > 0).withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, source, lang, shard and slot of every row."""
    return sharding.place(docs, carry=tuple(c for c in ("source", "lang") if c in docs.columns))


STAGES = [("quality classifier", keep_quality), ("near duplicates", drop_near_duplicates), ("benchmark decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", shard)]

#: The stages train a model and iterate; SQL can't express them. tests/llm hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
