"""A substring index: three-byte pieces of texts with the texts that hold them, written once, asked often.

The folder holds `grams` (gram, id: a row a piece and text, sorted, so that Parquet's statistics skip what isn't asked for),
`counts` (gram, n) and `texts` (id, content, in blocks by hash of the id). A search takes the needle's rarest pieces, meets
their texts by counting, reads the blocks that hold these, and tests the needle on whole contents as a plain search does. So
the rows are those of a plain search, and only a fraction of the texts is read. Pieces are of ASCII characters of lower-cased
texts; a needle with no three such characters in a row finds no help in the index and reads all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions import scalars as S
from pagequarry.operators.ranks import kept

#: The rarest pieces of a needle that are met.
PIECES = 6
#: Texts found by pieces up to this number, counted first, are broadcast.
MAX_BROADCAST = 1_000_000


def grams_of(text: bytes) -> np.ndarray:
    """Distinct runs of three ASCII bytes, each as one number."""
    x = np.frombuffer(text, dtype=np.uint8).astype(np.int32)
    if len(x) < 3:
        return np.empty(0, dtype=np.int32)
    plain = (x[:-2] < 128) & (x[1:-1] < 128) & (x[2:] < 128)
    return np.unique((x[:-2] << 14 | x[1:-1] << 7 | x[2:])[plain])


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def candidates(self, needle: str) -> DataFrame | None:
        """(id) of the texts that hold the needle's rarest pieces; None if it has no piece."""
        wanted = grams_of(needle.lower().encode()).tolist()
        if not wanted:
            return None
        read = lambda name: self.spark.read.parquet(f"{self.path}/{name}")
        found = read("counts").where(F.col("gram").isin(wanted)).orderBy("n", "gram").limit(PIECES).collect()
        known = read("counts").where(F.col("gram").isin(wanted)).count()
        if known < len(wanted):
            return read("grams").select("id").limit(0)
        rarest = [r["gram"] for r in found]
        met = read("grams").where(F.col("gram").isin(rarest)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        return met.where(F.col("n") == len(rarest)).select("id")

    def near(self, needle: str) -> DataFrame:
        """The texts that may hold the needle, read from their blocks alone."""
        ids = self.candidates(needle)
        if ids is None:
            return self.texts()
        n_blocks = self.spark.read.parquet(f"{self.path}/blocks").first()[0]
        placed = kept(ids.select("id", block_of(F.col("id"), n_blocks).alias("block")))
        blocks = [r[0] for r in placed.select("block").distinct().collect()]  # at most n_blocks numbers
        texts = self.texts().where(F.col("block").isin(blocks))
        return texts.join(F.broadcast(placed.select("id")) if placed.count() <= MAX_BROADCAST else placed.select("id"), "id", "left_semi")

    def search(self, needle: str, whole: bool = True, ignore_case: bool = True) -> DataFrame:
        """(id, content) of the texts that hold the needle, as paths.search finds it."""
        hit = S.whole_word(F.col("content"), needle, ignore_case) if whole else S.part_of(F.col("content"), needle, ignore_case)
        return self.near(needle).where(hit).select("id", "content")


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def write(files: DataFrame, path: str, blocks: int = 1024) -> Index:
    """Index files (id, content; ids are unique); a null content holds nothing."""
    spark, path = files.sparkSession, path.rstrip("/")
    files.select("id", "content", block_of(F.col("id"), blocks).alias("block")).repartition("block").write.partitionBy("block").parquet(f"{path}/texts")
    spark.range(1).select(F.lit(blocks).alias("blocks")).write.parquet(f"{path}/blocks")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([grams_of(t.encode()) if t else [] for t in part])

    rows = spark.read.parquet(f"{path}/texts").select("id", F.explode(pieces(F.lower("content"))).alias("gram"))
    rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").select("gram", "id").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/grams")
    spark.read.parquet(f"{path}/grams").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return Index(spark, path)
