"""Numbering of rows within groups of any size, and cutting of lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_cleared: set[str] = set()


def _clear_at_end(spark: SparkSession, folder: str) -> str:
    if folder not in _cleared:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _cleared.add(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, deleted when the driver ends; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not named:
        import tempfile

        named = f"file://{tempfile.gettempdir()}"
    return _clear_at_end(spark, f"{named.rstrip('/')}/pagequarry-tables-{sc.applicationId}")


def kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut, by a checkpoint in a folder of the application's own that is deleted when the driver ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(own_folder(spark))
    _clear_at_end(spark, sc.getCheckpointDir())
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """df written as compressed Parquet into the application's own folder and read back: kept, in less space."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list[str], order: list[str], into: str = "rank") -> DataFrame:
    """df with the rank (from 0) of each row among those of equal keys, by the columns of order.

    All rows are sorted by ranges, so a group larger than a task spans several; what each holds of a group is counted, and
    the counts of earlier ranges are added. keys may be empty.
    """
    by = [*keys, *order]
    rows = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    held = rows.groupBy("__part", *keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__part")  # a row a range that the group spans
    named = {k: f"__own_{k}" for k in ("__part", *keys)}
    before = held.withColumn("__before", F.sum("__n").over(w) - F.col("__n")).withColumnsRenamed(named).drop("__n")
    same = [F.col(k).eqNullSafe(F.col(own)) for k, own in named.items()]
    joined = rows.join(before, same).drop(*named.values())
    return joined.withColumn(into, F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before")


def filled_forward(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """df with each null of `values` replaced by the last value before it among rows of equal keys, in the columns of order.

    A scan in two passes, so that one key's rows spread over many tasks: rows are dealt to ranges of keys and order; each
    range fills what it can and says what it leaves behind, a row a range and key; what a range leaves is carried into later
    ranges of its key, to where they have no value yet. order should tell rows of a key apart; ties are filled in any order.
    Where there is no value before, null stays. keys may be empty, and null is a key like others.
    """
    by = [*keys, *order]
    rows = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    left = rows.groupBy("__part", *keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("__at"))).alias(f"__left_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    named = {k: f"__own_{k}" for k in ("__part", *keys)}
    carried = left.withColumns({f"__in_{v}": F.last(f"__left_{v}", ignorenulls=True).over(earlier) for v in values}).withColumnsRenamed(named)
    inside = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)  # rows of one range
    own = rows.withColumns({v: F.last(v, ignorenulls=True).over(inside) for v in values})
    joined = own.join(carried, [F.col(k).eqNullSafe(F.col(name)) for k, name in named.items()])
    return joined.withColumns({v: F.coalesce(v, F.col(f"__in_{v}")) for v in values}).select(*df.columns)
