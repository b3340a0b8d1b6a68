"""Helpers that the operators of this subpackage share: staging tables, word splitting, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Java and Python pattern for a run of them.
BLANK_RUN = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share; deleted when the driver ends.

    Where the session names none, a temporary folder serves in local mode; on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{named.rstrip('/')}/pagequarry-{app}" if named else "file://" + tempfile.mkdtemp(prefix="pagequarry-")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _own_dirs[app] = folder
    return _own_dirs[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return the table read back, so that lineage ends there.

    Unlike a cached or locally checkpointed frame, it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, many: str, total: int, how: str = "inner", hot: int = 1000) -> DataFrame:
    """left joined with right, which has a row a key and in `many` the number of rows that left has of it, of `total`.

    Keys with total / hot rows or more, of which there can be `hot` at most, are broadcast, so none lands in one task.
    how: inner or left.
    """
    is_hot = F.col(many) * hot >= max(1, total)
    few, rest = right.where(is_hot).drop(many), right.where(~is_hot).drop(many)
    with_hot = left.join(F.broadcast(few), key)
    without = left.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key, how)
    return with_hot.unionByName(without)


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """df with a gapless number from 0 in the order of its columns `order`.

    Rows are dealt to ranges and numbered there; only the rows counted in each range, a row a task, reach the driver.
    """
    sort = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, counts, before = F.shiftright("__at", 33), [], 0
    for r in sort.groupBy(part.alias("part")).count().orderBy("part").collect():
        counts.append((r["part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(counts, "__part long, __before long")
    inside = F.col("__at") - F.shiftleft(part, 33)
    return sort.join(F.broadcast(starts), part == F.col("__part")).withColumn(into, F.col("__before") + inside).drop("__at", "__part", "__before")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text: maximal runs without blanks. Empty for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def n_words_of(text: Column) -> Column:
    """Number of words as a long, without making the array of words: blanks that a non-blank follows, plus one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK_RUN))).cast("long")


# --- words in numpy ---------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(64, _P, dtype=np.uint64))
CHUNK_BYTES = 500_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(2 * n, _P, dtype=np.uint64))
    return _powers


#: Shape of each byte: letters, capitals and digits by class (bytes beyond ASCII count as letters), signs as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def word_hashes(texts: list[str | None], lower: bool, shape: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and len(texts)+1 offsets: text i has words offsets[i]:offsets[i+1].

    lower: A-Z count as a-z. shape: words are told apart by their shapes only, runs of one class being one. A null text
    has no words.
    """
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs))
    buf = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)
    ends_of_texts = np.cumsum(sizes)
    blank = _SPACE[buf]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(blobs) + 1, dtype=np.int64)
    if lower:
        buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
    lengths, kept = ends - starts, ~blank
    if shape:
        buf = _SHAPE[buf]
        kept[1:] &= buf[1:] != buf[:-1]
        lengths = np.add.reduceat(kept.astype(np.int64), starts)
    powers = _power_table(int(lengths.max()))
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    values = (buf[kept].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = mix(np.add.reduceat(values, first))
    offsets = np.concatenate(([0], np.searchsorted(starts, ends_of_texts, side="left"))).astype(np.int64)
    return hashes, offsets


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters each; a longer text is a range of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


_SEEDS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; order counts. Empty with fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(m, n, dtype=np.uint64)
    for i in range(n):
        total = mix(total + words[i : i + m] * _SEEDS[i % len(_SEEDS)])
    return total
